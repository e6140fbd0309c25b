"""The corpus pipeline: language ID, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the last return the columns
of `documents`.  Rows without an id are no duplicates by id: of equal texts without any id one stays, and near duplicates and
repeated passages are not looked for among them.  Rows that share an id are told apart by their texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydroframe.llm import exact_dedup, language_id, near_dedup, packing, substring_dedup
from hydroframe.llm.common import shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter (`und`) go; others stay, also those that no language's classifier is sure of."""
    found = language_id.with_language(docs, language_id.fit(docs), lang_out="__lang", score_out="__score")
    return found.where("__lang <> 'und'").select(*docs.columns)


def rows_of(docs: DataFrame, digest: Column, kept: DataFrame, of_kept: str) -> DataFrame:
    """The rows whose id and digest are among those kept, with both as __id and __digest."""
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__digest": digest})
    kept = kept.select(F.col("doc_id").alias("__kept_id"), F.col(of_kept).alias("__kept_digest"))
    return keyed.join(kept, F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__digest") == F.col("__kept_digest")), "left_semi")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased), the one with the largest doc_id stays; of several such rows, one."""
    kept = exact_dedup.exact_groups(docs).where("kept")
    same = F.sha2(exact_dedup.lower_ascii(F.coalesce("text", F.lit(""))), 256)
    order = W.partitionBy("__id", "__digest").orderBy(F.xxhash64(*docs.columns))
    return rows_of(docs, same, kept, "text_sha256").withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the one with the smallest doc_id stays."""
    kept = near_dedup.near_groups(docs).where("kept")
    return rows_of(docs, F.xxhash64(F.col("text").cast("string")), kept, "text_hash").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 that came before go; a document that loses none keeps its text, one that loses all goes."""
    done = substring_dedup.remove_repeats(docs, carry=[c for c in docs.columns if c != "text"]).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col("carried.n_chars"))}
    return done.select(*[(changed[c].cast(docs.schema[c].dataType) if c in changed else F.col(f"carried.{c}")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.query(docs)


STAGES = [("language_id", known_language), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substrings), ("packing", packed)]

#: SQL can't express the first stage; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
