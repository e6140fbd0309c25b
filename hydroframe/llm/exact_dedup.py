"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so: at the first sentence end or line end that follows `chunk` characters, or at
most at eight times that length.  Chunks get 64-bit fingerprints.  The distinct (fingerprint, chunk) pairs are the only
text that is shuffled, each once for each task that reads it, and they verify the fingerprints: a fingerprint that
stands for two different chunks is listed, and its chunks are numbered.  A document's recipe is the ordered list of its
chunks' fingerprints, with those numbers where they are needed; two texts are equal exactly when their recipes are.
Groups are then formed and joined on recipes, a few bytes for each chunk, so long documents don't move again.  Groups are
counted before the shuffle, and the join that brings the result back to a large group's rows can be split by AQE.

Edge cases: a null text counts as empty, and all empty texts are one group; a text without any sentence end is cut by
length; rows with the same id and equal texts are alike in the result, and all are marked kept if theirs is the largest id;
rows without an id count in their group and go if any of it has one, else keep_id is null and all are marked kept; an
empty table gives no rows; further columns are ignored; ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.common import checkpoint, id_text, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; the quick way is open to texts without other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def chunks(text: Column, chunk: int) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{chunk},{8 * chunk}}}?(?:[.!?]\s|\n)|.{{1,{8 * chunk}}}"), F.lit(0))


def fingerprint(chunk: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits)


def recipes(docs: DataFrame, chunk: int = 256, bits: int = 64) -> DataFrame:
    """doc_id, text and `recipe`, an array of (fingerprint, number) that is equal for equal texts only.

    `bits` shortens the fingerprints, to exercise their verification.
    """
    cut = docs.withColumn("chunks", chunks(F.col("text"), chunk))
    seen = cut.select(F.explode("chunks").alias("chunk")).withColumn("fp", fingerprint(F.col("chunk"), bits)).groupBy("fp", "chunk").agg(F.lit(1).alias("one"))
    shared = seen.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    plain = cut.withColumn("recipe", F.transform("chunks", lambda c: F.struct(fingerprint(c, bits).alias("fp"), F.lit(0).alias("number"))))
    if shared.isEmpty():
        return plain.select("doc_id", "text", "recipe")
    # Chunks under a shared fingerprint are numbered by their content; the documents that hold one get the numbers.
    rank = seen.join(shared, "fp", "left_semi").groupBy("fp").agg(F.sort_array(F.collect_list("chunk")).alias("apart"))
    rows = checkpoint(cut.withColumn("uid", F.monotonically_increasing_id()))  # else each use may number the rows anew
    held = rows.select("uid", F.posexplode("chunks").alias("pos", "chunk")).withColumn("fp", fingerprint(F.col("chunk"), bits))
    numbered = held.join(rank, "fp", "left").withColumn("number", F.coalesce(F.array_position("apart", F.col("chunk")).cast("int"), F.lit(0)))
    made = numbered.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", "fp", "number"))).alias("r")).select("uid", F.transform("r", lambda x: F.struct(x["fp"].alias("fp"), x["number"].alias("number"))).alias("recipe"))
    empty = F.array().cast("array<struct<fp:bigint,number:int>>")
    return rows.join(made, "uid", "left").select("doc_id", "text", F.coalesce("recipe", empty).alias("recipe"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = 256, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text) for each row."""
    rows = id_text(docs, id_col, text_col).withColumn("text", lower_ascii(F.coalesce("text", F.lit(""))))
    made = recipes(rows, chunk, bits).select("doc_id", "recipe", F.sha2("text", 256).alias("text_sha256"))
    groups = made.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return made.join(groups, "recipe").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""
