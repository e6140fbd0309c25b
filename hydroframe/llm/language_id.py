"""Language identification by string kernels.

The kernel of two texts is the number of different character n-grams (n = 1..3, over lower-cased letters, all else being
one separator) that both hold, over the root of the product of their numbers: a blended-spectrum presence kernel.  With
landmarks L from the training rows, Nystroem features are K(x, L) K(L, L)^-1/2, and one ridge regression for each
language against the rest is fitted on them.  As the kernel is an inner product of presence vectors, landmarks and weights fold
into one matrix (n-grams of the landmarks x languages); a batch of texts is scored by one matrix product.

Training rows are a bounded sample: of each language the `per_language` different texts with the smallest hashes among those of
at most `max_train_bytes`, fewer if there are many languages (`max_train_rows` in all).  Scoring takes every row's whole text.
Letters are told apart if they are among the most frequent ones of any language, each language giving as many as the next.

Edge cases: a null text and one without a letter (Unicode category L) are `und` with score 0; a text is scored whole whatever
its length; equal texts get equal results; without any training row every row is `und`; an empty table gives no rows; rows
without an id are scored like others, ids may be of any type; further columns are ignored, or kept by `with_language`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from hydroframe.llm.common import in_slices, table

SIZE = 128  #: classes of characters: separator, rare letter, and the most frequent letters
GRAMS = SIZE + SIZE**2 + SIZE**3


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Grams:
    """The n-grams of a text as numbers below GRAMS."""

    def __init__(self, letters: list[str]):
        self.letters = letters
        self.place = {ord(c): k + 2 for k, c in enumerate(letters)}
        self.low = np.zeros(0x3000, dtype=np.int32)
        for c in range(0x3000):
            self.low[c] = self.place.get(c, 1 if chr(c).isalpha() else 0)

    def all(self, text: str) -> np.ndarray:
        """Those of each place, in no order and with repeats."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if points.size and points.max() >= 0x3000:
            high = points >= 0x3000
            x = self.low[np.where(high, 0, points)]
            x[high] = [self.place.get(int(p), 1 if chr(p).isalpha() else 0) for p in points[high]]
        else:
            x = self.low[points]
        x = np.concatenate(([0], x, [0]))
        keep = np.ones(x.size, dtype=bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
        x = x[keep]
        two = x[:-1] * SIZE + x[1:]
        return np.concatenate((x, SIZE + two, SIZE + SIZE**2 + two[:-1] * SIZE + x[2:]))

    def __call__(self, text: str) -> np.ndarray:
        return np.unique(self.all(text))


def frequent_letters(rows: list[tuple[str, str]]) -> list[str]:
    """The most frequent letters of each language in turn, SIZE - 2 in all."""
    counts: dict[str, Counter] = {}
    for text, lang in rows:
        counts.setdefault(lang, Counter()).update(c for c in text.lower() if c.isalpha())
    ranks = [[c for c, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))] for lang in sorted(counts)]
    return list(dict.fromkeys(c for rank in zip_longest(*ranks) for c in rank if c))[: SIZE - 2]


class Model:
    """Languages, letters, the landmarks' n-grams, and the matrix of their weights."""

    def __init__(self, rows: list[tuple[str, str]], landmarks: int = 32, ridge: float = 1e-2):
        self.letters = frequent_letters(rows)
        self.languages = sorted({lang for _, lang in rows})
        grams = Grams(self.letters)
        sets = [grams(text) for text, _ in rows]
        places = {lang: [i for i, (_, x) in enumerate(rows) if x == lang] for lang in self.languages}
        marks = [i for lang in self.languages for i in sorted(places[lang], key=lambda i: -min(sets[i].size, 800))[:landmarks]]
        self.used = np.unique(np.concatenate([sets[i] for i in marks]))
        unit = lambda which: self._presence([sets[i] for i in which]) / np.sqrt([[sets[i].size] for i in which])
        mark_rows = unit(marks)
        inner = mark_rows @ mark_rows.T
        values, vectors = np.linalg.eigh(inner)
        root = vectors / np.sqrt(np.maximum(values, 1e-9)) @ vectors.T
        phi = np.concatenate([unit(range(at, min(at + 256, len(rows)))) @ mark_rows.T for at in range(0, len(rows), 256)]) @ root
        phi = np.column_stack([phi, np.ones(len(rows))])
        sides = np.where([[x == lang for lang in self.languages] for _, x in rows], 1.0, -1.0)
        beta = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ sides)
        self.weights = (mark_rows.T @ (root @ beta[:-1])).astype(np.float32)
        self.offset = beta[-1].astype(np.float32)

    def _presence(self, sets: list[np.ndarray]) -> np.ndarray:
        slot = np.full(GRAMS, -1, dtype=np.int32)
        slot[self.used] = np.arange(self.used.size)
        return presence(sets, slot, self.used.size)


def presence(sets: list[np.ndarray], slot: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(sets), width), dtype=np.float32)
    for row, found in zip(out, sets, strict=True):
        at = slot[found]
        row[at[at >= 0]] = 1
    return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 300, max_train_rows: int = 4000, max_train_bytes: int = 20_000, max_languages: int = 256, landmarks: int = 32) -> Model | None:
    """A model of the languages in `labelled`; None without a usable row."""
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(r"lang is not null and octet_length(text) <= {} and text rlike '\\p{{L}}'".format(max_train_bytes))
    first = W.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    rows = rows.withColumn("h", F.xxhash64("text"))
    # Hashes first, so that copies count once and only texts of the sample travel; in two steps, as a language may hold most rows.
    low = rows.select("lang", "h").distinct()
    for part in (["lang", F.pmod("h", F.lit(64))], ["lang"]):
        low = low.withColumn("n", F.row_number().over(W.partitionBy(*part).orderBy("h"))).where(F.col("n") <= per_language)
    low = low.orderBy("n", "lang").limit(max_train_rows).select("lang", "h")
    rows = rows.join(F.broadcast(low), ["lang", "h"]).select("lang", "text").distinct()
    some = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).orderBy("n", "lang").limit(max_train_rows).collect()
    if len({r["lang"] for r in some}) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    seen = sorted({(r["text"], r["lang"]) for r in some})
    return Model(seen, landmarks) if seen else None


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of each row, and the language predicted with its score, from 0 to 1."""
    parts = None if model is None else (model.letters, model.languages, model.used, model.weights, model.offset)
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(lang_out, StringType()), StructField(score_out, DoubleType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts is not None:
            letters, languages, used, weights, offset = parts
            grams, seen = Grams(letters), np.zeros(GRAMS, dtype=bool)
        for part in in_slices(batches, 128):
            texts = part.column(at).to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            open_rows = [i for i, t in enumerate(texts) if parts is not None and t and has_letter(t)]
            if open_rows:
                held, norm = np.empty((len(open_rows), used.size), dtype=np.float32), np.empty((len(open_rows), 1), dtype=np.float32)
                for row, size, i in zip(held, norm, open_rows, strict=True):
                    found = grams.all(texts[i])
                    seen[found] = True
                    row[:], size[:] = seen[used], np.sqrt(np.count_nonzero(seen))
                    seen[found] = False
                got = held @ weights / norm + offset
                for i, best, row in zip(open_rows, got.argmax(axis=1), got, strict=True):
                    names[i], scores[i] = languages[best], float(min(1.0, max(0.0, (row[best] + 1) / 2)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in schema])

    return docs.mapInArrow(work, schema)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return with_language(rows, model).drop("text")


def fold():
    return F.crc32(F.col("doc_id").cast("string")) % 3


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold() != 1))
    return identify(docs, model).select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score")
