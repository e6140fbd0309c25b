"""Substring deduplication by super-k-mer partitioning of word windows.

A window is `window` consecutive words; its minimiser is the smallest hash among its runs of `gram` words.  Consecutive
windows with the same minimiser are one super-k-mer.

1. Each text gives its super-k-mers as (minimiser, doc, start, count).  Sorted by minimiser, those whose minimiser comes
   once are done: equal windows have equal minimisers, so theirs are unique.  (A super-k-mer of periodic words stays.)
2. The rest travel as one packed string each to the bucket of their minimiser.  There they come sorted by document and
   start, and each of their windows is compared as text with those before it: the first stays, later ones are listed.
   A minimiser of more than `hot` super-k-mers sends windows one by one to buckets by their own hash, so that no bucket
   has to know more than `hot` super-k-mers; equal windows of one task are settled before they travel.  The most frequent
   minimisers of some `sample` documents are taken so from the start, and their super-k-mers are dealt out by document.
3. The listed runs return to their documents, and the words that they cover are removed.

Edge cases: a null text has no words; texts shorter than a window lose nothing; windows are judged on the input; equal texts
lose all from the second on; rows without an id lose nothing; of rows that share one, equal starts are no earlier than each
other, so equal rows don't cut each other; an empty table gives no rows; further columns are ignored; ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from hydroframe.llm.common import arrow_map, in_slices, table
from hydroframe.llm.hashing import mix, run_hashes, sliding_min, word_hashes

#: `tag` tells rows that share an id apart: half of their text's hash.  `salt` is 0 but for rows under a common minimiser.
PLACES = "key long, salt int, doc_id long, tag int, start int, count int, again boolean"
NAMES = ["key", "salt", "doc_id", "tag", "start", "count", "again"]


def super_kmers(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Minimisers, first windows and numbers of windows; and whether a window may repeat within one super-k-mer."""
    grams = run_hashes(words, gram)
    span = window - gram + 1
    low = sliding_min(grams, span)
    starts = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    periodic = any((grams[d:] == grams[:-d]).any() for d in range(1, min(span, grams.size - 1) + 1))
    return low[starts].view(np.int64), starts, np.diff(np.concatenate((starts, [low.size]))), periodic


def places(docs: DataFrame, window: int, gram: int, common: np.ndarray | None = None) -> DataFrame:
    """The super-k-mers of each row; those under the `common` minimisers (sorted) are marked by `again` and a salt."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, 512):
            made = []
            for doc, tag, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = word_hashes((text or "").encode())
                if words.size >= window:
                    keys, starts, counts, periodic = super_kmers(words, window, gram)
                    again, salt = np.full(keys.size, periodic), np.zeros(keys.size, dtype=np.int32)
                    if common is not None and common.size:
                        hot = common[np.minimum(np.searchsorted(common, keys), common.size - 1)] == keys
                        again |= hot
                        salt[hot] = 1 + (doc & 0xFFFF)
                    made.append((keys, salt, np.full(keys.size, doc), np.full(keys.size, tag, dtype=np.int32), starts.astype(np.int32), counts.astype(np.int32), again))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names=NAMES)

    return arrow_map(docs.select("doc_id", "tag", "text"), work, PLACES)


def common_minimisers(docs: DataFrame, window: int, gram: int, rows: int, at_least: int, most: int = 10_000) -> np.ndarray:
    """Minimisers that come `at_least` times among about `rows` rows, the `most` frequent of them.

    Which they are changes how rows travel and no result: a minimiser's rows all take the one way or the other.
    """
    some = docs.sample(min(1.0, rows / max(1, docs.count())), seed=1)
    found = places(some, window, gram).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    return np.sort(np.array([r["key"] for r in found.orderBy(F.desc("n"), "key").limit(most).collect()], dtype=np.int64))


def shared(found: DataFrame, hot: int) -> DataFrame:
    """Of rows that come sorted by key, those whose key others have too; `again` becomes: its key is hot."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot_key = None, None

        def emit(cols: list[np.ndarray], open_end: bool):
            """Rows to send, and those of the last key if more of them may come."""
            nonlocal hot_key
            keys = cols[0]
            starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
            sizes = np.diff(np.concatenate((starts, [keys.size])))
            is_hot = (sizes > hot) | (cols[1][starts] > 0) | ((keys[starts] == hot_key) if hot_key is not None else False)
            rest = None
            if open_end:
                if is_hot[-1]:
                    hot_key = keys[-1]
                else:
                    rest = [c[starts[-1] :] for c in cols]
            keep = np.repeat(sizes > 1, sizes) | np.repeat(is_hot, sizes) | cols[6]
            if rest is not None:
                keep[starts[-1] :] = False
            sent = [c[keep] for c in cols[:6]] + [np.repeat(is_hot, sizes)[keep]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in sent], names=NAMES), rest

        for part in batches:
            if part.num_rows:
                cols = [c.to_numpy(zero_copy_only=False) for c in part.columns]
                if held is not None:
                    cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
                out, held = emit(cols, True)
                if out.num_rows:
                    yield out
        if held is not None:
            yield emit(held, False)[0]

    return arrow_map(found.repartition("key", "salt").sortWithinPartitions("key"), work, PLACES)


def packed(docs: DataFrame, window: int, settle: int = 100_000) -> DataFrame:
    """Packed strings by bucket, from texts with the list of their shared super-k-mers; rows without words are settled repeats."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple[int, int, int]] = {}
        names = ["key", "doc_id", "tag", "start", "count", "words"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def of_window(text: bytes, at: tuple[int, int, int]) -> tuple:
            doc, start, tag = at
            return int(mix(run_hashes(word_hashes(text), window)).view(np.int64)[0]), doc, tag, start, 1, text

        for part in in_slices(batches, 128):
            rows = []
            for doc, tag, text, found in zip(*(part.column(c).to_pylist() for c in ("doc_id", "tag", "text", "found")), strict=True):
                words = (text or "").encode().split()
                for f in found:
                    start, count = f["start"], f["count"]
                    if not f["again"]:
                        rows.append((f["key"], doc, tag, start, count, b" ".join(words[start : start + count + window - 1])))
                        continue
                    for s in range(start, start + count):
                        one, here = b" ".join(words[s : s + window]), (doc, s, tag)
                        before = first.setdefault(one, here)
                        if before[:2] < here[:2]:
                            rows.append((hash(here), doc, tag, s, 1, None))
                        elif here[:2] < before[:2]:
                            first[one] = here
                            rows.append((hash(before), before[0], before[2], before[1], 1, None))
                        elif here != before:  # rows that share an id: neither comes before the other
                            rows.append(of_window(one, here))
            if len(first) > settle:
                rows += [of_window(one, at) for one, at in first.items()]
                first.clear()
            for at in range(0, len(rows), 20_000):
                yield batch(rows[at : at + 20_000])
        rows = [of_window(one, at) for one, at in first.items()]
        for at in range(0, len(rows), 20_000):
            yield batch(rows[at : at + 20_000])

    return arrow_map(docs, work, "key long, doc_id long, tag int, start int, count int, words binary")


def repeats(strings: DataFrame, window: int) -> DataFrame:
    """doc_id, tag, start, count of runs of windows that came before, from packed strings sorted by bucket, document and start."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, {}
        for part in batches:
            rows = []
            for key, doc, tag, start, count, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if text is None:  # settled before
                    rows.append((doc, tag, start, count))
                    continue
                if key != last:
                    last, seen = key, {}
                ends = list(accumulate(map(len, text.split(b" ")), lambda a, n: a + n + 1, initial=-1))
                run = 0
                for k in range(count):
                    here = (doc, start + k)
                    if seen.setdefault(text[ends[k] + 1 : ends[k + window]], here) < here:
                        run += 1
                    elif run:
                        rows.append((doc, tag, start + k - run, run))
                        run = 0
                if run:
                    rows.append((doc, tag, start + count - run, run))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "tag", "start", "count"])

    return arrow_map(strings.repartition("key").sortWithinPartitions("key", "doc_id", "start"), work, "doc_id long, tag int, start int, count int")


def cut(docs: DataFrame, window: int) -> DataFrame:
    """From rows of a text, the runs found in it and any `carried` column: n_words, n_removed, kept."""
    columns = [f for f in docs.schema if f.name not in ("found", "text" if "carried" not in docs.columns else "")]
    schema = StructType([*columns, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, 256):
            sizes, removed, kept = [], [], []
            for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist(), strict=True):
                words = (text or "").encode().split()
                sizes.append(len(words))
                if found:
                    gone = np.zeros(len(words), dtype=bool)
                    for f in found:
                        gone[f["start"] : f["start"] + f["count"] + window - 1] = True
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                removed.append(sizes[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in columns), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    return docs.mapInArrow(work, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 6, hot: int = 20_000, sample: int = 10_000, at_least: int = 64, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by single spaces) for each row.

    With `carry`, also the text and a struct `carried` of these columns: they travel with the text, which spares a join.
    """
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)
    rows = rows.withColumn("tag", F.shiftright(F.xxhash64("text"), 32).cast("int"))
    used = ["doc_id", "tag", "text"] + ["carried"] * bool(more)
    # Both joins read the same columns by the same keys, so the texts are shuffled once (ReusedExchange).  Aliases with
    # metadata are never optimised away on one side only, which would hide from Spark that the two are the same.
    known = rows.where("doc_id is not null").select(*[F.col(c).alias(c, metadata={"role": c}) for c in used])
    found = shared(places(known, window, gram, common_minimisers(known, window, gram, sample, at_least)), hot)
    lists = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("key", "start", "count", "again")).alias("found"))
    strings = packed(known.join(lists, ["doc_id", "tag"]), window)
    cuts = repeats(strings, window).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "count")).alias("found"))
    nothing = F.lit(None).cast("array<struct<start:int,count:int>>").alias("found")
    known, rest = known.join(cuts, ["doc_id", "tag"], "left").select(*used, "found"), rows.where("doc_id is null").select(*used, nothing)
    return cut(known.union(rest).drop("tag"), window)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS t FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS p FROM r),
g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
o AS (SELECT w.doc_id, w.ws, g.ps FROM w LEFT JOIN g USING (doc_id)),
z AS (SELECT o.doc_id, u.p, o.ws[u.p] AS word FROM o, unnest(range(1, len(o.ws) + 1)) AS u(p)),
y AS (SELECT z.doc_id, string_agg(z.word, ' ' ORDER BY z.p) AS kept FROM z ANTI JOIN c ON z.doc_id = c.doc_id AND z.p = c.p GROUP BY z.doc_id)
SELECT o.doc_id, len(o.ws)::BIGINT AS n_words, coalesce(len(o.ps), 0)::BIGINT AS n_removed, sha256(coalesce(y.kept, '')) AS kept_sha256
FROM o LEFT JOIN y ON o.doc_id = y.doc_id
"""
