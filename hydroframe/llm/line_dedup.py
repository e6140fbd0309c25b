"""Line deduplication by winnowing, with DataFrame functions only.

1. The lines of a text that hold a word are hashed in order.  Of each window of `run` hashes the smallest is selected (of
   equals the last), so any run of at least `run` lines that occurs twice has a selected line in common, at the same place in
   it.  Only the selected positions travel, each with the `run - 1` hashes on either side of it.
2. Positions are joined on their hash with the hashes that have more than one position; those are counted before the shuffle.
3. Matches are extended both ways over the hashes around them: to the windows of `run` lines which selected the position.
   Of equal windows (all their 64-bit hashes) the first one stays (smallest doc_id, then place), and the lines of the later
   ones are deleted; windows side by side make up longer runs.  Occurrences are joined to their first one only, never with
   each other, so a common line costs as much as a rare one, and AQE can split the join where a window has very many rows.

Edge cases: null and empty texts have no lines and lose nothing; texts shorter than `run` lines lose nothing; lines without
a word are no part of a run and stay; equal texts lose all runs from the second on; rows without an id lose nothing; of rows
that share one, equal places are no earlier than each other, so equal rows don't cut each other; an empty table gives no
rows; further columns are ignored; ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.common import id_text, table

WITH_WORD = r"filter(transform(lines, (l, i) -> if(l rlike '[^\\x20\\x09-\\x0D]', i, null)), i -> i is not null)"


def picked(start: str, hashes: str, run: int) -> str:
    """SQL of the position that the window of `run` hashes from `start` on selects."""
    return f"cast({start} + {run} - array_position(reverse({hashes}), array_min({hashes})) as int)"


def positions(rows: DataFrame, run: int) -> DataFrame:
    """fp, doc_id, tag, pos, and the hashes `around` the position from line `low` on, for each selected position."""
    rows = rows.withColumn("lines", F.split("text", "\n")).withColumn("places", F.expr(WITH_WORD))
    rows = rows.select("doc_id", "tag", F.expr("transform(places, i -> xxhash64(lines[i]))").alias("hashes"))
    chosen = f"array_distinct(transform(sequence(0, size(hashes) - {run}), s -> {picked('s', f'slice(hashes, s + 1, {run})', run)}))"
    chosen = f"if(size(hashes) < {run}, cast(array() as array<int>), {chosen})"
    rows = rows.select("doc_id", "tag", "hashes", F.explode(F.expr(chosen)).alias("pos")).withColumn("low", F.greatest(F.col("pos") - (run - 1), F.lit(0)))
    return rows.select(F.expr("hashes[pos]").alias("fp"), "doc_id", "tag", "pos", "low", F.expr(f"slice(hashes, low + 1, pos + {run} - low)").alias("around"))


def extended(met: DataFrame, run: int) -> DataFrame:
    """doc_id, tag, start, hashes for each window that selected a position."""
    starts = f"sequence(low, least(pos, low + size(around) - {run}))"
    found = met.select("doc_id", "tag", "pos", "low", "around", F.explode(F.expr(starts)).alias("start")).withColumn("hashes", F.expr(f"slice(around, start - low + 1, {run})"))
    return found.where(F.expr(f"{picked('start', 'hashes', run)} = pos")).select("doc_id", "tag", "start", "hashes")


def repeated_lines(rows: DataFrame, run: int) -> DataFrame:
    """doc_id, tag and the numbers (among lines with a word) of the lines to delete, for each document that loses any."""
    found = positions(rows.where("doc_id is not null"), run)
    place = F.struct("doc_id", "tag", "pos")
    common = found.groupBy("fp").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("fp")
    windows = extended(found.join(common, "fp", "left_semi"), run)
    first = windows.groupBy("hashes").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    later = windows.join(first, "hashes").where(F.struct("doc_id", "start") > F.col("first"))
    lines = later.select("doc_id", "tag", F.explode(F.sequence("start", F.col("start") + (run - 1))).alias("line"))
    return lines.groupBy("doc_id", "tag").agg(F.collect_set("line").alias("gone"))


def without(lines: Column, gone: Column) -> Column:
    """The lines that stay, joined."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 2) -> DataFrame:
    """doc_id, n_lines (all lines), n_removed, kept (the text without the deleted lines) for each row."""
    rows = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tag", F.shiftright(F.xxhash64("text"), 32).cast("int"))
    done = rows.join(repeated_lines(rows, run), ["doc_id", "tag"], "left").withColumn("lines", F.split("text", "\n"))
    done = done.withColumn("places", F.when(F.col("gone").isNotNull(), F.expr(WITH_WORD)))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(without(F.col("lines"), F.expr("transform(gone, g -> places[g])")))
    return done.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
a AS (SELECT d.doc_id, u.p, d.ls[u.p] AS line FROM d, unnest(range(1, len(d.ls) + 1)) AS u(p)),
b AS (SELECT doc_id, p, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM a WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT x.doc_id, x.p AS p1, y.p AS p2, row_number() OVER (PARTITION BY x.line, y.line ORDER BY x.doc_id, x.i) AS n
      FROM b x JOIN b y ON x.doc_id = y.doc_id AND y.i = x.i + 1),
g AS (SELECT doc_id, unnest([p1, p2]) AS p FROM w WHERE n > 1),
c AS (SELECT DISTINCT doc_id, p FROM g),
k AS (SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.p) AS kept FROM a ANTI JOIN c ON a.doc_id = c.doc_id AND a.p = c.p GROUP BY a.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.ls)::BIGINT AS n_lines, coalesce(n.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
