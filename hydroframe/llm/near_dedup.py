"""Near-duplicate detection by bottom-k sketches from one hash function.

1. Each text gives its set of word shingles as 64-bit hashes, the set's digest, and the `k` smallest hashes: its sketch.
   Texts with equal sets are one class and count once from here on.
2. Inverted lists: the values retained in the sketches are ordered by the number of sketches that hold them, rare ones first,
   and a class is listed under the first of its own only.  Two sketches that have `c` values in common meet in a list if each
   is listed under all but its last c - 1.  For sets that are whole in their sketches c is exact: links need that many.
   For larger ones c is (percent / 100 - slack) * k; that a link has fewer is a chance of about 1e-6 with the defaults.
   Lists of up to `short` classes give their pairs, if sizes and places in the order still allow a link; the number of lists
   that a pair shares is its overlap.  A longer list gives three pairs for each member, with classes of about its size.
3. The sketch of the union estimates the similarity, and pairs `slack` below the threshold go.
4. The rest are compared on their full sets: linked if 100 * intersection >= percent * union.
5. Links become components by alternating large and small stars.
6. Long lists that hold several components are closed exactly: their members' full sets are listed once more in the same way
   (of a set of n, the rarest n - ceil(percent * n / 100) + 1 meet every set that it can be linked with), and members outside
   a list's largest component are compared with those of other components that they meet there, first by bitmaps of 4096
   bits that bound their intersection, then by their sets.  Lists are dealt out by blocks of `block` members, so that no
   task has to hold a list.

Edge cases: null and empty texts have no set and are alone; a text with fewer words than a shingle is one shingle; very long
texts are read whole; equal texts are one class and travel once; a row without an id is alone, kept, and has no component; rows
that share an id are judged by their own texts, and of a component those of one text stay; an empty table gives no rows; further columns are ignored; ids are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.common import arrow_map, checkpoint, id_text, in_slices, release, table
from hydroframe.llm.hashing import run_hashes, word_hashes


BITMAP = 4096  #: bits of the bitmaps that are compared before sets are


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted set of hashes of a text's shingles."""
    found = word_hashes((text or "").encode().lower())
    if not found.size:
        return np.zeros(0, dtype=np.int64)
    return np.unique(run_hashes(found, min(words, found.size)).view(np.int64))


def sketches(rows: DataFrame, words: int, k: int) -> DataFrame:
    """doc_id, text_hash, size, digest, sketch for each row; the digest is null where the set is empty."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, 512):
            sets = [shingles(t, words) for t in part.column(1).to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None for s in sets]
            cut = [s[:k] for s in sets]
            ends = np.cumsum([0] + [s.size for s in cut]).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cut)))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "text_hash": part.column(2), "size": pa.array([s.size for s in sets], pa.int64()), "digest": pa.array(digests, pa.binary()), "sketch": lists})

    return arrow_map(rows.select("doc_id", "text", "text_hash"), work, "doc_id long, text_hash long, size long, digest binary, sketch array<long>")


class Bounds:
    """How many retained values two sets must have in common to be linked, for sketches of `k` values."""

    def __init__(self, percent: int, k: int, slack: float):
        self.percent, self.k = percent, k
        self.sure = max(1, int(k * (percent / 100 - slack)))

    def common(self, n: int, m: int) -> int:
        low, high = min(n, m), max(n, m)
        whole = -(-self.percent * (n + m) // (100 + self.percent))  # least intersection of sets of these sizes
        return whole if high <= self.k else max(1, whole - (high - self.k)) if low <= self.k else self.sure

    def listed(self, n: int) -> int:
        """Under how many of its values a set of n must be listed: with any partner's, they have one in common."""
        partners = range(-(-n * self.percent // 100), n * 100 // self.percent + 1)
        return max(min(n, self.k) - self.common(n, m) + 1 for m in partners)

    def listed_column(self, n: Column) -> Column:
        most = self.k * 100 // self.percent + 1  # beyond it all sets are treated alike
        return F.element_at(F.array(*[F.lit(self.listed(i)) for i in range(1, most + 1)]), F.least(n, F.lit(most)).cast("int"))

    def reachable(self, n: Column, m: Column, rest_n: Column, rest_m: Column) -> Column:
        """Whether sizes, and the numbers of values that follow the first common one, still allow a link."""
        low, high = F.least(n, m), F.greatest(n, m)
        whole = F.ceil(self.percent * (n + m) / (100 + self.percent))
        least = F.when(high <= self.k, whole).when(low <= self.k, whole - (high - self.k)).otherwise(self.sure)
        return (100 * low >= self.percent * high) & (F.least(rest_n, rest_m) + 1 >= least)


def rare_first(sets: DataFrame, listed: Column, wanted: Column | None = None) -> DataFrame:
    """value, node, size, rest, own: each set (node, size, values) under its rarest values; `rest` is how many values follow,
    `own` how many the set has for itself.

    Values of one set only, and those that no set with `wanted` has, come first in the order and make no list.
    """
    posts = sets.select("node", "size", (F.lit(True) if wanted is None else wanted).alias("wanted"), F.size("values").alias("width"), F.explode("values").alias("value"))
    counts = posts.groupBy("value").agg(F.count("*").alias("n"), F.max("wanted").alias("any")).where("n > 1 and any").select("value", "n")
    held = posts.join(counts, "value").groupBy("node").agg(F.first("size").alias("size"), F.first("width").alias("width"), F.sort_array(F.collect_list(F.struct("n", "value"))).alias("found"))
    held = held.withColumn("own", F.col("width") - F.size("found")).withColumn("first", F.slice("found", F.lit(1), F.greatest(listed - F.col("own"), F.lit(0))))
    return held.select("node", "size", "width", "own", F.posexplode("first").alias("at", "x")).select(F.col("x.value").alias("value"), "node", "size", (F.col("width") - 1 - F.col("own") - F.col("at")).alias("rest"), "own")


def sized_lists(lists: DataFrame) -> DataFrame:
    """The rows of lists with two members at least, with their length n."""
    return lists.join(lists.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "value")


def met(left: DataFrame, right: DataFrame, on: list[str], bounds: Bounds) -> DataFrame:
    """Pairs a < b of members of the same list that may be linked."""
    x, y = (df.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in on]) for df, s in ((left, "l"), (right, "r")))
    return x.join(y, on).where(bounds.reachable(F.col("size_l"), F.col("size_r"), F.col("rest_l"), F.col("rest_r")))


def stars(long_lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of each member with the class of about its size that has the fewest values of its own, the likeliest centre of
    a group, with the smallest such class by hash, and with the first of the next size.
    """
    size_class = F.floor(F.log("size") / F.log(F.lit(100 / percent))).cast("int")
    rows = long_lists.withColumn("c", size_class)
    node = F.struct("node", "size")
    heads = rows.groupBy("value", "c").agg(F.min_by(node, F.struct("own", F.xxhash64("node"))).alias("one"), F.min_by(node, F.xxhash64("node")).alias("two"))
    own = heads.select("value", "c", F.explode(F.array_distinct(F.array("one", "two"))).alias("h"))
    heads = own.union(heads.select("value", F.col("c") - 1, "one")).select("value", "c", F.col("h.node").alias("head"), F.col("h.size").alias("head_size"))
    near = 100 * F.least("size", "head_size") >= percent * F.greatest("size", "head_size")
    return rows.join(heads, ["value", "c"]).where((F.col("node") != F.col("head")) & near).select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))


def likely(pairs: DataFrame, classes: DataFrame, k: int, percent: int, slack: float) -> DataFrame:
    """The pairs (a, b) that the sketch of their union does not exclude."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    few = checkpoint(classes.select("node", "size", "sketch").join(used, "node", "left_semi"))
    side = lambda x: few.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.array_sort(F.array_union("sketch_a", "sketch_b"))
    both = both.withColumn("low", F.when(F.greatest("size_a", "size_b") > k, F.slice(union, 1, k)).otherwise(union))
    common = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), F.col("low")))
    return both.select("a", "b", (common / F.size("low")).alias("estimate")).where(F.col("estimate") >= percent / 100 - slack).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int, chunk: int = 1000) -> DataFrame:
    """The pairs whose full sets are alike enough.

    Of a pair, the class with more pairs is the hub.  A hub's text travels once for each `chunk` of its pairs, and the other
    texts once for each pair.
    """
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    side = lambda x: degrees.select(F.col("node").alias(x), F.struct("n", "node").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select(F.greatest("n_a", "n_b").alias("hub"), F.least("n_a", "n_b").alias("leaf"))
    both = checkpoint(both.select(F.col("hub.node").alias("hub"), F.col("leaf.node").alias("leaf"), F.expr(f"pmod(xxhash64(leaf.node), ceil(hub.n / {chunk}))").cast("int").alias("part")))
    hubs = both.select("hub", "part").distinct().join(texts, F.col("hub") == F.col("node")).select("hub", "part", F.lit(None).cast("long").alias("leaf"), "text")
    leaves = both.join(texts, F.col("leaf") == F.col("node")).select("hub", "part", "leaf", "text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(0, dtype=np.int64)
        for part in in_slices(batches, 512):
            a, b = [], []
            for hub, leaf, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                found = shingles(text, words)
                if leaf is None:
                    first = found
                    continue
                common = np.intersect1d(first, found, assume_unique=True).size
                if 100 * common >= percent * (first.size + found.size - common):
                    a.append(min(hub, leaf))
                    b.append(max(hub, leaf))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    order = [F.col("hub"), F.col("part"), F.col("leaf").asc_nulls_first()]
    return arrow_map(hubs.union(leaves).repartition("hub", "part").sortWithinPartitions(*order), work, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that it is connected with) for each node that has a link."""
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        # Large star: every larger neighbour of a node goes to the smallest of the node and its neighbours.
        ways = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = ways.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of these.
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(low, "u")
        edges = moved.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = checkpoint(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now


def strays(members: DataFrame, found: DataFrame) -> DataFrame:
    """node, component, stray for the members (value, node) of lists with several components; the members of a list's
    largest component are no strays of it."""
    placed = members.join(found, "node", "left").select("value", "node", F.coalesce("component", "node").alias("component"))
    parts = placed.groupBy("value", "component").agg(F.count("*").alias("n")).groupBy("value").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("parts"))
    held = placed.join(parts.where("parts > 1").select("value", "largest"), "value")
    return held.groupBy("node").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("largest")).alias("stray"))


def bitmaps(sets: list[np.ndarray], size: int = BITMAP) -> pa.Array:
    """For each set `size` bits, by the lowest bits of its values."""
    out = np.zeros((len(sets), size), dtype=bool)
    for row, values in zip(out, sets, strict=True):
        row[values & (size - 1)] = True
    return pa.array([r.tobytes() for r in np.packbits(out, axis=1)], pa.binary())


def comparable(left: dict[str, np.ndarray], right: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different components whose sizes, places in the list and bitmaps still allow a link.

    Each bit in which two bitmaps differ stands for a value that one set has and the other lacks.
    """
    both = left["size"][:, None] + right["size"][None, :]
    need = -(-percent * both // (100 + percent))
    low, high = np.minimum(left["size"][:, None], right["size"][None, :]), np.maximum(left["size"][:, None], right["size"][None, :])
    fine = (100 * low >= percent * high) & (np.minimum(left["rest"][:, None], right["rest"][None, :]) + 1 >= need)
    i, j = np.nonzero(fine & (left["component"][:, None] != right["component"][None, :]))
    close = np.zeros(i.size, dtype=bool)
    for at in range(0, i.size, 20_000):
        x, y = i[at : at + 20_000], j[at : at + 20_000]
        differ = np.bitwise_count(left["bits"][x] ^ right["bits"][y]).sum(axis=1, dtype=np.int64)
        close[at : at + 20_000] = both[x, y] - differ >= 2 * need[x, y]
    return i[close], j[close]


def across(nodes: DataFrame, texts: DataFrame, words: int, percent: int, block: int = 1000) -> DataFrame:
    """Pairs (a, b) of strays with members of other components that may be linked; none that is linked is left out."""

    def as_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, 256):
            sets = [shingles(t, words) for t in part.column(3).to_pylist()]
            ends = np.cumsum([0] + [s.size for s in sets]).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([s.size for s in sets], pa.int64()), lists, bitmaps(sets)], names=["node", "component", "stray", "size", "values", "bits"])

    sets = arrow_map(nodes.join(texts, "node").select("node", "component", "stray", "text"), as_sets, "node long, component long, stray boolean, size long, values array<long>, bits binary")
    sets = checkpoint(sets)
    listed = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    lists = sized_lists(rare_first(sets, listed, F.col("stray"))).drop("own").join(sets.select("node", "component", "stray", "bits"), "node")
    # A block holds `block` members of a list, and all strays of the list come to each of its blocks.
    blocks = F.ceil(F.col("n") / block).cast("int")
    columns = ["value", "other", "left", "node", "component", "size", "rest", "bits"]
    held = lists.withColumns({"other": F.pmod(F.xxhash64("node"), blocks).cast("int"), "left": F.lit(False)}).select(*columns)
    come = lists.where("stray").withColumns({"other": F.explode(F.sequence(F.lit(0), blocks - 1)), "left": F.lit(True)}).select(*columns)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, {}
        for part in in_slices(batches, 2000):
            cols = {n: part.column(n).to_numpy(zero_copy_only=False) for n in columns[:-1]}
            cols["rest"], cols["size"] = cols["rest"].astype(np.int64), cols["size"].astype(np.int64)
            cols["bits"] = np.frombuffer(b"".join(part.column("bits").to_pylist()), dtype=np.uint64).reshape(part.num_rows, -1)
            change = (cols["value"][1:] != cols["value"][:-1]) | (cols["other"][1:] != cols["other"][:-1]) | (cols["left"][1:] != cols["left"][:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), part.num_rows]
            for start, stop in zip(edges, edges[1:], strict=False):
                here = {n: cols[n][start:stop] for n in ("node", "component", "size", "rest", "bits")}
                if not cols["left"][start]:
                    if (now := (cols["value"][start], cols["other"][start])) == key:
                        here = {n: np.concatenate((members[n], here[n])) for n in here}
                    key, members = now, here
                    continue
                for at in range(0, stop - start, 500):
                    some = {n: x[at : at + 500] for n, x in here.items()}
                    i, j = comparable(some, members, percent)
                    if i.size:
                        x, y = some["node"][i], members["node"][j]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return arrow_map(held.union(come).repartition("value", "other").sortWithinPartitions("value", "other", "left"), work, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, k: int = 48, short: int = 64, slack: float = 0.3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash (by which rows that share an id are told apart) for each row."""
    bounds = Bounds(percent, k, slack)
    rows = id_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    marked = checkpoint(sketches(rows, words, k))
    known = marked.where("digest is not null and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    classes = checkpoint(classes.select("digest", F.monotonically_increasing_id().alias("node"), F.col("x.doc_id").alias("rep"), F.col("x.text_hash").alias("text_hash"), "size", "sketch"))
    marked = marked.select("doc_id", "text_hash", "size", "digest")
    # Smaller sets are linked with equal ones only, and those are their class.
    sets = classes.where(100 * F.col("size") >= percent * (F.col("size") + 1)).select("node", "size", F.col("sketch").alias("values"))
    lists = checkpoint(sized_lists(rare_first(sets, bounds.listed_column(F.col("size")))))
    release(rows.sparkSession)
    few = lists.where(F.col("n") <= short).drop("n", "own")
    found = met(few, few, ["value"], bounds).where("node_l < node_r").select(F.col("node_l").alias("a"), F.col("node_r").alias("b"))
    long_lists = lists.where(F.col("n") > short)
    overlaps = found.union(stars(long_lists, percent)).groupBy("a", "b").agg(F.count("*").alias("overlap"))
    pairs = checkpoint(likely(checkpoint(overlaps.select("a", "b")), classes, k, percent, slack))
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(long_lists.select("node")).distinct()
    used = classes.select("node", F.col("rep").alias("doc_id"), "text_hash").join(used, "node")
    texts = checkpoint(rows.where("doc_id is not null").join(used, ["doc_id", "text_hash"]).select("node", "text"))
    release(rows.sparkSession)
    links = checkpoint(verified(pairs, texts, words, percent))
    found = components(links)
    nodes = checkpoint(strays(long_lists.select("value", "node"), found))
    if not nodes.isEmpty():
        fresh = checkpoint(verified(checkpoint(across(nodes, texts, words, percent)), texts, words, percent))
        if not fresh.isEmpty():
            found = components(links.union(fresh))
    row = F.struct(F.col("rep").alias("doc_id"), "text_hash")
    named = found.join(classes.select("node", row.alias("row")), "node")
    named = named.join(named.groupBy("component").agg(F.min("row").alias("low")), "component").select("node", "low")
    labels = classes.join(named, "node", "left").select("digest", F.coalesce("low", row).alias("low"))
    done = marked.join(labels, "digest", "left")
    low = F.when(F.col("doc_id").isNotNull(), F.coalesce("low", F.struct("doc_id", "text_hash")))
    kept = F.coalesce((F.col("doc_id") == low["doc_id"]) & (F.col("text_hash") == low["text_hash"]), F.lit(True))
    return done.select("doc_id", F.col("size").alias("n_shingles"), low["doc_id"].alias("component_id"), kept.alias("kept"), "text_hash")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=2).drop("text_hash")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS x FROM w),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS t FROM s),
p AS (SELECT l.doc_id AS a, r.doc_id AS b, l.n AS na, r.n AS nb, count(*) AS c FROM e l JOIN e r ON l.t = r.t AND l.doc_id < r.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
z AS (SELECT a AS u, b AS v FROM k UNION ALL SELECT b, a FROM k),
c AS (SELECT doc_id AS node, doc_id AS low FROM s UNION SELECT z.v, c.low FROM c JOIN z ON z.u = c.node WHERE c.low < z.v)
SELECT s.doc_id, len(s.x)::BIGINT AS n_shingles, m.low AS component_id, m.low = s.doc_id AS kept
FROM s JOIN (SELECT node, min(low) AS low FROM c GROUP BY node) m ON m.node = s.doc_id
"""
