"""Packing of documents into token windows by Karmarkar-Karp multiway differencing.

A document becomes the ids of a `tokenizers` vocabulary followed by an end id.  Whole windows are cut off its front;
what is left, in nearly equal parts of at most a quarter of a window, which leaves 0.6 % of padding where whole rests leave
1.5 %, is one number-partitioning problem for up to `block_docs` documents: every item starts as a partial
partition with one non-empty part, and the two partial partitions with the largest differences are merged, large parts
onto small ones, until one is left.  The parts are then nearly equal, so they are nearly full once their number is the
total divided by the capacity, rounded up.  If a part is over the capacity, the number of windows rises by one and the
block is divided again.  Blocks are cut from the rows of a task in order, so nothing is shuffled, no task holds more
than a block, and a repeated task gives the same sequences.

Edge cases: a null text is an empty one, and an empty one is just the end id; a text longer than a window gives several
pieces; equal rows are packed each for itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.common import arrow_map, id_text, in_slices, table


def differencing(sizes: list[int], parts: int) -> list[list[int]]:
    """Splits the items 0..n-1 into `parts` lists of nearly equal total size."""
    heap = []
    for i, size in enumerate(sizes):
        heapq.heappush(heap, (-size, i, [(size, [i])]))
    made = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Both are sorted from large to small and stand for `parts` parts, the missing ones empty.
        shared = max(0, len(a) + len(b) - parts)
        tail = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - shared :], reversed(b[len(b) - shared :]), strict=True)] if shared else []
        merged = a[: len(a) - shared] + b[: len(b) - shared] + tail
        merged.sort(key=lambda part: -part[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == parts else 0)
        made += 1
        heapq.heappush(heap, (-spread, made, merged))
    return [items for _, items in heap[0][2]] if heap else []


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows (lists of items) of at most `capacity`; each size must fit by itself."""
    windows = -(-sum(sizes) // capacity)
    while True:
        made = differencing(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in made):
            return made
        windows += 1


class WordEncoder:
    """Ids of whole texts through a bounded memory of words.

    The vocabulary splits at white space and drops it, and neither its normaliser nor its merges look across, so a text's
    ids are those of its words in order.  A word of Latin letters only is one piece, which the normaliser just lower-cases,
    so the model gets it directly; the same holds for such a word before a full stop or comma, which is a piece of its own.
    All other words go through the whole tokenizer.  The memory has two halves: when the newer is full it becomes the
    older, and what is found there moves over.
    """

    def __init__(self, model: str, keep: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_str(model), keep
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(printed)]
        self.byte_chars = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.marks = {m: self._whole(m) for m in (b".", b",")}

    def _whole(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _learn(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            mark = self.marks.get(word[-1:], b"") if len(word) > 1 else b""
            core = word[:-1] if mark else word
            letters = core.decode()
            if letters.isalpha() and (core.isascii() or (max(letters) < "\u0250" and "\u0130" not in letters)):
                lower = letters.lower()
                key = lower.encode()
                ids = self.known.get(key) or self.older.get(key)
                if ids is None:
                    pieces = self.tokenize(lower if core.isascii() else key.decode("latin-1").translate(self.byte_chars))
                    ids = array("I", [p.id for p in pieces]).tobytes()
                    if key != word:
                        self.known[key] = ids
                ids += mark
            else:
                ids = self._whole(word)
        if len(word) <= 64:
            if len(self.known) >= self.keep:
                self.known, self.older = {}, self.known
            self.known[word] = ids
        return ids

    def __call__(self, text: str | None) -> bytes:
        """Unsigned 32-bit ids of a text."""
        out = []
        for word in (text or "").encode().split():
            ids = self.known.get(word)
            out.append(self._learn(word) if ids is None else ids)
        return b"".join(out)


#: One encoder for each vocabulary in a worker process; the next tasks there go on with it.
_ENCODERS: dict[int, WordEncoder] = {}


def worker_encoder(model: str) -> WordEncoder:
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(model)
    return _ENCODERS[key]


def pack(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, block_docs: int = 1024) -> DataFrame:
    """One row for each piece: doc_id, start, ids (binary, native uint32: little-endian on the usual machines), doc_tokens, sequence_id, offset.

    `model` is the content of a `tokenizers` JSON file whose vocabulary drops white space.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(model)
        end = array("I", [end_id]).tobytes()
        sequence = TaskContext.get().partitionId() << 33
        rest: list[tuple[int, int, bytes, int]] = []
        held, part_size = 0, max(1, capacity // 4)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        def close() -> list[tuple]:
            nonlocal sequence, rest
            rows = []
            for window in pack_block([len(ids) // 4 for _, _, ids, _ in rest], capacity):
                offset = 0
                for i in window:
                    doc, start, ids, total = rest[i]
                    rows.append((doc, start, ids, total, sequence, offset))
                    offset += len(ids) // 4
                sequence += 1
            rest = []
            return rows

        for part in in_slices(batches, 256):
            rows: list[tuple] = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                total, whole = len(ids) // 4, len(ids) // (4 * capacity)
                for k in range(whole):
                    rows.append((doc, k * capacity, ids[4 * k * capacity : 4 * (k + 1) * capacity], total, sequence, 0))
                    sequence += 1
                at, left = whole * capacity, total - whole * capacity
                for k in range(-(-left // part_size), 0, -1):  # nearly equal parts
                    n = -(-left // k)
                    rest.append((doc, at, ids[4 * at : 4 * (at + n)], total))
                    at, left = at + n, left - n
                held += 1
                if held >= block_docs:
                    rows += close()
                    held = 0
            if rows:
                yield batch(rows)
        if rest:
            yield batch(close())

    return arrow_map(id_text(docs, id_col, text_col), work, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def vocabulary() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def query(docs: DataFrame) -> DataFrame:
    packed = pack(docs, vocabulary())
    return packed.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(table(spark, sf_dir, "documents"))
