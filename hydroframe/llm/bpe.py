"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Encoding.  A sequence of tokens is what rank-ordered merging gives for its bytes exactly when each two neighbours
`a, b` are what merging gives for the bytes of `a + b` alone (merging inside one token never sees the other side before
the first merge across a border, and that first one would also happen with the two tokens alone).  So there is a
non-deterministic transducer whose states are (last complete token, place in the vocabulary's trie) and which closes
a token only after a fitting one.  `Transducer` determinises it by subsets as bytes come: a state is the set of open
hypotheses with the tokens each has closed but not yet emitted; what all hypotheses share is emitted at once.  A
hypothesis that is not yet refuted has an open token, so no more than the longest token's bytes are ever looked ahead.
States, pair tests and whole pieces are kept in bounded memories that are emptied when full; that changes speed only.

Decoding.  Tokens are turned to bytes and fed in chunks to `Utf8Stream`, a state machine which emits complete
characters and keeps the bytes of an unfinished one; malformed bytes become U+FFFD.

Edge cases: a null text is encoded as an empty one, with no ids; null ids are decoded as empty; very long pieces are
streamed; equal rows are each encoded; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.common import arrow_map, id_text, in_slices, table

NONE = -1


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the content of a rank file (base64 token and rank in each line)."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = 400_000, max_pairs: int = 500_000):
        self.ranks, self.max_states, self.max_pairs = ranks, max_states, max_pairs
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.children: list[dict[int, int] | None] = [{}]
        self.token = [NONE]
        for tok, rank in ranks.items():
            node = 0
            for b in tok:
                below = self.children[node]
                if below is None:
                    below = self.children[node] = {}
                nxt = below.get(b)
                if nxt is None:
                    nxt = below[b] = len(self.children)
                    self.children.append(None)
                    self.token.append(NONE)
                node = nxt
            self.token[node] = rank
        self.pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # A state is one flat tuple: for each hypothesis the last token, the node, the number of pending tokens, and those.
        # The hypothesis without an open token, if there is one, comes first.  Steps: state and byte to state and output.
        self.ids: dict[tuple, int] = {}
        self.hyps: list[tuple] = []
        self.steps: dict[int, int] = {}
        self.outs: list[tuple] = [()]
        self.out_ids: dict[tuple, int] = {(): 0}
        self._state((NONE, 0, 0))

    def _state(self, flat: tuple) -> int:
        got = self.ids.get(flat)
        if got is None:
            got = self.ids[flat] = len(self.hyps)
            self.hyps.append(flat)
        return got

    def merged(self, data: bytes) -> list[int]:
        """Merging by rank as defined: the lowest-ranked neighbouring pair first, the leftmost of equals."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [ranks.get(parts[i] + parts[i + 1], 1 << 40) for i in range(len(parts) - 1)]
        while costs:
            low = min(costs)
            if low == 1 << 40:
                break
            i = costs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 40)
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 40)
        return [ranks[p] for p in parts]

    def _fits(self, prev: int, tok: int) -> bool:
        key = (prev << 32) | tok
        fits = self.pairs.get(key)
        if fits is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            if prev == NONE:
                fits = self.merged(self.bytes_of[tok]) == [tok]
            else:
                both = self.bytes_of[prev] + self.bytes_of[tok]
                fits = both not in self.ranks and self.merged(both) == [prev, tok]
            self.pairs[key] = fits
        return fits

    def _expand(self, state: int, b: int) -> int:
        children, tokens, flat = self.children, self.token, self.hyps[state]
        found, at = [], 0
        while at < len(flat):
            prev, node, n = flat[at : at + 3]
            below = children[node]
            node = below.get(b) if below else None
            if node is not None:
                pend = flat[at + 3 : at + 3 + n]
                tok = tokens[node]
                if tok != NONE and self._fits(prev, tok):
                    found.insert(0, (tok, 0, pend + (tok,)))
                if children[node]:
                    found.append((prev, node, pend))
            at += 3 + n
        first = found[0][2]
        shared = min(len(p) for _, _, p in found)
        for _, _, p in found:
            while p[:shared] != first[:shared]:
                shared -= 1
        made = []
        for prev, node, p in found:
            made += (prev, node, len(p) - shared)
            made += p[shared:]
        out = first[:shared]
        out_id = self.out_ids.get(out)
        if out_id is None:
            out_id = self.out_ids[out] = len(self.outs)
            self.outs.append(out)
        step = self.steps[state << 8 | b] = self._state(tuple(made)) << 32 | out_id
        return step

    def run(self, data: bytes) -> list[int]:
        """The tokens of one piece, in one pass over its bytes."""
        if len(self.hyps) > self.max_states:
            self._reset()
        state, out, get, outs = 0, [], self.steps.get, self.outs
        for b in data:
            step = get(state << 8 | b)
            if step is None:
                if len(self.hyps) > self.max_states:
                    flat = self.hyps[state]
                    self._reset()
                    state, get, outs = self._state(flat), self.steps.get, self.outs
                step = self._expand(state, b)
            state = step >> 32
            if sure := step & 0xFFFFFFFF:
                out += outs[sure]
        flat = self.hyps[state]
        out += flat[3 : 3 + flat[2]]
        return out

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return self.run(data) if whole is None else [whole]  # a piece that is a token is that token


class Memo(dict):
    """A bounded memory: when its newer half is full it becomes the older one, and what is found there moves over."""

    def __init__(self, keep: int, longest: int):
        super().__init__()
        self.keep, self.longest, self.older = keep, longest, {}

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= self.longest:
            if len(self) >= self.keep:
                self.older = dict(self)
                self.clear()
            self[key] = value


class Encoder:
    """Ids of whole texts: pieces by a pattern, each through the transducer.

    With a pattern like that of the rank files, a piece never goes on over a space after another character, and a space
    before a character begins a piece.  Where white space is single spaces and line ends only, which `ODD` tests, a text
    may therefore be taken in stretches that begin with a space; those are remembered as a whole, as pieces are.
    """

    ODD = re.compile(r"[^\S \n]|  | \n|\n |[\x1c-\x1f]")

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 300_000, spaces_lead: bool = True):
        import regex

        self.find, self.machine, self.spaces_lead = regex.compile(pattern).findall, Transducer(ranks), spaces_lead
        self.pieces, self.stretches = Memo(keep, 64), Memo(keep, 64)

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.older.get(piece)
        if ids is None:
            ids = array("i", self.machine.piece(piece.encode())).tobytes()
        self.pieces.put(piece, ids)
        return ids

    def _pieces(self, text: str) -> bytes:
        out, get = [], self.pieces.get
        for piece in self.find(text):
            out.append(get(piece) or self._piece(piece))
        return b"".join(out)

    def _stretch(self, stretch: str) -> bytes:
        ids = self.stretches.older.get(stretch)
        if ids is None:
            ids = self._pieces(" " + stretch)
        self.stretches.put(stretch, ids)
        return ids

    def __call__(self, text: str) -> bytes:
        """Native 32-bit ids."""
        if not self.spaces_lead or self.ODD.search(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        if not rest or not rest[-1]:
            return self._pieces(text)
        get = self.stretches.get
        return self._pieces(first) + b"".join([get(s) or self._stretch(s) for s in rest])


#: One encoder for each rank file and pattern in a worker process; the next tasks there go on with it.
_ENCODERS: dict[tuple[bytes, str], Encoder] = {}


def worker_encoder(rank_file: bytes, pattern: str) -> Encoder:
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(rank_file), pattern)
    return _ENCODERS[key]


class Utf8Stream:
    """Incremental UTF-8: feed() gives the text of all complete characters so far, close() what is left."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """Bytes at the end which begin a character that isn't complete yet."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:  # a leading byte: it wants this many bytes
                want = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 1
                if back >= want:
                    return 0
                if back > 1:
                    second = data[-back + 1]
                    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                    if not low <= second <= high:
                        return 0
                return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self._open(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


def decode_ids(ids: Iterable[int], byte_of: dict[int, bytes], chunk: int = 8192) -> str:
    """The tokens' text, decoded as a stream of chunks of ids."""
    stream, out, at = Utf8Stream(), [], iter(ids)
    while data := b"".join(map(byte_of.__getitem__, islice(at, chunk))):
        out.append(stream.feed(data))
    return "".join(out) + stream.close()


def _arrays(made: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(m) // 4 for m in made]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), dtype="i4")))


def encode(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """doc_id, ids array<int>: the ordinary tokens (no special ones) of each whole text.

    `back` adds `decoded`, the text that decoding these ids gives, in the same pass.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(rank_file, pattern)
        for part in in_slices(batches, 256):
            made = [encoder(t or "") for t in part.column(1).to_pylist()]
            cols = {"doc_id": part.column(0), "ids": _arrays(made)}
            if back:
                cols["decoded"] = pa.array([decode_ids(array("i", m), encoder.machine.bytes_of) for m in made], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return arrow_map(id_text(docs, id_col, text_col), work, "doc_id long, ids array<int>" + ", decoded string" * back)


def decode(encoded: DataFrame, rank_file: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded: the text of each row's ids."""
    rows = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_of = {r: t for t, r in read_ranks(rank_file).items()}
        for part in in_slices(batches, 256):
            texts = [decode_ids(ids or (), byte_of) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "decoded": pa.array(texts, pa.string())})

    return arrow_map(rows, work, "doc_id long, decoded string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        rank_file = f.read()
    both = encode(table(spark, sf_dir, "documents"), rank_file, public_tokenizers.PATTERN, back=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
