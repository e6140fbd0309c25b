"""The pipeline's stages on the odd texts, on no rows, and as a whole against plain versions."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from test_operators import LOWER, plain_groups, plain_repeats
from tokenizers import Tokenizer

from hydroframe.llm import packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.select(*COLUMNS).coalesce(1).write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}"


def test_stages_follow_each_other(spark, folder):
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == COLUMNS
        before, after = now.collect(), out.collect()
        texts = [(r["doc_id"], r["text"], None) for r in before]
        ids = {r["doc_id"] for r in after}
        if name == "language_id":
            assert ids == {i for i, t, _ in texts if t and any(c.isalpha() for c in t)}
        elif name == "exact_dedup":
            assert ids == set({(t or "").translate(LOWER): i for i, t, _ in sorted(texts)}.values())
        elif name == "near_dedup":
            assert ids == {i for i, _, low, _ in plain_groups(texts, 5) if i == low}
        else:
            want = {i: (n, gone, text) for i, n, gone, text in plain_repeats(texts, 20)}
            assert ids == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
            old = {r["doc_id"]: r["text"] for r in before}
            assert all(r["text"] == (want[r["doc_id"]][2] if want[r["doc_id"]][1] else old[r["doc_id"]]) for r in after)
        kept[name] = len(ids)
        now = spark.createDataFrame(after, out.schema)
    assert kept["substring_dedup"] > 50


def test_run(spark, folder, texts):
    """The whole run against plain versions of all stages, id by id of what is packed."""
    library = Tokenizer.from_str(packing.vocabulary())
    kept = [(i, t) for i, t, _ in texts if t and any(map(str.isalpha, t))]
    kept = [(i, t) for t, i in {t.translate(LOWER): (i, t) for i, t in sorted(kept)}.items() for i, t in [i]]
    low = {i: c for i, _, c, _ in plain_groups([(i, t, None) for i, t in kept], 5)}
    kept = [(i, t) for i, t in kept if low[i] == i]
    cut = {i: (n, gone, x) for i, n, gone, x in plain_repeats([(i, t, None) for i, t in kept], 20)}
    want = {i: library.encode(cut[i][2] if cut[i][1] else t, add_special_tokens=False).ids + [2] for i, t in kept if not cut[i][1] or cut[i][1] < cut[i][0]}
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    seen = defaultdict(int)
    for r in got.collect():
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(ids) for i, ids in want.items()} and len(want) > 50
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "substring_dedup", "packing"]


def test_rows_without_an_id_and_repeated_rows(spark):
    """No stage loses a row for want of an id; of rows that are repeated one stays."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(None, a), (None, a), (None, b), (5, b), (5, b), (5, a + " c d"), (6, "other words"), (7, "Other words"), (None, None), (None, "12")]
    now = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for (name, stage), want in zip(corpus_pipeline.STAGES, [rows[:8], [(None, a), (5, b), (5, a + " c d"), (7, "Other words")], [(None, a), (5, b), (5, a + " c d"), (7, "Other words")], [(None, a), (5, b), (5, a + " c d"), (7, "Other words")], None], strict=False):
        out = stage(spark, now, "")
        if want is not None:
            assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str), name
            now = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["5", "5", "7", "None"]


def test_no_rows(spark, none):
    empty = none.select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
