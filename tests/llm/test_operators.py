"""Each operator against a plain version of what it is to compute, on the odd texts of the fixtures, and on no rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from hydroframe.llm import bpe, exact_dedup, language_id, line_dedup, near_dedup, packing, quality, substring_dedup, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# 1 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rank_file():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def tiktoken_of(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library(docs, texts, rank_file):
    library = tiktoken_of(bpe.read_ranks(rank_file))
    encoded = bpe.encode(docs, rank_file, P.PATTERN, back=True)
    got = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in encoded.collect()}
    assert got == {i: (library.encode_ordinary(t or ""), t or "") for i, t, _ in texts}
    assert rows(bpe.decode(encoded, rank_file), "doc_id", "decoded") == sorted((i, t or "") for i, t, _ in texts)


def test_bpe_states_are_bounded(rank_file):
    ranks = bpe.read_ranks(rank_file)
    small, library = bpe.Transducer(ranks, max_states=5, max_pairs=5), tiktoken_of(ranks)
    for text in ("internationalisation", "aaaaaaaaaaaaaaaaaaaa", "Größenordnung", "日本語", " thnblerest"):
        assert small.run(text.encode()) == library._encode_only_native_bpe(text) if hasattr(library, "_encode_only_native_bpe") else library.encode_ordinary(text)
        assert len(small.hyps) <= 10 and len(small.pairs) <= 5


def test_bpe_emits_before_the_end(rank_file):
    """After bounded lookahead the tokens of a long piece are out, whatever follows."""
    machine = bpe.Transducer(bpe.read_ranks(rank_file))
    first, second = machine.run(b"the" * 200), machine.run(b"the" * 200 + b"xyz")
    assert first[:150] == second[:150]


def test_utf8_stream():
    rng = np.random.default_rng(0)
    alphabet = [0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x99, 0x82, 0xFF, 0xE0, 0xED, 0xF4, 0x90]
    for _ in range(500):
        data = bytes(rng.choice(alphabet, rng.integers(0, 12)).tolist())
        stream, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            step = int(rng.integers(1, 4))
            out += stream.feed(data[at : at + step])
            at += step
        assert out + stream.close() == data.decode("utf-8", "replace")


# 2 -----------------------------------------------------------------------------------------------------------------

URLS = ["https://Example.COM/en/77?x#y", "http://a.b.example.com/en/6", "x://com/en/", "com/en/", None, "://", "http://example.net/de/89", "http://net/de/", "http://anet/de/", "http://org/es", "http://a.org/es/x/y/z", "http://example.com?/en/7", "http://example.com#/en/7", "HTTP://EXAMPLE.com/en/7/8", "http://u@h:80/p", "http:///en/7", "http://example.com/EN/7", "a://b://c", "", "h://net/de/" + "x" * 5000]


def plain_rule(url):
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0] if url and "://" in url else ""
    host, path = rest.split("/", 1)[0].translate(LOWER), rest[len(rest.split("/", 1)[0]) :]
    fits = [(len(h.split(".")), len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


@pytest.mark.parametrize("limit", [100, 2])
def test_urls(spark, limit):
    """By the trie, and by the join that longer lists take."""
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = url_filter.filter_urls(pages, url_filter.RULES, max_broadcast=limit)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {i: plain_rule(u) for i, u in enumerate(URLS)}
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES, max_broadcast=limit).count() == 0


def test_rules_of_the_contract(spark, tmp_path):
    """The query's verdicts under the contract's own list, written out here."""
    want = {"http://com/en/": "block", "http://example.com/en/7": "allow", "http://net/de/": "allow", "http://a.net/de/9": "allow", "http://example.net/de/8": "block", "http://a.example.net/de/89": "block", "http://example.net/de/9": "allow", "http://org/es/": "block", "http://net/en/": "allow"}
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = url_filter.op2_url_filter(spark, str(tmp_path))
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == dict(enumerate(want.values()))


# 3 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(docs, texts, bits):
    """With three bits nearly all fingerprints are shared, and only their verification tells chunks apart."""
    groups = defaultdict(list)
    for i, t, _ in texts:
        groups[(t or "").translate(LOWER)].append(i)
    want = sorted((i, max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g)
    assert rows(exact_dedup.exact_groups(docs, chunk=16, bits=bits), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


# 4 -----------------------------------------------------------------------------------------------------------------


def test_quality_base(docs, texts):
    want = []
    for i, t, _ in texts:
        ws, seen, again = WORD.findall(t or ""), set(), 0
        for line in (t or "").split("\n"):
            again += bool(WORD.search(line)) and line in seen
            seen.add(line)
        found = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        covered = {k + j for k in range(len(ws) - 4) if found[tuple(ws[k : k + 5])] > 1 for j in range(5)}
        want.append((i, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), again, len(covered), len(ws) < 10 or 100 * len(covered) > 20 * len(ws)))
    got = quality.judge(docs)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want)
    assert not got.where("base_failed and kept").count()


def test_quality_distance(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["the", "of", "and", "to", "in", "is", "that", "for", "on", "with"] + [f"word{chr(97 + k)}" for k in range(26)]
    clean = [(i, " ".join(rng.choice(vocabulary, 150)), "en") for i in range(40)]
    junk = [(100 + i, " ".join(f"#{a}$$%%&&{b}" for a, b in rng.integers(0, 9999, (150, 2))), None) for i in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i, _, _ in clean) and not any(got[i] for i, _, _ in junk)


def test_divergence(spark):
    p, q = [0.5, 0.3, 0.2, 0.0], [0.1, 0.3, 0.4, 0.2]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    got = spark.createDataFrame([(p,)], "h array<double>").select(F.expr(quality.divergence("h", q))).first()[0]
    assert got == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


# 5 -----------------------------------------------------------------------------------------------------------------


def test_language(spark, docs, texts, none):
    model = language_id.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    assert set(got) == {i for i, _, _ in texts} and all(0 <= s <= 1 for _, s in got.values())
    for i, t, lang in texts:
        if not t or not any(map(str.isalpha, t)):
            assert got[i] == ("und", 0.0)
        elif len(t) > 150 and lang and ("der" in t or "the" in t):
            assert got[i][0] == lang
    assert language_id.identify(none, model).count() == 0
    assert language_id.fit(none) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}


def test_kernel_is_the_presence_kernel():
    """Folded weights give the same scores as kernel values with each landmark."""
    texts = [("abc abd abe", "x"), ("xyz xyw xyv", "y"), ("abcd ab", "x"), ("wxyz wx", "y")]
    model = language_id.Model(texts, landmarks=2)
    grams = language_id.Grams(model.letters)
    sets = [set(grams(t).tolist()) for t, _ in texts]
    plain = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    for (t, _), found in zip(texts, sets, strict=True):
        assert len(found) == len(plain(f" {t} "))
    for i in range(4):
        for j in range(4):
            assert len(sets[i] & sets[j]) == len(plain(f" {texts[i][0]} ") & plain(f" {texts[j][0]} "))


def test_language_sample_of_copies(spark, monkeypatch):
    """Copies of a text count once in the sample."""
    made = [("the same text", "en")] * 500 + [(f"text number {i}", "en") for i in range(400)]
    df = spark.createDataFrame(made, "text string, lang string")
    low = df.distinct().orderBy(F.xxhash64("text")).first()["text"]
    df = df.union(spark.createDataFrame([(low, "en")] * 500, "text string, lang string"))
    seen = []
    monkeypatch.setattr(language_id, "Model", lambda rows, landmarks: seen.append(rows))
    language_id.fit(df)
    assert len(seen[0]) == 300 and (low, "en") in seen[0]


# 6 -----------------------------------------------------------------------------------------------------------------


def plain_lines(texts, run):
    first, out = {}, {}
    split = {i: [(k, line) for k, line in enumerate((t or "").split("\n")) if WORD.search(line)] for i, t, _ in sorted(texts)}
    for i, lines in split.items():
        gone = set()
        for s in range(len(lines) - run + 1):
            key = tuple(x for _, x in lines[s : s + run])
            if first.setdefault(key, (i, s)) != (i, s):
                gone |= {k for k, _ in lines[s : s + run]}
        out[i] = gone
    return sorted((i, len((t or "").split("\n")), len(out[i]), "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in out[i])) for i, t, _ in texts)


@pytest.mark.parametrize("run", [1, 2, 3])
def test_lines(docs, texts, run):
    assert rows(line_dedup.remove_lines(docs, run=run), "doc_id", "n_lines", "n_removed", "kept") == plain_lines(texts, run)


# 7 -----------------------------------------------------------------------------------------------------------------


def plain_groups(texts, n, percent=80):
    sets = {}
    for i, t, _ in texts:
        ws = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} or ({tuple(ws)} if ws else set())
    low = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return sorted((i, len(sets[i]), low[i], low[i] == i) for i in sets)


@pytest.mark.parametrize(("n", "short"), [(2, 64), (5, 64), (2, 1)])
def test_near_groups(docs, texts, n, short):
    got = near_dedup.near_groups(docs, words=n, short=short)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == plain_groups(texts, n)


def test_near_groups_of_many(spark):
    """A large family, with a chain of links through it and strangers that share a passage, by long lists alone."""
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(120)]
    made = []
    for i in range(120):
        ws = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 14))):
            ws[k] = f"e{i}_{k}"
        made.append((i, " ".join(ws), None))
    made += [(1000 + i, " ".join(base[:60] + [f"s{i}_{k}" for k in range(60)]), None) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    assert rows(near_dedup.near_groups(df, words=2, short=5), "doc_id", "n_shingles", "component_id", "kept") == plain_groups(made, 2)


def test_near_groups_of_small_sets(spark):
    """Groups of texts of few shingles around a common one, each with words of its own on either side, all in long lists."""
    made, kinds = [], [(size, *x) for size in range(4, 16) for x in ((1, 200), (2, 70), (3, 70))]
    for g, (size, own, many) in enumerate(kinds):
        base = [f"g{g}_{k}" for k in range(size + 1)]
        group = [base] + [base + more if i % 2 else more + base for i in range(many) for more in [[f"g{g}w{i}_{k}" for k in range(own)]]]
        group += [base[:k] + base[k + 1 :] for k in range(size + 1)]
        made.append([(1000 * g + i, " ".join(x), None) for i, x in enumerate(group)])
    df = spark.createDataFrame([(i, t) for group in made for i, t, _ in group], "doc_id long, text string")
    got = rows(near_dedup.near_groups(df, words=2), "doc_id", "n_shingles", "component_id", "kept")
    assert got == [x for group in made for x in plain_groups(group, 2)]


def test_near_groups_of_strangers(spark):
    """Many texts that share most of their words without being alike enough, some pairs of which are: by long lists alone."""
    rng = np.random.default_rng(8)
    shared = [f"b{k}" for k in range(100)]
    made = []
    for i in range(150):
        own = [f"s{i // 2}_{k}" for k in range(30)] + [f"o{i}_{k}" for k in range(int(rng.integers(1, 40)))]
        made.append((i, " ".join(shared + own), None))
    df = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    want = plain_groups(made, 2)
    assert rows(near_dedup.near_groups(df, words=2, short=10), "doc_id", "n_shingles", "component_id", "kept") == want
    assert 75 < sum(kept for *_, kept in want) < 150


# 8 -----------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 200_000
    data = [(1, "http://a/ b\n", "x" * 100), (2, None, "x" * 100), (3, "u", None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", big), (9, "u", big), (8, "u", big), (2, "u", "other\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*d, "clash") for d in data], "page_id long, url string, html string, digest string").repartition(3)
    folder = f"file://{tmp_path}/w"
    archives = warc.write_archives(pages, folder, roll_bytes=200)
    read = warc.read_archives(archives, folder).collect()
    want = []
    for i, _, html in data:
        payload = (html or "").encode()
        same = [j for j, _, h in data if (h or "").encode() == payload]
        first = min(same) if len(payload) >= 100 and min(same) < i else None
        want.append((i, len(payload), sha(payload), "revisit" if first else "response", first, None if first else payload))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in read]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r["records"] for r in archives.collect()) == len(data)
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder + "0"), folder + "0").count() == 0


def test_warc_finds_damage():
    good = warc.record(5, "u", b"payload", sha(b"payload"), None)
    assert warc.parse(good)[0] == 5
    for bad in (good[:-1], good.replace(b"payload\r", b"Payload\r"), b"nonsense", good.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises((warc.BadRecord, KeyError, ValueError)):
            warc.parse(bad)

    class Cut:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:7], self.data[7:]
            return out

    two = warc.member(good, 6) + warc.member(good, 1)
    assert list(warc.members(Cut(two))) == [good, good]
    with pytest.raises(warc.BadRecord):
        list(warc.members(Cut(two[:-5])))


# 9 -----------------------------------------------------------------------------------------------------------------


def plain_repeats(texts, window):
    first, out = {}, []
    texts = sorted(texts, key=lambda x: (x[0] is None, x[0]))
    for i, t, _ in texts:
        ws = (t or "").encode().split()
        for s in range(len(ws) - window + 1):
            key, here = tuple(ws[s : s + window]), (i, s)
            if i is not None:
                first[key] = min(first.get(key, here), here)
    for i, t, _ in texts:
        ws = (t or "").encode().split()
        gone = {k for s in range(len(ws) - window + 1) if i is not None and first[tuple(ws[s : s + window])] < (i, s) for k in range(s, s + window)}
        out.append((i, len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "gram", "hot", "at_least"), [(20, 6, 20_000, 16), (5, 2, 20_000, 2), (20, 6, 1, 10**6), (8, 8, 2, 10**6)])
def test_repeats(docs, texts, window, gram, hot, at_least):
    """Also with buckets that are hot after one or two super-k-mers, and with nearly all minimisers as common ones."""
    got = substring_dedup.remove_repeats(docs, window=window, gram=gram, hot=hot, at_least=at_least)
    assert sorted(rows(got, "doc_id", "n_words", "n_removed", "kept"), key=str) == plain_repeats(texts, window)


@pytest.mark.parametrize(("hot", "at_least"), [(20_000, 16), (1, 10**6), (20_000, 1)])
def test_repeats_of_rows_that_share_an_id(spark, hot, at_least):
    """Rows (7, a) twice, (7, b) with another start, (7, short), an earlier and later copies, and rows without an id."""
    a, b = " ".join(f"w{k}" for k in range(40)), " ".join(f"x{k}" for k in range(25))
    made = [(7, a), (7, a), (7, "short text"), (8, a), (7, b + " " + a), (9, b), (9, a + " " + a), (None, a), (None, None), (7, None)]
    for extra in ([], [(3, "y " + a)]):
        df = spark.createDataFrame(made + extra, "doc_id long, text string").repartition(3)
        got = substring_dedup.remove_repeats(df, hot=hot, at_least=at_least)
        want = plain_repeats([(i, t, None) for i, t in made + extra], 20)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
        assert [x for x in want if x[0] == 7 and x[1] == 40] == [(7, 40, 40 if extra else 0, "" if extra else a)] * 2


# 10 ----------------------------------------------------------------------------------------------------------------


def test_packing(docs, texts):
    model = packing.vocabulary()
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(model)
    capacity = 512
    pieces = packing.pack(docs, model, capacity=capacity, block_docs=16).collect()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p["ids"]), dtype="<u4").tolist()
        by_doc[p["doc_id"]].append((p["start"], ids, p["doc_tokens"]))
        by_window[p["sequence_id"]].append((p["offset"], len(ids)))
    for i, t, _ in texts:
        want = library.encode(t or "", add_special_tokens=False).ids + [2]
        got, at = [], 0
        for start, ids, total in sorted(by_doc[i]):
            assert start == at and total == len(want)
            got += ids
            at += len(ids)
        assert got == want
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert zlib.crc32(b"") == 0


def test_differencing():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 1000, 300).tolist()
    parts = packing.differencing(sizes, 40)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(300)) and len(parts) == 40
    assert max(sums) - min(sums) < 60
    windows = packing.pack_block(sizes, 1000)
    assert all(sum(sizes[i] for i in w) <= 1000 for w in windows)
    assert packing.pack_block([5], 5) == [[0]] and packing.differencing([], 3) == []


# All ---------------------------------------------------------------------------------------------------------------


def test_empty_tables(none, rank_file):
    assert bpe.encode(none, rank_file, P.PATTERN, back=True).count() == 0
    assert exact_dedup.exact_groups(none).count() == 0
    assert quality.judge(none).count() == 0
    assert line_dedup.remove_lines(none).count() == 0
    assert near_dedup.near_groups(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert packing.pack(none, packing.vocabulary()).count() == 0


def test_missing_and_equal_ids(spark, rank_file, tmp_path):
    """Rows without an id and rows with the same id come out as often as they went in, with the values that the docstrings state."""
    text, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    made = [(None, text), (None, None), (7, text), (7, text.upper()), (7, other), (8, None), (9, text + " x"), (None, "alone")]
    df = spark.createDataFrame([(i, t, "en", "u", "x") for i, t in made], "doc_id long, text string, lang string, url string, digest string").repartition(3)
    order = lambda df, *c: sorted((tuple(r[x] for x in c) for r in df.collect()), key=str)
    groups = {text: (7, 3), None: (8, 2), other: (7, 1), text + " x": (9, 1), "alone": (None, 1)}
    want = [(i, *groups[t and t.lower()], i == groups[t and t.lower()][0], sha((t or "").lower())) for i, t in made]
    assert order(exact_dedup.exact_groups(df), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=str)
    near = order(near_dedup.near_groups(df, words=2), "doc_id", "n_shingles", "component_id", "kept")
    # Of the rows of 7 in the component of `text`, those of one text stay; which one follows from its hash.
    assert [x for x in near if x[0] != 7] == [(8, 0, 8, True), (9, 40, 7, False), (None, 0, None, True), (None, 1, None, True), (None, 39, None, True)]
    assert sorted(x[3] for x in near if x[0] == 7) == [False, True, True] and all(x[1:3] == (39, 7) for x in near if x[0] == 7)
    lines = spark.createDataFrame([(None, "a\nb"), (7, "a\nb"), (7, "a\nb"), (7, "c\na\nb"), (9, "a\nb"), (None, None)], "doc_id long, text string")
    assert order(line_dedup.remove_lines(lines), "doc_id", "n_removed", "kept") == sorted([(None, 0, "a\nb"), (7, 0, "a\nb"), (7, 0, "a\nb"), (7, 2, "c"), (9, 2, ""), (None, 0, "")], key=str)
    judged = quality.judge(df)
    assert order(judged, "doc_id", "n_words") == sorted([(i, len((t or "").split())) for i, t in made], key=str)
    found = language_id.identify(df, language_id.fit(df))
    assert order(found, "doc_id", "lang_pred") == sorted([(i, "en" if t else "und") for i, t in made], key=str)
    encoded = bpe.encode(df, rank_file, P.PATTERN, back=True)
    assert order(encoded, "doc_id", "decoded") == sorted([(i, t or "") for i, t in made], key=str)
    pieces = packing.pack(df, packing.vocabulary())
    assert sorted(str(r["doc_id"]) for r in pieces.collect()) == sorted(str(i) for i, _ in made)
    urls = spark.createDataFrame([(None, "http://a.com/en/"), (None, None), (3, "http://a.com/en/")], "page_id long, url string")
    assert order(url_filter.filter_urls(urls, url_filter.RULES), "page_id", "verdict") == sorted([(None, "block"), (None, "allow"), (3, "block")], key=str)
    folder = f"file://{tmp_path}/w"
    read = warc.read_archives(warc.write_archives(df, folder, "doc_id", "url", "text"), folder)
    want = [(i, len(t or ""), 7 if i == 9 and t == text else None) for i, t in made]
    assert order(read, "page_id", "payload_bytes", "refers_to") == sorted(want, key=str)


def test_letters(spark):
    """Numerals are no letters, whatever script they are of."""
    model = language_id.fit(spark.createDataFrame([("some text here", "en"), ("ein Text hier", "de")], "text string, lang string"))
    df = spark.createDataFrame([(0, "²½ ② 12 _"), (1, "² a"), (2, "ª"), (3, "٣"), (4, "漢")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, model).collect()}
    assert got[0] == got[3] == "und" and "und" not in (got[1], got[2], got[4])


def test_language_scores_by_plain_regression(spark, docs, texts):
    """Kernel values by sets of n-grams, Nystroem features and ridge regression written out."""
    rows = sorted({(t, lang) for _, t, lang in texts if t and lang and any(map(str.isalpha, t)) and len(t.encode()) <= 20_000})
    model = language_id.Model(rows, landmarks=5)
    grams = language_id.Grams(model.letters)
    sets = [set(grams(t).tolist()) for t, _ in rows]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    marks = [i for lang in model.languages for i in sorted((i for i, r in enumerate(rows) if r[1] == lang), key=lambda i: -min(len(sets[i]), 800))[:5]]
    inner = np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(inner)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-9))) @ vectors.T
    features = lambda s: np.append(np.array([kernel(s, sets[i]) for i in marks]) @ root, 1.0)
    phi = np.array([features(s) for s in sets])
    sides = np.array([[1.0 if r[1] == lang else -1.0 for lang in model.languages] for r in rows])
    beta = np.linalg.inv(phi.T @ phi + 1e-2 * np.eye(phi.shape[1])) @ phi.T @ sides
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    for i, t, _ in texts:
        if t and any(map(str.isalpha, t)):
            raw = features(set(grams(t).tolist())) @ beta
            assert got[i][1] == pytest.approx(min(1, max(0, (raw.max() + 1) / 2)), abs=2e-3)
            assert got[i][0] == model.languages[raw.argmax()] or np.sort(raw)[-1] - np.sort(raw)[-2] < 2e-3


def test_quality_of_many_languages(spark):
    """Languages without a usable document don't count towards the limit, and one with more references than allowed is an error."""
    rng = np.random.default_rng(4)
    good = [(i, " ".join(rng.choice(["the", "of", "and", "house", "river", "stone"], 12, replace=True).tolist() + [f"u{i}"]), "en") for i in range(3)]
    odd = [(100 + i, "two words", f"l{i}") for i in range(400)]
    df = spark.createDataFrame(good + odd, "doc_id long, text string, lang string")
    got = quality.judge(df)
    assert got.where("char_distance is not null").count() == 403
    with pytest.raises(ValueError, match="languages"):
        quality.judge(df.union(spark.createDataFrame([(999, good[0][1] + " x", "zz")], df.schema)), max_languages=1)
