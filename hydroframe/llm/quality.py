"""Quality rules: Jensen-Shannon distance to language references, with DataFrame functions only.

Two histograms describe a text: its characters by class, and its words by a short list of common words of each language
(with one bin for all other words).  A language's reference is the sum of the histograms of all its documents that pass
the base rules, so the references follow the corpus, one row for each language.
A text is kept if to one and the same reference its distance is at most `max_char` for the classes and `max_word` for the words.
Texts with fewer than `min_chars` characters or `min_words` words are too short to be measured and are kept if they pass
the base rules.

Base rules: at least 10 words, and at most 20 % of the words in 5-word windows that occur twice or more.

Edge cases: null and empty texts have no words and fail the base rules; very long texts are measured whole, and windows are
compared by sorted 64-bit hashes; equal rows get equal results; without any reference (no labelled document passes) the
base rules decide; more than `max_languages` languages with a reference are an error; an empty table gives no rows; rows
without an id are judged like others; further columns are ignored, and rows without a language are no reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.common import SPACES, checkpoint, table

#: Common words whose shares are compared; fixed values, a parameter of the operator.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "on", "with", "was", "are"],
    "de": ["der", "die", "und", "das", "den", "zu", "mit", "ist", "von", "ein", "nicht", "auf"],
    "fr": ["le", "la", "les", "et", "des", "un", "du", "que", "dans", "pour", "est", "qui"],
    "es": ["el", "los", "que", "y", "las", "una", "con", "por", "para", "del", "se", "como"],
}
#: Character classes that are counted by themselves; white space and all other characters are the last two bins.
CLASSES = ["[A-Z]+", "[0-9]+", r"""[.,;:!?'"()\-]+""", r"""[\x21-\x7E&&[^A-Za-z0-9.,;:!?'"()\-]]+""", r"[^\x00-\x7F]+"]
WINDOW = 5


def measured(text: Column) -> tuple[Column, Column]:
    spaces = " \t\n\x0b\f\r"
    trimmed = F.btrim(text, F.lit(spaces))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)), F.char_length(text)


def repeated_words(words: str) -> list[tuple[str, str]]:
    """(name, expression) steps that end in n_repeat_words."""
    return [
        ("w_hash", f"transform({words}, w -> xxhash64(w))"),
        ("win", f"if(size({words}) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size({words}) - {WINDOW}), i -> xxhash64(" + ", ".join(f"w_hash[i + {k}]" for k in range(WINDOW)) + ")))"),
        ("again", "size(array_distinct(win)) < size(win)"),
        ("sorted", "if(again, sort_array(transform(win, (h, i) -> struct(h, i))), null)"),
        ("starts", "sort_array(filter(transform(sorted, (s, k) -> if((k > 0 and sorted[greatest(k - 1, 0)].h = s.h) or (k < size(sorted) - 1 and sorted[least(k + 1, size(sorted) - 1)].h = s.h), s.i, null)), i -> i is not null))"),
        ("n_repeat_words", f"if(again, aggregate(sequence(1, size(starts)), 0L, (n, k) -> n + if(k = size(starts), {WINDOW}, least({WINDOW}, starts[least(k, size(starts) - 1)] - starts[k - 1]))), 0L)"),
    ]


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str, common: dict[str, list[str]]) -> DataFrame:
    words, _ = measured(F.col("text"))
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).withColumn("words", words)
    for name, step in repeated_words("words"):
        df = df.withColumn(name, F.expr(step))
    listed = sorted({w for ws in common.values() for w in ws})
    inside = ", ".join(f"'{w}'" for w in listed)
    df = df.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length("text").cast("long").alias("n_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        "n_repeat_words",
        *[(F.char_length("text") - F.char_length(F.regexp_replace("text", c, ""))).cast("double").alias(f"c{k}") for k, c in enumerate(CLASSES)],
        F.expr(f"concat(' ', array_join(filter(transform(words, w -> lower(w)), w -> w in ({inside})), '  '), ' ')").alias("hits"),
    )
    counts = [((F.octet_length("hits") - F.octet_length(F.replace("hits", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("double") for w in listed]
    df = df.withColumn("word_hist", F.array(*counts)).withColumn("hit", F.expr("aggregate(word_hist, 0D, (a, x) -> a + x)"))
    blank = F.col("n_chars").cast("double") - F.col("word_chars")
    rest = F.col("word_chars").cast("double") - sum((F.col(f"c{k}") for k in range(len(CLASSES))), F.lit(0.0))
    return df.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        "n_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.array(*[F.col(f"c{k}") for k in range(len(CLASSES))], blank, rest).cast("array<int>").alias("char_hist"),
        F.concat("word_hist", F.array(F.col("n_words").cast("double") - F.col("hit"))).cast("array<int>").alias("word_hist"),
    )


def references(measures: DataFrame, word_bins: int, max_languages: int = 256) -> dict[str, tuple[list[float], list[float]]]:
    """Histograms of each language, as shares, over all documents that pass the base rules: a few numbers for each."""
    bins = {"char_hist": len(CLASSES) + 2, "word_hist": word_bins}
    # A condition inside the sums and no filter: a filter would be pushed below the measures and repeat them.
    sums = [F.sum(F.when(~F.col("base_failed"), F.col(name)[k])).alias(f"{name}{k}") for name, n in bins.items() for k in range(n)]
    rows = measures.groupBy("lang").agg(*sums).where("lang is not null and char_hist0 is not null").limit(max_languages + 1).collect()
    if len(rows) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    found = {}
    for row in sorted(rows, key=lambda r: r["lang"]):
        totals = [[row[f"{name}{k}"] for k in range(n)] for name, n in bins.items()]
        found[row["lang"]] = tuple([x / sum(xs) for x in xs] for xs in totals)
    return found


def divergence(hist: str, reference: list[float]) -> str:
    """SQL of the Jensen-Shannon distance (base 2, in 0..1) between a histogram of counts and one of shares.

    With p the shares of `hist`, q the reference and m their mean, the divergence is the mean of KL(p, m) and KL(q, m).
    """
    q = "array(" + ", ".join(f"{x!r}D" for x in reference) + ")"
    term = lambda x, y: f"if({x} > 0, {x} * log2(2 * {x} / ({x} + {y})), 0D)"
    return f"sqrt(greatest(0D, aggregate(zip_with({hist}, {q}, (p, q) -> {term('p', 'q')} + {term('q', 'p')}), 0D, (a, x) -> a + x) / 2))"


def _share_of(total: Column):
    return lambda x: F.try_divide(x.cast("double"), total)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: dict[str, list[str]] | None = None, min_chars: int = 200, min_words: int = 40, max_char: float = 0.27, max_word: float = 0.3, max_languages: int = 256) -> DataFrame:
    """doc_id, the measures, both distances from the reference that is nearest by the limits, base_failed and kept, for each row."""
    common = COMMON if common is None else common
    # The measures are a few hundred bytes a row and used twice; the texts are read once.
    measures = checkpoint(features(docs, id_col, text_col, lang_col, common))
    refs = references(measures, len({w for ws in common.values() for w in ws}) + 1, max_languages)
    shares = measures
    for hist, total in (("char_hist", F.col("n_chars")), ("word_hist", F.col("n_words"))):
        shares = shares.withColumn(hist, F.when(total > 0, F.transform(hist, _share_of(total))))
    nearest = F.lit(None).cast("struct<off:double,c:double,w:double>")
    if refs:
        far = [F.struct(F.expr(divergence("char_hist", c)).alias("c"), F.expr(divergence("word_hist", w)).alias("w")) for c, w in refs.values()]
        off = F.transform(F.array(*far), lambda x: F.struct(F.greatest(x["c"] / max_char, x["w"] / max_word).alias("off"), x["c"].alias("c"), x["w"].alias("w")))
        nearest = F.when((F.col("n_chars") > 0) & (F.col("n_words") > 0), F.array_min(off))
    out = shares.withColumn("nearest", nearest)
    long_enough = (F.col("n_chars") >= min_chars) & (F.col("n_words") >= min_words)
    far = (F.col("nearest.c") > max_char) | (F.col("nearest.w") > max_word)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("nearest.c").alias("char_distance"), F.col("nearest.w").alias("word_distance"), "base_failed", (~F.col("base_failed") & ~F.coalesce(long_enough & far, F.lit(False))).alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def _oracle(max_char: float = 0.27, max_word: float = 0.3) -> str:
    listed = sorted({w for ws in COMMON.values() for w in ws})
    classes = ["[A-Z]", "[0-9]", r"""[.,;:!?''"()\-]""", r"""[#$%&*+/<=>@\[\\\]^_`{|}~]""", r"[^\x00-\x7F]"]
    counts = ", ".join(f"len(text) - len(regexp_replace(text, '{c}', '', 'g')) AS c{k}" for k, c in enumerate(classes))
    words = ", ".join(f"len(list_filter(ws, lambda w: lower(w) = '{w}'))" for w in listed)
    term = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    far = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {term('z[1]', 'z[2]')} + {term('z[2]', 'z[1]')})) / 2))"
    n_char, n_word = len(classes) + 2, len(listed) + 1
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{k}])" for k in range(1, n + 1)) + "]"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM d WHERE len(ws) >= 5),
runs AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i : i + 4], ' ')) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(0, 5)) AS p FROM runs WHERE n > 1) GROUP BY doc_id),
a AS (SELECT d.doc_id, lang, ws, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars, len(text) AS n_chars,
 (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
 coalesce(rep.n, 0)::BIGINT AS n_repeat_words, {counts} FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
b AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
 [c0, c1, c2, c3, c4, n_chars - word_chars, word_chars - c0 - c1 - c2 - c3 - c4] AS ch, [{words}] AS hits FROM a),
m AS (SELECT *, list_append(hits, n_words - list_sum(hits)) AS wh FROM b),
s AS (SELECT lang, {sums('ch', n_char)} AS cs, {sums('wh', n_word)} AS us FROM m WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang),
r AS (SELECT list_transform(cs, lambda x: x::DOUBLE / list_sum(cs)) AS cq, list_transform(us, lambda x: x::DOUBLE / list_sum(us)) AS uq FROM s),
p AS (SELECT doc_id, list_transform(ch, lambda x: x::DOUBLE / n_chars) AS cp, list_transform(wh, lambda x: x::DOUBLE / n_words) AS up FROM m WHERE n_chars >= 200 AND n_words >= 40 AND NOT base_failed),
j AS (SELECT doc_id, bool_or({far('cp', 'cq')} <= {max_char} AND {far('up', 'uq')} <= {max_word}) AS near FROM p, r GROUP BY doc_id)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(near, true) AS kept
FROM m LEFT JOIN j ON j.doc_id = m.doc_id
"""


ORACLE = _oracle()
