import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key long, chunks string, words string"


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, very long, periodic, equal (but for case) and nearly equal texts; ties everywhere."""
    rng = random.Random(5)
    en = ["the", "of", "and", "to", "in", "is", "that", "house", "river", "stone", "over", "cloud", "with", "paper", "winter", "market"]
    de = ["der", "die", "und", "das", "zu", "mit", "ist", "Haus", "Fluß", "Stein", "über", "Wolke", "schön", "Papier", "Markt", "für"]
    passage = words(rng, 60, [f"w{i}" for i in range(500)])
    base = words(rng, 300, [f"n{i}" for i in range(2000)])
    near = base.split()
    near[17] = "changed"
    far = base.split()
    far[::3] = [f"x{i}" for i in range(len(far[::3]))]
    rows = [None, "", " \n\t ", "one", "two words", "The Same Text.\nTwo lines.", "the same text.\nTwo lines.", "THE SAME TEXT.\nTwo lines.", "É the accents differ", "é the accents differ"]
    rows += [base, " ".join(near), " ".join(far), base.upper(), "a " * 200, "ab " * 60 + passage, passage + " tail " + words(rng, 30, en), "head\n" + passage + "\nend"]
    rows += [words(rng, 20_000, en + [f"v{i}" for i in range(5000)])]
    rows += [words(rng, rng.randrange(30, 120), en) + "." for _ in range(30)] + [words(rng, rng.randrange(30, 120), de) + "." for _ in range(30)]
    rows += ["line one here\nline two here\nline three\n\nend " + str(i) for i in range(5)] + ["日本語 text 🙂 \x1c\x85 odd", "no-space-" * 300]
    return [(3 * i + 1, t, "de" if t and ("und" in t or "ist" in t) and "the" not in t else "en" if t else None) for i, t in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, lang, None if i % 2 else "s", None, 1, 2, "c", "w") for i, t, lang in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
