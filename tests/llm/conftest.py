import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASHING = ("Rate2", "Score2", "_llm_fp", "_llm_source", "_llm_row", "_llm_key", "own_5", "a.b", "score", "kept", "n_words", "copy", "rate", "mix_key", "lang_pred", "rejected", "base_failed", "component_id", "fingerprint", "log_weight", "predicted", "ids", "start")

ENGLISH = "the of and to in that is was for with on as by this from or have an they which one all were when there can more said what been who will out about time".split()
GERMAN = "der die das und ist nicht ein eine mit auf für von dem den des sich auch als wird wurde haben werden oder über nach bei schon wie kann mehr".split()


def prose(rng, words, n):
    out = []
    for i in range(n):
        w = rng.choice(words) + rng.choice(["", "", "ing", "er", "ly", "s"])
        out.append(w.capitalize() + "." if i % 11 == 10 else w)
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus():
    """Rows: clean texts of two languages, junk, near copies, exact copies, edge cases."""
    rng = random.Random(4)
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        rows.append((i, prose(rng, ENGLISH if lang == "en" else GERMAN, 60 + rng.randint(0, 150)), lang, f"s{i % 4}", 0))
    for i in range(120, 135):
        rows.append((i, " ".join(w + "$$$" for w in prose(rng, ENGLISH, 90).split()), "en", "s0", 0))
    base = prose(rng, ENGLISH, 300).split()
    for i in range(135, 150):
        copy = list(base)
        copy[i % 300] = f"changed{i}"
        rows.append((i, " ".join(copy) if i % 2 else " ".join(base), "en", "s1", 0))
    return rows


@pytest.fixture(scope="session")
def edge():
    """Nulls in every column, empty and very long texts, repeated rows and ids, odd characters."""
    rng = random.Random(5)
    return [
        (None, None, None, None, None), (None, "text without an id", "en", None, 3), (1000, None, "en", "s0", 0), (1001, "", "en", "s0", 0),
        (1002, " \n\t\n ", None, "s0", 0), (1003, prose(rng, ENGLISH, 60_000), "en", "s0", 0), (1004, "same row", "en", "s0", 8), (1004, "same row", "en", "s0", 8),
        (1004, "another text of this id", "en", "s0", 8), (1005, "x" * 200_000, "en", "s0", 0), (1006, "1234 !!! ²½ 5678", "de", "s9", 0), (1007, "日本語 のテキスト   \x1c é́ \U0001f600", "fr", "s0", 0), (-5, "a", "en", "s0", 1),
    ]


@pytest.fixture(scope="session")
def documents(spark, corpus, edge):
    return spark.createDataFrame(corpus + edge, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, corpus):
    """Documents with extra columns named as operators name theirs."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus[:40] + corpus[135:], SCHEMA)
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 0 if 120 <= i < 135 else 1, int(i % 10 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
