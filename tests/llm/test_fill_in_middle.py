"""Fill-in-middle against its SQL, a plain version, and exact round trips."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from conftest import SCHEMA
from lodestone.llm import fill_in_middle as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["", " ", "\n\n \t", "a", " a", "a ", "<P> a b", "x <S", "P>y <", "z <M", "\U0001f600 b\U0001f600  c\U0001f600", "\x1c\x85 \xa0 e", "<<P", "é é\r\né"]


def plain(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows_of(corpus, edge):
    rng = random.Random(3)
    made = [(5000 + i, "".join(rng.choice(["a", "bé", " ", "\n", "  ", "\t", "<", "P>", "\U0001f600", "."]) for _ in range(rng.randint(0, 40))), None, "s", 0) for i in range(300)]
    return corpus + edge + [(4000 + i, t, None, "s", 0) for i, t in enumerate(ODD * 8)] + made


def test_equals_plain_version_and_sql(spark, corpus, edge):
    rows = rows_of(corpus, edge)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = Counter(plain(r[0], r[1]) for r in rows)
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in M.fill_in_middle(docs).collect())
    assert got == want and {k[2] for k in got} == {"plain", "psm", "spm"}
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})
    c = duckdb.connect()
    c.register("documents", documents)
    digests = M.digests(docs).collect()
    assert Counter(map(tuple, digests)) == Counter(c.sql(M.SQL).fetchall())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r.doc_id, r.restored_sha256) for r in digests) == Counter((r[0], sha(r[1])) for r in rows)


def test_every_grammar_loses_nothing(spark, corpus, edge):
    docs = spark.createDataFrame([r for r in rows_of(corpus, edge) if len(r[1] or "") < 5000], SCHEMA).where("text IS NOT NULL")
    for grammar in M.UNITS:
        rows = docs.select("text", M.units(F.col("text"), grammar).alias("u")).collect()
        assert all("".join(r.u) == r.text and "" not in r.u and (r.text == "") == (not r.u) for r in rows), grammar
        out = M.fill_in_middle(docs, grammar, cut=100).select("text", "form", M.restored(F.col("output"), F.col("form")).alias("back")).collect()
        assert all(r.back == r.text for r in out) and sum(r.form != "plain" for r in out) > 200, grammar
    one = lambda text, grammar: spark.createDataFrame([(text,)], "t string").select(M.units(F.col("t"), grammar)).first()[0]
    assert one("a\n\nb", "lines") == ["a\n", "\n", "b"]
    assert one("ab12 é!", "runs") == ["ab", "12", " ", "é", "!"]
    assert one("One. Two? 3.5。四", "sentences") == ["One.", " Two?", " 3.5。", "四"]
    assert one("\U0001f600é", "characters") == ["\U0001f600", "é"]


def test_shares_and_odd_tables(spark, empty, clashing):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    n = {r.form: r["count"] for r in M.fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(n["plain"] - 1500) < 120 and abs(n["spm"] - 1200) < 120
    assert M.fill_in_middle(empty).count() == 0 and M.digests(empty).count() == 0
    out = M.fill_in_middle(clashing.withColumns({"N": F.lit("mine"), "first": F.lit("own first"), "units": F.lit(1)}))
    assert "N" not in out.columns and out.first()["first"] == "own first" and out.first()["score"] == "own score"
    assert out.columns == [*clashing.columns, "first", "units", *M.ADDED]
