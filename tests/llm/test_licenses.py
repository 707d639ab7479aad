"""The license scan against its SQL, against regular expressions, and on edited license texts."""

import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SCHEMA
from lodestone.llm import licenses as L

MIT = L._MARK.sub(lambda m: "the authors" if m[1].startswith("words") else "", L.TEMPLATES[1][1])


def written_out(rng, source):
    """A text that a template accepts: optional wording left out or not, replaced wording of random length."""
    out, stack, end = [], [True], 0
    for mark in [*L._MARK.finditer(source), None]:
        if all(stack):
            out += L.normalised(source[end : mark.start() if mark else None]).decode().split()
        if mark is None:
            return out
        end = mark.end()
        if mark[1] == "optional":
            stack.append(rng.random() < 0.5)
        elif mark[1] == "end":
            stack.pop()
        elif all(stack):
            out += [rng.choice(["foo", "the", "license", "é"]) for _ in range(rng.randint(int(mark[2]), int(mark[3])))]


def edited(rng, words):
    words = list(words)
    for _ in range(rng.randint(1, 2)):
        i = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.3:
            words.insert(i, "junk")
        elif kind < 0.6 and len(words) > 1:
            del words[i]
        else:
            words[i] = rng.choice(["the", "of", "license"])
    return words


def test_automata_equal_regular_expressions():
    rng, hits, misses = random.Random(2), 0, 0
    for source in L.TEMPLATES:
        template = L.Template(*source)
        pattern = re.compile(template.pattern().encode())
        for _ in range(60):
            words = written_out(rng, template.source)
            if rng.random() < 0.5:
                words = edited(rng, words)
            around = [[rng.choice(["a", "this", "licensed"]) for _ in range(rng.randint(0, 3))] for _ in range(2)]
            text = f" {' '.join(around[0] + words + around[1])} ".encode()
            want, got = pattern.search(text), list(template.places(text))
            assert bool(got) == bool(want), text
            if got:
                assert got[0][0] == want.start() and pattern.fullmatch(text[got[0][0] : text.find(b" ", got[0][0] + 1) + 1] + b"x") is None
            hits, misses = hits + bool(want), misses + (not want)
    assert hits > 300 and misses > 300


def test_mandatory_wording_is_exact():
    scanner = L.Scanner(L.PHRASES, L.TEMPLATES)
    labels = lambda text: {p[0] for p in scanner.scan(text)[1]}
    assert labels(MIT) == {"mit"} and scanner.scan(MIT)[2] == pytest.approx(158 / 162)
    assert labels(MIT.replace("sublicense", "")) == set() and labels(MIT.replace("without restriction", "with restriction")) == set()
    assert labels(MIT.upper().replace(" ", "\n// ")) == {"mit"}
    assert labels(MIT.replace("the authors", "A. B. Smith and all of the other contributors")) == {"mit"}
    assert labels(MIT.replace("the authors", "x " * 13)) == set()
    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"gpl-3"}
    assert labels("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version") == {"gpl-3", "gpl-or-later"}
    assert labels("Licensed under CC BY-SA 4.0") == {"cc-by-sa"} and labels("Licensed under CC BY-NC 4.0") == {"cc-by-nc"}
    n, places, score = scanner.scan("x Under the MIT-License. y under the mit license")
    assert n == 10 and [p[:3] for p in places] == [("mit", -1, 1)[:2] + (1,), ("mit", -1, 6)] and score == 0.5


def test_templates_must_be_whole():
    for bad in ("<<optional>> a", "a <<end>> b", "<<words 1-2>> a", "a <<words 0-2>>", "<<optional>>a<<end>>", "a <<words 3-2>> b"):
        with pytest.raises(ValueError):
            L.Template("x", bad)
    t = L.Template("x", "a <<optional>>b <<optional>>c<<end>><<end>> <<words 0-2>> d")
    found = lambda s: [(at, n) for at, n in t.places(f" {s} ".encode())]
    assert found("a d") == [(0, 2)] and found("a b d a b c x y d") == [(0, 3), (6, 6)] and found("a x y z d") == [] and found("a a a d") == [(0, 4)] and found("a a a a d") == [(2, 4)]


def test_equals_sql(spark, corpus, edge):
    rng = random.Random(8)
    rows = corpus + edge
    for i in range(300):
        label, source = L.TEMPLATES[i % len(L.TEMPLATES)]
        words = written_out(rng, source)
        if i % 3 == 0:
            words = edited(rng, words)
        rows.append((3000 + i, " ".join(["start", *words, "end", *rng.choice(["under the MIT license!", "CC-BY-NC cc by nc", "Apache License, Version 2.0 apache license version 2", ""]).split()]), "en", "s", 0))
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})
    c = duckdb.connect()
    c.register("documents", documents)
    got = L.digests(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(c.sql(L.SQL).fetchall())
    assert sum(r.labels != "" for r in got) > 150
    of = {r.doc_id: r for r in got}
    assert of[1000].n_words == 0 and of[1000].labels == "" and of[1000].first_word is None and of[1000].score == 0


def test_long_texts_and_odd_tables(spark, empty, clashing):
    words = ("word " * 300_000) + MIT + " tail" * 300_000
    assert L.normalised(words, 1000) == L.normalised(words)
    assert L.normalised("x" * 5000 + " y", 1000) == b" " + b"x" * 5000 + b" y "
    n, places, _ = L.Scanner(L.PHRASES, L.TEMPLATES).scan(words)
    assert places[0][2] == 300_000 and places[0][:2] == ("mit", 1) and n == places[0][3] + 1 + 300_000
    assert L.scan(empty).count() == 0 and L.digests(empty).count() == 0
    out = L.scan(clashing.withColumns({"Labels": F.lit("mine"), "words": F.lit("own words")}))
    assert out.columns == [*(c for c in clashing.columns if c not in ("score", "n_words")), "words", *L.ADDED]
    assert out.first()["words"] == "own words" and out.first()["kept"] == "own kept"
    named = L.scan(clashing.select(F.col("doc_id"), F.lit("foo bar").alias("text")), {"foo bar": "z"}, [("y", "foo <<words 0-1>> bar")]).first()
    assert named.labels == ["y", "z"] and named.places[0].first == 0 and named.score == pytest.approx(2 / 6)
