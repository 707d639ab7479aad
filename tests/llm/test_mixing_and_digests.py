import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SCHEMA
from lodestone.llm import digests as D
from lodestone.llm import mixing, quality_rules
from lodestone.llm.mixing import mix, mixed


def in_duckdb(sql, rows):
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    documents["n_chars"] = documents["n_chars"].astype("Int64")
    c = duckdb.connect()
    c.register("documents", documents)
    return c.sql(sql)


def test_mixing_equals_sql(documents, corpus, edge):
    want = Counter((d, t, round(r, 6), c, k) for d, t, _, _, _, r, c, k in in_duckdb(mixing.SQL, corpus + edge).fetchall())
    got = Counter((r.doc_id, r.text, round(r.rate, 6), r.copy, r.mix_key) for r in mix(documents).collect())
    assert got == want


def test_given_weights_are_met(spark):
    rows = [(i, "word " * 20, "en", "big" if i % 10 else "small", 0) for i in range(4000)]
    out = mix(spark.createDataFrame(rows, SCHEMA), {"big": 0.5, "small": 0.5}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in out}
    assert abs(n["big"] - n["small"]) < 0.1 * 4000 and abs(sum(n.values()) - 4000) < 400


def test_rates_above_one_draw(spark):
    """Large means are drawn as sums."""
    rows = [(i, "x" * (1 if i % 500 else 10), "en", "rare" if i % 500 == 0 else "rest", 0) for i in range(1000)]
    out = mix(spark.createDataFrame(rows, SCHEMA), {"rare": 1.0}).groupBy("doc_id").count().collect()
    n = sum(r["count"] for r in out)
    assert {r.doc_id for r in out} == {0, 500} and abs(n - 1018 / 10) < 45


def test_mixing_of_odd_tables(empty, clashing, documents):
    assert mix(empty).count() == 0 and mixed(empty).columns == empty.columns
    assert mixed(clashing).columns == clashing.columns and mixed(clashing).first()["copy"] == "own copy"
    assert mixed(documents).columns == documents.columns


def test_order_is_mixed(documents):
    keys = [r.mix_key for r in mix(documents).coalesce(1).select("mix_key").collect()]
    assert len(set(keys)) > 100 and all(len(k) == 16 for k in keys)


def test_quality_equals_sql(spark, corpus, edge):
    """Sources of other sizes and habits, so that groups have thresholds of their own; edge rows."""
    more = [(2000 + i, " ".join(f"{w}{'#' * (i % (s + 1))}" for w in r[1].split()), r[2], f"t{s}", 0) for s in range(1, 4) for i, r in enumerate(corpus[: 30 * s])]
    rows = corpus + more + [r for r in edge if len(r[1] or "") < 100_000]
    want = Counter(map(tuple, in_duckdb(quality_rules.SQL, rows).fetchall()))
    got = Counter(tuple(r) for r in quality_rules.quality(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == want


def test_fences_follow_the_sketch(spark):
    """A source whose ordinary symbol rate is doubled gets another fence and keeps its documents; junk beside them goes, also where nobody else has a symbol."""
    rng = random.Random(9)

    def text(rate, n=150):
        return " ".join(rng.choice(["word", "text", "other", "thing", "some"]) + str(i) + ("#" if rng.random() < rate else "") for i in range(n))

    def source(first, name, rate, junk):
        return [(first + i, text(rate * (1 + i % 3 / 3)), "en", name, 0) for i in range(300)] + [(first + 300 + i, text(1).replace("#", "###"), "en", name, 0) for i in range(junk)]

    found = {}
    for rate in (0.1, 0.2):
        rows = source(0, "plain", 0.0, 20) + source(1000, "marked", rate, 20)
        measured = quality_rules.written(quality_rules.with_metrics(spark.createDataFrame(rows, SCHEMA)).drop("text"), "measured")
        fences = {r._llm_source: r._llm_high_symbols for r in quality_rules.thresholds(quality_rules.written(quality_rules.sketches(measured), "sketch")).collect()}
        kept = {r.doc_id: r.kept for r in quality_rules.verdicts(measured).collect()}
        for first in (0, 1000):
            assert sum(kept[first + i] for i in range(300)) >= 297 and not any(kept[first + 300 + i] for i in range(20))
        found[rate] = fences
    assert found[0.2]["marked"] > 1.3 * found[0.1]["marked"] and found[0.1]["marked"] > 2 * found[0.1]["plain"]


def brute_level(window):
    return sum(int(D._G[n]) for n in Counter(window).values()) // D._SCALE


def test_levels_equal_their_definition():
    rng = np.random.default_rng(3)
    data = rng.choice(np.frombuffer(b"abcdeee  \n", np.uint8), 400)
    got = D.levels(data)
    assert got.tolist() == [brute_level(data[i : i + D.WINDOW].tobytes()) for i in range(len(data) - D.WINDOW + 1)]


def brute_features(text, ranks):
    """Votes by the definition, one window at a time."""
    raw = text.encode()
    level = [brute_level(raw[i : i + D.WINDOW]) for i in range(len(raw) - D.WINDOW + 1)]
    votes = Counter()
    for i in range(len(level)):
        run = range(i, min(len(level), i + D.NEIGHBOURS))
        votes[min(run, key=lambda j: (ranks[level[j]], j))] += 1
    return sorted(i for i, n in votes.items() if n >= D.VOTES)


def test_features_equal_brute_force(corpus):
    texts = [r[1] for r in corpus[:12]]
    counts = np.bincount(D.levels(np.frombuffer(" ".join(texts).encode(), np.uint8)), minlength=D.LEVELS)
    ranks = D.rank(counts)
    owner, hashes = D._features([t.encode() for t in texts], ranks)
    for i, t in enumerate(texts):
        at = brute_features(t, ranks)
        windows = np.array([list(t.encode()[a : a + D.WINDOW]) for a in at], np.uint8)
        assert hashes[owner == i].tolist() == D._hash(windows).tolist()


def brute_chain(hashes):
    out = []
    for i in range(0, len(hashes), D.FEATURES):
        bits = np.zeros(D.BITS, bool)
        for h in hashes[i : i + D.FEATURES]:
            for k in range(D.HASHES):
                bits[h >> 11 * k & D.BITS - 1] = True
        out.append(bits)
    return out


def brute_likeness(a, b):
    """By the definition, over lists of rows of bits."""
    if not a or not b:
        return float(len(a) == len(b))
    a, b = sorted((a, b), key=len)

    def alike(x, y):
        common, most, chance = int((x & y).sum()), min(int(x.sum()), int(y.sum())), int(x.sum()) * int(y.sum()) / D.BITS
        return 1.0 if common >= most else max(0.0, min(1.0, (common - chance) / max(most - chance, 1e-9)))

    return sum(int(x.sum()) * max(alike(x, y) for y in b) for x in a) / sum(int(x.sum()) for x in a)


def test_chains_and_likeness_equal_brute_force(corpus):
    texts = [r[1] for r in corpus[:9]] + [" ".join(r[1] for r in corpus[:60]), " ".join(r[1] for r in corpus[30:110])]
    ranks = D.rank(np.bincount(D.levels(np.frombuffer(" ".join(texts).encode(), np.uint8)), minlength=D.LEVELS))
    raw = [t.encode() for t in texts]
    owner, hashes = D._features(raw, ranks)
    chains = D.digest(raw, ranks)
    brute = [brute_chain([int(h) for h in hashes[owner == i]]) for i in range(len(raw))]
    for c, b in zip(chains, brute):
        assert np.unpackbits(c, axis=1).astype(bool).tolist() == [x.tolist() for x in b]
    for i in range(len(raw)):
        for j in range(len(raw)):
            want = brute_likeness(brute[i], brute[j])
            assert abs(D.likeness(chains[i], chains[j]) - want) < 1e-12
            assert abs(D.likeness(chains[i], chains[j], block=1, other=2) - want) < 1e-12


def test_stretches_give_the_features_of_the_whole(monkeypatch, corpus):
    texts = [" ".join(r[1] for r in corpus[i : i + 9]).encode() for i in range(0, 60, 7)] + [b"spam " * 300, b"a" * 200, b"0123456789abcdef" * 90 + corpus[3][1].encode()]
    ranks = D.rank(np.arange(D.LEVELS)[::-1])
    whole = [x.tolist() for x in D._features(texts, ranks)]
    for size in (1, 40, 333):
        monkeypatch.setattr(D, "STRETCH", size)
        assert [x.tolist() for x in D._features(texts, ranks)] == whole


def test_a_text_of_twenty_megabytes():
    import resource

    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(5000)]
    text = b" ".join(words[i] for i in rng.integers(0, 5000, 3_500_000))
    assert len(text) > 20_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ranks = D.rank(np.arange(D.LEVELS)[::-1])
    a, b = D.digest([text, text[: len(text) * 3 // 4] + text[::-1][: len(text) // 4]], ranks)
    assert 0.6 < D.likeness(a, b) < 1 and D.likeness(a, a) == 1.0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 900_000  # KB


def test_a_common_id_is_split_into_ranges(spark, corpus):
    rows = [(7 if i % 3 else None if i % 2 else i, r[1]) for i, r in enumerate(corpus)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = D.in_order(docs, 12).where("NOT last").groupBy("bucket").count().collect()
    assert len(placed) > 8 and max(r["count"] for r in placed) < len(rows) / 4
    got = D.fingerprints(docs).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((d, len(t)) for d, t in rows)
    ends = {t[len(t) - len(t) // 4 :] for _, t in rows}
    assert all(r.edited_text[r.n_chars - r.n_chars // 4 :] in {t[: r.n_chars // 4] for _, t in rows} for r in got) and ends


def test_rarity_counts_every_window(documents, corpus, edge):
    want = np.zeros(D.LEVELS, int)
    for r in corpus + edge:
        raw = (r[1] or "").encode()
        if len(raw) >= D.WINDOW:
            want += np.bincount(D.levels(np.frombuffer(raw, np.uint8)), minlength=D.LEVELS)
    assert D.rarity(documents).tolist() == want.tolist()


def test_only_the_empty_text_has_no_digest():
    texts = [p * n for p, n in (("spam ", 400), ("a", 500), ("buy now ", 100), ("0123456789abcdef", 60), ("lorem ipsum ", 80))]
    other = "".join(chr(32 + i * i % 91) for i in range(3000))
    ranks = D.rank(np.bincount(D.levels(np.frombuffer(other.encode(), np.uint8)), minlength=D.LEVELS))
    chains = D.digest([t.encode() for t in [*texts, ""]], ranks)
    assert [len(c) > 0 for c in chains] == [True] * 5 + [False]
    for t, chain in zip(texts, chains, strict=False):
        assert D.likeness(chain, D.digest([D.edited(t, other).encode()], ranks)[0]) > 0.6
    assert max(D.likeness(a, b) for i, a in enumerate(chains) for b in chains[:i]) < 0.3
    falling = [bytes(range(i, i + 64)) for i in range(100)]
    assert all(len(c) for c in D.digest(falling, ranks))


def test_digest_rows(documents, corpus, edge):
    rows = sorted(corpus + edge, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in rows]
    want = Counter()
    for i, t in enumerate(texts):
        n = len(t)
        e = t[: n - n // 4] + texts[(i + 1) % len(texts)][: n // 4]
        want[rows[i][0], n, hashlib.sha256(e.encode()).hexdigest()] += 1
    got = D.fingerprints(documents).collect()
    assert Counter((r.doc_id, r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest()) for r in got) == want
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id is not None and r.doc_id < 120 and r.doc_id >= 0:
            assert r.near_edited > 0.4 > r.near_next
    ids = {r[0]: r[1] for r in corpus}
    for r in got:
        if r.doc_id in ids:
            assert by_text.setdefault(ids[r.doc_id], r.fingerprint) == r.fingerprint
    assert {r.fingerprint for r in got if r.doc_id in (1000, 1001)} == {""}


def test_digests_do_not_depend_on_partitions(documents, clashing, empty, spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    order = lambda df: sorted(map(str, df.collect()))
    assert order(D.fingerprints(docs.repartition(7))) == order(D.fingerprints(docs.coalesce(1)))
    assert D.fingerprints(empty).count() == 0
    assert D.fingerprints(clashing).count() == clashing.count()
    assert D.fingerprints(docs.where(F.col("doc_id") == 3)).count() == 1


def test_ranges_do_not_change_the_result_or_the_plan(spark, corpus):
    """4 and 400 ranges give the same rows; a plan's size doesn't follow them; an id that most rows have is split."""
    rows = [(7 if i % 3 else i, r[1], r[2], r[3], 0) for i, r in enumerate(corpus)] + [(None, "no id", None, None, 0)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)

    def followed(count):
        """The rows that each row is followed by: of a range's rows all but the last one, as tasks read them."""
        read = D.in_order(docs, count).select("bucket", "last", "doc_id", "text").collect()
        pairs, ended = Counter(), set()
        for a, b in zip(read, read[1:], strict=False):
            if a.bucket == b.bucket and not a["last"] and not (b["last"] and a.bucket in ended):
                pairs[(a.doc_id, a.text, b.doc_id)] += 1
        return pairs

    few, many = followed(4), followed(400)
    assert sum(few.values()) == sum(many.values()) == len(rows)
    assert Counter((k[0], k[2]) for k in few.elements()) == Counter((k[0], k[2]) for k in many.elements())
    sizes = [len(D.in_order(docs, n)._jdf.queryExecution().optimizedPlan().toString()) for n in (4, 400)]
    assert sizes[1] < 1.2 * sizes[0]
