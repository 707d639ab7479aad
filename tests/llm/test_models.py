"""Language ID, toxicity, quality rules, resampling and LM scoring."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import ENGLISH, GERMAN, SCHEMA, prose
from lodestone.llm import language_id as L
from lodestone.llm import lm_scoring as M
from lodestone.llm import quality_rules as Q
from lodestone.llm import resampling as I
from lodestone.llm import toxicity as X


def test_language(documents, corpus, edge):
    rows = L.identify(documents).collect()
    assert len(rows) == len(corpus) + len(edge)
    lang = {r[0]: r[2] for r in corpus}
    held = [r for r in rows if r.held_out and r.doc_id in lang]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002, 1006):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    kept = L.keep_known(documents)
    assert kept.columns == documents.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(120)) <= ids and not {1000, 1001, 1002, 1006} & ids


def test_language_without_labels_or_rows(spark, documents, empty, clashing):
    assert L.identify(empty).count() == 0
    none = documents.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in L.identify(none).collect()} == {("und", 0.0)}
    assert L.keep_known(clashing).columns == clashing.columns
    assert L.keep_known(clashing).first()["score"] == "own score"


def language_texts():
    rng = random.Random(3)
    return [prose(rng, ENGLISH if i % 2 else GERMAN, 40 + rng.randint(0, 80)) for i in range(600)], ["en" if i % 2 else "de" for i in range(600)]


def test_rejection_is_calibrated():
    """Outsiders that the model has not seen are rejected at the stated rate, texts of its languages are kept."""
    model = L.fit(*language_texts())
    assert model.false_acceptance <= L.FALSE_ACCEPTANCE and model.false_rejection <= L.FALSE_REJECTION + 1 / 100
    rng, score = np.random.default_rng(77), L.Scorer(model)
    texts, _ = language_texts()
    strange = [" ".join(L.outsider(t.split(), rng)) for t in texts]
    assert score(strange)[2].mean() > 0.8 and score(texts)[2].mean() < 0.02


def test_language_scores_equal_brute_force():
    """Mean of the vectors of all features of all words, bias, temperature, softmax."""
    import zlib

    model = L.fit(*language_texts())
    texts = ["the quick brown", "Über-raschung ², und das", "x", "1234", "das das the"]
    labels, scores, rejected = L.Scorer(model)(texts)
    for t, label, s, r in zip(texts, labels, scores, rejected):
        rows = []
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            marked = f"<{w}>"
            for g in [marked] + [marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)]:
                rows.append(model.vectors[zlib.crc32(g.encode()) % L.BUCKETS])
        if not rows:
            assert (label, s, r) == ("und", 0.0, True)
            continue
        z = (np.mean(rows, axis=0) + model.bias) / model.temperature
        p = np.exp(z) / np.exp(z).sum()
        assert label == model.labels[int(p.argmax())] and abs(s - p.max()) < 1e-5 and r == (s < model.reject_below)


def brute_metrics(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = Counter(x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r"))
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), sum(n - 1 for n in lines.values()), len(covered)


def test_quality(documents, corpus, edge, empty, clashing):
    texts = Counter((r[0], *brute_metrics(r[1])) for r in corpus + edge)
    rows = Q.quality(documents).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == texts
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in rows if r.kept}
    assert len(kept & set(range(120))) >= 118 and not kept & set(range(120, 135))
    assert Q.quality(empty).count() == 0
    out = Q.keep_good(clashing)
    assert out.columns == clashing.columns and out.first()["n_words"] == "own n_words"


def test_metrics_of_texts_with_line_and_word_repeats():
    for t in ("a b c a b c", "x\nx\n\ny\nx", "a a a a", "one two", "é é é é é", " $ \n $ "):
        n = brute_metrics(t)
        assert Q.measure(t)[:5] == n or (n[0] == 0 and Q.measure(t)[0] == 0)


def test_buckets_bound_the_error(spark):
    rows = spark.range(0, 100_000, 37).select("id", Q.bucket(F.col("id")).alias("b")).collect()
    assert all(r.b <= r.id < r.b * 33 / 32 + 1 for r in rows)


INSULTS = ("blockhead", "nitwit", "dimwit")


def toxic_corpus(n=700):
    rng, rows = random.Random(9), []
    for i in range(n):
        words = prose(rng, ENGLISH, 80).split()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), "en", "s0", 0))
    return rows


@pytest.fixture(scope="module")
def toxic_model():
    rows = toxic_corpus()
    return X.fit([r[1] for r in rows], [int(r[0] % 4 == 0) for r in rows])


def test_toxicity_tolerates_gaps_and_insertions(toxic_model):
    rng = random.Random(2)
    score = X.Scorer(toxic_model)
    clean = score([prose(rng, ENGLISH, 100) for _ in range(200)])
    assert (clean >= 0.5).mean() < 0.03
    for word in ("blockhead", "block-head", "b.l.o.c.k.h.e.a.d", "b l o c k h e a d", "blockxhead", "bl0ckhead", "NITWIT!", "nit*wit", "dimm-wit"):
        assert score([f"this is a {word} of a text"])[0] >= 0.5, word


def test_labels_are_of_sentences(monkeypatch, toxic_model):
    """Without the splitter the machine is another one."""
    real = X.Reader.__call__

    def whole(self, texts):
        monkeypatch.setattr(X, "WORDS", 1 << 30)
        return real(self, [t.replace(".", "").replace("\n", " ") for t in texts])

    monkeypatch.setattr(X.Reader, "__call__", whole)
    rows = toxic_corpus()
    other = X.fit([r[1] for r in rows], [int(r[0] % 4 == 0) for r in rows])
    assert other.landmarks != toxic_model.landmarks or abs(other.weights - toxic_model.weights).max() > 0.1


def brute_kernel(a, b):
    """The subsequence kernel of two words by its definition."""
    from itertools import combinations

    def features(word):
        s, out = f"<{word}>", Counter()
        for i, j, k in combinations(range(len(s)), 3):
            if k - i < X.SPAN:
                out[s[i], s[j], s[k]] += X.DECAY ** (k - i + 1)
        norm = math.sqrt(sum(v * v for v in out.values()))
        return {c: v / norm for c, v in out.items()}

    fa, fb = features(a), features(b)
    return sum(v * fb.get(c, 0) for c, v in fa.items())


def test_nystroem_features_give_the_kernel_of_landmarks(toxic_model):
    marks = toxic_model.landmarks[:40]
    kernel = X.Kernel(marks)
    k = X._POWERS[kernel(marks)]
    for i in range(0, 40, 7):
        for j in range(0, 40, 5):
            assert abs(k[i, j] - brute_kernel(marks[i], marks[j]) ** X.POWER) < 0.01
    z = k @ X.whitening(kernel, marks)
    assert abs(z @ z.T - k).max() < 0.05


def brute_sentences(text):
    import re

    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text):
        words, run = [], ""
        for t in [*(x for x in map(X.plain, sentence.split()) if x), ""]:
            if len(t) == 1:
                run += t
                continue
            if len(run) >= X.LETTERS:
                words.append(run)
            run = ""
            words += [t] if t else []
        for i in range(0, len(words), X.WORDS):
            some = words[i : i + X.WORDS]
            yield some + [a + b for a, b in zip(some, some[1:]) if max(len(a), len(b)) <= X.JOINED]


def test_scores_equal_brute_force(toxic_model):
    """A document: the highest of its sentences; a sentence: weights times the powers of its best kernel values."""
    rng = random.Random(6)
    texts = [prose(rng, ENGLISH, 40) + "\nYou are a nit wit. b l o c k h e a d!", "Hi there. dim-wit x y z", "", "!!! 12", prose(rng, ENGLISH, 90).replace(".", "")]
    got = X.Scorer(toxic_model)(texts)
    for t, g in zip(texts, got):
        best = toxic_model.bias
        for words in brute_sentences(t):
            value = [max(max(round(255 * min(1, brute_kernel(p, m))) for p in X.pieces(w)) for w in words) / 255 for m in toxic_model.landmarks] if words else []
            if words:
                best = max(best, toxic_model.bias + sum(w * v**X.POWER for w, v in zip(toxic_model.weights, value)))
        assert abs(g - 1 / (1 + math.exp(-(toxic_model.slope * best + toxic_model.shift)))) < 0.02


def test_toxicity_query(spark, documents, empty, clashing):
    rows = toxic_corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(r[0], int(r[0] % 4 == 0)) for r in rows], "doc_id long, toxic int")
    out = X.toxicity(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(rows) and held
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in out)
    few = X.toxicity(documents, labels).collect()
    assert {r.predicted for r in few if r.doc_id in (1000, 1001, 1002)} == {0}
    assert X.toxicity(empty, labels).count() == 0
    assert X.toxicity(clashing, labels.limit(0)).count() == clashing.count()


def test_subsequence_kernel_equals_its_definition():
    from itertools import combinations

    def features(word):
        s, out = f"<{word}>", Counter()
        for i, j, k in combinations(range(len(s)), 3):
            if k - i < X.SPAN:
                out[s[i], s[j], s[k]] += X.DECAY ** (k - i + 1)
        norm = math.sqrt(sum(v * v for v in out.values()))
        return {c: v / norm for c, v in out.items()}

    for a, b in (("idiot", "idxiot"), ("aab", "abba"), ("x", "xx")):
        fa, fb = features(a), features(b)
        kernel = sum(v * fb.get(c, 0) for c, v in fa.items())
        dense = np.zeros((2, X._SIZE**3))
        for rows, r, codes, each in X.spectra([a, b]):
            dense[rows[r], codes] += each
        assert abs(dense[0] @ dense[1] - kernel) < 1e-9


def test_resampling(documents, labels, empty, clashing, corpus, edge):
    good = labels.where("quality = 1")
    rows = I.resample(documents, good, 0.8).collect()
    assert len(rows) == len(corpus) + len(edge) and sum(r.kept for r in rows) == round(0.8 * len(rows))
    least = min(r.gumbel_key for r in rows if r.kept)
    assert all(r.gumbel_key <= least for r in rows if not r.kept)
    assert not any(r.kept for r in rows if r.doc_id is not None and 120 <= r.doc_id < 135)
    assert {(r.n_features, r.log_weight) for r in rows if r.doc_id in (1000, 1001, 1002)} == {(0, 0.0)}
    again = {(r.doc_id, r.log_weight, r.gumbel_key): r.kept for r in I.resample(documents.repartition(2), good, 0.8).collect()}
    assert all(again[r.doc_id, r.log_weight, r.gumbel_key] == r.kept for r in rows if r.doc_id not in (None, 1004))
    assert I.resample(empty, good, 0.5).count() == 0
    assert sum(r.kept for r in I.resample(clashing, good.limit(0), 1.0).collect()) == clashing.count()


def test_resampling_weights_equal_brute_force(spark, corpus, labels):
    import zlib

    def features(t):
        tokens = [zlib.crc32(x.encode()) for x in I._TOKEN.findall(t.lower())]
        mix = lambda a, b: (((a * 0x9E3779B97F4A7C15 % 2**64) ^ b) * 0xD6E8FEB86659FD93 % 2**64 >> 20) % I.BUCKETS
        return [x % I.BUCKETS for x in tokens] + [mix(a, b) for a, b in zip(tokens, tokens[1:])]

    raw, target = Counter(), Counter()
    for r in corpus:
        raw.update(features(r[1]))
        if not 120 <= r[0] < 135:
            target.update(features(r[1]))
    n, m = sum(raw.values()), sum(target.values())

    def weight(r):
        own = Counter(features(r[1]))
        size, mine = sum(own.values()), not 120 <= r[0] < 135
        return sum(k * (math.log((target[f] - k * mine + 1) / (m - size * mine + I.BUCKETS)) - math.log((raw[f] - k + 1) / (n - size + I.BUCKETS))) for f, k in own.items())

    got = {r.doc_id: (r.log_weight, r.gumbel_key) for r in I.resample(spark.createDataFrame(corpus, SCHEMA), labels.where("quality = 1"), 0.5).collect()}
    for r in corpus:
        assert abs(got[r[0]][0] - weight(r)) < 1e-6
        x = (r[0] + I.SEED * 0x9E3779B97F4A7C15) % 2**64
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * by % 2**64
        u = ((x ^ x >> 31) >> 11) + 0.5
        assert abs(got[r[0]][1] - got[r[0]][0] + math.log(-math.log(u / 2**53))) < 1e-6


def test_flags_by_broadcast_and_by_shuffle(spark, monkeypatch, documents):
    from lodestone.llm import shared

    ids = spark.createDataFrame([(1,), (1,), (None,), (1004,), (9999,)], "doc_id long")
    for rows in (100, 1):
        monkeypatch.setattr(shared, "FLAGGED_ROWS", rows)
        got = Counter((r.doc_id, r.f) for r in shared.flagged(documents, ids, "f").collect())
        assert got == Counter((r.doc_id, r.doc_id in (1, 1004)) for r in documents.collect())


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.randint(-(2**63), 2**63 - 1), 7, -7, 0]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    ordered = sorted(((v, i) for i, v in enumerate(values)), reverse=True)
    for k in (1, 2, 250, 499, 500):
        assert I.kth_largest(df, ["v", "i"], k) == ordered[k - 1]
    assert I.kth_largest(df, ["v"], 501) is None


def brute_lm(rows, good):
    from lodestone.llm.encoding import SegmentEncoder, tokenizer_path

    tok = SegmentEncoder(tokenizer_path()).tokenizer
    size = max(tok.get_vocab(with_added_tokens=True).values()) + 1
    docs = [(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    models = []
    for keep in (lambda d: True, lambda d: d in good):
        uni, pair, ctx = Counter(), Counter(), Counter()
        for d, ids in docs:
            if keep(d):
                uni.update(ids)
                pair.update(zip([size, *ids], ids))
                ctx.update([size, *ids][: len(ids)])
        models.append((uni, pair, ctx, sum(uni.values())))
    mus = (M.SMOOTHING * models[0][3] / max(1, models[1][3]), M.SMOOTHING)
    out = []
    for d, ids in docs:
        pairs = list(zip([size, *ids], ids))
        own, own_ctx = Counter(pairs), Counter(v for v, _ in pairs)
        loss = []
        for (uni, pair, ctx, n), mu, mine in zip(models, mus, (True, d in good)):
            total = 0.0
            for v, w in pairs:
                p1 = (uni[w] + 1) / (n + size)
                total -= math.log((pair[v, w] - mine * own[v, w] + mu * p1) / (ctx[v] - mine * own_ctx[v] + mu))
            loss.append(total / len(ids) if ids else 0.0)
        out.append((d, len(ids), round(loss[1], 6), round(loss[0], 6), round(loss[1] - loss[0], 6)))
    return out


@pytest.mark.parametrize("mapped", [True, False])
def test_lm_scores_equal_brute_force(spark, monkeypatch, corpus, edge, labels, mapped):
    """One pair, that of `the the`, is a tenth of all; parts are small, so that there are several of each."""
    monkeypatch.setattr(M, "BLOCK_TOKENS", 3000)
    monkeypatch.setattr(M, "RANGE_PAIRS", 500)
    monkeypatch.setattr(M, "MERGED_TOKENS", 100)
    monkeypatch.setattr(M, "ANSWERED_TOKENS", 300)
    rows = [r for r in corpus + edge if len(r[1] or "") < 5000] + [(3000 + i, "the " * 300, "en", "s0", 0) for i in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    good = labels.where("quality = 1")
    got = M.score(docs, good, model_pairs=M.MODEL_PAIRS if mapped else 0).collect()
    want = brute_lm(rows, {i for i in range(150) if not 120 <= i < 135})
    order = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss, r.score) for r in got), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=order)):
        assert a[:2] == b[:2] and all(abs(x - y) < 1e-5 for x, y in zip(a[2:], b[2:]))


def test_counts_beyond_32_bits(tmp_path):
    keys, counts = np.array([3, 7, 1 << 40], np.int64), np.array([1, 1 << 33, 5 << 32], np.int64)
    sent = [b for part in range(3) for b in M._rows_of(4, part % 1, keys, counts, counts // 2)]
    merged = {}
    list(M._merged(iter(sent), lambda r, *c: iter([merged.update({r: c})])))
    assert merged[4][1].tolist() == (3 * counts).tolist() and merged[4][2].tolist() == (3 * (counts // 2)).tolist()
    (tmp_path / "range-00004").write_bytes(b"".join(c.astype("<i8").tobytes() for c in merged[4]))
    M._range.cache_clear()
    assert [c.tolist() for c in M._range(str(tmp_path), 4)] == [c.tolist() for c in merged[4]]


def test_lm_scoring_of_little(documents, empty, labels, clashing):
    good = labels.where("quality = 1")
    assert M.score(empty, good).count() == 0
    assert M.score(clashing, good.limit(0)).count() == clashing.count()
    out = {r.doc_id: r for r in M.score(documents, good).collect()}
    assert out[1000].n_tokens == 0 and out[1000].score == 0.0
    junk, clean = [[out[i].score for i in part] for part in (range(120, 135), range(120))]
    assert min(junk) > max(clean)
