"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A word (a run of letters, in lower case, between < and >) has the features: itself and its character n-grams,
hashed into BUCKETS rows of an embedding matrix. A document is the mean of the rows of all features of all its
words. Matrix and softmax are trained together by stochastic gradient descent in numpy, on the driver, from a sample:
at most ROWS_PER_LANGUAGE rows of each of the LANGUAGES most frequent labels, and SAMPLE_CHARACTERS in all.

Outsiders stand for text of no known language: words of sample texts with their letters shuffled, or replaced
one for one by letters of a random alphabet. Three fifths of the sample train, some of them also as outsiders, whose target is
all labels equally. A fifth calibrates the temperature (least log loss, outsiders included). The last fifth sets the
score below which a document is rejected: the least that at most FALSE_ACCEPTANCE of its outsiders reach, but not
so high that more than FALSE_REJECTION of its real texts fall below. The model carries both rates as measured.

The model is linear, so a word adds a fixed vector to its document; workers keep the vectors of words seen lately.

Null and empty text, and text without a letter, is `und`, score 0, rejected. Very long texts are scored whole; memory follows the
longest one. Equal texts have equal results, so repeated rows do; equal scores go to the first label in order. An empty table
gives no rows; without a labelled row every row is `und`. Other columns of docs are not read by `identify`; `keep_known` returns them all, also
those named like its own.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import groups, map_adding, sampled, texts_of, through

BUCKETS, DIMENSIONS, ORDERS = 1 << 14, 16, (2, 3, 4)
#: Bounds of the sample.
ROWS_PER_LANGUAGE, LANGUAGES, SAMPLE_CHARACTERS = 500, 200, 16_000_000
#: STEPS: batches of gradient descent in all, however small the sample.
STEPS, RATE, BATCH = 400, 2.0, 32
FALSE_ACCEPTANCE, FALSE_REJECTION = 0.05, 0.002
#: Words of an outsider at most, and the alphabets that its letters may come from.
OUTSIDER_WORDS, STRANGE = 120, "abcdefghijklmnopqrstuvwxyzàâäçèéêëîïíñóôöùûüúßαβγδεζηθικλμνξοπρστυφχψωабвгдежзийклмнопрстуфхцчшщыьэюя"
#: Words a worker keeps the vectors of.
CACHED_WORDS = 200_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashed features of a word of letters."""
    w = f"<{word}>"
    grams = [w] + [w[i : i + n] for n in ORDERS for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; the pattern also finds signs such as ², which `is_word` tells apart."""
    return _WORD.findall(text.lower())


def is_word(run: str) -> bool:
    return any(map(str.isalpha, run))


def outsider(words: list[str], rng: np.random.Generator) -> list[str]:
    """Words of no language: the letters of some words shuffled, or replaced by those of a random alphabet."""
    n = int(rng.integers(3, OUTSIDER_WORDS))
    at = int(rng.integers(0, max(1, len(words) - n)))
    some = words[at : at + n]
    letters = "".join(some)
    if rng.integers(2):
        new = "".join(np.array(list(letters))[rng.permutation(len(letters))])
    else:
        own = sorted(set(letters))
        new = letters.translate(dict(zip(map(ord, own), np.array(list(STRANGE * (len(own) // len(STRANGE) + 1)))[rng.permutation(len(STRANGE) * (len(own) // len(STRANGE) + 1))], strict=False)))
    out, done = [], 0
    for w in some:
        out.append(new[done : done + len(w)])
        done += len(w)
    return out


@dataclass
class LanguageModel:
    labels: list[str]
    vectors: np.ndarray  # BUCKETS x labels: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float
    false_acceptance: float = 0.0  # of outsiders, as measured on the last fifth
    false_rejection: float = 0.0  # of its texts

    def word(self, word: str) -> tuple[np.ndarray, int]:
        f = features(word)
        return self.vectors[f].sum(0), len(f)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def mean_features(words: list[str], cache: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets of a text's words and their shares; None without words."""
    found: list[int] = []
    for w in words:
        if w not in cache:
            cache[w] = features(w)
        found += cache[w]
    if not found:
        return None
    keys, counts = np.unique(np.array(found), return_counts=True)
    return keys, (counts / len(found)).astype(np.float32)


def _threshold(real: np.ndarray, strange: np.ndarray) -> float:
    """The score that rejects all but FALSE_ACCEPTANCE of strange scores, or FALSE_REJECTION of real ones if that is less."""
    by_outsiders = np.nextafter(np.sort(strange)[-int(FALSE_ACCEPTANCE * len(strange)) - 1], 2) if len(strange) else 0.0
    return float(min(by_outsiders, np.sort(real)[int(FALSE_REJECTION * len(real))] if len(real) else by_outsiders))


def fit(texts: list[str], labels: list[str], seed: int = 7) -> LanguageModel | None:
    """The model of labelled texts; None if no text has a letter."""
    known = sorted(set(labels))
    cache: dict[str, list[int]] = {}
    texts_words = [[w for w in words_of(t) if is_word(w)] for t in texts]
    usable = [i for i, w in enumerate(texts_words) if w]
    if not usable:
        return None
    rng = np.random.default_rng(seed)
    order = [usable[i] for i in rng.permutation(len(usable))]
    fifth = len(order) // 5
    folds = [order[2 * fifth :], order[:fifth] or order, order[fifth : 2 * fifth] or order]
    rows = [[(mean_features(texts_words[i], cache), known.index(labels[i])) for i in fold] for fold in folds]
    strange = [[(mean_features(outsider(texts_words[i], rng), {}), -1) for i in fold] for fold in (folds[0][::3], folds[1], folds[2])]
    goals = np.vstack([np.eye(len(known), dtype=np.float32), np.full((1, len(known)), 1 / len(known), np.float32)])  # the last: of outsiders
    train = rows[0] + strange[0]
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(known))).astype(np.float32)
    bias = np.zeros(len(known), np.float32)
    a_round = -(-len(train) // BATCH)
    epochs = -(-STEPS // a_round)
    steps, done = epochs * a_round, 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(train)).tolist()
        for at in range(0, len(train), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            chosen = [train[i] for i in shuffled[at : at + BATCH]]
            hidden = np.stack([v @ embedding[k] for (k, v), _ in chosen])
            p = (_softmax(hidden @ weights + bias) - goals[[y for _, y in chosen]]) / len(chosen)
            back = p @ weights.T
            weights -= rate * hidden.T @ p
            bias -= rate * p.sum(0)
            for ((k, v), _), g in zip(chosen, back, strict=True):
                embedding[k] -= rate * 100 * v[:, None] * g  # rows of a mean have small gradients
    vectors = embedding @ weights
    logits = lambda some: np.stack([v @ vectors[k] for (k, v), _ in some]) + bias
    z, goal = logits(rows[1] + strange[1]), goals[[y for _, y in rows[1] + strange[1]]]
    grid = np.geomspace(0.1, 20, 80)
    loss = [-(goal * np.log(_softmax(z / t) + 1e-12)).sum(1).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    best = lambda some: _softmax(logits(some) / temperature).max(1)
    real, odd = best(rows[2]), best(strange[2])
    least = _threshold(real, odd)
    return LanguageModel(known, vectors.astype(np.float32), bias, temperature, least, float((odd >= least).mean()), float((real < least).mean()))


class Scorer:
    def __init__(self, model: LanguageModel):
        self.model, self.places = model, {}
        self.table = np.zeros((1024, len(model.labels) + 1), np.float32)

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Labels, scores and whether the model rejects."""
        if len(self.places) > CACHED_WORDS:
            self.places = {}
        places, codes, ends = self.places, [], []
        for t in texts:
            for w in words_of(t):
                at = places.get(w)
                if at is None:
                    if not is_word(w):
                        continue
                    at = places[w] = len(places)
                    if at >= len(self.table):
                        self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    self.table[at, :-1], self.table[at, -1] = self.model.word(w)
                codes.append(at)
            ends.append(len(codes))
        ends = np.array(ends)
        found = np.diff(ends, prepend=0) > 0
        sums = np.zeros((len(texts), self.table.shape[1]))
        if codes:
            added = self.table[np.array(codes)].astype(np.float64)
            sums[found] = np.add.reduceat(added, np.r_[0, ends[:-1]][found], axis=0)
        z = (sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.model.bias) / self.model.temperature
        p = _softmax(z)
        best = p.argmax(1)
        score = np.where(found, p.max(1), 0.0)
        labels = [self.model.labels[b] if f else UNKNOWN for b, f in zip(best.tolist(), found.tolist(), strict=True)]
        return labels, score, ~found | (score < self.model.reject_below)


_SCORERS: dict[str, Scorer] = {}


def scorer(name: str, model: LanguageModel) -> Scorer:
    """This worker's scorer of a model."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(model)
    return _SCORERS[name]


def held_out(key: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id as text is 2 modulo 4. A null id is neither held out nor learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, languages: int = LANGUAGES, characters: int = SAMPLE_CHARACTERS) -> LanguageModel | None:
    """Fit on rows of docs (doc_id, text, lang) that are not held out and have text and lang, within these bounds."""
    usable = docs.select("doc_id", "text", F.col("lang").alias("label")).where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    common = usable.groupBy("label").count().orderBy(F.desc("count"), "label").limit(languages).collect()
    rows = sampled(usable, {r["label"]: r["count"] for r in common}, rows_per_language, characters)
    return fit([t for t, _ in rows], [y for _, y in rows])


def with_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs plus lang_pred, score and rejected. Null text, and text without a letter, is `und` with score 0, rejected.

    Without a model (nothing to learn from) that holds for every row.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # at most BUCKETS rows of LANGUAGES numbers

    def add(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = texts_of(batch)
        if shared.value is None:
            labels, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        else:
            parts = [scorer(name, shared.value)(g) for g in groups(texts)]
            labels = [x for p in parts for x in p[0]]
            score, rejected = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        return {"lang_pred": pa.array(labels, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected)}

    return map_adding(docs, {"lang_pred": "string", "score": "double", "rejected": "boolean"}, add)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document; lang, source and doc_id never enter a prediction."""
    return with_language(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs that the model doesn't reject, with the columns of docs."""
    return through(docs, lambda inner: with_language(inner, train(inner)).where("NOT rejected"))
