"""Toxicity: a support vector machine over a subsequence string kernel of sentences, with Nystroem landmarks.

The kernel of two words counts common subsequences of three letters, each occurrence weighted by DECAY to the power of
the letters it spans, over the norms of both; so a word with gaps or inserted characters stays close to the word meant.
A word's subsequences span at most SPAN letters, its ends count as letters, and longer tokens are read in overlapping
pieces of PIECE letters. The third power of it (POWER) is a kernel too, and sets near forms apart from chance likeness.

The examples are sentences; one of over WORDS words is cut into several. A sentence has its words and, for
insults that are split, each two neighbours of up to JOINED letters closed up. Its kernel with a landmark is that of
its best word, and the Nystroem map takes these values, whitened by the landmarks' own kernel matrix. Landmarks are words
of the sample: those that speak most for toxic documents, clean ones closest to them, and frequent ones.

Labels are of documents, so sentences are labelled in rounds (multiple-instance learning). All sentences of clean
documents are negative. Of a toxic document one sentence is positive: first the one with the most telling word (by the
likelihood ratio, SURE at least), then the one that the last machine puts highest, if above zero; other toxic
documents wait, since some labels have no ground in the text. Each positive sentence is an example again with a letter inserted into its
most telling word. Each round adds the clean sentences that the machine takes for
toxic. The machine is linear with hinge loss, trained by dual coordinate descent. A document's decision is the highest of its sentences', its score
a logistic function of it fitted to the training documents.

Words are found in lower case; letters outside ALPHABET lose their accents, and digits and signs that imitate a letter inside a word are
read as it. Characters between letters of a token, and runs of single letters, are closed up: i.d.i.o.t and i d i o t.

Null and empty texts, and those without a word, have the score of no evidence. Texts are scored whole, a group at a time, so very long ones cost
memory in proportion to one text. Repeated rows have equal scores; ties don't arise. Empty tables give no rows. Other columns of
the inputs are not read, so their names don't matter to `toxicity`; `with_toxicity` replaces score and predicted. Without both labels
all scores are equal.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drawn, groups, map_adding, sampled, texts_of, written

DECAY, LETTERS, SPAN, PIECE, POWER = 0.75, 3, 6, 20, 3
WORDS, JOINED = 32, 4
LANDMARKS, EPOCHS, ROUNDS, COST = 200, 12, 6, 2.0
#: Clean sentences drawn for the first round, and added in each of the later ones at most.
NEGATIVES, HARD = 4000, 2000
#: Weight of a sentence with an inserted letter where scores are fitted, against a clean document.
VARIED = 0.25
#: Likelihood ratio statistic from which a word is telling.
SURE = 12.0
#: Bounds of the training sample: rows of either label, and characters in all.
ROWS_PER_LABEL, SAMPLE_CHARACTERS = 1500, 16_000_000
CACHED_WORDS = 250_000
ALPHABET = "abcdefghijklmnopqrstuvwxyzàâäçèéêëîïíñóôöùûüúß"
#: Letters and the two ends of a word.
_SIZE = len(ALPHABET) + 2
_CODES = np.zeros(256, np.int64)
_CODES[np.frombuffer(ALPHABET.encode("latin-1"), np.uint8)] = np.arange(len(ALPHABET))
_KNOWN = frozenset(ALPHABET)
_LIKE = str.maketrans("013457@$!|", "oieastasil")
#: Words as rules elsewhere take them, and line feeds.
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+|\n")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
#: Kernel values are kept as whole parts of 255.
_POWERS = ((np.arange(256) / 255) ** POWER).astype(np.float32)


def plain(token: str) -> str:
    """A token as letters of ALPHABET (empty if it has none)."""
    t = token.lower().rstrip(".,!?;:")
    if t.isalpha() and (t.isascii() or _KNOWN.issuperset(t)):
        return t
    t = _EDGE.sub("", t).translate(_LIKE)
    out = []
    for c in t:
        if c in _KNOWN:
            out.append(c)
        elif not c.isascii():
            out += [x for x in unicodedata.normalize("NFKD", c) if x in _KNOWN]
    return "".join(out)


def pieces(word: str) -> list[str]:
    """A word, or overlapping pieces of a long one."""
    if len(word) <= PIECE:
        return [word]
    return [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


@cache
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of three letters in a word of that length, and their weights."""
    at = [(i, j, k) for i in range(length) for j in range(i + 1, min(length, i + SPAN)) for k in range(j + 1, min(length, i + SPAN))]
    a = np.array(at, np.int64).reshape(-1, 3)
    return a, DECAY ** (a[:, 2] - a[:, 0] + 1.0)


def spectra(words: list[str]):
    """Per length of word: row numbers, codes of subsequences and their weights, normed to one."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for length, all_rows in by.items():
        for at in range(0, len(all_rows), 10_000):
            rows = all_rows[at : at + 10_000]
            letters = np.full((len(rows), length + 2), _SIZE - 1, np.int64)
            letters[:, 0] = _SIZE - 2
            letters[:, 1:-1] = _CODES[np.frombuffer("".join(words[i] for i in rows).encode("latin-1"), np.uint8)].reshape(-1, length)
            places, weights = _triples(length + 2)
            codes = (letters[:, places[:, 0]] * _SIZE + letters[:, places[:, 1]]) * _SIZE + letters[:, places[:, 2]]
            keyed = np.sort(codes << 8 | np.arange(codes.shape[1]), axis=1)  # a piece has at most 216 places
            sorted_codes = keyed >> 8
            sums = np.cumsum(weights[keyed & 255], axis=1)
            last = np.ones(codes.shape, bool)
            last[:, :-1] = sorted_codes[:, 1:] != sorted_codes[:, :-1]
            r, c = np.nonzero(last)
            upto = sums[r, c]
            first = np.r_[True, r[1:] != r[:-1]]
            each = upto - np.where(first, 0, np.r_[0, upto[:-1]])
            norm = np.sqrt(np.bincount(r, each * each, len(rows)))
            yield np.array(rows), r, sorted_codes[r, c], each / norm[r]


class Kernel:
    """Kernel values of words with landmarks, by an index from subsequence to landmarks."""

    def __init__(self, landmarks: list[str]):
        self.count = len(landmarks)
        found = [(codes, rows[r], each) for rows, r, codes, each in spectra(landmarks)]
        codes, self.landmark, self.weight = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(codes, kind="stable")
        self.landmark, self.weight = self.landmark[order], self.weight[order]
        self.first = np.searchsorted(codes[order], np.arange(_SIZE**LETTERS + 1))

    def _rows(self, words: list[str]):
        """Numbers of some words, and their kernel values with the landmarks."""
        for rows, r, codes, each in spectra(words):
            n = self.first[codes + 1] - self.first[codes]
            entry = np.repeat(np.arange(len(codes)), n)
            at = np.arange(len(entry)) + np.repeat(self.first[codes] - (np.cumsum(n) - n), n)
            values = np.bincount(r[entry] * self.count + self.landmark[at], each[entry] * self.weight[at], len(rows) * self.count)
            yield rows, values.astype(np.float64, copy=False).reshape(len(rows), self.count)

    def exact(self, words: list[str]) -> np.ndarray:
        """words x landmarks: the kernel before its power."""
        out = np.zeros((len(words), self.count))
        for rows, values in self._rows(words):
            out[rows] = values
        return out

    def __call__(self, words: list[str]) -> np.ndarray:
        """words x landmarks: 255 times the kernel, rounded; a long word has the best of its pieces."""
        split = [pieces(w) for w in words]
        flat = [p for s in split for p in s]
        out = np.zeros((len(flat), self.count), np.uint8)
        for rows, values in self._rows(flat):
            values *= 255
            values += 0.5
            out[rows] = np.minimum(values, 255).astype(np.uint8)
        if len(flat) == len(words):
            return out
        return np.maximum.reduceat(out, np.cumsum([0, *map(len, split)][:-1]), axis=0)


class _Learning(dict):
    """A dictionary that gets what it lacks from a function."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, key):
        self[key] = value = self.learn(key)
        return value


class Reader:
    """Texts to sentences of numbered words. Numbers last until `forget`."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.words: list[str] = []  # by number
        self.short = np.zeros(0, bool)  # by number, as far as it has been needed
        self.numbers: dict[str, int] = {}
        self.tokens = _Learning(self._learn)  # twice the word's number (-1: none, -2 - i: the single letter i) + 1 if it ends a sentence
        self.pairs: dict[int, int] = {}

    def _number(self, word: str) -> int:
        if word not in self.numbers:
            self.numbers[word] = len(self.words)
            self.words.append(word)
        return self.numbers[word]

    def _learn(self, token: str) -> int:
        if token == "\n":
            return -1
        word = plain(token)
        number = -1 if not word else -2 - _KNOWN_AT[word] if len(word) == 1 else self._number(word)
        return 2 * number + (token[-1] in ".!?")

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words of all sentences, where each sentence begins, and the text it is of."""
        split = [_TOKEN.findall(t) for t in texts]
        lengths = np.array([len(s) for s in split], np.int64)
        known = np.fromiter(map(self.tokens.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(texts)), lengths)
        word, ends = known >> 1, (known & 1).astype(bool)
        after = np.r_[True, ends[:-1] | (owner[1:] != owner[:-1])] if len(known) else ends
        sentence = np.cumsum(after)
        word, sentence, owner = self._spelled(word, sentence, owner)
        if not len(word):
            return word, word, owner
        begin = np.r_[True, sentence[1:] != sentence[:-1]]
        place = np.arange(len(word)) - np.maximum.accumulate(np.where(begin, np.arange(len(word)), 0))
        begin |= place % WORDS == 0
        unit = np.cumsum(begin)
        starts = np.nonzero(begin)[0]
        word, unit = self._closed_up(word, unit)
        return word, np.nonzero(np.r_[True, unit[1:] != unit[:-1]])[0], owner[starts]

    def _spelled(self, word: np.ndarray, sentence: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Without tokens that are no words; runs of LETTERS single letters or more in a sentence become a word."""
        some = word != -1
        word, sentence, owner = word[some], sentence[some], owner[some]
        single = word < -1
        if not single.any():
            return word, sentence, owner
        begin = np.r_[True, ~single[:-1] | (sentence[1:] != sentence[:-1])] & single
        run = np.cumsum(begin) * single
        sizes = np.bincount(run)
        word = word.copy()
        for first in np.nonzero(begin)[0]:
            n = int(sizes[run[first]])
            word[first] = self._number("".join(ALPHABET[-2 - w] for w in word[first : first + n].tolist())) if n >= LETTERS else -1
        keep = (~single | begin) & (word >= 0)
        return word[keep], sentence[keep], owner[keep]

    def _closed_up(self, word: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """With each two short neighbours of a sentence as one more word."""
        new = self.words[len(self.short) :]
        self.short = np.concatenate([self.short, np.fromiter((len(w) <= JOINED for w in new), bool, len(new))])
        short = self.short[word]
        both = np.nonzero(short[:-1] & short[1:] & (unit[:-1] == unit[1:]))[0]
        if not len(both):
            return word, unit
        keys, back = np.unique(word[both] << 32 | word[both + 1], return_inverse=True)
        for k in set(keys.tolist()).difference(self.pairs):
            self.pairs[k] = self._number(self.words[k >> 32] + self.words[k & 0xFFFFFFFF])
        joined = np.array([self.pairs[k] for k in keys.tolist()], np.int64)[back]
        units = np.concatenate([unit, unit[both]])
        order = np.argsort(units, kind="stable")
        return np.concatenate([word, joined])[order], units[order]


_KNOWN_AT = {c: i for i, c in enumerate(ALPHABET)}


def pooled(values: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """sentences x landmarks: the best of each sentence's words."""
    sizes = np.diff(np.r_[starts, len(words)])
    out = np.empty((len(starts), values.shape[1]), np.uint8)
    for i in range(0, len(starts), 2000):
        # longest sentences first: those that have a j-th word are the first ones
        order = i + np.argsort(-sizes[i : i + 2000], kind="stable")
        first, longest = starts[order], sizes[order]
        best = values[words[first]]
        for j in range(1, int(longest[0])):
            n = int(np.searchsorted(-longest, -j))
            np.maximum(best[:n], values[words[first[:n] + j]], out=best[:n])
        out[order] = best
    return out


@dataclass
class ToxicModel:
    landmarks: list[str]
    weights: np.ndarray  # by landmark, for the power of the kernel
    bias: float
    slope: float
    shift: float

    def decisions(self, best: np.ndarray) -> np.ndarray:
        """Of sentences, by their pooled values."""
        out, weights = np.empty(len(best)), self.weights.astype(np.float32)
        for i in range(0, len(best), 5000):
            out[i : i + 5000] = _POWERS[best[i : i + 5000]] @ weights
        return out + self.bias

    def chance(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -60, 60)))


def _machine(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """A linear machine with hinge loss, by coordinate descent on its dual."""
    x = np.c_[x, np.ones(len(y))].astype(np.float64)
    signed = x * y[:, None]
    norm = (x * x).sum(1).tolist()
    alpha, w = [0.0] * len(y), np.zeros(x.shape[1])
    for _ in range(EPOCHS):
        moved = 0
        for i in rng.permutation(len(y)).tolist():
            old = alpha[i]
            new = min(max(old - (float(signed[i] @ w) - 1) / norm[i], 0.0), COST)
            if new != old:
                w += (new - old) * signed[i]
                alpha[i] = new
                moved += 1
        if not moved:
            break
    return w[:-1], float(w[-1])


def whitening(kernel: Kernel, landmarks: list[str]) -> np.ndarray:
    """landmarks x features: powers of kernel values with landmarks times this are the Nystroem features."""
    values, vectors = np.linalg.eigh(_POWERS[kernel(landmarks)].astype(np.float64))
    keep = values > 1e-2
    return vectors[:, keep] / np.sqrt(values[keep])


def _telling(words: list[str], seen: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood ratio statistics of words for toxic documents (0 where they speak against), and the log odds. seen: documents of either label that have the word."""
    clean, toxic = seen
    odds = np.log((toxic + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))
    even = (clean + toxic) / n.sum()
    part = lambda k, m: np.where(k > 0, k * np.log(np.maximum(k, 1) / (m * even)), 0)
    return np.where(odds > 0, 2 * (part(toxic, n[1]) + part(clean, n[0])), 0), odds


def _landmarks(words: list[str], seen: np.ndarray, sure: np.ndarray, odds: np.ndarray) -> list[str]:
    usable = np.array([len(w) <= PIECE for w in words])
    rank = lambda value, some: [words[i] for i in sorted(np.nonzero(some & usable)[0].tolist(), key=lambda i: (-value[i], words[i]))]
    telling = rank(sure, sure >= SURE)[: LANDMARKS // 2]
    if not telling:
        return []
    clean = np.nonzero((seen[0] > 0) & (odds < 0.5) & usable)[0]
    like, near = np.zeros(len(words)), Kernel(telling[:30])
    for i in range(0, len(clean), 20_000):
        like[clean[i : i + 20_000]] = near.exact([words[j] for j in clean[i : i + 20_000]]).sum(1)
    closest = rank(like, like > 0)[: LANDMARKS // 4]
    return list(dict.fromkeys([*telling, *closest, *rank(seen[0], seen[0] > 0)[:LANDMARKS]]))[:LANDMARKS]


def fit(texts: list[str], labels: list[int], seed: int = 11) -> ToxicModel:
    """The machine for texts labelled 1 (toxic) or 0; without both labels all scores are that of the empty text."""
    blank = ToxicModel([], np.zeros(0), 0.0, 1.0, -2.0)
    if len(set(labels)) < 2:
        return blank
    rng, truth, n = np.random.default_rng(seed), np.array(labels), np.bincount(labels, minlength=2)
    reader = Reader()
    word, starts, owner = reader(texts)
    sizes = np.diff(np.r_[starts, len(word)])
    held = np.unique(np.repeat(owner, sizes) * len(reader.words) + word)  # each word once a document
    seen = np.stack([np.bincount(held[truth[held // len(reader.words)] == y] % len(reader.words), minlength=len(reader.words)) for y in (0, 1)])
    sure, odds = _telling(reader.words, seen, n)
    landmarks = _landmarks(reader.words, seen, sure, odds)
    if not landmarks:
        return blank
    kernel = Kernel(landmarks)
    white = whitening(kernel, landmarks)
    values = kernel(reader.words)
    best = pooled(values, word, starts)
    toxic, clean = np.nonzero(truth[owner] == 1)[0], np.nonzero(truth[owner] == 0)[0]

    def witnesses(value: np.ndarray, least: float) -> np.ndarray:
        """The highest sentence of each toxic document that has one above the least."""
        order = toxic[np.lexsort((toxic, -value[toxic], owner[toxic]))]
        first = order[np.r_[True, owner[order[1:]] != owner[order[:-1]]]] if len(order) else order
        return first[value[first] > least]

    def varied(sentences: np.ndarray) -> np.ndarray:
        """Pooled values of sentences with a letter inserted into their most telling word, of those where it has five letters or more."""
        kept, new = [], []
        for i in sentences.tolist():
            own = word[starts[i] : starts[i] + sizes[i]]
            most = own[np.argmax(sure[own])]
            w = reader.words[most]
            if sure[most] >= SURE and len(w) >= 5:
                at = int(rng.integers(1, len(w)))
                kept.append(values[own[own != most]].max(0, initial=0))
                new.append(w[:at] + ALPHABET[int(rng.integers(26))] + w[at:])
        return np.maximum(kept, kernel(new)) if new else best[:0]

    positive = witnesses(np.maximum.reduceat(sure[word], starts), SURE - 1e-9)
    negative = np.sort(rng.choice(clean, min(NEGATIVES, len(clean)), replace=False))
    model = blank
    for turn in range(ROUNDS):
        if not len(positive) or not len(negative):
            return blank
        examples = np.concatenate([best[positive], varied(positive), best[negative]])
        signs = np.r_[np.ones(len(examples) - len(negative)), -np.ones(len(negative))]
        w, b = _machine(_POWERS[examples] @ white, signs, rng)
        model = ToxicModel(landmarks, white @ w, b, 1.0, 0.0)
        decision = model.decisions(best)
        positive = witnesses(decision, 0.0)
        hard = clean[np.argsort(-decision[clean], kind="stable")[:HARD]]
        negative = np.union1d(negative, hard[decision[hard] > -1])
    top = np.full(len(texts), model.bias)
    np.maximum.at(top, owner, decision)
    odd = model.decisions(varied(positive))  # sentences with an inserted letter count too, so that the threshold is not far above them
    balance = np.r_[np.where(truth > 0, np.sqrt(n[0] / n[1]), 1.0), np.full(len(odd), VARIED)]  # half way between the sample's shares and equal ones
    top, truth = np.r_[top, odd], np.r_[truth, np.ones(len(odd))]
    slope, shift = 1.0, 0.0
    for _ in range(3000):  # logistic regression on one number
        p = 1 / (1 + np.exp(-np.clip(slope * top + shift, -60, 60)))
        slope -= 0.2 * (balance * (p - truth) * top).mean()
        shift -= 0.2 * (balance * (p - truth)).mean()
    model.slope, model.shift = float(max(slope, 1e-3)), float(shift)
    return model


class Scorer:
    """Scores of texts; keeps the kernel values of words seen lately."""

    def __init__(self, model: ToxicModel):
        self.model, self.reader = model, Reader()
        self.kernel = Kernel(model.landmarks) if model.landmarks else None
        self.values = np.zeros((1024, len(model.landmarks)), np.uint8)
        self.filled = 0

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.model.bias)
        if self.kernel is not None:
            if len(self.reader.words) > CACHED_WORDS or len(self.reader.pairs) > 2 * CACHED_WORDS:
                self.reader.forget()
                self.filled = 0
            word, starts, owner = self.reader(texts)
            words = self.reader.words
            if len(words) > len(self.values):
                self.values = np.concatenate([self.values[: self.filled], np.zeros((2 * len(words) - self.filled, self.kernel.count), np.uint8)])
            self.values[self.filled : len(words)] = self.kernel(words[self.filled :])
            self.filled = len(words)
            if len(starts):
                np.maximum.at(out, owner, self.model.decisions(pooled(self.values, word, starts)))
        return self.model.chance(out)


_SCORERS: dict[str, Scorer] = {}


def scorer(name: str, model: ToxicModel) -> Scorer:
    """This worker's scorer of a model."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(model)
    return _SCORERS[name]


def held_out(key: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id as text is 0 modulo 5. A null id is neither held out nor learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL, characters: int = SAMPLE_CHARACTERS) -> ToxicModel:
    """Fit on labelled documents that are not held out, at most rows_per_label of either label and so many characters."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    usable = usable.distinct()
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    chosen = usable.where(drawn(F.xxhash64(F.lit("toxicity"), "doc_id"), F.col("label"), counts, rows_per_label))  # some thousand ids
    rows = written(docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(written(chosen, "toxicity-sample")), "doc_id").select("doc_id", "text", "label"), "toxicity-texts")
    found = sampled(rows, {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}, rows_per_label, characters)
    return fit([t for t, _ in found], [y for _, y in found])


def with_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """docs plus score (null and empty texts have that of no evidence) and predicted."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # LANDMARKS words and numbers

    def add(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        score = np.concatenate([scorer(name, shared.value)(g) for g in groups(texts_of(batch))])
        return {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}

    return map_adding(docs, {"score": "double", "predicted": "int"}, add)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels, lang, source and doc_id never enter a score."""
    return with_toxicity(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
