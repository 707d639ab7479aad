"""Plain Python versions of tokenizing, BM25 and fusion, to compare with."""

import math
import re
from collections import Counter

_WORD = re.compile(r"[\w.+#/-]+")
_CJK = re.compile("[㐀-鿿]")


def terms(text):
    out = []
    for raw in _WORD.findall(text):
        t = raw.lower()
        marks = _CJK.findall(t)
        if marks:
            out += marks + [a + b for a, b in zip(marks, marks[1:])] + re.findall(r"[a-z0-9_.+#/-]{2,}", t)
        elif len(t) > 1:
            out.append(t)
    return out


def bm25(corpus, question):
    docs = {k: terms(v) for k, v in corpus.items()}
    mean = sum(map(len, docs.values())) / max(1, len(docs))
    df = Counter(t for d in docs.values() for t in set(d))
    out = {}
    for k, d in docs.items():
        tf, s = Counter(d), 0.0
        for t in terms(question):
            if tf[t]:
                idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                s += idf * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / mean))
        if s > 0:
            out[k] = s
    return out
