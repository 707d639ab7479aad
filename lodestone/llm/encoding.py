"""Encoding with a public tokenizer, with a cache of text segments.

A byte-level pre-tokenizer always starts a new piece at a space or line feed that
follows a character which is not white space, so the ids of a text are the ids of
its segments, one after the other, where segments begin at such places. A vocabulary's added tokens (end of text and the like) are taken
out first, as the library does. Words come back often; only segments not seen lately go through the tokenizers library.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: White space and then other characters, up to a space or line feed.
_SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*|\s+")
#: White space other than space and line feed; texts without it can be cut by str.split.
_RARE_SPACE = "\t\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters which Python takes for white space and the tokenizer doesn't, and the mark of a segment's key.
_ODD = "\x00\x1c\x1d\x1e\x1f"

#: A line feed or nothing, a word of Latin letters, marks: each is one piece for the pre-tokenizer.
_MARKS = ".,!?;:$&%*#"
_WORD = re.compile(f"(\\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([{_MARKS}]*)")
#: The byte-level alphabet: printable bytes are themselves, the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def _spelled(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_ALPHABET)


def _has(text: str, characters: str) -> bool:
    return any(c in text for c in characters)


def segment_keys(text: str) -> list[str]:
    """Keys of a text's segments: a word for the segment " word"; else a mark (NUL: none; line feed: itself) and the segment.

    The text must not have a character of _ODD.
    """
    if not text:
        return []
    # no two white spaces together, none at either end, and none but spaces and line feeds
    even = text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in ("  ", " \n", "\n ", "\n\n"))
    if even and not _has(text, _RARE_SPACE if not text.isascii() else "\t\v\f\r"):
        keys = []
        for line in text.split("\n"):
            words = line.split(" ")
            words[0] = ("\n" if keys else "\x00") + words[0]
            keys += words
        return keys
    return ["\x00" + s for s in _SEGMENT.findall(text)]


def segment_of(key: str) -> str:
    return key[1:] if key[0] == "\x00" else key if key[0] == "\n" else " " + key


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Segments(dict):
    """The young generation of the cache; what it lacks comes from the old one, or is learnt."""

    def __init__(self, learn, old: dict):
        self.learn, self.old = learn, old

    def __missing__(self, key: str) -> bytes:
        raw = self.old.get(key)
        if raw is None:
            raw = self.learn(key)
        self[key] = raw
        return raw


class SegmentEncoder:
    """Texts to arrays of unsigned ids, exactly those of the tokenizers library for the whole text.

    limit: segments in each of the two generations of the cache (bounds a worker's memory).
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.model = self.tokenizer.model
        self.packed = [np.array([i], self.dtype).tobytes() for i in range(size)]
        self.line, self.marks = self._piece("\u010a"), {}
        self.limit, self.young = limit, _Segments(self._learn, {})
        # a vocabulary's added tokens are cut out of a text before anything else; those with conditions are left to the library
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: self.packed[i] for i, t in added.items() if t.content}
        self.strict = [t.content for t in added.values() if t.lstrip or t.rstrip or t.single_word or t.normalized]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """The ids of one pre-token, given as the byte-level alphabet spells it."""
        return b"".join([self.packed[t.id] for t in self.model.tokenize(piece)])

    def _learn(self, key: str) -> bytes:
        """Encode a segment: a word of Latin letters goes to the library's model by itself, any other segment as a text."""
        word = key.rstrip(_MARKS)
        if word.isascii() and word.isalpha():
            if len(word) < len(key):
                return self.young[word] + self._tail(key[len(word) :])
            return b"".join([self.packed[t.id] for t in self.model.tokenize("\u0120" + word)])
        m = _WORD.fullmatch(key)
        if m is None:
            return self._plain([segment_of(key)])[0]
        line, word, marks = m.groups()
        if line:
            raw = self.line + self._piece(_spelled(word))
        elif marks:
            raw = self.young[word]
        else:
            raw = self._piece("\u0120" + _spelled(word))
        return raw + self._tail(marks) if marks else raw

    def _tail(self, marks: str) -> bytes:
        """The ids of marks behind a word."""
        if (tail := self.marks.get(marks)) is None:
            tail = self._piece(marks)
            if len(self.marks) < 10_000:
                self.marks[marks] = tail
        return tail

    def _around_added(self, text: str) -> bytes:
        """The ids of a text that has added tokens: their own, and those of the texts between them."""
        if any(c in text for c in self.strict):
            return self._plain([text])[0]
        between = self.cut.split(text)
        return b"".join(self.added[x] if i % 2 else self.raw([x])[0] for i, x in enumerate(between) if x)

    def raw(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian bytes of self.dtype."""
        get, out = self.young.__getitem__, []
        for t in texts:
            if self.cut is not None and any(c in t for c in self.added):
                out.append(self._around_added(t))
            else:
                out.append(self._plain([t])[0] if _has(t, _ODD) else b"".join(map(get, segment_keys(t))))
        if len(self.young) > self.limit:
            self.young = _Segments(self._learn, dict(self.young))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, self.dtype) for x in self.raw(texts)]


_ENCODERS: dict[str, SegmentEncoder] = {}


def encoder(path: str) -> SegmentEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SegmentEncoder(path)
    return _ENCODERS[path]
