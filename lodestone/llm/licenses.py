"""License scan: phrases, and templates whose markup says which wording may be left out or replaced.

A template is a text with marks: `<<optional>>...<<end>>` may be left out, and `<<words 0-20>>` stands for any words, so many.
Its words are those of the scan (lower case, letters and digits), so punctuation and layout don't matter. It is compiled
to an automaton over words; a place of a text is accepted if its words lead from the first state to the last, that is, if all
mandatory wording stands there exactly and in order. States are sets of automaton places, made when a text first
reaches them. Templates begin and end with wording, and spans of replaced words are bounded, so that a place is decided within a bounded
number of words. The longest acceptance counts, places of one template don't overlap.

A text that lacks a template's anchor (its longest run of mandatory words) has no place of it, so nearly all texts are
only searched for anchors. Texts are scanned whole, as one byte string with a space before and after each word.

Score is the strength of the best evidence: m / (m + 4) for a phrase, or a template, of m mandatory words; 0 without any.

Null and empty texts, and texts without a word, have no words, no places, empty labels and score 0. Repeated rows get the same result each, null ids come through. A
word may be of any length. Very long texts are normalised in stretches of a megabyte, with the same result; memory follows the longest one.
An empty table gives no rows. Columns of docs named like an added one are replaced, whatever their case; others come through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_adding, texts_of, through

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<words 1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<optional>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<optional>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY <<words 1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"""
#: Public license texts and notices, with marks. (label, template)
TEMPLATES = [
    ("mit", "<<optional>>This <<words 1-4>> is<<end>> Licensed under the <<optional>>terms of the<<end>> MIT License"),
    ("mit", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including
the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software. {_NO_WARRANTY}"""),
    ("isc", """Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies"""),
    ("bsd-2-clause", f"{_BSD_START} {_BSD_END}"),
    ("bsd-3-clause", f"""{_BSD_START} <<optional>>3.<<end>> Neither the name of <<words 1-16>> nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. {_BSD_END}"""),
    ("apache-2", "Licensed under the Apache <<optional>>Software<<end>> License <<optional>>Version<<end>> 2.0"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<words 1-4>> except in compliance with the License.
You may obtain a copy of the License at <<words 3-10>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("gpl-2", "<<optional>>licensed<<end>> under the <<optional>>terms of the<<end>> GNU General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version 2"),
    ("gpl-3", "<<optional>>licensed<<end>> under the <<optional>>terms of the<<end>> GNU General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version 3"),
    ("gpl-or-later", "GNU General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version <<words 1-4>> or <<optional>>at your option<<end>> any later version"),
    ("lgpl", "GNU Lesser General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version"),
    ("agpl-3", "GNU Affero General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version 3"),
    ("mpl-2", "subject to the terms of the Mozilla Public License <<optional>>version<<end>> <<optional>>v<<end>> 2.0"),
    ("cc-by", "Licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY <<optional>>4.0<<end>> license"),
    ("cc-by", "Creative Commons Attribution <<words 1-2>> <<optional>>International<<end>> License"),
    ("cc-by-sa", "Licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY SA"),
    ("cc-by-nc", "Licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY NC"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial <<words 1-2>> <<optional>>International<<end>> License"),
    ("zlib", """This software is provided as-is, without any express or implied warranty. In no event will <<words 1-6>> be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"""),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
ADDED = ("n_words", "places", "labels", "score")
MATCH = "array<struct<label:string,template:int,first:long,last:long>>"
WEIGHT = 4
STRETCH = 1 << 20

#: What every byte is read as: A-Z in lower case, digits, a-z and bytes of other characters as they are, the rest as a space.
_READ_AS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARK = re.compile(r"<<\s*(optional|end|words\s+(\d+)-(\d+))\s*>>")


def normalised(text: str, stretch: int = STRETCH) -> bytes:
    """The words of a text, with one space before, between and after them; a single space if it has none."""
    raw = text.encode("utf-8", "surrogatepass").translate(_READ_AS)
    parts, at = [], 0
    while at < len(raw):
        end = raw.find(b" ", at + stretch)
        end = len(raw) if end < 0 else end
        parts += [b" ".join(words)] if (words := raw[at:end].split()) else []
        at = end
    return b" " + b" ".join(parts) + b" " if parts else b" "


@dataclass
class Template:
    """A compiled template. Places 0, 1, ... of the automaton are joined by steps: a word, any word (None), or nothing."""

    label: str
    source: str
    steps: list[dict] = field(default_factory=list)  # place -> {word or None: set of places}
    free: list[set[int]] = field(default_factory=list)  # place -> places reached without a word
    mandatory: int = 0
    anchor: bytes = b""
    starts: tuple[bytes, ...] = ()

    def __post_init__(self):
        self._place()
        open_, run, runs, depth, at, end = [], [], [], 0, 0, 0
        for mark in [*_MARK.finditer(self.source), None]:
            for word in normalised(self.source[end : mark.start() if mark else None]).split():
                at = self._step(at, word)
                if not depth:
                    self.mandatory += 1
                    run.append(word)
            runs.append(run)
            run = []
            if mark is None:
                break
            end = mark.end()
            if mark[1] == "optional":
                open_.append(at)
                depth += 1
            elif mark[1] == "end":
                if not open_:
                    raise ValueError(f"an end without optional in the template of {self.label}")
                self.free[open_.pop()].add(at)
                depth -= 1
            else:
                least, most = int(mark[2]), int(mark[3])
                if least > most:
                    raise ValueError(f"no number of words is both {least} at least and {most} at most")
                skipped = []
                for i in range(most):
                    if i >= least:
                        skipped.append(at)
                    at = self._step(at, None)
                for place in skipped:
                    self.free[place].add(at)
        if open_ or not self.mandatory:
            raise ValueError(f"the template of {self.label} is open, or has no mandatory word")
        self.last = at
        first = self._closed({0})
        words = {w for p in first for w in self.steps[p]}
        if None in words or at in first or any(None in self.steps[p] for p in self._reaching_end()):
            raise ValueError(f"the template of {self.label} must begin and end with wording")
        self.starts = tuple(sorted(words))
        self.anchor = b" " + b" ".join(max(runs, key=lambda r: (len(r[:8]), sum(map(len, r[:8]))))[:8]) + b" "
        self.sets, self.moves = {first: 0}, [{}]
        self.members = [first]

    def _place(self) -> int:
        self.steps.append({})
        self.free.append(set())
        return len(self.steps) - 1

    def _step(self, at: int, word: bytes | None) -> int:
        to = self._place()
        self.steps[at].setdefault(word, set()).add(to)
        return to

    def _closed(self, places: set[int]) -> frozenset[int]:
        """places and all that are reached from them without a word."""
        todo, found = list(places), set(places)
        while todo:
            new = self.free[todo.pop()] - found
            found |= new
            todo += new
        return frozenset(found)

    def _reaching_end(self) -> list[int]:
        """The places from which one word leads to acceptance."""
        return [p for p, s in enumerate(self.steps) for to in s.values() if any(self.last in self._closed({t}) for t in to)]

    def move(self, state: int, word: bytes) -> int:
        """The state behind a word, -1 if there is none."""
        known = self.moves[state].get(word)
        if known is None:
            to = {t for p in self.members[state] for key in (word, None) for t in self.steps[p].get(key, ())}
            if not any(word in self.steps[p] for p in self.members[state]):
                word = None  # all words that no step names lead to the same state
                if (known := self.moves[state].get(None)) is not None:
                    return known
            known = -1
            if to:
                closed = self._closed(to)
                known = self.sets.setdefault(closed, len(self.sets))
                if known == len(self.members):
                    self.members.append(closed)
                    self.moves.append({})
            self.moves[state][word] = known
        return known

    def accepted(self, words: bytes, at: int) -> tuple[int, int] | None:
        """Where the longest accepted place that begins at the space `at` ends (its last space), and its words; None without one."""
        state, n, best = 0, 0, None
        while state >= 0 and (end := words.find(b" ", at + 1)) > 0:
            state, n, at = self.move(state, words[at + 1 : end]), n + 1, end
            if state >= 0 and self.last in self.members[state]:
                best = at, n
        return best

    def places(self, words: bytes) -> Iterator[tuple[int, int]]:
        """(the space before, number of words) of each accepted place, from left to right."""
        if self.anchor not in words:
            return
        at = {s: words.find(b" " + s + b" ") for s in self.starts}
        behind = 0
        while at := {s: p for s, p in at.items() if p >= 0}:
            first = min(at, key=at.get)
            start = at[first]
            if start >= behind and (found := self.accepted(words, start)):
                behind = found[0]
                yield start, found[1]
            at[first] = words.find(b" " + first + b" ", max(start + 1, behind))

    def pattern(self) -> str:
        """The template as a regular expression over normalised words: an independent form, for SQL and tests."""
        out, end = "", 0
        for mark in [*_MARK.finditer(self.source), None]:
            out += "".join(f" {w.decode()}" for w in normalised(self.source[end : mark.start() if mark else None]).split())
            if mark:
                end = mark.end()
                out += "(?:" if mark[1] == "optional" else ")?" if mark[1] == "end" else f"(?: [^ ]+){{{mark[2]},{mark[3]}}}"
        return out + " "


class Scanner:
    """Finds phrases and templates in texts."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.phrases = [(b" " + p.encode() + b" ", label, len(p.split())) for p, label in phrases.items()]
        self.templates = [Template(label, source) for label, source in templates]

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int, int]], float]:
        """Words, (label, template or -1 for a phrase, first word, last word) by first word, and score."""
        words = normalised(text)
        found, score = [], 0.0
        for phrase, label, n in self.phrases:
            at = words.find(phrase)
            while at >= 0:
                found.append((at, n, label, -1))
                score = max(score, n / (n + WEIGHT))
                at = words.find(phrase, at + 1)
        for i, t in enumerate(self.templates):
            for at, n in t.places(words):
                found.append((at, n, t.label, i))
                score = max(score, t.mandatory / (t.mandatory + WEIGHT))
        out, counted, before = [], 0, 0
        for at, n, label, i in sorted(found):
            counted += words.count(b" ", before, at)
            before = at
            out.append((label, i, counted, counted + n - 1))
        return words.count(b" ") - 1, out, score


_SCANNERS: dict[tuple, Scanner] = {}


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs (text and any others) plus n_words, places (label, template: its number, -1 for a phrase, first and last word), labels (distinct, sorted) and score."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    Scanner(phrases, templates)  # a malformed template fails here
    key = (tuple(phrases.items()), tuple(templates))

    def add(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if key not in _SCANNERS:
            _SCANNERS[key] = Scanner(phrases, templates)
        rows = [_SCANNERS[key].scan(t) for t in texts_of(batch)]
        kind = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))
        names = ("label", "template", "first", "last")
        return {
            "n_words": pa.array([r[0] for r in rows], pa.int64()),
            "places": pa.array([[dict(zip(names, p, strict=True)) for p in r[1]] for r in rows], kind),
            "labels": pa.array([sorted({p[0] for p in r[1]}) for r in rows], pa.list_(pa.string())),
            "score": pa.array([r[2] for r in rows], pa.float64()),
        }

    return through(docs, lambda inner: map_adding(inner, {"n_words": "long", "places": MATCH, "labels": "array<string>", "score": "double"}, add), ADDED)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    base = scan(docs.select("doc_id", "text")).drop("text").withColumn("base", F.filter("places", lambda p: p["template"] < 0))
    named = F.array_join(F.array_sort(F.array_distinct("base.label")), ",")
    return base.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first").alias("first_word"), F.array_max("base.first").alias("last_word"), named.alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _sql() -> str:
    """The scan with DuckDB's lists for phrases, and its regular expressions for templates."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    at = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        test = " AND ".join(f"w[i{f' + {k}' if k else ''}] = {quoted(x)}" for k, x in enumerate(words))
        at.append(f"list_transform(list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {test}), lambda i: {{'at': i - 1, 'label': {quoted(label)}, 'm': {len(words)}}})")
    hits = []
    for t in (Template(*x) for x in TEMPLATES):
        hits.append(f"CASE WHEN regexp_matches(j, {quoted(t.pattern())}) THEN {{'label': {quoted(t.label)}, 'm': {t.mandatory}}} END")
    base = f"list_concat(list_concat({at[0]}, {at[1]}), {at[2]})"
    both = "list_concat(list_transform(base, lambda b: {'label': b.label, 'm': b.m}), list_filter([" + ",\n  ".join(hits) + "], lambda x: x IS NOT NULL))"
    named = lambda c: f"array_to_string(list_sort(list_distinct(list_transform({c}, lambda x: x.label))), ',')"
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, {base} AS base, ' ' || array_to_string(w, ' ') || ' ' AS j FROM t),
q AS (SELECT doc_id, len(w) AS n_words, base, {both} AS found FROM p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base, CAST(list_min(list_transform(base, lambda b: b.at)) AS BIGINT) AS first_word, CAST(list_max(list_transform(base, lambda b: b.at)) AS BIGINT) AS last_word,
  coalesce({named('base')}, '') AS base_labels, coalesce({named('found')}, '') AS labels, coalesce(list_max(list_transform(found, lambda x: CAST(x.m AS DOUBLE) / (x.m + {WEIGHT}))), 0.0) AS score FROM q"""


SQL = _sql()
