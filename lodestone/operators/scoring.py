"""Scoring of blocks of chunks by the task that has them: each task sends on the k best chunks of each query, not a row for each pair.

Queries are known to all tasks, as a bounded table of their terms' weights. A task reads chunks block by block, bounds what each
query can score in a block by the block's largest gains, and scores it for the queries that the bound doesn't rule out. Memory is a batch of chunks, the queries, and some
thousands of candidates, whatever the number of chunks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens of the blocks that are worked on together, about.
TOKENS = 500_000
#: Candidates held before they are cut to each query's k best, and (query, chunk) scores computed at once.
HELD, AT_ONCE = 100_000, 1_000_000


def whole_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, ..., tokens), a block's together, in pieces of whole blocks and of TOKENS tokens or a single block."""
    held = None
    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        if not rows.num_rows:
            continue
        edges = np.flatnonzero(np.diff(rows.column("block").to_numpy(), prepend=rows.column("block")[0].as_py() - 1))
        tokens = np.r_[0, np.cumsum(pc.list_value_length(rows.column("tokens")).to_numpy(zero_copy_only=False))]
        start = 0
        for end, following in zip(edges[1:], [*edges[2:], None], strict=False):
            if following is None or tokens[following] - tokens[start] > TOKENS:
                yield rows.slice(start, end - start)
                start = end
        held = rows.slice(edges[-1])
    if held is not None:
        yield held


class Asked:
    """Terms of queries: entries (query, term, weight) with queries and terms as numbers; least: the score that a query's hits must reach."""

    def __init__(self, table: pa.Table):
        """table: query_id, term, weight, least (null: any score counts)."""
        ids, terms = table["query_id"].combine_chunks().dictionary_encode(), table["term"].combine_chunks().dictionary_encode()
        self.queries, self.vocabulary = ids.dictionary, terms.dictionary
        query, term = ids.indices.to_numpy(), terms.indices.to_numpy()
        order = np.argsort(query, kind="stable")
        self.query, self.term = query[order], term[order]
        self.weight = table["weight"].to_numpy()[order]
        self.least = np.zeros(len(self.queries))
        self.least[query] = table["least"].fill_null(0.0).to_numpy()


def _counts(asked: Asked, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and frequency of asked terms in rows of tokens, by row."""
    ids = pc.index_in(tokens.flatten(), value_set=asked.vocabulary.cast(tokens.type.value_type))
    row = np.repeat(np.arange(len(tokens), dtype=np.int64), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    width = max(1, len(asked.vocabulary))
    pair, tf = np.unique(row[known] * width + ids.drop_null().to_numpy(), return_counts=True)
    return pair // width, pair % width, tf


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least, self.parts, self.held, self.next = k, least.copy(), [], 0, HELD

    def add(self, query: np.ndarray, score: np.ndarray, chunk: pa.Array, **more: np.ndarray) -> None:
        """more: further columns of the candidates, which go with them."""
        good = score >= self.least[query]
        if good.any():
            self.parts.append(pa.table({"query": query[good], "score": score[good], "chunk_id": chunk.filter(pa.array(good)), **{c: x[good] for c, x in more.items()}}))
            self.held += len(self.parts[-1])
            if self.held > self.next:
                self.cut()
                self.next = self.held + HELD

    def cut(self) -> pa.Table | None:
        if not self.parts:
            return None
        rows = pa.concat_tables(self.parts).sort_by([("query", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
        query = rows["query"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = np.flatnonzero(place == self.k - 1)
        # a later chunk with the same score may have the smaller id, so equal scores stay in
        self.least[query[last]] = np.maximum(self.least[query[last]], rows["score"].to_numpy()[last])
        rows = rows.filter(pa.array(place < self.k))
        self.parts, self.held = [rows], len(rows)
        return rows


def best_of(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest of each row; of equal ones the first."""
    if score.shape[1] <= k:
        return np.indices(score.shape).reshape(2, -1)
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    more, same = score > least, score == least
    return np.nonzero(more | same & (np.cumsum(same, axis=1) <= k - more.sum(1, keepdims=True)))


def _sums(asked: Asked, gains: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In slices, queries and the sums of their terms' rows of gains (terms by chunks)."""
    starts = np.r_[np.flatnonzero(np.diff(asked.query, prepend=-1)), len(asked.query)]
    step, a = max(1, AT_ONCE // max(1, gains.shape[1])), 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + step, side="right")) - 1)
        yield asked.query[starts[a:b]], np.add.reduceat(gains[asked.term[starts[a] : starts[b]]], starts[a:b] - starts[a], axis=0)
        a = b


#: Beyond every character; and characters of runs, and entries of chunks, that are looked at together.
SPAN, POINTS, ENTRIES = 1 << 21, 1 << 20, 1 << 22


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of texts, one text after the other, and where each begins (and the last ends)."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    return points, np.r_[0, np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))].astype(np.int64)


class Prefixes:
    """Different terms by their beginnings, level by level, so that all places of many texts go down together."""

    def __init__(self, terms: pa.Array):
        self.terms, self.levels, self.ends = terms, [], []
        points, starts = _points(terms)
        alive, node = np.arange(len(terms)), np.zeros(len(terms), np.int64)
        while len(alive):
            depth = len(self.levels)
            edges, node = np.unique(node * SPAN + points[starts[alive] + depth], return_inverse=True)
            self.levels.append(edges)
            done = starts[alive] + depth + 1 == starts[alive + 1]
            end = np.full(len(edges), -1)
            end[node[done]] = alive[done]
            self.ends.append(end)
            alive, node = alive[~done], node[~done]

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and number of occurrences without overlaps, by text."""
        points, starts = _points(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(starts))
        left = starts[1:][text] - np.arange(len(points))
        at, node, keys = np.arange(len(points)), np.zeros(len(points), np.int64), []
        for depth, (edges, end) in enumerate(zip(self.levels, self.ends, strict=True)):
            more = left[at] > depth
            at, node = at[more], node[more]
            wanted = node * SPAN + points[at + depth]
            node = np.minimum(np.searchsorted(edges, wanted), len(edges) - 1)
            met = edges[node] == wanted
            at, node = at[met], node[met]
            term = end[node]
            keys.append(text[at[term >= 0]] * len(self.terms) + term[term >= 0])
        key, n = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
        text, term = key // max(1, len(self.terms)), key % max(1, len(self.terms))
        for i in np.flatnonzero(n > 1):  # places may overlap
            n[i] = texts[text[i]].as_py().count(self.terms[term[i]].as_py())
        return text, term, n

    def found_in_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, of some texts at a time."""
        ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        parts, a = [(np.zeros(0, np.int64),) * 3], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POINTS, side="right")))
            text, term, n = self.found(texts.slice(a, b - a))
            parts.append((text + a, term, n))
            a = b
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def within(value, k: int, full: int):
    """For mapInArrow over (chunk_id, runs): query_id, chunk_id, matched and score of the task's k best chunks of each query by occurrences of its terms in the runs.

    value: gives the Asked, whose weights don't count. The score is matched in full-ths, one at most. Each distinct run of a batch is searched once, and
    counts are held for as many chunks as AT_ONCE and ENTRIES allow.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = value()
        prefixes, width = Prefixes(asked.vocabulary.cast(pa.string())), len(asked.vocabulary)
        found, step = Best(k, asked.least), max(1, 4 * AT_ONCE // max(1, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pc.sort_indices(batch.column("chunk_id")))  # of equal scores in a batch the smallest id stays
            runs = batch.column("runs")
            words = runs.flatten().dictionary_encode()
            text, term, n = prefixes.found_in_pieces(words.dictionary.cast(pa.string()))
            sizes = np.bincount(text, minlength=len(words.dictionary))
            first, word = np.cumsum(sizes) - sizes, words.indices.to_numpy()
            edge = np.r_[0, np.cumsum(pc.list_value_length(runs).to_numpy(zero_copy_only=False))].astype(np.int64)
            total, a = np.r_[0, np.cumsum(sizes[word])][edge], 0
            while a < batch.num_rows:
                b = min(a + step, max(a + 1, int(np.searchsorted(total, total[a] + ENTRIES, side="right")) - 1))
                some = word[edge[a] : edge[b]]
                many = sizes[some]
                row = np.repeat(np.repeat(np.arange(b - a), np.diff(edge[a : b + 1])), many)
                # the entries of each word: its first one and those after it
                at = np.repeat(first[some] - (np.cumsum(many) - many), many) + np.arange(len(row))
                counts = np.bincount(term[at] * (b - a) + row, n[at], width * (b - a)).reshape(width, b - a)
                for query, matched in _sums(asked, counts):
                    score = np.minimum(1.0, matched / full)
                    q, c = best_of(score, k)
                    hit = score[q, c] > 0
                    q, c = q[hit], c[hit]
                    found.add(query[q], score[q, c], batch.column("chunk_id").take(pa.array(c + a)), matched=matched[q, c].astype(np.int32))
                a = b
        if (rows := found.cut()) is not None:
            ids = asked.queries.take(pa.array(rows["query"].to_numpy()))
            yield from pa.table({"query_id": ids, "chunk_id": rows["chunk_id"], "matched": rows["matched"], "score": rows["score"]}).combine_chunks().to_batches()

    return run


def bounds(value):
    """For mapInArrow over (super, term, most), a superblock's rows together as far as may be: query_id, super and bound, in parts that add up.

    value: gives the Asked. A row goes on for each query and superblock that share a term, none for the terms.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = value()
        at, bound = None, np.zeros(len(asked.queries))

        def part() -> pa.RecordBatch:
            query = np.flatnonzero(bound)
            return pa.RecordBatch.from_arrays([asked.queries.take(pa.array(query)), pa.array(np.full(len(query), at)), pa.array(bound[query])], names=["query_id", "super", "bound"])

        for batch in batches:
            ids = pc.index_in(batch.column("term"), value_set=asked.vocabulary.cast(batch.column("term").type))
            rows = batch.filter(ids.is_valid())
            term, super_, most = ids.drop_null().to_numpy(), rows.column("super").to_numpy(), rows.column("most").to_numpy()
            edges = np.r_[np.flatnonzero(np.diff(super_, prepend=-1)), len(term)]
            for a, b in zip(edges, edges[1:], strict=False):
                if super_[a] != at:
                    if at is not None:
                        yield part()
                    at, bound = super_[a], np.zeros(len(asked.queries))
                gains = np.bincount(term[a:b], most[a:b], len(asked.vocabulary))
                bound += np.bincount(asked.query, asked.weight * gains[asked.term], len(asked.queries))
        if at is not None:
            yield part()

    return run


def _block(asked: Asked, row: np.ndarray, term: np.ndarray, gain: np.ndarray, n: int, least: np.ndarray, slack: float, scratch: np.ndarray) -> tuple[np.ndarray, Iterator]:
    """Whether a query has a term in a block of n chunks; and, in slices, the queries whose bound reaches least and their scores of the n chunks."""
    here, column = np.unique(term, return_inverse=True)
    gains = np.zeros((len(here), n))
    gains[column, row] = gain
    scratch[here] = np.arange(len(here))
    at = scratch[asked.term]
    scratch[here] = -1
    met = np.flatnonzero(at >= 0)
    bound = np.bincount(asked.query[met], asked.weight[met] * gains.max(1)[at[met]], len(asked.queries))
    open_ = (bound > 0) & (bound + slack >= least)
    met = met[open_[asked.query[met]]]

    def scores() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        query = asked.query[met]
        starts = np.r_[np.flatnonzero(np.diff(query, prepend=-1)), len(met)]
        step, a = max(1, AT_ONCE // n), 0
        while a < len(starts) - 1:
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + step, side="right")) - 1)
            some = met[starts[a] : starts[b]]
            yield query[starts[a:b]], np.add.reduceat(asked.weight[some, None] * gains[at[some]], starts[a:b] - starts[a], axis=0)
            a = b

    return bound > 0, scores()


def best(value, k: int, k1: float, b: float, avgdl: float, slack: float, work: bool):
    """For mapInArrow over (block, chunk_id, dl, tokens), a block's rows together: query_id, chunk_id and score of the task's k best chunks of each query.

    value: gives the Asked. work: instead query_id, blocks, blocks_scored and pairs_scored, with the first thresholds only; a block that two tasks
    have is counted by each.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = value()
        found, scratch = Best(k, asked.least), np.full(len(asked.vocabulary), -1)
        counted = np.zeros((3, len(asked.queries)), np.int64)
        for batch in whole_blocks(batches):
            row, term, tf = _counts(asked, batch.column("tokens"))
            dl = batch.column("dl").to_numpy()[row]
            gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / max(avgdl, 1e-9)))
            block = batch.column("block").to_numpy()
            edges = np.r_[np.flatnonzero(np.diff(block, prepend=block[0] - 1)), len(block)]
            cuts = np.searchsorted(row, edges)
            for start, end, i, j in zip(edges, edges[1:], cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                has, slices = _block(asked, row[i:j] - start, term[i:j], gain[i:j], end - start, found.least, slack, scratch)
                counted[0] += has
                for query, score in slices:
                    q, c = np.nonzero(score > 0)
                    if work:
                        counted[1][query] += 1
                        counted[2] += np.bincount(query[q], minlength=len(has))
                    else:
                        rounded = np.round(score[q, c], 9)
                        good = rounded >= found.least[query[q]]
                        found.add(query[q[good]], rounded[good], batch.column("chunk_id").take(pa.array(c[good] + start)))
        if work:
            yield pa.RecordBatch.from_arrays([asked.queries, *map(pa.array, counted)], names=["query_id", "blocks", "blocks_scored", "pairs_scored"])
        elif (rows := found.cut()) is not None:
            ids = asked.queries.take(pa.array(rows["query"].to_numpy()))
            yield from pa.table({"query_id": ids, "chunk_id": rows["chunk_id"], "score": rows["score"]}).combine_chunks().to_batches()

    return run
