"""Encoding, token files and packing against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import packing
from lodestone.llm.encoding import SegmentEncoder, tokenizer_path
from lodestone.llm.token_files import round_trip


@pytest.fixture(scope="module")
def encoder():
    return SegmentEncoder(tokenizer_path(), limit=500)


def plain(encoder, text, end, untouched={}):
    """The ids of the tokenizers library by itself, with a tokenizer of its own."""
    if not untouched:
        from tokenizers import Tokenizer

        untouched["it"] = Tokenizer.from_file(tokenizer_path())
    return [*untouched["it"].encode(text or "", add_special_tokens=False).ids, end]


def test_added_tokens(encoder):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "a<|endoftext|>b\x1c", "<|endoftext", "x \n<|endoftext|>\n y", "<|endof<|endoftext|>text|>"]
    assert [g.tolist() for g in encoder.encode(texts)] == [plain(encoder, t, 0)[:-1] for t in texts]
    assert encoder.encode(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]


def test_segments_give_the_ids_of_the_whole_text(encoder):
    rng = random.Random(3)
    parts = [" ", " ", "\n", "\t", "\r", "  ", "a", "bc", ".", "!!", "é", "\xa0", " ", "\x1c", "\x00", "'s", "'ll", "12", "日本", "<|endoftext|>", "I", "\x85", "the", "ß", "Ğa", "x$$$", "#", "µ", "×"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(4000)]
    for i in range(0, len(texts), 400):
        got = encoder.encode(texts[i : i + 400])
        assert [g.tolist() for g in got] == [plain(encoder, t, 0)[:-1] for t in texts[i : i + 400]]


def test_token_files_round_trip(spark, documents, corpus, edge, encoder):
    from lodestone.llm.shared import tie

    ties = {r.text: r.tie for r in documents.select("text", tie().alias("tie")).collect()}
    rows = sorted(corpus + edge, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]], r[1] or ""))
    start, want = 0, Counter()
    for r in rows:
        ids = plain(encoder, r[1], 0)
        want[(r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    got = Counter((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in round_trip(documents).collect())
    assert got == want


def test_token_files_in_few_pieces_and_of_a_common_id(monkeypatch, spark, corpus, encoder, tmp_path):
    """Readers that hold five documents, or 300 ids; an id that most rows have is split over shards."""
    from lodestone.llm import token_files as W

    monkeypatch.setattr(W, "READ_DOCUMENTS", 5)
    monkeypatch.setattr(W, "READ_IDS", 300)
    docs = spark.createDataFrame([(3 if i % 4 else i, r[1]) for i, r in enumerate(corpus)], "doc_id long, text string")
    manifest = W.write_token_files(docs, str(tmp_path / "files"), shards=9)
    shards = manifest.orderBy("shard").collect()
    assert len(shards) > 6 and max(s.documents for s in shards) < len(corpus) / 3
    assert [s.base for s in shards] == np.cumsum([0, *(s.tokens for s in shards[:-1])]).tolist()
    rows = W.read_token_files(spark, str(tmp_path / "files"), manifest).collect()
    want = Counter((3 if i % 4 else i, tuple(plain(encoder, r[1], 0))) for i, r in enumerate(corpus))
    assert Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    for s in shards:  # as another reader would map them
        raw = np.fromfile(tmp_path / "files" / f"shard-{s.shard:05d}.off", "<u8")
        ids = np.memmap(tmp_path / "files" / f"shard-{s.shard:05d}.bin", f"<u{raw[1]}", "r")
        assert raw[0] == int.from_bytes(b"LODETOK2", "little") and len(raw) == s.documents + 3 and raw[-1] == len(ids) == s.tokens


def test_prefix_sums_of_several_blocks(monkeypatch, spark):
    from lodestone.llm import shared

    monkeypatch.setattr(shared, "BLOCK", 4)
    rng = random.Random(2)
    rows = [(s, i, rng.randint(0, 9)) for s in "ab" for i in rng.sample(range(40), 25)]
    got = {(r.s, r.i): r.b for r in shared.prefix_sums(spark.createDataFrame(rows, "s string, i int, v int"), ["s"], "i", "v", "b").collect()}
    assert got == {(s, i): sum(v for t, j, v in rows if t == s and j < i) for s, i, _ in rows}


def test_token_files_of_nothing_and_of_extra_columns(empty, clashing):
    assert round_trip(empty).count() == 0
    assert round_trip(clashing).count() == clashing.count()


def check_packing(rows, texts, encoder):
    """Every id in one piece, sequences gapless, full or a power of two."""
    whole = Counter()
    for t in texts:
        whole[tuple(plain(encoder, t[1], 1)), t[0]] += 1
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, ids))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    tokens = sum(len(ids) * n for (ids, _), n in whole.items())
    assert sum(r.length for r in rows) == tokens
    for (doc_id, n), found in pieces.items():
        starts = sorted(found)
        mine = [(ids, k) for (ids, d), k in whole.items() if d == doc_id and len(ids) == n]
        if sum(k for _, k in mine) == 1:
            assert [x for _, p in starts for x in p] == list(mine[0][0])
        else:  # several rows with this id and length: each start as often as there are such rows covers it
            assert sum(len(p) for _, p in starts) == n * sum(k for _, k in mine)


def test_packing(documents, corpus, edge, encoder):
    check_packing(packing.pack(documents).collect(), corpus + edge, encoder)


def sized(n, sources, words):
    """Documents of given sources, so many tokens each or so."""
    rng = random.Random(8)
    return [(i, " ".join(rng.choice(("alpha", "beta", "gamma", "of", "the", "and")) for _ in range(rng.randint(words // 2, 2 * words))), "en", rng.choices(list(sources), sources.values())[0], 0) for i in range(n)]


def window_shares(rows):
    """Per part, in order, the full windows: (target, share) by source."""
    windows = defaultdict(dict)
    size = Counter()
    for r in rows:
        windows[r.sequence_id][r.source] = (r.target_share, r.window_share)
        size[r.sequence_id] += r.length
    out = defaultdict(list)
    for s in sorted(windows):
        if size[s] == 2048:
            out[s >> 32].append(windows[s])
    return out


def test_windows_keep_the_targets_until_a_source_ends(monkeypatch, spark, encoder):
    """Equal targets for sources of 1 to 4; while the small one lasts every window is half and half, but for the last of a part."""
    from conftest import SCHEMA

    monkeypatch.setattr(packing, "PART_TOKENS", 20_000)
    docs = sized(1500, {"big": 4, "small": 1}, 100)
    rows = packing.pack(spark.createDataFrame(docs, SCHEMA), {"big": 1, "small": 1}).collect()
    check_packing(rows, docs, encoder)
    parts = window_shares(rows)
    mixed = [w for p in parts.values() for w in p[:-3] if "small" in w and abs(w["small"][0] - 0.5) < 0.01]
    assert len(mixed) > 0.15 * sum(map(len, parts.values()))
    assert all(abs(w["small"][1] - 0.5) < 0.2 for w in mixed)
    assert abs(sum(w["small"][1] for w in mixed) / len(mixed) - 0.5) < 0.02
    assert all("small" not in w or w["small"][0] < 0.01 for w in parts[max(parts)])  # used up


def lag(rows):
    """How many tokens, at the end of each sequence, the sources are from what the plan had for them until then, summed up."""
    target, share, size = defaultdict(dict), defaultdict(dict), Counter()
    for r in rows:
        target[r.sequence_id >> 32][r.source] = r.target_share
        share[r.sequence_id][r.source] = r.window_share
        size[r.sequence_id] += r.length
    ahead, out = Counter(), 0.0
    for s in sorted(share):
        for source, t in target[s >> 32].items():
            ahead[source] += (share[s].get(source, 0.0) - t) * size[s]
        out += sum(map(abs, ahead.values()))
    return out


def test_deficits_are_carried_from_part_to_part(monkeypatch, spark):
    """Without the carried deficits the sources are further from the plan."""
    from conftest import SCHEMA

    monkeypatch.setattr(packing, "PART_TOKENS", 20_000)
    docs = spark.createDataFrame(sized(1200, {"a": 1, "b": 1, "c": 1}, 300), SCHEMA)
    weights = {"a": 1.0, "b": 1.0, "c": 1.0}
    carried = lag(packing.pack(docs, weights).collect())
    monkeypatch.setattr(packing, "_packed", _without_carrying(packing._packed))
    assert carried < lag(packing.pack(docs, weights).collect())


def _without_carrying(packed):
    """Packing that takes every carried deficit for zero."""

    def f(context, granule):
        run = packed(context, granule)

        def g(batches):
            import pyarrow as pa

            def zeroed():
                for b in batches:
                    i = b.schema.get_field_index("deficit")
                    yield b.set_column(i, "deficit", pa.array([None if x is None else 0.0 for x in b.column(i).to_pylist()], pa.float64()))

            yield from run(zeroed())

        return g

    return f


def test_plan_uses_sources_until_they_end():
    """Tokens of a: 100 at weight 1/2, b: 300 at 1/4, c: 200 at 1/4. a ends at time 200, c at 800, b at 1200."""
    plan = packing.Plan(np.array([200.0, 1200.0, 800.0]), np.array([0.5, 0.25, 0.25]))
    assert plan.tokens[-1] == 600
    for time in (0.0, 50.0, 200.0, 500.0, 800.0, 1000.0, 1200.0):
        brute = sum(w * min(time, r) for w, r in ((0.5, 200), (0.25, 1200), (0.25, 800)))
        assert abs(plan.tokens_at(time) - brute) < 1e-9 and abs(plan.time_at(brute) - time) < 1e-9


def brute_windows(queues, weights, context, granule):
    """Deficit round-robin over lists of tokens, one token at a time; no deficit carried in."""
    queues = {s: list(q) for s, q in sorted(queues.items())}
    deficit, rest, turn, names = dict.fromkeys(queues, 0.0), sum(map(len, queues.values())), 0, sorted(queues)
    while rest:
        size = context if rest >= context else 2 ** int(np.log2(rest))
        window = []

        def take(s, n):
            for _ in range(n):
                window.append(queues[s].pop(0))
                deficit[s] -= 1

        for s in names:
            deficit[s] += weights[s] * size
        for i in range(len(names)):
            s = names[(i + turn) % len(names)]
            due = int(deficit[s])
            if queues[s] and due >= min(granule, len(queues[s])) and len(window) < size:
                take(s, min(due, len(queues[s]), size - len(window)))
        while len(window) < size:
            s = max((s for s in names if queues[s]), key=lambda s: deficit[s])
            take(s, min(max(granule, int(deficit[s])), len(queues[s]), size - len(window)))
        names = [s for s in names if queues[s]]
        turn = (turn + 1) % max(1, len(names))
        rest -= size
        yield window


def test_round_robin_equals_brute_force():
    rng = random.Random(5)
    for _ in range(20):
        weights = dict(zip("abcd", np.random.default_rng(rng.randint(0, 99)).dirichlet(np.ones(4)).tolist()))
        docs = [(rng.choice("abcd"), i, rng.randint(1, 400)) for i in range(60)]
        p, queues = packing._Part(0), defaultdict(list)
        p.weight = dict(weights)
        for s, i, n in docs:
            p.add(s, i, np.arange(n, dtype=np.uint16))
            queues[s] += [(i, k) for k in range(n)]
        known = {s: w / sum(weights[x] for x in queues) for s, w in weights.items()}
        got = [[(doc, start + k) for doc, start, n, _, _, _ in w for k in range(n)] for w in p.windows(256, 16)]
        assert got == list(brute_windows(queues, known, 256, 16))


def part(tokens, weights, carried=None):
    out = packing._Part(0)
    out.weight, out.deficit = dict(weights), dict(carried or {})
    for source, n in tokens.items():
        for i in range(0, n, 500):
            out.add(source, i, np.zeros(min(500, n - i), np.uint16))
    return out


def shares(p, names):
    for window in p.windows(2048, 64):
        n = Counter()
        for _, _, length, _, _, source in window:
            n[source] += length
        yield [n[s] / 2048 for s in names], sum(n.values())


def test_every_window_has_the_target_proportions():
    target = {"a": 0.6, "b": 0.3, "c": 0.1}
    windows = list(shares(part({"a": 60_000, "b": 30_000, "c": 10_000}, target), target))
    full = [w for w, n in windows if n == 2048]
    assert len(full) == 48
    assert all(abs(x - t) < 0.07 for w in full[:-1] for x, t in zip(w, target.values()))


def test_a_carried_deficit_is_made_good():
    """The source that earlier parts left short comes more often, evenly over the part."""
    target = {"a": 0.5, "b": 0.5}
    windows = [w for w, n in shares(part({"a": 60_000, "b": 40_000}, target, {"a": 10_000.0, "b": -10_000.0}), target) if n == 2048]
    assert all(abs(w[0] - 0.6) < 0.07 for w in windows[:-1])


def test_packing_of_nothing_and_of_extra_columns(empty, clashing):
    assert packing.pack(empty).count() == 0
    assert {r.doc_id for r in packing.pack(clashing).collect()} == {r.doc_id for r in clashing.collect()}
