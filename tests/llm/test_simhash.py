import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import simhash as S
from lodestone.llm.components import components


def brute_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(keys, prints, limit=4):
    up = list(range(len(keys)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= limit:
                up[root(i)] = root(j)
    least = {}
    for i, k in enumerate(keys):
        r = root(i)
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    return [least[root(i)] for i in range(len(keys))]


def test_equals_brute_force(documents, corpus, edge):
    rows = corpus + edge
    prints = [brute_fingerprint(r[1]) for r in rows]
    want = sorted(map(str, zip([r[0] for r in rows], [f"{p:016x}" for p in prints], brute_components([r[0] for r in rows], prints), strict=True)))
    got = sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in S.simhash_components(documents).collect())
    assert got == want


def crowd(n, seed):
    """Fingerprints in balls around few centres, so that anchors are crowded."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    out = []
    for _ in range(n):
        x = int(centres[rng.integers(4)])
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("hot", [10, 100_000])
@pytest.mark.parametrize("covering", [S.THREE, S.TWO])
def test_links_reach_all_pairs_however_anchors_are_split(spark, monkeypatch, covering, hot, few):
    if not few:
        if hot > 10:
            return
        monkeypatch.setattr(S, "small", lambda df: df)  # as if crowded anchors were too many to broadcast
    prints = crowd(300, hot)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = S.links(spark.createDataFrame([(p,) for p in signed], "fp long"), covering=covering, hot=hot)
    found = {r.node: r.root for r in components(edges).collect()}
    got = [found.get(p, p) for p in signed]
    want = brute_components(signed, prints)
    assert got == want
    assert edges.count() < 8 * len(prints) * 8  # forests, not all pairs


@pytest.mark.parametrize("block", [*S.THREE.blocks, *S.TWO.blocks, *S.TWO.second[0], *S.THREE.second[1]])
def test_code_covers_and_anchors_meet(block):
    """A value within the threshold has the home anchor of the other among its own."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x.copy()
    for _ in range(block.within):
        y ^= np.uint64(1) << (rng.integers(0, block.bits, 500).astype(np.uint64) + np.uint64(block.first))
    rows, at, home = S.anchors(x, block)
    r2, a2, h2 = S.anchors(y, block)
    near = set(zip(rows.tolist(), at.tolist(), strict=True))
    assert len(near) == len(rows)
    assert all((r, a) in near for r, a in zip(r2[h2].tolist(), a2[h2].tolist(), strict=True))
    assert home.sum() == 500
    part = (x >> np.uint64(block.first) & np.uint64((1 << block.bits) - 1)).astype(np.int64)
    assert (np.bitwise_count(at[home] ^ part[rows[home]]) <= 1).all()
    assert not S._syndrome(at, block.code).any()


def test_components_of_a_long_path_and_of_a_star(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components(path).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and 5000 not in got


def test_uneven_components_and_fingerprints(spark, monkeypatch):
    """Common keys are broadcast, the others shuffle; as if a broadcast held three rows."""
    from lodestone.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    hub = [(1, 1 + i) for i in range(1, 200)] + [(1000 + 2 * i, 1001 + 2 * i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(hub, "u long, v long")).collect()}
    assert got == {n: min(e) if min(e) != 1 else 1 for e in hub for n in e}
    prints = [0] * 60 + crowd(40, 3)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    marked = spark.createDataFrame(list(enumerate(signed)), "doc_id long, _llm_fp long")
    rows = {r.doc_id: r.component_id for r in S.near_duplicates(marked).collect()}
    assert [rows[i] for i in range(100)] == brute_components(list(range(100)), prints)


def test_one_of_each_keeps_the_smallest_id(documents, clashing, empty):
    kept = S.one_of_each(documents).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(135) == 1 and not {136, 137, 149} & set(ids) and ids.count(1004) == 2
    assert S.one_of_each(documents).columns == documents.columns
    assert S.one_of_each(clashing).columns == clashing.columns
    assert S.one_of_each(empty).count() == 0
    assert S.simhash_components(empty).count() == 0
    row = S.one_of_each(clashing).where(F.col("doc_id") == 3).first()
    assert row["fingerprint"] == "own fingerprint"
