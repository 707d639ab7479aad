"""Versions, vectors, index, cells, order statistics, revisions, pages and logs: against plain versions, with conflicts, restarts and hot keys."""

import json
import math
import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import cells, revisions
from lodestone.operators import evaluation as V
from lodestone.operators import index as I
from lodestone.operators import retrieval as R
from lodestone.operators import scoring
from lodestone.operators.quantiles import percentiles, selected
from lodestone.operators.vectors import VectorTable
from lodestone.operators.versions import Conflict, Versions
from lodestone.sources import files, paged
from lodestone.streaming import trace


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id long, source string, x long")


def held(t):
    return sorted(map(tuple, t.read(t.manifest()).collect()))


def test_two_writers_one_must_retry(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"), "source", 4)
    assert t.manifest() is None
    first = t.commit(rows(spark, (1, "a", 1), (2, "b", 2)), None)
    winner = t.commit(rows(spark, (1, "a", 10)), first, t.touched(rows(spark, (1, "a", 1))))
    with pytest.raises(Conflict):
        t.commit(rows(spark, (2, "b", 20)), first, t.touched(rows(spark, (2, "b", 2))))
    assert t.history() == [1, 2] and held(t) == [(1, "a", 10), (2, "b", 2)]
    other, tries = Versions(spark, str(tmp_path / "t"), "source", 4), []

    def step(base):
        tries.append(base.version)
        if len(tries) == 1:  # another writer comes first
            other.replace(rows(spark, (3, "c", 3)))
        new = rows(spark, (2, "b", 20))
        return t.read(base, t.touched(new)).where("source <> 'b'").unionByName(new), t.touched(new)

    t.change(step)
    assert tries == [2, 3] and held(t) == [(1, "a", 10), (2, "b", 20), (3, "c", 3)]
    assert sorted(map(tuple, t.read(winner).collect())) == [(1, "a", 10), (2, "b", 2)], "an old version is still there"


def test_an_interrupted_write_leaves_the_old_version(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"), "source", 2)
    t.commit(rows(spark, (1, "a", 1)), None)
    bad = rows(spark, (1, "a", 2)).withColumn("x", F.when(F.col("x") > 0, F.raise_error(F.lit("lost"))).cast("long"))
    with pytest.raises(Exception, match="lost"):
        t.replace(bad)
    assert t.history() == [1] and held(t) == [(1, "a", 1)]
    t.upsert(rows(spark, (1, "a", 5), (9, "z", 9)), "id")
    assert held(t) == [(1, "a", 5), (9, "z", 9)]
    t.delete(spark.createDataFrame([(7,)], "id long"), "id")
    assert len(t.history()) == 2, "nothing to delete, no version"
    t.delete(spark.createDataFrame([(1,)], "id long"), "id")
    assert held(t) == [(9, "z", 9)] and t.cleaned(1)
    assert held(t) == [(9, "z", 9)]
    with pytest.raises(ValueError):
        t.commit(rows(spark, (1, "a", 1)).drop("x"), t.manifest(), ["0"])


def test_vector_table(spark, tmp_path):
    """Deleting, replacing and synchronizing by count; another encoder's table is not read."""
    def encode(chunks):
        return chunks.select("chunk_id", "source_id", F.array(F.length("content").cast("double"), F.lit(1.0)).alias("vector"))

    def chunks(*values):
        return spark.createDataFrame(list(values), "chunk_id long, source_id string, content string")

    t = VectorTable(spark, str(tmp_path / "v"), {"model": "a"}, encode, 4)
    with pytest.raises(LookupError):
        t.read()
    lengths = lambda: {r.chunk_id: (r.source_id, r.vector[0]) for r in t.read().collect()}
    t.upsert(chunks((1, "s", "xx"), (2, "s", "xxx"), (3, "r", "x")))
    t.upsert(chunks((2, "s", "xxxxx"), (3, "q", "moved")))
    assert lengths() == {1: ("s", 2.0), 2: ("s", 5.0), 3: ("q", 5.0)}
    t.delete_chunks(spark.createDataFrame([(1,)], "chunk_id long"))
    assert lengths() == {2: ("s", 5.0), 3: ("q", 5.0)}
    t.replace_source(chunks((7, "s", "seven")))
    assert lengths() == {7: ("s", 5.0), 3: ("q", 5.0)}
    active = chunks((7, "s", "a"), (8, "s", "bb"), (3, "q", "ccc"))
    assert {r.source_id for r in t.diverging(active).collect()} == {"s"}
    t.synchronize(active)
    assert lengths() == {7: ("s", 1.0), 8: ("s", 2.0), 3: ("q", 5.0)}, "the source that doesn't diverge keeps its vectors"
    n = len(t.versions.history())
    t.synchronize(active)
    assert len(t.versions.history()) == n
    t.delete_source(spark.createDataFrame([("s",)], "source_id string"))
    assert lengths() == {3: ("q", 5.0)}
    other = VectorTable(spark, str(tmp_path / "v"), {"model": "b"}, encode, 4)
    with pytest.raises(LookupError):
        other.read()
    other.synchronize(active)
    assert {r.chunk_id: r.vector[0] for r in other.read().collect()} == {7: 1.0, 8: 2.0, 3: 3.0}


def corpus(spark, n=600):
    """Chunks of three kinds of words, with words that all have and words that one has; null and empty ones."""
    rng = random.Random(2)
    kinds = [[f"{k}{i}" for i in range(60)] for k in ("ab", "cd", "ef")]
    chunks = [(i, f"s{i % 3}", " ".join(["the", "of"] * rng.randint(1, 6) + rng.choices(kinds[i % 3], k=rng.randint(1, 40)) + [f"only{i}"])) for i in range(n)]
    chunks += [(n, "s0", None), (n + 1, "s1", ""), (n + 2, "s1", "the the the")]
    queries = [(i, chunks[i * 7 % n][2]) for i in range(30)] + [(100, "the"), (101, "nothing here"), (102, "the of ab1 ab1 only5"), (103, None)]
    return spark.createDataFrame(chunks, "chunk_id long, source_id string, content string"), spark.createDataFrame(queries, "query_id long, question string")


@pytest.mark.parametrize("block, k, known", [(8, 5, True), (64, 3, True), (8, 5, False), (64, 3, False)])
def test_index_equals_the_scan(spark, tmp_path, monkeypatch, block, k, known):
    monkeypatch.setattr(I, "_known", lambda asked: known)
    chunks, queries = corpus(spark)
    made = I.build(chunks.repartition(3), str(tmp_path / "ix"), block=block)
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
    want = key(R.bm25(chunks.where("content IS NOT NULL").unionByName(chunks.where("content IS NULL").withColumn("content", F.lit(""))), queries, k))
    assert key(I.search(made, queries, k)) == want and len(want) > 90
    work = {r.query_id: r for r in I.search(made, queries, k, work=True).collect()}
    assert set(work) == {i for i, *_ in want}
    if block == 8:
        assert sum(r.blocks_scored for r in work.values()) < 0.5 * sum(r.blocks for r in work.values()), "blocks are skipped"
        assert work[0].pairs_scored < 300, "most chunks that share only common words are not scored"


def test_best_of_blocks_with_equal_scores_and_odd_batches(monkeypatch):
    """A block cut by batches, chunk ids that fall while scores tie, strings as ids; against a plain computation."""
    monkeypatch.setattr(scoring, "HELD", 7)
    monkeypatch.setattr(scoring, "TOKENS", 40)
    monkeypatch.setattr(scoring, "AT_ONCE", 50)
    rng = random.Random(5)
    texts = [rng.choices("abcdefg", k=rng.randint(0, 6)) for _ in range(300)]
    chunks = [(i // 8, f"c{999 - i}", len(t), t) for i, t in enumerate(texts)]
    entries = [(q, t, w, None if q % 2 else 0.5) for q in range(9) for t, w in zip(rng.sample("abcdefgz", 3), (0.25, 0.5, 1.0), strict=True)]
    asked = scoring.Asked(pa.table(dict(zip(("query_id", "term", "weight", "least"), map(list, zip(*entries, strict=True)), strict=True))))
    schema = pa.schema([("block", pa.int64()), ("chunk_id", pa.string()), ("dl", pa.int32()), ("tokens", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*chunks[i : i + 11], strict=True)), schema, strict=True)], schema=schema) for i in range(0, 300, 11)]
    pieces = list(scoring.whole_blocks(iter(batches)))
    assert pa.Table.from_batches(pieces) == pa.Table.from_batches(batches) and len(pieces) > 5
    assert sum(len(set(p.column("block").to_pylist())) for p in pieces) == 38, "no block is cut"
    listed = [r for b in I._listed(iter(batches)) for r in b.to_pylist()]
    assert len(listed) == len({(b, x) for b, _, _, t in chunks for x in t})
    assert {(r["term"], r["block"], x["chunk_id"], x["tf"], x["dl"]) for r in listed for x in r["list"]} == {(x, b, c, t.count(x), n) for b, c, n, t in chunks for x in t}
    got = [r for b in scoring.best(lambda: asked, 4, 1.5, 0.75, 3.0, 1e-6, False)(iter(batches)) for r in b.to_pylist()]
    want = set()
    for q in range(9):
        terms, scored = {t: w for n, t, w, _ in entries if n == q}, []
        for _, c, dl, t in chunks:
            s = round(sum(w * t.count(x) * 2.5 / (t.count(x) + 1.5 * (0.25 + 0.75 * dl / 3.0)) for x, w in terms.items()), 9)
            if s > 0 and s >= (0 if q % 2 else 0.5):
                scored.append((-s, c))
        want |= {(q, c, -s) for s, c in sorted(scored)[:4]}
    assert {(r["query_id"], r["chunk_id"], r["score"]) for r in got} == want and len(got) == len(want)


def test_index_is_built_once_for_a_state(spark, tmp_path):
    chunks, queries = corpus(spark, 60)
    built = []
    open_ = lambda **p: I.opened(spark, lambda: built.append(1) or chunks, str(tmp_path), p)
    a, b, c = open_(state=1), open_(state=1), open_(state=2)
    assert len(built) == 2 and a.path == b.path != c.path and a.n == 63
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.parquet").write_text("x")
    before = I.state(spark, str(tmp_path / "t"))
    (tmp_path / "t/y.parquet").write_text("y")
    assert I.state(spark, str(tmp_path / "t")) != before
    assert I.search(I.build(chunks.limit(0), str(tmp_path / "none")), queries, 3).count() == 0


def test_cells(spark, tmp_path):
    """Clustered vectors: few cells are probed and nearly all neighbours found; a cell of most rows has slices; odd vectors."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 3
    x = np.concatenate([centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) / 2, centres[0] + rng.normal(size=(2000, 16)) / 3])
    table = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(9000, None), (9001, [1.0, 2.0]), (9002, [0.0] * 16)]
    vectors = spark.createDataFrame(table, "chunk_id long, vector array<double>").repartition(4)
    asked = vectors.where("chunk_id % 50 = 0 AND chunk_id < 9000").select(F.col("chunk_id").alias("query_id"), "vector")
    fitted = cells.fit(vectors, 60)
    assert fitted.probes < 20
    cells.SLICE, before = 100, cells.SLICE
    try:
        stored = cells.build(vectors, fitted, str(tmp_path / "c"))
    finally:
        cells.SLICE = before
    assert stored.agg(F.max("slices")).first()[0] >= 3 and stored.count() == 5001
    exact = R.dense(vectors.where("chunk_id < 9000"), asked, 10)
    found = cells.search(stored, fitted, asked, 10)
    assert cells.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.93
    scores = {(r.query_id, r.chunk_id): r.score for r in exact.collect()}
    both = [(scores[r.query_id, r.chunk_id], r.score) for r in found.collect() if (r.query_id, r.chunk_id) in scores]
    assert all(abs(a - b) < 2e-6 for a, b in both), "scores are exact"
    assert cells.fit(vectors.limit(0)) is None


@pytest.mark.parametrize("kind", ["ties", "wide", "normal"])
def test_order_statistics(spark, kind):
    rng = random.Random(kind)
    draw = {"ties": lambda: float(rng.randint(0, 3)), "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 308), "normal": lambda: rng.gauss(0, 1)}[kind]
    groups = {g: [draw() for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("hot", 9000), (None, 7))}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("empty", None), ("a", None)], "g string, v double").repartition(5)
    got = {r.g: r for r in percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95, "p10": 0.1}).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        at = lambda p: vs[max(1, math.ceil(len(vs) * p)) - 1]
        half = (vs[(len(vs) + 1) // 2 - 1] + vs[len(vs) // 2]) / 2
        assert (got[g].p50, got[g].p95, got[g].p10) == (half, at(0.95), at(0.1))
    one = selected(df, ["g"], "v", {"first": F.lit(1), "none": F.col("n") + 1, "last": F.col("n")})
    assert {r["g"]: (r["first"], r["none"], r["last"]) for r in one.collect()} == {g: (min(v), None, max(v)) for g, v in groups.items()}


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "v double")
    r = selected(df, [], "v", {"a": F.lit(1), "b": F.lit(2), "c": F.lit(3)}).first()
    assert (r.a, r.b) == (1.0, float("inf")) and math.isnan(r.c)


def test_hashed_bootstrap_is_near_the_exact_one(spark):
    """The interval of a mean is that of the normal approximation; rows that shuffle don't grow with the table."""
    rng = random.Random(1)
    values = {g: [rng.gauss(m, 2) for _ in range(1500)] for g, m in (("a", 0), ("b", 5))}
    df = spark.createDataFrame([(g, v, i) for g, vs in values.items() for i, v in enumerate(vs)] + [("a", None, -1)], "g string, v double, _order long").repartition(3)
    for r in V.bootstrap_by_hash(df, "g", "v").collect():
        mean, error = statistics.fmean(values[r.g]), statistics.stdev(values[r.g]) / math.sqrt(1500)
        assert abs(r.low - (mean - 1.96 * error)) < 0.25 * error and abs(r.high - (mean + 1.96 * error)) < 0.25 * error


def manifest(spark, files_):
    return spark.createDataFrame([(p, t) for p, t in files_.items()], "path string, text string").withColumn("hash", F.sha2("text", 256))


def test_revision_rules(spark):
    old = manifest(spark, {"unchanged.py": "u", "changed.py": "old", "deleted.py": "d", "moved.py": "m", "twin1": "t", "twin2": "t"})
    new = manifest(spark, {"unchanged.py": "u", "changed.py": "new", "lib/moved.py": "m", "copy.py": "u", "added.py": "a", "twin1": "t", "twin3": "t"})
    status = {(r.status, r.path, r.target) for r in revisions.name_status(old.select("path", "hash"), new.select("path", "hash")).collect()}
    assert status == {("M", "changed.py", None), ("D", "deleted.py", None), ("R", "moved.py", "lib/moved.py"), ("C", "unchanged.py", "copy.py"), ("A", "added.py", None), ("R", "twin2", "twin3")}
    chunks = old.select("path", F.concat(F.lit("repo@old/"), "path").alias("locator"))
    cut = lambda f: f.select("path", F.concat(F.lit("repo@new/"), "path").alias("locator"))
    run = lambda known, previous: revisions.revised(chunks, new, known, "new", previous, cut)
    found, step = run(old.select("path", "hash"), "old")
    got = {r.path: r.locator.split("@")[1].split("/")[0] for r in found.collect()}
    # as a diff reports a copy, it is the path copied from that is indexed anew
    assert step == "updated" and got == {"unchanged.py": "new", "changed.py": "new", "lib/moved.py": "new", "added.py": "new", "twin1": "old", "twin3": "new"}
    assert run(old, "new")[1] == "unchanged" and run(old, "new")[0].count() == 6
    found, step = run(None, "old")
    assert step == "full" and {r.path for r in found.collect()} == {r.path for r in new.collect()}


def test_paged_issues(spark, tmp_path):
    """Every page before the end once, pull requests go and don't count, errors carry their message, reading resumes, known numbers keep their chunk."""
    total = 437

    def get(page):
        if page > 40:
            raise RuntimeError("never asked for")
        first = (page - 1) * 10 + 1
        return [{"number": n, "title": f"t{n}", **({"pull_request": {}} if n % 4 == 0 else {})} for n in range(first, min(total, first + 9) + 1)] if page < 99 else []

    schema = "number long, title string, pull_request string"
    with pytest.raises(Exception, match="never asked for"):
        paged.pages(spark, get, schema, 10, 3).count()
    total = 95
    read = paged.pages(spark, get, schema, 10, 3)
    assert [r.number for r in read.orderBy("page", "place").collect()] == list(range(1, 96))
    assert [r.number for r in paged.issues(read, 20).collect()] == [n for n in range(1, 96) if n % 4][:20]
    assert paged.resume_at(read, 10) == 10 and paged.resume_at(read.where("page < 10"), 10) == 10 and paged.resume_at(read.limit(0)) == 1
    assert {r.page for r in paged.pages(spark, get, schema, 10, 3, first=10).collect()} == {10}

    def limited(page):
        raise RuntimeError("rate limited (remaining=0)")

    with pytest.raises(Exception, match="remaining=0"):
        paged.pages(spark, limited, schema).count()
    (tmp_path / "page=1").mkdir()
    (tmp_path / "page=1/a.json").write_text("\n".join(json.dumps({"number": n}) for n in (2, 1)))
    assert [r["number"] for r in paged.folder_of_pages(f"file://{tmp_path}")(1)] == [1, 2] and paged.folder_of_pages(str(tmp_path))(2) == []
    known = spark.createDataFrame([("u1", 5, "a"), ("u2", 6, "b")], "url string, chunk_id long, content string")
    found = spark.createDataFrame([("u1", "a"), ("u2", "c"), ("u3", "d"), ("u3", "d")], "url string, content string")
    got = {r.url: (r.chunk_id, r.status) for r in paged.upserted(known, found, F.lit(99).cast("long")).collect()}
    assert got == {"u1": (5, "known"), "u2": (6, "changed"), "u3": (99, "new")}
    assert "pull_request" not in files.issues(spark.createDataFrame([(1, "t", None, "u", None)], "number long, title string, body string, html_url string, pull_request string")).columns


def test_log_goes_on_after_a_restart(spark, tmp_path):
    """Numbers without gaps over three goes; a go without new files adds nothing; late events say so; readers resume and stop at the terminal event."""
    events, log, state = (str(tmp_path / n) for n in ("events", "log", "state"))
    schema = "run_id long, event_id long, event_type string, ts timestamp"

    def put(*values):
        spark.createDataFrame([(r, e, k, t) for r, e, k, t in values], "run_id long, event_id long, event_type string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(events)
        trace.append(spark.readStream.schema(schema).parquet(events), log, state)

    put((1, 1, "start", 10), (1, 2, "tool", 30), (2, 3, "start", 11))
    trace.append(spark.readStream.schema(schema).parquet(events), log, state)
    put((1, 4, "tool", 20), (1, 5, "done", 40), (2, 6, "tool", 11))
    put((1, 7, "note", 50), (3, 8, "start", 1))
    held_ = spark.read.parquet(log).drop("batch")
    assert sorted((r.run_id, r.sequence, r.event_id, r.late) for r in held_.collect()) == [(1, 1, 1, False), (1, 2, 2, False), (1, 3, 4, True), (1, 4, 5, False), (1, 5, 7, False), (2, 1, 3, False), (2, 2, 6, False), (3, 1, 8, False)]
    seen = lambda *pairs: sorted((r.run_id, r.sequence) for r in trace.tail(held_, spark.createDataFrame(list(pairs), "run_id long, sequence long"), ("done",)).collect())
    assert seen((1, 2), (2, 2)) == [(1, 3), (1, 4), (3, 1)] and seen((1, 4), (2, 0), (3, 1)) == [(2, 1), (2, 2)]


def test_numbers_go_on_over_many_batches(spark, tmp_path, monkeypatch):
    """Whole lists of runs, the batches between them, their removal, a batch that runs twice, and null runs and times."""
    monkeypatch.setattr(trace, "WHOLE", 3)
    events, log, state = (str(tmp_path / n) for n in ("events", "log", "state"))
    schema, want, last, newest = "run_id long, event_id long, event_type string, ts timestamp", [], {}, {}
    for batch in range(8):
        rows = [(None if run == 4 else run, 100 * batch + i, "e", None if (batch, i) == (2, 1) else 50 + (batch * 7 + i * 5) % 20) for i in range(4) for run in [(batch * i) % 5] if run != 3 or batch < 2]
        spark.createDataFrame(rows, "run_id long, event_id long, event_type string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(events)
        trace.append(spark.readStream.schema(schema).parquet(events), log, state)
        if batch in (3, 5):  # as after a failure between the batch's end and its commit
            (tmp_path / f"state/commits/{batch}").unlink()
            (tmp_path / f"state/commits/.{batch}.crc").unlink(missing_ok=True)
            trace.append(spark.readStream.schema(schema).parquet(events), log, state)
        before = dict(newest)
        for run, event, _, t in sorted(rows, key=lambda r: (r[3] is None, r[3] or 0, r[1])):
            last[run] = last.get(run, 0) + 1
            want.append((run, last[run], event, t is not None and run in before and t < before[run]))
            newest[run] = max(newest.get(run, 0), t or 0)
    got = spark.read.parquet(log)
    assert sorted(map(str, ((r.run_id, r.sequence, r.event_id, r.late) for r in got.collect()))) == sorted(map(str, want))
    assert {p.name for p in (tmp_path / "state/runs").iterdir() if p.is_dir()} == {"batch=5", "batch=6", "batch=7"}


def test_a_batch_is_numbered_in_one_shuffle_without_python(spark):
    events = spark.range(100).selectExpr("id % 3 AS run_id", "id AS event_id", "'e' AS event_type", "timestamp_seconds(id) AS ts")
    runs = spark.range(2).selectExpr("id AS run_id", "10 AS last", "timestamp_seconds(50) AS newest")
    numbered = trace.sequenced(events, runs.selectExpr("run_id", "cast(last AS long) AS last", "newest"))
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert {(r.run_id, r.n, r.late) for r in numbered.groupBy("run_id").agg(F.min("sequence").alias("n"), F.sum(F.col("late").cast("int")).alias("late")).collect()} == {(0, 11, 17), (1, 11, 17), (2, 1, 0)}
