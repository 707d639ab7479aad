"""Evaluation of retrieval and of answers."""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..functions.python import EXACT_DRAWS, bootstrap_mean, fact_coverage, generator_draws, generator_states, joined_parts, percentile_places, whole_parts
from ..functions.text import phrase_share
from .common import rank, settled
from .evidence import SUPPORT, citations
from .quantiles import percentiles, selected

CUTOFFS = (1, 3, 5, 10)
#: Values of a group that a task of the shared bootstrap holds.
PART = 1 << 21


def retrieval_metrics(hits: DataFrame, required: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """recall_at_k, mrr and ndcg_at_10 of each query of required (query_id, phrases) from hits (query_id, rank, content).

    Recall looks for phrases in the joined texts of the first k hits, so a phrase may lie across two of them. Where
    nothing is required, recall is 1 only if nothing was found, and nDCG is 1.
    """
    most = max(cutoffs)
    scored = required.join(hits.where(F.col("rank") <= most), "query_id", "left").withColumn("gain", phrase_share(F.coalesce("content", F.lit("")), F.col("phrases")))
    listed = scored.groupBy("query_id").agg(F.first("phrases").alias("phrases"), F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "content", "gain")))).alias("h"))
    joined = lambda k: F.array_join(F.transform(F.filter("h", lambda x: x["rank"] <= k), lambda x: x["content"]), " ")
    none = F.size("phrases") == 0
    recall = [F.when(none, (F.size("h") == 0).cast("double")).otherwise(phrase_share(joined(k), F.col("phrases"))).alias(f"recall_at_{k}") for k in cutoffs]
    relevant = F.filter("h", lambda x: x["gain"] > 0)
    first = F.when(F.size(relevant) > 0, 1 / F.get(relevant, F.lit(0))["rank"]).otherwise(0.0)
    gains = F.transform("h", lambda x: x["gain"])
    discounted = lambda a: F.aggregate(F.transform(a, lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
    ideal = discounted(F.sort_array(gains, asc=False))
    ndcg = F.when(ideal > 0, discounted(gains) / ideal).otherwise(none.cast("double"))
    return listed.select("query_id", *recall, first.alias("mrr"), ndcg.alias("ndcg_at_10"))


def run_summary(runs: DataFrame) -> DataFrame:
    """One row: runs, completed ones, their latencies and tokens, tool calls, cache hits (null for none)."""
    done = F.col("status") == "completed"
    counts = runs.agg(
        F.count("*").alias("run_count"),
        F.count(F.when(done, 1)).alias("completed_count"),
        F.coalesce(F.sum(F.when(done, F.col("tokens"))), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("tool_calls"), F.lit(0)).alias("total_tool_calls"),
        F.nullif(F.sum(F.when(done, F.col("cache_hits"))), F.lit(0)).alias("cache_hits"),
    )
    latency = percentiles(runs.where(done), [], "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95})
    return counts.withColumn("_one", F.lit(1)).join(latency.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")  # one row each


def bootstrap(values: DataFrame, by: str, value: str, seed: int, samples: int = 2_000) -> DataFrame:
    """by, mean, low, high with the draws of the standard generator. Groups of up to EXACT_DRAWS draws are a task each; larger ones are shared by many tasks, with the same draws."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("_order")[value].astype(float).tolist()
        low, high = bootstrap_mean(ordered, seed, samples)
        return pd.DataFrame({by: [group[by].iloc[0]], "mean": [sum(ordered) / len(ordered)], "low": [low], "high": [high]})

    kind = values.schema[by].dataType.simpleString()
    values = settled(values.select(by, value, "_order"))
    large = settled(values.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") * samples > EXACT_DRAWS).select(F.col(by).alias("_key"), "n"))
    same = F.col(by).eqNullSafe(F.col("_key"))
    small = values.join(large, same, "left_anti").groupBy(by).applyInPandas(one, f"{by} {kind}, mean double, low double, high double")
    if large.isEmpty():
        return small
    number = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
    rows = values.join(large, same).select(F.col("_key").alias("key"), "n", number.alias("v"), F.col("_order").alias("o"))
    return small.unionByName(_shared_bootstrap(rows, seed, samples).select(F.col("key").alias(by), "mean", "low", "high"))


def _shared_bootstrap(rows: DataFrame, seed: int, samples: int) -> DataFrame:
    """key, mean, low, high of groups (key, n, v, o) of any size.

    A task runs through the generator once for each n and keeps its state before every DRAWN tries, a few kB each; with these, tasks make the draws again, apart, for PART values of a
    group, and send on sums by sample. Values are split into whole numbers of 26 bits below the group's largest exponent, so sums are exact in whatever order.
    """
    spark, kind = rows.sparkSession, rows.schema["key"].dataType.simpleString()
    finite = F.when(F.abs("v") < float("inf"), F.abs("v"))
    groups = settled(rows.groupBy("key", "n").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.coalesce(F.max(finite), F.lit(0.0)).alias("top")))
    walked = groups.where("least < most").select("n").distinct().mapInArrow(lambda batches: (s for b in batches for n in b.column("n").to_pylist() for s in generator_states(seed, n, n * samples)), "n long, first long, state binary")
    states = settled(walked)
    # places in order of o: ranges of rows are counted, and a range's rows are numbered from what is before it
    ranged = settled(rows.repartitionByRange("key", "o").sortWithinPartitions("key", "o").select("key", "n", "v", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")))
    counted = ranged.groupBy("key", "range").agg(F.count("*").alias("rows"), F.min("at").alias("start"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select(F.col("key").alias("k"), F.col("range").alias("r"), (before - F.col("start")).alias("offset"))
    placed = ranged.join(F.broadcast(offsets), F.col("key").eqNullSafe(F.col("k")) & (F.col("range") == F.col("r"))).withColumn("place", F.col("at") + F.col("offset")).drop("k")
    slices = spark.sparkContext.defaultParallelism
    tops = groups.select(F.col("key").alias("k"), "top")
    part = placed.join(F.broadcast(tops), F.col("key").eqNullSafe(F.col("k"))).select("key", "n", "top", "v", "place", F.expr(f"place div {PART}").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PART}"))).alias("part")
    drawn = groups.where("least < most").select("key", "n", parts).join(states, "n").withColumn("slice", F.pmod(F.xxhash64("first"), F.lit(slices)).cast("int"))

    def add(held: pa.Table, segments: pa.Table) -> pa.Table:
        place, v = held["place"].to_numpy(), np.empty(len(held))
        n, top, base = held["n"][0].as_py(), held["top"][0].as_py(), int(place.min())
        v[place - base] = held["v"].to_numpy()
        pieces = whole_parts(v, top)
        found = [(np.array([samples]), limb, np.array([x.sum()])) for limb, x in pieces] if held["slice"][0].as_py() == 0 else []
        for first, state in zip(segments["first"].to_pylist(), segments["state"].to_pylist(), strict=True):
            drawn = generator_draws(state, n)[: n * samples - first]
            sample, mine = (first + np.arange(len(drawn))) // n, (drawn >= base) & (drawn < base + len(v))
            sample, drawn = sample[mine], drawn[mine] - base
            edges = np.flatnonzero(np.diff(sample, prepend=-1))
            found += [(sample[edges], limb, np.add.reduceat(x[drawn], edges)) for limb, x in pieces if len(edges)]
        columns = [np.concatenate(c) for c in zip(*((s, np.full(len(s), limb), t) for s, limb, t in found), strict=True)] or [np.zeros(0, np.int64)] * 3
        keys = held["key"].combine_chunks().take(pa.array(np.zeros(len(columns[0]), np.int64)))
        return pa.table([keys, *map(pa.array, columns)], names=["key", "sample", "limb", "total"])

    by = ["key", "part", "slice"]
    sums = part.groupBy(*by).cogroup(drawn.select(*by, "first", "state").groupBy(*by)).applyInArrow(add, f"key {kind}, sample long, limb long, total long")
    sums = sums.groupBy("key", "sample", "limb").agg(F.sum("total").alias("total"))
    ready = sums.join(F.broadcast(groups.withColumnRenamed("key", "k")), F.col("key").eqNullSafe(F.col("k"))).drop("k")

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        n, top, least, most = (group[c].iloc[0] for c in ("n", "top", "least", "most"))
        limbs = defaultdict(dict)
        for s, limb, total in zip(group["sample"], group["limb"], group["total"], strict=True):
            limbs[s][int(limb)] = int(total)
        total = [joined_parts(limbs[s], top) / n for s in range(samples + 1)]
        places = percentile_places(samples, 0.95)
        low, high = (np.sort(total[:samples])[list(places)] if least < most else (least, least))
        return pd.DataFrame({"key": [group["key"].iloc[0]], "mean": [total[samples]], "low": [low], "high": [high]})

    return ready.groupBy("key").applyInPandas(ends, f"key {kind}, mean double, low double, high double")


def bootstrap_by_hash(values: DataFrame, by: str, value: str, samples: int = 2_000) -> DataFrame:
    """by, mean, low, high for groups of any size: a row counts in each sample as often as a Poisson number of mean one, hashed from group, row and sample.

    One hash of a row gives two numbers a and b; sample s takes (a + s b) modulo 2^48, so the weights of a row are independent for any two samples. The
    weights of a row need no other row: each task adds up vectors of `samples` sums for each group, and only these shuffle, however many rows there are. A
    different estimator from the exact one, with the same distribution. _order: a unique number of the row. Null values don't count.
    """
    cdf = np.array(list(itertools.accumulate(math.exp(-1.0) / math.factorial(k) for k in range(18))))
    digest = F.md5(F.concat_ws("|", F.col(by).cast("string"), F.col("_order").cast("string")).cast("binary"))
    number = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("long")
    hashed = values.where(F.col(value).isNotNull()).select(F.col(by).alias("by"), F.col(value).cast("double").alias("value"), number(1).alias("a"), number(13).alias("b"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, sums = np.arange(samples, dtype=np.int64), {}
        for batch in batches:
            v, a, b = (batch.column(i).to_numpy() for i in (1, 2, 3))
            places = defaultdict(list)
            for i, key in enumerate(batch.column(0).to_pylist()):
                places[key].append(i)
            for key, mine in places.items():
                total = sums.setdefault(key, np.zeros((2, samples)))
                for some in np.array_split(np.array(mine), -(-len(mine) // 512)):
                    u = ((a[some, None] + steps * b[some, None]) & (1 << 48) - 1) / float(1 << 48)
                    n = np.searchsorted(cdf, u, side="right")
                    total += v[some] @ n, n.sum(0)
            if len(sums) > held:
                yield from rows(sums)
                sums = {}
        yield from rows(sums)

    def rows(sums: dict) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("by", kind), ("s", pa.int32()), ("total", pa.float64()), ("n", pa.float64())])
        for key, (total, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * samples, kind), pa.array(np.arange(samples, dtype=np.int32)), pa.array(total), pa.array(n)], schema=schema)

    kind, held = to_arrow_type(values.schema[by].dataType), 1000  # groups whose sums a task holds at once
    parts = hashed.mapInArrow(add, f"by {values.schema[by].dataType.simpleString()}, s int, total double, n double")
    means = parts.groupBy("by", "s").agg((F.sum("total") / F.sum("n")).alias("m"))
    ordered = means.groupBy("by").agg(F.sort_array(F.collect_list("m")).alias("m"))  # `samples` numbers a group
    low, high = percentile_places(samples, 0.95)
    at = lambda k: F.round(F.get("m", F.lit(k)), 9)
    return ordered.select(F.col("by").alias(by), at(low).alias("low"), at(high).alias("high"))


def value_at(rows: DataFrame, by: str, value: str, place, name: str) -> DataFrame:
    """by and the value at a place (from 1; a Column function of the group's size) of each group in ascending order."""
    return selected(rows, [by], value, {name: place(F.col("n"))})


def token_recall(reference: Column, answer: Column) -> Column:
    """Share of the reference's distinct terms that the answer has; 0 without terms."""
    wanted = F.array_distinct(T.tokenize(reference))
    return F.size(F.array_intersect(wanted, T.tokenize(answer))) / F.greatest(F.lit(1), F.size(wanted))


def run_scores(questions: DataFrame, runs: DataFrame, evidence: DataFrame, calls: DataFrame, grades: DataFrame, threshold: float = SUPPORT) -> DataFrame:
    """One row of scores for each run, computed from its answers, evidence, tool calls and grades.

    questions: id, reference_answer, facts (arrays of wordings), required (phrases), expected_tools, answerable.
    runs: run_id, id, mode, status, raw_answer, answer, repaired and the counters agent_steps, tool_calls, tokens, latency_ms,
    reranker_latency_ms, retrieval_rounds, rewrite_attempts, rewrite_successes, retrieval_context_tokens, estimated_cost_usd.
    evidence: run_id, evidence_id, number, content. calls: run_id, tool. grades: run_id, round, coverage, relevance.
    raw_ scores are of the answer as generated, the others of the repaired one.
    """
    texts = evidence.groupBy("run_id").agg(F.count("*").alias("n_evidence"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "content"))), lambda x: x["content"]), " ").alias("evidence_text"))
    places = evidence.select("run_id", "evidence_id", "number", "content")

    def cited(answer: str, name: str) -> DataFrame:
        found = citations(runs.select("run_id", F.col(answer).alias("answer")), evidence, threshold).join(places, ["run_id", "evidence_id"], "left")
        good = F.array_sort(F.collect_list(F.when(F.col("valid"), F.struct("number", "content"))))
        return found.groupBy("run_id").agg(F.count("*").alias(f"{name}cited"), F.count(F.when(F.col("valid"), 1)).alias(f"{name}faithful"), F.array_join(F.transform(good, lambda x: x["content"]), " ").alias(f"{name}cited_text"))

    total = F.col("coverage") + F.col("relevance")
    gains = grades.groupBy("run_id").agg(((F.max_by(total, "round") - F.min_by(total, "round")) / 2).alias("gain"), F.count("*").alias("n_grades"))
    used = calls.groupBy("run_id").agg(F.collect_set("tool").alias("tools"))
    r = runs.join(questions, "id")
    for more in (texts, cited("raw_answer", "raw_"), cited("answer", ""), gains, used):
        r = r.join(more, "run_id", "left")
    answerable, required = F.col("answerable"), F.col("required")
    flag = lambda c: c.cast("double")
    count = lambda c: F.coalesce(c, F.lit(0))
    none = F.size(required) == 0
    no_evidence = count("n_evidence") == 0
    abstained = {p: no_evidence | T.abstains(F.col(a)) for p, a in (("raw_", "raw_answer"), ("", "answer"))}
    precision = lambda p: F.when(count(f"{p}cited") > 0, F.col(f"{p}faithful") / F.col(f"{p}cited")).otherwise(flag(~answerable))
    recall = lambda text, nothing: F.when(none, flag(nothing)).otherwise(T.phrase_share(F.coalesce(text, F.lit("")), required))
    tools = F.coalesce("tools", F.array().cast("array<string>"))
    right_tool = F.arrays_overlap(tools, F.col("expected_tools")) | ((F.col("mode") == "naive") & F.array_contains(tools, "semantic_document_search"))
    by_kind = lambda score, p: F.when(answerable, score).otherwise(flag(abstained[p]))
    scores = {
        "correctness": by_kind(fact_coverage("facts", "raw_answer"), "raw_"),
        "post_repair_correctness": by_kind(fact_coverage("facts", "answer"), ""),
        "lexical_reference_recall": by_kind(token_recall(F.col("reference_answer"), F.col("raw_answer")), "raw_"),
        "post_repair_lexical_reference_recall": by_kind(token_recall(F.col("reference_answer"), F.col("answer")), ""),
        "raw_citation_precision": precision("raw_"),
        "raw_citation_faithfulness": precision("raw_"),
        "raw_citation_recall": recall(F.col("raw_cited_text"), count("raw_cited") == 0),
        "citation_precision": precision(""),
        "citation_faithfulness": precision(""),
        "citation_recall": recall(F.col("cited_text"), count("cited") == 0),
        "evidence_citation_coverage": count("faithful") / F.greatest(F.lit(1), count("n_evidence")),
        "recall_at_k": recall(F.col("evidence_text"), no_evidence),
        "answerable": answerable,
        "raw_abstained": abstained["raw_"],
        "abstained": abstained[""],
        "abstention_correct": flag(abstained["raw_"] != answerable),
        "post_repair_abstention_correct": flag(abstained[""] != answerable),
        "citation_repair_triggered": F.col("repaired"),
        "tool_accuracy": flag(right_tool),
        "rewrite_quality_gain": F.when(count("n_grades") > 1, F.col("gain")).otherwise(0.0),
    }
    return r.select("run_id", "id", "mode", "status", *(c.alias(n) for n, c in scores.items()), *COUNTERS)


#: Counters of a run that its row of scores repeats.
COUNTERS = ("agent_steps", "tool_calls", "tokens", "latency_ms", "reranker_latency_ms", "retrieval_rounds", "rewrite_attempts", "rewrite_successes", "retrieval_context_tokens", "estimated_cost_usd")
#: Scores whose mean a summary has under the same name, and under another.
MEANS = ("correctness", "post_repair_correctness", "lexical_reference_recall", "post_repair_lexical_reference_recall", "raw_citation_precision", "raw_citation_faithfulness", "raw_citation_recall", "citation_precision", "citation_faithfulness", "citation_recall", "evidence_citation_coverage", "recall_at_k", "tool_accuracy")
NAMED_MEANS = {
    "average_steps": "agent_steps", "average_tool_calls": "tool_calls", "average_retrieval_rounds": "retrieval_rounds", "abstention_accuracy": "abstention_correct", "post_repair_abstention_accuracy": "post_repair_abstention_correct",
    "citation_repair_rate": "citation_repair_triggered", "average_retrieval_context_tokens": "retrieval_context_tokens", "average_tokens": "tokens", "average_reranker_latency_ms": "reranker_latency_ms",
}


def score_summary(rows: DataFrame) -> DataFrame:
    """Means, rates and ratios of run_scores by mode, latencies, and the interval of correctness by a hashed bootstrap."""
    mean = lambda c, name: F.round(F.avg(F.col(c).cast("double")), 9).alias(name)
    tried = F.col("rewrite_attempts") > 0
    latency = percentiles(rows, ["mode"], "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95})
    interval = bootstrap_by_hash(rows.withColumn("_order", F.col("run_id")), "mode", "correctness").select("mode", F.col("low").alias("correctness_low"), F.col("high").alias("correctness_high"))
    out = rows.groupBy("mode").agg(
        F.count("*").alias("questions"), F.count(F.when(F.col("status") == "completed", 1)).alias("completed"),
        *(mean(c, c) for c in MEANS), *(mean(c, name) for name, c in NAMED_MEANS.items()),
        F.round(F.avg(tried.cast("double")), 9).alias("rewrite_trigger_rate"),
        F.round(F.sum("rewrite_successes") / F.greatest(F.lit(1), F.sum("rewrite_attempts")), 9).alias("rewrite_success_rate"),
        F.round(F.coalesce(F.avg(F.when(tried, F.col("rewrite_quality_gain"))), F.lit(0.0)), 9).alias("average_rewrite_quality_gain"),
        F.round(F.sum("estimated_cost_usd"), 9).alias("total_estimated_cost_usd"),
    )
    return out.join(latency, "mode").join(interval, "mode", "left")


def compared(rows: DataFrame, modes: list[str], seed: int, samples: int = 2_000) -> DataFrame:
    """For each mode after the first: questions that both have, the mean difference in correctness and its interval."""
    rows = settled(rows.select("id", "mode", "correctness"))  # every mode reads the scores twice
    deltas = []
    for offset, mode in enumerate(modes[1:], 1):
        pair = paired(rows, "id", "correctness", modes[0], mode).select(F.lit(mode).alias("candidate"), F.col("id").alias("_order"), "delta")
        counted = pair.groupBy("candidate").agg(F.count("*").alias("questions"))
        deltas.append(counted.join(bootstrap(pair, "candidate", "delta", seed + offset, samples), "candidate"))
    return reduce(DataFrame.unionByName, deltas).select(F.lit(modes[0]).alias("baseline"), "candidate", "questions", F.col("mean").alias("correctness_delta"), "low", "high")


def contract(runs: DataFrame, evidence: DataFrame, citations: DataFrame, calls: DataFrame) -> DataFrame:
    """Whether each run (run_id, tool_calls) keeps its contract: run_id, unknown_citations (cited, but no evidence of the run) and tools_counted (as many calls as it reports)."""
    known = evidence.select("run_id", "evidence_id").distinct()
    unknown = citations.select("run_id", "evidence_id").distinct().join(known, ["run_id", "evidence_id"], "left_anti").groupBy("run_id").agg(F.count("*").alias("unknown_citations"))
    made = calls.groupBy("run_id").agg(F.count("*").alias("_made"))
    joined = runs.select("run_id", "tool_calls").join(unknown, "run_id", "left").join(made, "run_id", "left")
    return joined.select("run_id", F.coalesce("unknown_citations", F.lit(0)).alias("unknown_citations"), (F.coalesce("_made", F.lit(0)) == F.col("tool_calls")).alias("tools_counted"))


#: What two runs must have in common to be compared.
COMPARED = ("dataset_sha256", "corpus_sha256", "actual_retrieval", "seed", "temperature", "provider", "vector_backend", "embedding_backend", "candidate_k", "evidence_k", "max_agent_rewrites", "token_budget", "citation_repair", "modes")


def mismatches(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """key of the settings (key, value) in which two runs differ, of those that must not."""
    both = baseline.select("key", F.col("value").alias("_a")).join(candidate.select("key", F.col("value").alias("_b")), "key", "full_outer")
    return both.where(F.col("key").isin(*COMPARED) & ~F.col("_a").eqNullSafe(F.col("_b"))).select("key")


def paired(rows: DataFrame, key: str, value: str, baseline: str, candidate: str) -> DataFrame:
    """key and delta of the keys that both modes have."""
    of = lambda mode, name: rows.where(F.col("mode") == mode).select(key, F.col(value).alias(name))
    return of(baseline, "a").join(of(candidate, "b"), key).select(key, (F.col("b") - F.col("a")).alias("delta"))
