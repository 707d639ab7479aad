"""Queries of evaluation and runtime statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.python import fact_coverage
from ..operators import evaluation as V
from ..operators import evidence as E
from ..operators import retrieval as R
from ..operators.common import settled
from ..operators.quantiles import percentiles
from .common import CHUNKS, QUESTIONS, bm25, chunks, lexical, questions, table, tokens
from .evidence import _EVIDENCE, _SUPPORT, _ranked

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _metrics(spark, sf):
    c = R.active(chunks(spark, sf))
    hits = R.with_texts(settled(lexical(spark, sf, 10)), c.select("chunk_id", "content")).select("query_id", "rank", "content")
    words = F.split("text", " ")
    phrases = F.transform(F.sequence(F.lit(1), F.size(words), F.lit(4)), lambda i: F.array_join(F.slice(words, i, F.lit(4)), " "))  # every four words
    return V.retrieval_metrics(hits, table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), phrases.alias("phrases")))


_PHRASES = "list_transform(range(1, len(w) + 1, 4), lambda i: array_to_string(w[i:i + 3], ' '))"
_METRICS = f"""{CHUNKS}, {QUESTIONS}, {bm25('hits', "SELECT * FROM chunks WHERE status = 'completed'", 10)},
need AS (SELECT item_id AS query_id, {_PHRASES} AS phrases FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)),
h AS (SELECT query_id, rank, content, phrases, len(list_filter(phrases, lambda p: contains(lower(content), lower(p)))) / CAST(len(phrases) AS DOUBLE) AS gain FROM hits JOIN chunks USING (chunk_id) JOIN need USING (query_id)),
i AS (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS r FROM h),
ideal AS (SELECT query_id, sum((pow(2, gain) - 1) / log2(r + 1)) AS idcg FROM i GROUP BY query_id),
m AS (SELECT query_id, {", ".join(f"len(list_filter(any_value(phrases), lambda p: contains(lower(string_agg(content, ' ' ORDER BY rank) FILTER (rank <= {k})), lower(p)))) / CAST(len(any_value(phrases)) AS DOUBLE) AS recall_at_{k}" for k in V.CUTOFFS)}, coalesce(1.0 / min(rank) FILTER (gain > 0), 0) AS mrr, sum((pow(2, gain) - 1) / log2(rank + 1)) AS dcg FROM h GROUP BY query_id),
metrics AS (SELECT need.query_id, {", ".join(f"coalesce(recall_at_{k}, 0) AS recall_at_{k}" for k in V.CUTOFFS)}, CAST(coalesce(mrr, 0) AS DOUBLE) AS mrr, CASE WHEN coalesce(idcg, 0) > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg_at_10 FROM need LEFT JOIN m USING (query_id) LEFT JOIN ideal USING (query_id))"""


@query(f"WITH {_METRICS} SELECT query_id, {', '.join(f'round(recall_at_{k}, 9) AS recall_at_{k}' for k in V.CUTOFFS)} FROM metrics")
def recall_at_k(spark, sf):
    return _metrics(spark, sf).select("query_id", *(F.round(f"recall_at_{k}", 9).alias(f"recall_at_{k}") for k in V.CUTOFFS))


@query(f"WITH {_METRICS} SELECT query_id, round(mrr, 9) AS mrr FROM metrics")
def mrr(spark, sf):
    return _metrics(spark, sf).select("query_id", F.round("mrr", 9).alias("mrr"))


@query(f"WITH {_METRICS} SELECT query_id, round(ndcg_at_10, 9) AS ndcg_at_10 FROM metrics")
def ndcg_at_10(spark, sf):
    return _metrics(spark, sf).select("query_id", F.round("ndcg_at_10", 9).alias("ndcg_at_10"))


@query(f"WITH {_METRICS} SELECT query_id % 4 AS category, count(*) AS n, round(avg(recall_at_5), 9) AS recall_at_5, round(avg(mrr), 9) AS mrr, round(avg(ndcg_at_10), 9) AS ndcg_at_10 FROM metrics GROUP BY 1")
def metrics_by_category(spark, sf):
    return _metrics(spark, sf).groupBy((F.col("query_id") % 4).alias("category")).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 9).alias(c) for c in ("recall_at_5", "mrr", "ndcg_at_10")))


def _form(text: str) -> str:
    """SQL of fact_form for these texts: full-width letters and spaces folded, lower case, nothing but word characters."""
    return f"regexp_replace(lower(translate({text}, 'Ｆｕｌ　', 'Ful ')), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


_FACTS = [(1, [["KV cache", "KV-cache"], ["vLLM"]], "The kv-cache of VLLM"), (2, [["a b"]], "none"), (3, [], "x"), (4, [["Ｆｕｌｌ width"]], "full WIDTH text")]


_FACTS_SQL = "f(id, fact, answer) AS (VALUES " + ", ".join(f"({i}, {fact!r}, '{answer}')" for i, facts, answer in _FACTS for fact in facts or [[]]) + ")"


@query(f"""WITH {_FACTS_SQL}, h AS (SELECT id, len(fact) > 0 AS is_fact, len(list_filter(fact, lambda a: contains({_form("answer")}, {_form("a")}))) > 0 AS found FROM f)
SELECT id, round(CAST(count(*) FILTER (is_fact AND found) AS DOUBLE) / greatest(1, count(*) FILTER (is_fact)), 9) AS coverage FROM h GROUP BY id""")
def fact_coverage_score(spark, sf):
    rows = spark.createDataFrame(_FACTS, "id int, facts array<array<string>>, answer string")
    return rows.select("id", fact_coverage("facts", "answer").alias("coverage"))


# runs of whole passages: answers of four kinds, evidence from the search, counters from the run's number
_SHARE = lambda t: f"CASE WHEN len(required) = 0 THEN NULL ELSE len(list_filter(required, lambda p: contains(lower(coalesce({t}, '')), lower(p)))) / CAST(len(required) AS DOUBLE) END"
_KNOWN = lambda a: f"(CAST(contains({_form(a)}, {_form(_W3)}) AS INT) + CAST(contains({_form(a)}, 'zzz') OR contains({_form(a)}, {_form('w[4]')}) AS INT)) / 2.0"
_W3 = "array_to_string(w[1:3], ' ')"
_RECALL = lambda a: f"len(list_intersect(list_distinct({tokens('question')}), {tokens(a)})) / CAST(greatest(1, len(list_distinct({tokens('question')}))) AS DOUBLE)"
_GONE = lambda a: f"n_evidence = 0 OR regexp_matches(regexp_replace({a}, '^\\s+', ''), '{T.ABSTENTION}')"
_SCORES = f"""{_EVIDENCE}, evi AS (SELECT query_id AS run_id, number, 'S' || number AS evidence_id, content FROM ev),
one AS (SELECT run_id, content AS fc FROM evi WHERE number = 1),
a1 AS (SELECT query_id AS run_id, question, string_split(question, ' ') AS w, ['naive', 'fixed_retrieval', 'agentic'][query_id % 3 + 1] AS mode, coalesce(fc, '') AS fc FROM questions LEFT JOIN one ON run_id = query_id),
a2 AS (SELECT *, CASE run_id % 4 WHEN 0 THEN fc || ' [S1]' || chr(10) || 'unrelated words here [S2]' WHEN 1 THEN question || ' [S1] [S9]' WHEN 2 THEN 'insufficient evidence' ELSE question END AS raw_answer FROM a1),
r AS (SELECT *, CASE WHEN run_id % 4 = 3 THEN '- ' || fc || ' [S1]' ELSE replace(raw_answer, '[S9]', '') END AS answer, run_id % 7 <> 0 AS answerable, CASE WHEN run_id % 5 = 0 THEN [] ELSE [array_to_string(w[1:4], ' '), array_to_string(w[5:8], ' ')] END AS required FROM a2),
an AS (SELECT run_id, 'raw' AS kind, raw_answer AS answer FROM r UNION ALL SELECT run_id, 'final', answer FROM r),
mk AS (SELECT DISTINCT run_id, kind, answer, unnest(regexp_extract_all(answer, '\\[(S\\d+)\\]', 1)) AS marker FROM an),
cl AS (SELECT run_id, kind, marker, substr(coalesce(list_filter(list_transform(list_filter(string_split(answer, chr(10)), lambda l: contains(l, '[' || marker || ']')), lambda l: trim(regexp_replace(trim(replace(l, '[' || marker || ']', '')), '^[#\\-* ]+', ''))), lambda x: x <> '')[1], 'Evidence reference'), 1, 500) AS claim FROM mk),
ci AS (SELECT cl.run_id, kind, number, content, content IS NOT NULL AND round(CAST({_SUPPORT} AS DOUBLE), 9) >= 0.18 AS valid FROM cl LEFT JOIN evi ON evi.run_id = cl.run_id AND evidence_id = marker),
cs AS (SELECT run_id, kind, count(*) AS cited, count(*) FILTER (valid) AS faithful, string_agg(content, ' ' ORDER BY number) FILTER (valid) AS cited_text FROM ci GROUP BY ALL),
et AS (SELECT run_id, count(*) AS n_evidence, string_agg(content, ' ' ORDER BY number) AS evidence_text FROM evi GROUP BY run_id),
j AS (SELECT r.*, coalesce(n_evidence, 0) AS n_evidence, evidence_text, coalesce(x.cited, 0) AS raw_cited, coalesce(x.faithful, 0) AS raw_faithful, x.cited_text AS raw_text, coalesce(y.cited, 0) AS cited, coalesce(y.faithful, 0) AS faithful, y.cited_text FROM r LEFT JOIN et USING (run_id) LEFT JOIN cs x ON x.run_id = r.run_id AND x.kind = 'raw' LEFT JOIN cs y ON y.run_id = r.run_id AND y.kind = 'final'),
k AS (SELECT *, {_GONE("raw_answer")} AS raw_abstained, {_GONE("answer")} AS abstained FROM j),
scores AS (SELECT run_id, run_id AS id, mode, CASE WHEN run_id % 11 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN answerable THEN {_KNOWN("raw_answer")} ELSE CAST(raw_abstained AS INT) END AS correctness, CASE WHEN answerable THEN {_KNOWN("answer")} ELSE CAST(abstained AS INT) END AS post_repair_correctness,
  CASE WHEN answerable THEN {_RECALL("raw_answer")} ELSE CAST(raw_abstained AS INT) END AS lexical_reference_recall, CASE WHEN answerable THEN {_RECALL("answer")} ELSE CAST(abstained AS INT) END AS post_repair_lexical_reference_recall,
  CASE WHEN raw_cited > 0 THEN raw_faithful / CAST(raw_cited AS DOUBLE) ELSE CAST(NOT answerable AS INT) END AS raw_citation_precision, raw_citation_precision AS raw_citation_faithfulness, coalesce({_SHARE("raw_text")}, CAST(raw_cited = 0 AS INT)) AS raw_citation_recall,
  CASE WHEN cited > 0 THEN faithful / CAST(cited AS DOUBLE) ELSE CAST(NOT answerable AS INT) END AS citation_precision, citation_precision AS citation_faithfulness, coalesce({_SHARE("cited_text")}, CAST(cited = 0 AS INT)) AS citation_recall,
  faithful / CAST(greatest(1, n_evidence) AS DOUBLE) AS evidence_citation_coverage, coalesce({_SHARE("evidence_text")}, CAST(n_evidence = 0 AS INT)) AS recall_at_k, answerable, raw_abstained, abstained,
  CAST(raw_abstained <> answerable AS DOUBLE) AS abstention_correct, CAST(abstained <> answerable AS DOUBLE) AS post_repair_abstention_correct, raw_answer <> answer AS citation_repair_triggered,
  CAST(run_id % 3 = 0 OR run_id % 2 = 0 OR run_id % 3 = 2 AS DOUBLE) AS tool_accuracy,
  CASE WHEN run_id % 3 = 0 THEN 0.0 ELSE ((run_id * (run_id % 3 + 1) % 10) / 10.0 + ((run_id + run_id % 3 + 1) % 5) / 5.0 - (run_id % 10) / 10.0 - ((run_id + 1) % 5) / 5.0) / 2 END AS rewrite_quality_gain,
  run_id % 9 AS agent_steps, run_id % 4 AS tool_calls, run_id * 13 % 500 AS tokens, run_id * 31 % 997 + 0.5 AS latency_ms, run_id % 17 / 2.0 AS reranker_latency_ms, run_id % 3 + 1 AS retrieval_rounds, run_id % 3 AS rewrite_attempts, CAST(run_id % 3 > 1 AS INT) AS rewrite_successes, run_id * 7 % 300 AS retrieval_context_tokens, run_id % 100 / 1000.0 AS estimated_cost_usd FROM k)"""


def _scores(spark, sf):
    q = questions(spark, sf)
    evidence = E.registered(_ranked(spark, sf), 6).select(F.col("query_id").alias("run_id"), "evidence_id", "number", "content")
    first = evidence.where("number = 1").select(F.col("run_id").alias("query_id"), F.col("content").alias("fc"))
    w = F.split("question", " ")
    r = q.join(first, "query_id", "left").withColumns({"run_id": F.col("query_id"), "id": F.col("query_id"), "w": w, "fc": F.coalesce("fc", F.lit(""))})
    kind, n = F.col("id") % 4, F.col("id")
    raw = F.when(kind == 0, F.concat("fc", F.lit(" [S1]\nunrelated words here [S2]"))).when(kind == 1, F.concat("question", F.lit(" [S1] [S9]"))).when(kind == 2, "insufficient evidence").otherwise(F.col("question"))
    r = r.withColumn("raw_answer", raw).withColumn("answer", F.when(kind == 3, F.concat(F.lit("- "), "fc", F.lit(" [S1]"))).otherwise(F.replace("raw_answer", F.lit("[S9]"), F.lit(""))))
    some = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    asked = r.select("id", F.col("question").alias("reference_answer"), F.array(F.array(some(1, 3)), F.array(F.lit("zzz"), F.get("w", F.lit(3)))).alias("facts"), F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(some(1, 4), some(5, 4))).alias("required"), F.array(F.when(n % 2 == 0, "semantic_document_search").otherwise("code_keyword_search")).alias("expected_tools"), (n % 7 != 0).alias("answerable"))
    runs = r.select(
        "run_id", "id", F.get(F.array(*map(F.lit, ("naive", "fixed_retrieval", "agentic"))), (n % 3).cast("int")).alias("mode"), F.when(n % 11 == 0, "failed").otherwise("completed").alias("status"), "raw_answer", "answer", (F.col("raw_answer") != F.col("answer")).alias("repaired"),
        (n % 9).alias("agent_steps"), (n % 4).alias("tool_calls"), (n * 13 % 500).alias("tokens"), (n * 31 % 997 + 0.5).alias("latency_ms"), (n % 17 / 2).alias("reranker_latency_ms"), (n % 3 + 1).alias("retrieval_rounds"), (n % 3).alias("rewrite_attempts"), (n % 3 > 1).cast("int").alias("rewrite_successes"), (n * 7 % 300).alias("retrieval_context_tokens"), (n % 100 / 1000).alias("estimated_cost_usd"),
    )
    tools = F.when(n % 3 == 2, F.array(F.lit("semantic_document_search"), F.lit("code_keyword_search"))).otherwise(F.array(F.lit("semantic_document_search")))
    calls = r.select("run_id", F.explode(tools).alias("tool"))
    i = F.col("round")
    grades = r.select("run_id", n.alias("id"), F.explode(F.sequence(F.lit(1), (n % 3 + 1).cast("int"))).alias("round")).select("run_id", "round", (n * i % 10 / 10).alias("coverage"), ((n + i) % 5 / 5).alias("relevance"))
    return V.run_scores(asked, runs, evidence, calls, grades)


_ROUNDED = ("correctness", "post_repair_correctness", "lexical_reference_recall", "post_repair_lexical_reference_recall", "raw_citation_precision", "raw_citation_faithfulness", "raw_citation_recall", "citation_precision", "citation_faithfulness", "citation_recall", "evidence_citation_coverage", "recall_at_k", "rewrite_quality_gain", "latency_ms", "reranker_latency_ms", "estimated_cost_usd")


@query(f"WITH {_SCORES} SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), 9) AS {c}' for c in _ROUNDED)}) FROM scores")
def run_scores(spark, sf):
    """Every score of a run from its answers, evidence, calls and grades."""
    return _scores(spark, sf).withColumns({c: F.round(F.col(c).cast("double"), 9) for c in _ROUNDED})


#: CTEs of the hashed bootstrap's interval for v (key, value, row): one hash a row, 2,000 samples.
_INTERVAL = """p AS (SELECT 0 AS k, exp(-1.0) AS c UNION ALL SELECT k, sum(exp(-1.0) / gamma(k + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) + exp(-1.0) FROM (SELECT unnest(range(1, 18)) AS k)),
h AS (SELECT key, value, md5(key || '|' || row) AS m FROM v WHERE value IS NOT NULL), s AS (SELECT unnest(range(0, 2000)) AS s),
u AS (SELECT key, s, value, ((CAST('0x' || substr(m, 1, 12) AS BIGINT) + s * CAST('0x' || substr(m, 13, 12) AS BIGINT)) % 281474976710656) / 281474976710656.0 AS u FROM h, s),
w AS (SELECT key, s, value, (SELECT count(*) FROM p WHERE c <= u) AS n FROM u),
means AS (SELECT key, s, sum(n * value) / CAST(sum(n) AS DOUBLE) AS m FROM w GROUP BY key, s), lists AS (SELECT key, list(m ORDER BY m) AS m FROM means GROUP BY key),
interval AS (SELECT key, round(m[51], 9) AS low, round(m[1950], 9) AS high FROM lists)"""


@query(f"""WITH {_SCORES}, v AS (SELECT mode AS key, CAST(correctness AS DOUBLE) AS value, run_id AS row FROM scores), {_INTERVAL} SELECT mode, any_value(low) AS correctness_low, any_value(high) AS correctness_high, count(*) AS questions, count(*) FILTER (status = 'completed') AS completed, {', '.join(f'round(avg(CAST({c} AS DOUBLE)), 9) AS {c}' for c in V.MEANS)}, {', '.join(f'round(avg(CAST({c} AS DOUBLE)), 9) AS {n}' for n, c in V.NAMED_MEANS.items())},
round(avg(CAST(rewrite_attempts > 0 AS INT)), 9) AS rewrite_trigger_rate, round(sum(rewrite_successes) / CAST(greatest(1, sum(rewrite_attempts)) AS DOUBLE), 9) AS rewrite_success_rate, round(coalesce(avg(CAST(rewrite_quality_gain AS DOUBLE)) FILTER (rewrite_attempts > 0), 0), 9) AS average_rewrite_quality_gain, round(sum(CAST(estimated_cost_usd AS DOUBLE)), 9) AS total_estimated_cost_usd, median(CAST(latency_ms AS DOUBLE)) AS p50_latency_ms, quantile_disc(CAST(latency_ms AS DOUBLE), 0.95) AS p95_latency_ms FROM scores LEFT JOIN interval ON mode = key GROUP BY mode""")
def mode_summary(spark, sf):
    return V.score_summary(_scores(spark, sf))


@query(f"WITH {_SCORES}, t AS (SELECT run_id // 3 AS id, mode, correctness FROM scores) SELECT a.id, round(CAST(b.correctness - a.correctness AS DOUBLE), 9) AS delta FROM t a JOIN t b ON a.id = b.id AND a.mode = 'naive' AND b.mode = 'agentic'")
def mode_paired_delta(spark, sf):
    rows = _scores(spark, sf).withColumn("id", F.expr("run_id div 3"))
    return V.paired(rows, "id", "correctness", "naive", "agentic").select("id", F.round("delta", 9).alias("delta"))


@query()
def mode_comparison(spark, sf):
    """Each mode against the naive one with an interval, whose draws are the standard generator's and so have no SQL."""
    rows = _scores(spark, sf).withColumn("id", F.expr("run_id div 3"))
    return V.compared(rows, ["naive", "fixed_retrieval", "agentic"], seed=7)


@query("SELECT key FROM (VALUES ('corpus_sha256', 'x', 'y'), ('seed', '7', '7'), ('modes', 'a', NULL), ('note', 'p', 'q')) t(key, a, b) WHERE a IS DISTINCT FROM b AND key <> 'note'")
def run_comparability(spark, sf):
    """Settings in which two runs differ and must not."""
    a = spark.createDataFrame([("corpus_sha256", "x"), ("seed", "7"), ("modes", "a"), ("note", "p")], "key string, value string")
    return V.mismatches(a, spark.createDataFrame([("corpus_sha256", "y"), ("seed", "7"), ("note", "q")], "key string, value string"))


@query("SELECT l_returnflag, median(l_extendedprice) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag")
def latency_percentiles(spark, sf):
    return percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95})


@query("""WITH r AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, value AS latency_ms, event_id % 700 AS tokens, event_id % 4 AS tool_calls FROM events)
SELECT count(*) AS run_count, count(*) FILTER (status = 'completed') AS completed_count, median(latency_ms) FILTER (status = 'completed') AS p50_latency_ms, quantile_disc(latency_ms, 0.95) FILTER (status = 'completed') AS p95_latency_ms, CAST(sum(tokens) FILTER (status = 'completed') AS BIGINT) AS total_tokens, CAST(sum(tool_calls) AS BIGINT) AS total_tool_calls, true AS no_cache FROM r""")
def run_summary(spark, sf):
    e = table(spark, sf, "events").selectExpr("CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status", "value AS latency_ms", "event_id % 700 AS tokens", "event_id % 4 AS tool_calls", "0L AS cache_hits")
    out = V.run_summary(e)
    return out.withColumn("no_cache", F.col("cache_hits").isNull()).drop("cache_hits")


@query("""SELECT event_type, count(*) FILTER (event_id % 10 <> 0) AS completed, count(*) FILTER (event_id % 10 = 0) AS failed, round(count(*) FILTER (event_id % 10 <> 0) / CAST(count(*) AS DOUBLE), 9) AS success_rate, count(DISTINCT CASE WHEN event_id % 10 = 0 THEN user_id % 3 END) AS error_types, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS wall_seconds, median(value) AS p50, quantile_disc(value, 0.95) AS p95, round(count(*) FILTER (event_id % 10 <> 0) / CAST(greatest(1, floor(epoch(max(ts))) - floor(epoch(min(ts)))) AS DOUBLE), 9) AS throughput FROM events GROUP BY event_type""")
def concurrency_stats(spark, sf):
    failed = F.col("event_id") % 10 == 0
    e = table(spark, sf, "events")
    out = e.groupBy("event_type").agg(
        F.count(F.when(~failed, 1)).alias("completed"), F.count(F.when(failed, 1)).alias("failed"), F.round(F.count(F.when(~failed, 1)) / F.count("*"), 9).alias("success_rate"),
        F.count_distinct(F.when(failed, F.col("user_id") % 3)).alias("error_types"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("wall_seconds"),
        F.round(F.count(F.when(~failed, 1)) / F.greatest(F.lit(1), F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))), 9).alias("throughput"),
    )
    return out.join(percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}), "event_type")


@query("SELECT user_id, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS delta, count(*) - 1 AS warm FROM events GROUP BY user_id")
def counter_delta(spark, sf):
    """Last less first value of each user, and how many runs are warm."""
    order = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.max_by("value", order) - F.min_by("value", order), 6).alias("delta"), (F.count("*") - 1).alias("warm"))


@query("SELECT l_returnflag, CASE WHEN avg(l_tax) = 0 THEN NULL ELSE round((avg(l_discount) - avg(l_tax)) / avg(l_tax) * 100, 6) END AS change FROM lineitem GROUP BY l_returnflag")
def percent_change(spark, sf):
    a, b = F.avg("l_tax"), F.avg("l_discount")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round((b - a) / F.nullif(a, F.lit(0.0)) * 100, 6).alias("change"))


@query("""SELECT event_type, (array_agg(value ORDER BY value))[greatest(1, least(count(*), CAST(floor(count(*) * 0.9 + 0.999) AS BIGINT)))] AS p90 FROM events GROUP BY event_type""")
def benchmark_percentile(spark, sf):
    """The value at place int(n f + 0.999)."""
    e = table(spark, sf, "events")
    return V.value_at(e, "event_type", "value", lambda n: F.greatest(F.lit(1), F.least(n, F.floor(n * 0.9 + 0.999))), "p90")


@query()
def bootstrap_ci_exact(spark, sf):
    v = table(spark, sf, "labels").select(F.lit("quality").alias("metric"), "quality", F.col("doc_id").alias("_order"))
    return V.bootstrap(v, "metric", "quality", seed=7)


@query(f"WITH v AS (SELECT 'quality' AS key, quality AS value, doc_id AS row FROM labels), {_INTERVAL} SELECT key AS metric, low, high FROM interval")
def bootstrap_ci_hash(spark, sf):
    """Interval of a mean by hashed Poisson weights, 2,000 samples."""
    v = table(spark, sf, "labels").select(F.lit("quality").alias("metric"), "quality", F.col("doc_id").alias("_order"))
    return V.bootstrap_by_hash(v, "metric", "quality")


@query("""WITH r AS (SELECT user_id AS run_id, count(*) FILTER (event_type = 'click') + CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS tool_calls FROM events GROUP BY user_id),
e AS (SELECT DISTINCT user_id AS run_id, event_id % 9 AS s FROM events WHERE event_id % 2 = 0), c AS (SELECT DISTINCT user_id AS run_id, event_id % 11 AS s FROM events WHERE event_id % 5 = 0),
u AS (SELECT run_id, count(*) AS n FROM c ANTI JOIN e USING (run_id, s) GROUP BY run_id)
SELECT run_id, coalesce(n, 0) AS unknown_citations, run_id % 10 <> 0 AS tools_counted FROM r LEFT JOIN u USING (run_id)""")
def run_contract(spark, sf):
    """Runs of users' events: what they cite must be their evidence, and they must have made as many calls as they report (every tenth reports one more)."""
    e = table(spark, sf, "events").withColumnRenamed("user_id", "run_id")
    click = F.col("event_type") == "click"
    runs = e.groupBy("run_id").agg((F.count(F.when(click, 1)) + (F.col("run_id") % 10 == 0).cast("int")).alias("tool_calls"))
    cited = lambda every, of: e.where(F.col("event_id") % every == 0).select("run_id", (F.col("event_id") % of).alias("evidence_id"))
    return V.contract(runs, cited(2, 9), cited(5, 11), e.where(click))
