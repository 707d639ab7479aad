"""Queries of planning, grading, evidence sets, reports and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import retrieval as R
from ..operators.common import settled
from . import agent
from .common import CHUNKS, QUESTIONS, bm25, chunks, lexical, questions, table, tokens
from .search import _NEAREST, _channels, indexed_embedding_hits

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_list = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query(f"SELECT conv_id, turn, lower(trim(text)) IN ({_list(T.GREETINGS)}) AS small_talk FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, true), (-2, 0, true), (-3, 0, false))")
def chitchat_router(spark, sf):
    """Greetings need no retrieval."""
    more = spark.createDataFrame([(-1, 0, " Hello "), (-2, 0, "谢谢"), (-3, 0, "hello there")], "conv_id long, turn long, text string")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text").unionByName(more)
    return c.select("conv_id", "turn", F.lower(F.trim("text")).isin(*T.GREETINGS).alias("small_talk"))


@query("""WITH p AS (SELECT conv_id, turn, text, list_filter(string_split_regex(text, '[;；。]|\\band\\b|\\b以及\\b'), lambda p: length(trim(p)) > 0)[1:3] AS parts FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, turn, text, CASE WHEN len(parts) > 0 THEN list_transform(parts, lambda p: CASE WHEN length(regexp_replace(p, '^[ ?？.]+|[ ?？.]+$', '', 'g')) > 0 THEN regexp_replace(p, '^[ ?？.]+|[ ?？.]+$', '', 'g') ELSE text END) ELSE [text] END AS parts FROM p)
SELECT conv_id, turn, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS part, unnest(parts) AS question FROM b""")
def plan_subquestions(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.posexplode(T.subquestions(F.col("text"))).alias("part", "question"))


_TYPE = f"CASE WHEN regexp_matches(lower({{0}}), '{'|'.join(T.ISSUE_CUES)}') THEN 'issues' WHEN regexp_matches(lower({{0}}), '{'|'.join(T.CODE_CUES)}') THEN 'code' ELSE 'mixed' END"


@query(f"SELECT conv_id, turn, {_TYPE.format('text')} AS expected FROM conversations")
def evidence_type_route(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.evidence_type(F.col("text")).alias("expected"))


@query(f"""WITH m(mode) AS (VALUES ('naive'), ('fixed_retrieval'), ('agentic')), r(round) AS (VALUES (1), (2)), q AS (SELECT item_id, {_TYPE.format('text')} AS expected FROM benchmark)
SELECT item_id, mode, round, unnest(list_filter(['semantic_document_search', CASE WHEN mode <> 'naive' AND expected IN ('code', 'mixed') THEN 'code_keyword_search' END, CASE WHEN mode <> 'naive' AND expected IN ('issues', 'mixed') THEN 'github_issue_search' END, CASE WHEN round >= 2 THEN 'web_search' END], lambda t: t IS NOT NULL)) AS tool FROM q, m, r""")
def tool_selection(spark, sf):
    q = table(spark, sf, "benchmark").select("item_id", T.evidence_type(F.col("text")).alias("expected"))
    each = q.select("*", F.explode(F.array(*map(F.lit, ("naive", "fixed_retrieval", "agentic")))).alias("mode")).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("round"))
    return each.select("item_id", "mode", "round", F.explode(E.tools(F.col("mode"), F.col("expected"), F.col("round"), web=True)).alias("tool"))


_REWRITE = "CASE " + " ".join("WHEN " + " AND ".join(f"contains(lower(q), '{c}')" for c in cues) + f" THEN '{new}'" for cues, new in T.REWRITES) + f" ELSE q || ' {T.REWRITE_SUFFIXES[0]}' END"


@query(f"WITH a AS (SELECT item_id, text AS q FROM benchmark UNION ALL VALUES (-1, '语义搜索为什么优于字面匹配'), (-2, 'GitHub Repo 避免每次全量重建')) SELECT item_id, {_REWRITE} AS rewritten FROM a")
def query_rewrite(spark, sf):
    more = spark.createDataFrame([(-1, "语义搜索为什么优于字面匹配"), (-2, "GitHub Repo 避免每次全量重建")], "item_id long, text string")
    return table(spark, sf, "benchmark").select("item_id", "text").unionByName(more).select("item_id", T.rewrite(F.col("text"), 1).alias("rewritten"))


_TWO = f"""{CHUNKS}, {QUESTIONS}, {_NEAREST}, {bm25('b', "SELECT * FROM chunks WHERE status = 'completed'", 20, 'b_')}"""


@query(f"""WITH {_TWO}, u AS (SELECT *, 'vectors' AS tool, 1 AS ord FROM a UNION ALL SELECT *, 'texts', 2 FROM b)
SELECT query_id, chunk_id, tool, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, ord) AS n FROM u) WHERE n = 1""")
def best_hit_dedupe(spark, sf):
    a, b = _channels(spark, sf)
    both = a.withColumn("tool", F.lit("vectors")).withColumn("ord", F.lit(1)).unionByName(b.withColumn("tool", F.lit("texts")).withColumn("ord", F.lit(2)))
    return E.best_hits(both).select("query_id", "chunk_id", "tool", F.round("score", 6).alias("score"))


def _ranked(spark, sf, k=20):
    c, q = R.active(chunks(spark, sf)), questions(spark, sf)
    return R.with_texts(settled(lexical(spark, sf, k)), c.select("chunk_id", "source_id", "content")).join(q, "query_id")


_RANKED = f"""{CHUNKS}, {QUESTIONS}, {bm25('hits', "SELECT * FROM chunks WHERE status = 'completed'", 20)},
ranked AS (SELECT query_id, chunk_id, rank, question, source_id, content FROM hits JOIN chunks USING (chunk_id) JOIN questions USING (query_id))"""
_ASKED = f"list_filter(list_distinct({tokens('question')}), lambda t: NOT list_contains([{_list(T.QUESTION_STOP_WORDS)}], t))"
_GRADED = f"""{_RANKED}, g AS (SELECT query_id, source_id, {_ASKED} AS asked, list_intersect({_ASKED}, {tokens('content')}) AS found FROM ranked WHERE rank <= 8),
grades AS (SELECT query_id, len(list_distinct(flatten(list(found)))) / CAST(greatest(1, any_value(len(asked))) AS DOUBLE) AS coverage, max(len(found) / CAST(greatest(1, len(asked)) AS DOUBLE)) AS relevance, least(1.0, count(DISTINCT source_id) / 2.0) AS diversity FROM g GROUP BY query_id)"""


@query(f"WITH {_GRADED} SELECT query_id, round(coverage, 6) AS coverage, round(relevance, 6) AS relevance, CAST(diversity AS DOUBLE) AS diversity, (coverage >= 0.35 AND relevance >= 0.18) OR relevance >= 0.65 AS sufficient FROM grades")
def evidence_grade(spark, sf):
    return E.graded(_ranked(spark, sf)).select("query_id", F.round("coverage", 6).alias("coverage"), F.round("relevance", 6).alias("relevance"), "diversity", "sufficient")


@query("""WITH g AS (SELECT a.x / 20.0 AS coverage, b.x / 20.0 AS relevance, m.mode, r.round FROM (SELECT unnest(range(0, 21)) AS x) a, (SELECT unnest(range(0, 21)) AS x) b, (VALUES ('naive', 1), ('fixed_retrieval', 2), ('agentic', 3)) m(mode, rounds), (VALUES (1), (2)) r(round)),
d AS (SELECT *, (coverage >= 0.35 AND relevance >= 0.18) OR relevance >= 0.65 AS s FROM g)
SELECT mode, round, CASE WHEN mode = 'fixed_retrieval' AND round < 2 THEN 'fixed_retrieve_again' WHEN s THEN 'generate' ELSE 'retrieve_again' END AS action, count(*) AS n FROM d GROUP BY ALL""")
def decision_policy(spark, sf):
    """Decisions over a grid of grades."""
    x = spark.range(21).withColumn("coverage", F.col("id") / 20).drop("id").withColumn("relevance", F.explode(F.expr("transform(sequence(0, 20), i -> i / 20D)")))
    g = x.withColumn("m", F.explode(F.expr("array(struct('naive' AS mode, 1 AS rounds), struct('fixed_retrieval' AS mode, 2 AS rounds), struct('agentic' AS mode, 3 AS rounds))"))).select("coverage", "relevance", "m.*").withColumn("round", F.explode(F.array(F.lit(1), F.lit(2))))
    action = E.decision(F.col("mode"), E.sufficient(F.col("coverage"), F.col("relevance")), F.col("round"), F.when(F.col("mode") == "fixed_retrieval", 2).otherwise(F.col("rounds")))
    return g.groupBy("mode", "round", action.alias("action")).agg(F.count("*").alias("n"))


@query(f"WITH {_GRADED} SELECT query_id, NOT ((coverage >= 0.35 AND relevance >= 0.18) OR relevance >= 0.65) AND (coverage < 0.2 OR relevance < 0.12) AS refused FROM grades")
def refusal_policy(spark, sf):
    g = E.graded(_ranked(spark, sf))
    return g.select("query_id", E.refuses(F.lit("agentic"), F.col("sufficient"), F.lit(1), F.col("coverage"), F.col("relevance")).alias("refused"))


@query("SELECT user_id, arg_max(event_id, (value, -event_id)) AS best_event, round(max(value), 6) AS best_value FROM events GROUP BY user_id")
def best_grade(spark, sf):
    """The best round of each run; the first of equals."""
    best = F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id")))
    return table(spark, sf, "events").groupBy("user_id").agg(best.alias("best_event"), F.round(F.max("value"), 6).alias("best_value"))


_EVIDENCE = f"""{_RANKED}, e1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, sha256(content) ORDER BY rank) AS n FROM ranked WHERE rank <= 6),
ev AS (SELECT query_id, question, chunk_id, content, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS number FROM e1 WHERE n = 1)"""


@query(f"WITH {_EVIDENCE} SELECT query_id, chunk_id, 'S' || number AS evidence_id FROM ev")
def register_evidence(spark, sf):
    return E.registered(_ranked(spark, sf), 6).select("query_id", "chunk_id", "evidence_id")


_BUDGETED = f"""{_EVIDENCE}, b AS (SELECT *, greatest(1, length(content) // 4) AS est FROM ev), l AS (SELECT *, 1200 - coalesce(sum(est) OVER (PARTITION BY query_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM b),
fitted AS (SELECT query_id, question, number, 'S' || number AS evidence_id, CASE WHEN est > remaining THEN substr(content, 1, CAST(remaining * 4 AS BIGINT)) ELSE content END AS content, CAST(least(est, remaining) AS INTEGER) AS tokens FROM l WHERE remaining > 0)"""


@query(f"WITH {_BUDGETED} SELECT query_id, evidence_id, tokens, length(content) AS n_chars FROM fitted")
def token_budget(spark, sf):
    e = E.budgeted(E.registered(_ranked(spark, sf), 6), 2000)
    return e.select("query_id", "evidence_id", "tokens", F.length("content").cast("long").alias("n_chars"))


@query(f"""WITH {_BUDGETED}, x AS (SELECT *, regexp_replace(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS one FROM fitted WHERE number <= 5)
SELECT query_id, '## 研究结论' || chr(10) || chr(10) || '问题：' || question || chr(10) || chr(10) || string_agg('- ' || CASE WHEN length(one) > 360 THEN substr(one, 1, 357) || '...' ELSE one END || ' [' || evidence_id || ']', chr(10) ORDER BY number) || chr(10) || chr(10) || '## 限制' || chr(10) || chr(10) || '以上结论仅基于当前已索引的证据。' AS answer FROM x GROUP BY query_id, question""")
def extractive_report(spark, sf):
    return E.reports(E.budgeted(E.registered(_ranked(spark, sf), 6), 2000))


_ANSWERS = [
    (1, "# Title\n- The queue retries failed jobs [S1] with backoff\nUnrelated words here [S2]\nSee [S9] too [S1]"),
    (2, "No markers at all"),
    (3, "[S2]\n* Vector search finds neighbours [S2]"),
    (4, "the and of [S1]"),
]
_EV = [(1, "S1", "Failed jobs are retried by the queue with exponential backoff."), (1, "S2", "Completely different content."), (3, "S2", "vector search index finds nearest neighbours quickly"), (4, "S1", "the and of")]
_sql = lambda rows: ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("\n", "' || chr(10) || '") + "'" for v in r) + ")" for r in rows)
_ANSWERS_SQL = f"answers(run_id, answer) AS (VALUES {_sql(_ANSWERS)}), evidence(run_id, evidence_id, content) AS (VALUES {_sql(_EV)})"


def _answers(spark):
    return spark.createDataFrame(_ANSWERS, "run_id int, answer string"), spark.createDataFrame(_EV, "run_id int, evidence_id string, content string")


@query(f"WITH {_ANSWERS_SQL} SELECT run_id, unnest(regexp_extract_all(answer, '\\[(S\\d+)\\]', 1)) AS marker FROM answers")
def citation_markers(spark, sf):
    return _answers(spark)[0].select("run_id", F.explode(T.citation_markers(F.col("answer"))).alias("marker"))


_CLAIMS = f"""{_ANSWERS_SQL}, m AS (SELECT DISTINCT run_id, answer, unnest(regexp_extract_all(answer, '\\[(S\\d+)\\]', 1)) AS marker FROM answers),
c AS (SELECT run_id, marker, coalesce(list_filter(list_transform(list_filter(string_split(answer, chr(10)), lambda l: contains(l, '[' || marker || ']')), lambda l: trim(regexp_replace(trim(replace(l, '[' || marker || ']', '')), '^[#\\-* ]+', ''))), lambda x: x <> '')[1], 'Evidence reference') AS claim FROM m)"""


@query(f"WITH {_CLAIMS} SELECT run_id, marker, claim FROM c")
def citation_claims(spark, sf):
    a = _answers(spark)[0].select("run_id", "answer", F.explode(F.array_distinct(T.citation_markers(F.col("answer")))).alias("marker"))
    return a.select("run_id", "marker", T.citation_claim(F.col("answer"), F.col("marker")).alias("claim"))


_TERMS = f"list_filter(list_distinct({tokens('claim')}), lambda t: NOT list_contains([{_list(T.CLAIM_STOP_WORDS)}], t))"
_SUPPORT = f"CASE WHEN content IS NULL OR len({_TERMS}) = 0 THEN 0.0 ELSE len(list_intersect({_TERMS}, {tokens('content')})) / CAST(len({_TERMS}) AS DOUBLE) END"


@query(f"WITH s AS (SELECT doc_id, string_split(text, chr(10))[1] AS claim, array_to_string(string_split(text, chr(10))[2:], chr(10)) AS content FROM documents) SELECT doc_id, round(CAST({_SUPPORT} AS DOUBLE), 9) AS support FROM s")
def claim_support(spark, sf):
    """How far the rest of a document supports its first line."""
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    rest = F.array_join(F.slice("l", F.lit(2), F.greatest(F.size("l"), F.lit(1))), "\n")
    return d.select("doc_id", F.round(E.support(F.get("l", F.lit(0)), rest), 9).alias("support"))


@query(f"WITH {_CLAIMS}, j AS (SELECT c.run_id, marker AS evidence_id, claim, content, {_SUPPORT} AS support FROM c LEFT JOIN evidence e ON c.run_id = e.run_id AND c.marker = e.evidence_id) SELECT run_id, evidence_id, claim, content IS NOT NULL AS known, round(CAST(support AS DOUBLE), 9) AS support_score, content IS NOT NULL AND support >= 0.18 AS valid FROM j")
def citation_verify(spark, sf):
    return E.citations(*_answers(spark))


@query(f"""WITH {_CLAIMS}, j AS (SELECT c.run_id, marker, claim, content, {_SUPPORT} AS support FROM c LEFT JOIN evidence e ON c.run_id = e.run_id AND c.marker = e.evidence_id),
b AS (SELECT run_id, list(marker) FILTER (content IS NULL) AS unknown, bool_or(content IS NOT NULL AND support < 0.18) AS unsupported FROM j GROUP BY run_id),
f AS (SELECT run_id, '- ' || min(content) || ' [S1]' AS fallback FROM evidence GROUP BY run_id),
s AS (SELECT answers.run_id, fallback, coalesce(unknown, []) AS unknown, coalesce(unsupported, false) AS unsupported, list_reduce(list_prepend(answer, list_transform(coalesce(unknown, []), lambda m: '[' || m || ']')), lambda a, m: replace(a, m, '')) AS stripped FROM answers LEFT JOIN b USING (run_id) LEFT JOIN f USING (run_id)),
r AS (SELECT *, fallback IS NOT NULL AND (unsupported OR len(regexp_extract_all(stripped, '\\[(S\\d+)\\]', 1)) = 0) AS replaced FROM s)
SELECT run_id, CASE WHEN replaced THEN fallback ELSE stripped END AS answer, CASE WHEN replaced THEN 'replaced' WHEN len(unknown) > 0 THEN 'stripped' ELSE 'kept' END AS action FROM r""")
def citation_repair(spark, sf):
    answers, evidence = _answers(spark)
    fallback = evidence.groupBy("run_id").agg(F.concat(F.lit("- "), F.min("content"), F.lit(" [S1]")).alias("answer"))
    return E.repaired(answers, evidence, fallback)


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<think>plan' || chr(10) || 'x</think> ' || text WHEN turn % 3 = 1 THEN text || ' <THINK>cut off' ELSE text END AS t FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '(?is)<think>.*?</think>\\s*', '', 'g'), '(?is)<think>.*$', ''), '^\\s+|\\s+$', '', 'g') AS text FROM t""")
def strip_reasoning(spark, sf):
    c = table(spark, sf, "conversations")
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>plan\nx</think> "), "text")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" <THINK>cut off"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.strip_reasoning(t).alias("text"))


_ABST = [(1, "## 结论\n\n证据不足：没有资料"), (2, "Sorry, insufficient evidence here"), (3, "A clear answer. " + "x" * 90 + " cannot answer"), (4, "  I cannot answer that")]


@query(f"WITH a(id, t) AS (VALUES {_sql(_ABST)}) SELECT id, regexp_matches(regexp_replace(t, '^\\s+', ''), '{T.ABSTENTION}') AS abstained FROM a")
def abstention_flag(spark, sf):
    return spark.createDataFrame(_ABST, "id int, t string").select("id", T.abstains(F.col("t")).alias("abstained"))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens, round((greatest(1, length(text) // 4) * 0.15 + 200 * 0.6) / 1e6, 12) AS cost FROM documents")
def token_cost(spark, sf):
    n = T.estimated_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", n.alias("tokens"), F.round(T.cost(n, F.lit(200), 0.15, 0.6), 12).alias("cost"))


def _issues(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 10**9).alias("chunk_id"), F.col("text").alias("content"))


def _loop(mode):
    def f(spark, sf):
        return agent.run(chunks(spark, sf), _issues(spark, sf), questions(spark, sf), mode, embedded=indexed_embedding_hits(spark, sf), lexical=lambda q, k: lexical(spark, sf, k, q))["answers"]

    f.__name__ = {"naive": "naive_loop", "fixed_retrieval": "fixed_loop", "agentic": "agentic_loop"}[mode]
    f.__doc__ = f"Answers of the {mode} loop for all questions, with hybrid search over hashed embeddings, which have no SQL."
    return query()(f)


for _mode in agent.ROUNDS:
    _loop(_mode)


@query(f"""WITH {_BUDGETED.replace("1200 -", "5200 -")}, x AS (SELECT *, regexp_replace(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS one FROM fitted WHERE number <= 5),
r AS (SELECT query_id, '## 研究结论' || chr(10) || chr(10) || '问题：' || question || chr(10) || chr(10) || string_agg('- ' || CASE WHEN length(one) > 360 THEN substr(one, 1, 357) || '...' ELSE one END || ' [' || evidence_id || ']', chr(10) ORDER BY number) || chr(10) || chr(10) || '## 限制' || chr(10) || chr(10) || '以上结论仅基于当前已索引的证据。' AS answer FROM x GROUP BY query_id, question)
SELECT query_id, CASE WHEN lower(trim(question)) IN ({_list(T.GREETINGS)}) THEN '{agent.GREETING}' ELSE coalesce(answer, '{agent.NO_EVIDENCE}') END AS answer, false AS refused, 'kept' AS action FROM questions LEFT JOIN r USING (query_id)""")
def naive_loop_lexical(spark, sf):
    """The naive loop over the lexical channel alone, from route to citation check."""
    return agent.run(chunks(spark, sf), _issues(spark, sf), questions(spark, sf), "naive", lexical=lambda q, k: lexical(spark, sf, k, q))["answers"]
