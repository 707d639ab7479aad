"""The loop for tables of questions against a plain version, one question at a time."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evidence as E
from lodestone.operators import retrieval as R
from lodestone.operators.registry import Tool, per_question, reranker
from lodestone.plans import agent
from reference_search import bm25, terms

WORDS = "queue worker retry lease token vector index search code issue cache shard batch stream parse build".split()
CHUNK = "chunk_id long, source_id string, content string, status string, category string"


def corpus():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing"]) for _ in range(n))
    chunks = [(i, f"s{i % 4}", text(rng.randint(3, 30)), "deleted" if i % 9 == 8 else "completed", "code" if i % 3 == 0 else "docs") for i in range(40)]
    issues = [(1000 + i, text(12)) for i in range(10)]
    questions = [(1, "hello"), (2, "how does the queue retry and where is the lease; what of tokens"), (3, "zebra giraffe"), (4, "vector index search code"), (5, "an issue of shards"), (6, "zebra and worker cache batch stream parse builds zoo lion ape"), (7, "; ; .")]
    return chunks, issues, questions


def parts_of(question):
    import re

    parts = [p.strip(" ?？.") for p in re.split(r"[;；。]|\band\b|\b以及\b", question) if p.strip()][:3]
    return [p or question for p in parts or [question]]


def best(scored, n):
    return sorted(((c, s) for c, s in scored.items() if s > 0), key=lambda x: (-x[1], x[0]))[:n]


def dense(query, chunks):
    """A stand-in for the dense channel: a chunk is near a query if their first words begin alike, or a little by its number."""
    first = (terms(query) or ["?"])[0][0]
    return best({c: 0.9 if t[:1] == first else 0.5 if c % 11 == 3 else 0 for c, _, t, status, _ in chunks if status == "completed"}, 20)


def fused(a, b, n):
    """Reciprocal rank fusion of two channels, best first; one that is alone keeps its scores."""
    if not a or not b:
        return (a or b)[:n]
    place = [{c: i for i, (c, _) in enumerate(x, 1)} for x in (a, b)]
    score = {c: round(sum(1 / (60 + p[c]) for p in place if c in p) / (2 / 61), 9) for c in {**place[0], **place[1]}}
    last = 10**9
    return sorted(score.items(), key=lambda x: (-x[1], place[0].get(x[0], last), place[1].get(x[0], last), x[0]))[:n]


def searched(tool, query, chunks, issues, both=False):
    active = {c: t for c, _, t, status, _ in chunks if status == "completed"}
    asked = list(dict.fromkeys(terms(query)))
    if tool == "semantic_document_search":
        lexical = best({c: round(s, 9) for c, s in bm25(active, query).items()}, 60 if both else 20)
        return fused(dense(query, chunks), lexical, 20) if both else lexical
    if tool == "code_keyword_search":
        code = {c: t for c, _, t, status, category in chunks if status == "completed" and category == "code"}
        return best({c: min(1.0, sum(t.lower().count(a) for a in asked) / 5) for c, t in code.items()}, 20)
    return best({c: round(len(set(asked) & set(terms(t))) / max(1, len(asked)), 9) for c, t in issues}, 20)


def plain(question, mode, chunks, issues, web=None, both=False, broken=()):
    """Grades, evidence and whether the question is refused, as the loop has them."""
    low = question.lower()
    expected = "issues" if any(c in low for c in T.ISSUE_CUES) else "code" if any(c in low for c in T.CODE_CUES) else "mixed"
    queries = [question] if mode == "naive" else parts_of(question)
    source = {c: s for c, s, *_ in chunks} | {c: "issues" for c, _ in issues} | {c: "web" for c, _, _ in web or []}
    content = {c: t for c, _, t, *_ in chunks} | dict(issues) | {c: t for c, t, _ in web or []}
    hits, grades, ever = {}, [], mode == "naive"
    for n in range(1, agent.ROUNDS[mode] + 1):
        for q in queries:
            tools = ["semantic_document_search"]
            tools += ["code_keyword_search"] if mode != "naive" and expected in ("code", "mixed") else []
            tools += ["github_issue_search"] if mode != "naive" and expected in ("issues", "mixed") else []
            for c, s in [x for t in tools if (t, question) not in broken and t not in broken for x in searched(t, q, chunks, issues, both)] + ([(c, s) for c, _, s in web] if web and n > 1 else []):
                hits[c] = max(hits.get(c, s), s)
        ranked = sorted(hits, key=lambda c: -hits[c])  # stable: of equal scores that which was brought first
        if mode == "naive":
            break
        asked = {t for t in terms(" ".join(queries)) if len(t) > 1 and t not in T.QUESTION_STOP_WORDS}
        found = [asked & set(terms(content[c])) for c in ranked[: min(6, 8)]]
        coverage = len(set().union(*found)) / max(1, len(asked))
        relevance = max((len(f) / max(1, len(asked)) for f in found), default=0.0)
        enough = bool(found) and ((coverage >= 0.35 and relevance >= 0.18) or relevance >= 0.65)
        grades.append((n, " ".join(queries), round(coverage, 3) if found else 0.0, round(relevance, 3), enough))
        ever = ever or enough
        if enough and (mode == "agentic" or n == agent.ROUNDS[mode]):
            break
        suffix = T.REWRITE_SUFFIXES[min(n - 1, 1)]
        queries = [f"{q} {suffix}" for q in queries]
    top = max(grades, key=lambda g: (g[2] + g[3], -g[0]), default=None)
    refused = mode == "agentic" and not ever and (not ranked or top[2] < E.REFUSE_COVERAGE or top[3] < E.REFUSE_RELEVANCE)
    evidence = []
    for c in [] if refused else ranked[:6]:
        if content[c] not in [content[e] for e in evidence]:
            evidence.append(c)
    return grades, evidence, refused


WEB = [(9000, "zebra giraffe in the savanna", 0.9), (9001, "another page", 0.01)]


@pytest.mark.parametrize("mode, with_web", [("naive", False), ("fixed_retrieval", False), ("agentic", False), ("agentic", True)])
def test_loops_equal_the_plain_version(spark, mode, with_web):
    from pyspark.sql import functions as F

    chunks, issues, questions = corpus()
    pages = spark.createDataFrame([(c, "web", t, s) for c, t, s in WEB], "chunk_id long, source_id string, content string, score double")
    web = (lambda q, k: q.select("query_id").join(F.broadcast(pages))) if with_web else None
    out = agent.run(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(issues, "chunk_id long, content string"), spark.createDataFrame(questions, "query_id long, question string"), mode, web=web)
    out = {name: df.collect() for name, df in out.items()}
    answers = {r.query_id: r for r in out["answers"]}
    assert answers[1].answer == agent.GREETING and len(answers) == len(questions)
    for q, question in questions[1:]:
        grades, evidence, refused = plain(question, mode, chunks, issues, WEB if with_web else None)
        got = sorted((r.round, r.query, r.coverage, r.relevance, r.sufficient) for r in out["grades"] if r.query_id == q)
        assert got == grades, question
        assert [r.chunk_id for r in sorted((r for r in out["evidence"] if r.query_id == q), key=lambda r: r.number)] == evidence
        assert answers[q].refused == refused and (answers[q].answer == agent.NO_EVIDENCE) == (not evidence)
        calls = [r for r in out["calls"] if r.query_id == q]
        assert {r.round for r in calls} == {g[0] for g in grades} or mode == "naive" and {r.round for r in calls} == {1}
        assert all((r.results == 0) == (r.top_score is None) for r in calls)
        if mode != "naive":
            assert {r.part for r in calls} == set(range(len(parts_of(question))))
    assert ("web_search" in {r.tool for r in out["calls"]}) == with_web


def test_answers_are_verified_and_repaired(spark):
    """A generator that cites what is not there, one that says nothing of its evidence, and one that is right."""
    chunks, issues, _ = corpus()
    questions = spark.createDataFrame([(i, "queue worker retry lease") for i in range(1, 4)], "query_id long, question string")

    def generate(evidence):
        one = evidence.where("number = 1").selectExpr("query_id", "content")
        return one.selectExpr("query_id", "CASE query_id WHEN 1 THEN concat(content, ' [S1] [S99]') WHEN 2 THEN 'penguins fly south [S1]' ELSE concat(content, ' [S1]') END AS answer")

    out = agent.run(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(issues, "chunk_id long, content string"), questions, "naive", generate=generate)
    got = {r.query_id: r for r in out["answers"].collect()}
    assert {q: r.action for q, r in got.items()} == {1: "stripped", 2: "replaced", 3: "kept"}
    assert "[S99]" not in got[1].answer and got[2].answer.endswith(agent.REPAIR_NOTE)
    assert all(r.known for r in out["citations"].collect())


def test_both_channels_equal_the_plain_version(spark):
    chunks, issues, questions = corpus()

    def embedded(c, q, k):
        rows = [(i, t, s) for i, text in [(r.query_id, r.question) for r in q.collect()] for t, s in dense(text, chunks)]
        return R.top(spark.createDataFrame(rows, "query_id long, chunk_id long, score double"), k, ["query_id"], [F.desc("score"), F.asc("chunk_id")])

    out = agent.run(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(issues, "chunk_id long, content string"), spark.createDataFrame(questions, "query_id long, question string"), "agentic", embedded=embedded)
    evidence = out["evidence"].collect()
    for q, question in questions[1:]:
        want = plain(question, "agentic", chunks, issues, both=True)[1]
        assert [r.chunk_id for r in sorted((r for r in evidence if r.query_id == q), key=lambda r: r.number)] == want, question


def broken_tools(chunks, issues):
    """Semantic search that fails as a whole; issue search that asks question by question, fails for one and needs two attempts for others."""

    def fails(queries, k):
        raise TimeoutError("semantic backend timed out")

    def load():
        tried = set()

        def ask(question, k):
            if "issue of shards" in question:
                raise RuntimeError("no such index")
            if question not in tried:
                tried.add(question)
                raise ConnectionError("reset")
            return [(c, s, "issues", dict(issues)[c]) for c, s in searched("github_issue_search", question, chunks, issues)]

        return ask

    return [Tool("semantic_document_search", fails, max_retries=1), per_question("github_issue_search", load, max_retries=1)]


def test_a_failing_tool_leaves_other_evidence(spark):
    """The loop ends, other tools' and other questions' evidence is that of the plain version without the failed calls, and calls say what failed."""
    chunks, issues, questions = corpus()
    out = agent.run(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(issues, "chunk_id long, content string"), spark.createDataFrame(questions, "query_id long, question string"), "agentic", tools=broken_tools(chunks, issues))
    evidence, calls, answers = out["evidence"].collect(), out["calls"].collect(), {r.query_id: r for r in out["answers"].collect()}
    assert len(answers) == len(questions)
    for q, question in questions[1:]:
        want = plain(question, "agentic", chunks, issues, broken=("semantic_document_search", ("github_issue_search", "an issue of shards")))
        got = [r.chunk_id for r in sorted((r for r in evidence if r.query_id == q), key=lambda r: r.number)]
        assert got == want[1] and answers[q].refused == want[2], question
    status = {(r.query_id, r.tool): (r.status, r.attempts, r.error, r.error_type, r.retryable) for r in calls}
    assert all(v == ("failed", 2, "semantic backend timed out", "timeout", True) for (q, t), v in status.items() if t == "semantic_document_search")
    assert status[5, "github_issue_search"] == ("failed", 1, "no such index", "internal", False)
    assert status[2, "github_issue_search"][:2] == ("completed", 2) and status[4, "code_keyword_search"] == ("completed", 1, None, None, False)
    assert any(evidence) and all(r.results == 0 for r in calls if r.status == "failed")


def test_a_failing_reranker_degrades_to_retrieval_order(spark):
    chunks, issues, _ = corpus()
    questions = [(i, t) for i, t in enumerate(["queue worker retry lease", "vector index search code", "cache shard batch"], 1)]
    tables = spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(issues, "chunk_id long, content string"), spark.createDataFrame(questions, "query_id long, question string")

    def load():
        def model(pairs):
            if "vector" in pairs[0][0]:
                raise RuntimeError("reranker unavailable")
            return [-len(c) / 50 for _, c in pairs]

        return model

    plainly = agent.run(*tables, "agentic")["evidence"].collect()
    out = agent.run(*tables, "agentic", reranker=reranker(load))
    got = out["evidence"].collect()
    order = lambda rows, q: [r.chunk_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.number)]
    assert {r.query_id: (r.status, r.error) for r in out["reranking"].collect()} == {1: ("completed", None), 2: ("degraded", "reranker unavailable"), 3: ("completed", None)}
    assert order(got, 2) == order(plainly, 2) and all(r.rerank_score is None for r in got if r.query_id == 2)
    for q in (1, 3):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.number)
        lengths = [len(dict((c, t) for c, _, t, *_ in chunks).get(r.chunk_id) or dict(issues)[r.chunk_id]) for r in mine]
        assert lengths == sorted(lengths) and all(r.rerank_score is not None for r in mine)

    def whole(hits):
        raise OSError("no model file")

    out = agent.run(*tables, "naive", reranker=whole)
    assert {(r.status, r.error) for r in out["reranking"].collect()} == {("degraded", "no model file")}
    assert order(out["evidence"].collect(), 1) == order(agent.run(*tables, "naive")["evidence"].collect(), 1)


def test_repair_can_be_switched_off(spark):
    chunks, issues, _ = corpus()
    questions = spark.createDataFrame([(1, "queue worker retry lease")], "query_id long, question string")
    generate = lambda evidence: evidence.where("number = 1").selectExpr("query_id", "'Unsupported marker [S99].' AS answer")
    tables = spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(issues, "chunk_id long, content string"), questions
    off, on = (agent.run(*tables, "agentic", generate=generate, repair=r) for r in (False, True))
    assert off["answers"].first().answer == "Unsupported marker [S99]." and [(r.evidence_id, r.valid) for r in off["citations"].collect()] == [("S99", False)]
    assert "[S99]" not in on["answers"].first().answer
