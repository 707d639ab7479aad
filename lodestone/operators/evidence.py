"""From hits to cited reports: grading, decisions, evidence sets, extractive answers and checked citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .common import rank

#: Fixed values.
COVERAGE, RELEVANCE, STRONG_RELEVANCE = 0.35, 0.18, 0.65
REFUSE_COVERAGE, REFUSE_RELEVANCE = 0.2, 0.12
SUPPORT, GRADED_HITS, REPORTED = 0.18, 8, 5
TOKEN_BUDGET, RESERVED, LEAST_BUDGET = 6000, 800, 256


def best_hits(hits: DataFrame) -> DataFrame:
    """The best hit of each query and chunk over tools and rounds (column ord: the earlier of equals); ord is when the chunk was first brought."""
    best = F.max_by(F.struct("tool", "score"), F.struct("score", -F.col("ord")))
    return hits.groupBy("query_id", "chunk_id").agg(best.alias("b"), F.min("ord").alias("ord")).select("query_id", "chunk_id", "b.tool", "b.score", "ord")


def graded(hits: DataFrame) -> DataFrame:
    """Coverage, relevance, diversity and sufficient of each query from its first hits (query_id, question, rank, source_id, content)."""
    terms = F.array_distinct(T.tokenize("content"))
    asked = T.without(T.tokenize("question"), T.QUESTION_STOP_WORDS)
    first = hits.where(F.col("rank") <= GRADED_HITS).select("query_id", "source_id", asked.alias("asked"), F.array_intersect(asked, terms).alias("found"))
    of = F.greatest(F.lit(1), F.size(F.first("asked")))
    out = first.groupBy("query_id").agg(
        (F.size(F.array_distinct(F.flatten(F.collect_list("found")))) / of).alias("coverage"),
        F.max(F.size("found") / F.greatest(F.lit(1), F.size("asked"))).alias("relevance"),
        F.least(F.lit(1.0), F.count_distinct("source_id") / 2).alias("diversity"),
    )
    return out.withColumn("sufficient", sufficient(F.col("coverage"), F.col("relevance")))


def sufficient(coverage: Column, relevance: Column) -> Column:
    return ((coverage >= COVERAGE) & (relevance >= RELEVANCE)) | (relevance >= STRONG_RELEVANCE)


def decision(mode: Column, enough: Column, round_number: Column, rounds: Column) -> Column:
    """What follows a graded round."""
    return F.when((mode == "fixed_retrieval") & (round_number < rounds), "fixed_retrieve_again").when(enough, "generate").otherwise("retrieve_again")


def reason(mode: Column, enough: Column, round_number: Column, rounds: Column, coverage: Column, relevance: Column) -> Column:
    """Why a graded round is followed by what it is; coverage and relevance as reported."""
    weak = F.concat(F.lit("evidence below threshold: coverage="), coverage, F.lit(", relevance="), relevance, F.lit("; rewrite and retrieve again"))
    met = "evidence met the configured coverage/relevance threshold; continue to generation"
    return F.when((mode == "fixed_retrieval") & (round_number < rounds), "fixed two-retrieval control requires a second retrieval").when(enough, met).otherwise(weak)


def refuses(mode: Column, ever_sufficient: Column, hits: Column, coverage: Column, relevance: Column) -> Column:
    """Whether a run ends without evidence."""
    weak = (coverage < REFUSE_COVERAGE) | (relevance < REFUSE_RELEVANCE)
    return (mode == "agentic") & ~ever_sufficient & ((hits == 0) | weak)


def registered(ranked: DataFrame, k: int) -> DataFrame:
    """Evidence of each query: the first k hits, one for each content, named S1, S2, ... in order of rank."""
    first = ranked.where(F.col("rank") <= k).withColumn("content_hash", F.sha2("content", 256))
    unique = first.withColumn("_n", rank("query_id", "content_hash", order=[F.asc("rank")])).where("_n = 1").drop("_n")
    return unique.withColumn("number", rank("query_id", order=[F.asc("rank")])).withColumn("evidence_id", F.concat(F.lit("S"), "number"))


def budgeted(evidence: DataFrame, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Evidence within the token budget: the item that crosses it is cut, those after it are dropped."""
    total = max(LEAST_BUDGET, budget - RESERVED)
    before = Window.partitionBy("query_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(total) - F.coalesce(F.sum("_n").over(before), F.lit(0))
    kept = evidence.withColumn("_n", T.estimated_tokens(F.col("content"))).withColumn("_left", left).where("_left > 0")
    content = F.when(F.col("_n") > F.col("_left"), F.substring("content", F.lit(1), (F.col("_left") * 4).cast("int"))).otherwise(F.col("content"))
    return kept.withColumn("content", content).withColumn("tokens", F.least("_n", F.col("_left")).cast("int")).drop("_n", "_left")


def reports(evidence: DataFrame) -> DataFrame:
    """query_id and an answer that quotes the first items of evidence with their markers."""
    line = F.concat(F.lit("- "), T.excerpt(F.col("content")), F.lit(" ["), F.col("evidence_id"), F.lit("]"))
    items = evidence.where(F.col("number") <= REPORTED).groupBy("query_id", "question").agg(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["line"]), "\n")
    return items.select("query_id", F.concat(F.lit("## 研究结论\n\n问题："), "question", F.lit("\n\n"), body, F.lit("\n\n## 限制\n\n以上结论仅基于当前已索引的证据。")).alias("answer"))


def support(claim: Column, evidence: Column) -> Column:
    """Share of a claim's terms that the evidence has; 0 without terms."""
    terms = T.without(T.tokenize(claim), T.CLAIM_STOP_WORDS)
    return F.coalesce(F.size(F.array_intersect(terms, T.tokenize(evidence))) / F.nullif(F.size(terms), F.lit(0)), F.lit(0.0))


def citations(answers: DataFrame, evidence: DataFrame, threshold: float = SUPPORT) -> DataFrame:
    """Each marker of each answer (run_id, answer) once, with its claim, support and whether it is valid.

    evidence: run_id, evidence_id, content. A marker without evidence is unknown, support 0.
    """
    each = answers.select("run_id", "answer", F.explode(F.array_distinct(T.citation_markers(F.col("answer")))).alias("evidence_id"))
    claimed = each.withColumn("claim", T.citation_claim(F.col("answer"), F.col("evidence_id"))).drop("answer")
    joined = claimed.join(evidence.select("run_id", "evidence_id", "content"), ["run_id", "evidence_id"], "left")
    score = F.when(F.col("content").isNull(), 0.0).otherwise(support(F.col("claim"), F.col("content")))
    return joined.select("run_id", "evidence_id", "claim", F.col("content").isNotNull().alias("known"), F.round(score, 9).alias("support_score")).withColumn("valid", F.col("known") & (F.col("support_score") >= threshold))


def repaired(answers: DataFrame, evidence: DataFrame, fallback: DataFrame, threshold: float = SUPPORT) -> DataFrame:
    """run_id, answer, action: unknown markers are taken out; where none are left, or one is unsupported, the fallback replaces the answer once.

    fallback: run_id and an extractive answer; a run without evidence has none, and markers are only taken out.
    """
    checked = citations(answers, evidence, threshold)
    bad = checked.groupBy("run_id").agg(F.collect_set(F.when(~F.col("known"), F.col("evidence_id"))).alias("unknown"), F.max(F.col("known") & ~F.col("valid")).alias("unsupported"))
    joined = answers.join(bad, "run_id", "left").join(fallback.select("run_id", F.col("answer").alias("_fallback")), "run_id", "left")
    empty = F.array().cast("array<string>")
    unknown = F.coalesce("unknown", empty)
    stripped = F.aggregate(unknown, F.col("answer"), lambda a, m: F.replace(a, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))
    none_left = F.size(T.citation_markers(stripped)) == 0
    replace = F.col("_fallback").isNotNull() & (none_left | F.coalesce("unsupported", F.lit(False)))
    action = F.when(replace, "replaced").when(F.size(unknown) > 0, "stripped").otherwise("kept")
    return joined.select("run_id", F.when(replace, F.col("_fallback")).otherwise(stripped).alias("answer"), action.alias("action"))


def tools(mode: Column, expected: Column, round_number: Column, web: bool = False) -> Column:
    """Names of the tools that a round uses."""
    wide = mode != "naive"
    some = F.array(
        F.lit("semantic_document_search"),
        F.when(wide & expected.isin("code", "mixed"), "code_keyword_search"),
        F.when(wide & expected.isin("issues", "mixed"), "github_issue_search"),
        F.when(F.lit(web) & (round_number >= 2), "web_search"),
    )
    return F.filter(some, lambda t: t.isNotNull())
