"""Text functions as Columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
WORD = r"[\p{L}\p{N}_.+#/-]+"
CJK = r"[㐀-鿿]"
LATIN_RUN = r"[a-z0-9_.+#/-]{2,}"
QUESTION_STOP_WORDS = ("what", "how", "why", "when", "where", "which", "the", "and", "for", "with", "是什么", "为什么", "如何", "什么", "哪些", "怎么")
CLAIM_STOP_WORDS = ("the", "a", "an", "and", "or", "is", "are", "to", "of", "in", "for", "with", "this", "that", "evidence", "reference")
GREETINGS = ("hi", "hello", "你好", "嗨", "谢谢", "thanks")
ISSUE_CUES = ("issue", "bug", "报错", "故障")
CODE_CUES = ("code", "function", "class", "实现", "源码")
ABSTENTION = r"(?is)^(?:#{1,3}\s*)?(?:结论\s*)?.{0,80}(?:证据不足|insufficient evidence|cannot answer)"
REWRITES = (
    (("语义搜索", "字面匹配"), "Dense Retrieval BM25 weighted RRF hybrid retrieval"),
    (("不应该被仓库索引", "哪些文件"), ".git build directory binary model weights secret files ignored"),
    (("源码检索", "最小证据单元"), "Symbol locator class function method source code"),
    (("错误应该重试", "不应重试"), "connection timeout limited retry parameter Schema validation error"),
    (("真实 qwen", "deterministic provider"), "Qwen vLLM real evaluation deterministic extractive provider offline pipeline"),
    (("避免每次全量重建", "github repo"), "file hash Git commit changed files incremental indexing"),
)
REWRITE_SUFFIXES = ("technical documentation exact terminology", "implementation behavior evidence source")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Lower-case runs of word characters and . + # / -"""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


def _cjk_terms(token: Column) -> Column:
    """Characters, pairs of neighbours among them, and Latin runs of a token with CJK characters."""
    characters = F.regexp_extract_all(token, F.lit(CJK), F.lit(0))
    pairs = F.when(F.size(characters) > 1, F.zip_with(F.slice(characters, 1, F.size(characters) - 1), F.slice(characters, 2, F.size(characters) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(characters, pairs, F.regexp_extract_all(token, F.lit(LATIN_RUN), F.lit(0)))


def tokenize(text: Column | str) -> Column:
    """Search terms of a text, in order, with repeats. Null gives no terms."""
    text = F.coalesce(_col(text), F.lit(""))
    plain = F.filter(words(text), lambda t: F.length(t) > 1)
    mixed = F.flatten(F.transform(words(text), lambda t: F.when(t.rlike(CJK), _cjk_terms(t)).when(F.length(t) > 1, F.array(t)).otherwise(F.array().cast("array<string>"))))
    return F.when(text.rlike(CJK), mixed).otherwise(plain)


def without(terms: Column, stop_words: tuple[str, ...]) -> Column:
    """Distinct terms longer than one character that are no stop words."""
    stop = F.array(*map(F.lit, stop_words))
    return F.array_distinct(F.filter(terms, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))


def occurrences(text: Column, part: Column) -> Column:
    """How often part is found in text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def strip_reasoning(text: Column) -> Column:
    """Without closed reasoning blocks, then without an unfinished one, trimmed."""
    closed = F.regexp_replace(text, r"(?is)<think>.*?</think>\s*", "")
    return F.regexp_replace(F.regexp_replace(closed, r"(?is)<think>.*$", ""), r"^\s+|\s+$", "")


def citation_markers(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(r"\[(S\d+)\]"), F.lit(1))


def citation_claim(answer: Column, marker: Column) -> Column:
    """The first line with the marker, without it and without leading list signs; at most 500 characters."""
    rendered = F.concat(F.lit("["), marker, F.lit("]"))
    lines = F.filter(F.split(answer, "\n"), lambda line: F.contains(line, rendered))
    claims = F.transform(lines, lambda line: F.trim(F.regexp_replace(F.trim(F.replace(line, rendered, F.lit(""))), r"^[#\-* ]+", "")))
    first = F.get(F.filter(claims, lambda c: F.length(c) > 0), F.lit(0))
    return F.coalesce(F.substring(first, 1, 500), F.lit("Evidence reference"))


def excerpt(text: Column, most: int = 360) -> Column:
    """White space (that of SQL: no vertical tab) collapsed, cut to so many characters."""
    one = F.regexp_replace(F.regexp_replace(text, r"^[ \t\n\f\r]+|[ \t\n\f\r]+\z", ""), r"[ \t\n\f\r]+", " ")
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 3), F.lit("..."))).otherwise(one)


def abstains(answer: Column) -> Column:
    return F.regexp_replace(answer, r"^\s+", "").rlike(ABSTENTION)


def subquestions(question: Column) -> Column:
    """Parts of a question between ; and full stops, `and` and the like: three at most; the question if there are none."""
    parts = F.split(question, r"[;；。]|\band\b|\b以及\b")
    kept = F.slice(F.filter(parts, lambda p: F.length(F.trim(p)) > 0), 1, 3)
    bare = F.transform(kept, lambda p: F.regexp_replace(p, r"^[ ?？.]+|[ ?？.]+$", ""))
    named = F.transform(bare, lambda p: F.when(F.length(p) > 0, p).otherwise(question))
    return F.when(F.size(named) > 0, named).otherwise(F.array(question))


def evidence_type(question: Column) -> Column:
    low = F.lower(question)
    has = lambda cues: low.rlike("|".join(cues))
    return F.when(has(ISSUE_CUES), "issues").when(has(CODE_CUES), "code").otherwise("mixed")


def rewrite(query: Column, round_number: int) -> Column:
    """The query for the next round: that of the first rule whose cues it all has, else with a suffix for the round."""
    out = F.concat(query, F.lit(" " + REWRITE_SUFFIXES[min(round_number - 1, len(REWRITE_SUFFIXES) - 1)]))
    for cues, better in reversed(REWRITES):
        every = F.lit(True)
        for cue in cues:
            every &= F.contains(F.lower(query), F.lit(cue))
        out = F.when(every, better).otherwise(out)
    return out


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def cost(prompt: Column, completion: Column, prompt_price: float, completion_price: float) -> Column:
    """Price of tokens, with prices per million."""
    return (prompt * prompt_price + completion * completion_price) / 1e6


def squash(score: Column) -> Column:
    """Logistic function of a score clamped to 60."""
    return 1 / (1 + F.exp(-F.least(F.lit(60.0), F.greatest(F.lit(-60.0), score))))


def phrase_share(content: Column, phrases: Column) -> Column:
    """Share of phrases that content has, without regard to case; 0 without phrases."""
    found = F.filter(phrases, lambda p: F.contains(F.lower(content), F.lower(p)))
    return F.coalesce(F.size(found) / F.nullif(F.size(phrases), F.lit(0)), F.lit(0.0))


def point_id(chunk_id: Column) -> Column:
    """The first 15 hex digits of the id's SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(chunk_id, 256), 1, 15), 16, 10).cast("long")


def line_locator(path: Column, first: Column, last: Column, prefix: str = "") -> Column:
    return F.format_string(prefix + "%s#L%d-L%d", path, first, last)


def lines(text: Column) -> Column:
    """Lines of a text: every line boundary counts, and the empty rest after the last one does not."""
    split = F.split(F.regexp_replace(text, "\r\n|[\r\u000b\u000c\u001c\u001d\u001e\u0085  ]", "\n"), "\n")
    return F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)
