"""Quality rules: a fixed base rule, and thresholds that adapt to each language and source.

Each measure of a document is an integer (counts, or parts per thousand). A quantile sketch of a measure is a
table of counts by bucket: a value keeps its BITS leading bits, so quantiles are right within 1/256. Adding up the
counts of two sketches gives the sketch of both, in any order, so a group's sketch is one aggregation, the sketches
of a language and of the corpus are sums of it, and results don't depend on the partitions.

Quantiles of few documents say little, so each is drawn towards that of the level above: a language's quantile is the mean
of its own, weighted by its documents, and of the corpus's, weighted SHRINK; that of a language and source likewise with its language's.

A document fails if a measure is above median + SPREADS x spread of its group or, for the mean word length, below median -
SPREADS x lower spread. The spread comes from the upper side of the sketch: each quantile of LADDER, less the median, over what it is
in a normal distribution; the largest counts. The ladder is climbed only as far as the body reaches: where a quantile is more
than JUMP times as far from the median as the one before, another population begins (what is to be found), and that one and those
above say nothing about ordinary documents. The first step is measured by the lower quartile, and may be JUMP times as long as the others. Documents of no symbol at all still differ by chance, so the least spread is what one
occurrence makes in a short document of the group: 1000 over the lower decile of its words (or letters), also from the sketch, whose buckets at the median it is no narrower than. Bars that stand
alone separate the cells of tables and are no noise.

Null text is empty, so the base rule fails it. Null language and source are groups of their own (together with the empty string).
Texts are measured whole; memory follows the longest one. Values at a fence pass. Repeated rows count each time and get the same verdict. An
empty table gives no rows. Columns that docs has besides doc_id, text, lang and source are not read by `quality`; `keep_good` returns them all, also
those named like a metric.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_adding, small, texts_of, through, uneven_join, written

#: Fixed values of the base rule.
BASE_MIN_WORDS, BASE_REPEAT_PERCENT = 50, 50
#: SHRINK: documents that the level above weighs as many as. JUMP: see above.
SPREADS, SHRINK, JUMP, BITS = 8, 100, 5, 9
#: Measure -> (the size that its least spread is taken from, whether low values fail too).
MEASURES = {"symbols": ("words", False), "capitals": ("letters", False), "dup_lines": ("words", False), "repeats": ("words", False), "word_length": ("words", True)}
SIZES = {"words": "n_words", "letters": "word_chars"}
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_bars")
#: Quantile -> the thousandths of documents up to it.
QUANTILES = {"q10": 100, "q25": 250, "q50": 500, "q75": 750, "q90": 900, "q95": 950, "q97": 975, "q99": 990}
#: Rising quantiles -> how far each is from the median in a normal distribution, in thousandths of its deviation.
LADDER = {"q75": 674, "q90": 1282, "q95": 1645, "q97": 1960, "q99": 2326}
_SPACE = " \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))


def measure(text: str) -> tuple[int, ...]:
    """METRICS of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0, 0
    letters = len(text) - sum(map(text.count, _SPACE))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    repeated = 0
    if n >= 3:
        codes: dict[bytes, int] = {}
        w = np.array([codes.setdefault(x, len(codes)) for x in words], np.int64)
        k = len(codes)
        pairs = w[:-1] * k + w[1:]
        keys = pairs[:-1] * k + w[2:] if k < 2_000_000 else np.unique(pairs, return_inverse=True)[1][:-1] * k + w[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : i + n - 2] |= twice
        repeated = int(covered.sum())
    return n, letters, symbols, len(lines) - len(set(lines)), repeated, capitals, words.count(b"|")


def with_metrics(docs: DataFrame) -> DataFrame:
    """docs plus METRICS (columns of these names are replaced)."""

    def add(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = np.array([measure(t) for t in texts_of(batch)], np.int64).reshape(-1, len(METRICS))
        return {name: pa.array(rows[:, i]) for i, name in enumerate(METRICS)}

    return map_adding(docs, dict.fromkeys(METRICS, "long"), add)


def base_failed() -> Column:
    return (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))


def _measures() -> dict[str, Column]:
    words, letters = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    whole = lambda top, below: F.expr("1000") * top / below
    return {
        "symbols": F.floor(whole(F.col("n_symbols") - F.col("n_bars"), words)),
        "capitals": F.floor(whole(F.col("n_capitals"), letters)),
        "dup_lines": F.floor(whole(F.col("n_dup_lines"), words)),
        "repeats": F.floor(whole(F.col("n_repeat_words"), words)),
        "word_length": F.floor(whole(F.col("word_chars"), words)),
    }


def bucket(value: Column) -> Column:
    """value with all but its BITS leading bits cleared."""
    dropped = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, dropped), dropped)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the quantile sketches of documents that the base rule keeps."""
    values = _measures() | {name: F.col(metric) for name, metric in SIZES.items()}
    pairs = F.array(*(F.struct(F.lit(name).alias("measure"), bucket(value).alias("bucket")) for name, value in values.items()))
    passed = measured.where(~base_failed())
    each = passed.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.explode(pairs).alias("x"))
    return each.groupBy("lang", "source", F.col("x.measure").alias("measure"), F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """Per group and measure: documents and QUANTILES."""
    w = Window.partitionBy(*by, "measure")
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    ranked = merged.select(*by, "measure", "bucket", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("total"))
    at = lambda share: F.min(F.when(F.col("upto") * 1000 >= F.col("total") * share, F.col("bucket")))
    return ranked.groupBy(*by, "measure").agg(F.max("total").alias("docs"), *(at(t).alias(q) for q, t in QUANTILES.items()))


def _shrunk(own: DataFrame, above: DataFrame, by: list[str]) -> DataFrame:
    """own with its quantiles drawn towards those of the level above."""
    joined = own.join(small(above.select(*by, *(F.col(q).alias(f"above_{q}") for q in QUANTILES))), by)
    mean = lambda q: F.expr(f"(docs * {q} + {SHRINK} * above_{q}) div (docs + {SHRINK})").alias(q)
    return joined.select(*(c for c in own.columns if c not in QUANTILES), *map(mean, QUANTILES))


def _fences(name: str) -> dict[str, str]:
    """SQL of the fences of a measure over a group's quantiles, called <measure>_<quantile>; whole numbers, so that any engine has the same."""
    size, low = MEASURES[name]
    unit = f"greatest(1000 div greatest({size}_q10, 1), {name}_q50 div {1 << (BITS - 1)})"
    away = lambda q: f"({name}_{q} - {name}_q50 + {unit})"
    spread, reached, before = [unit], "true", f"{JUMP} * ({name}_q50 - {name}_q25 + {unit})"
    for q, normal in LADDER.items():
        reached += f" and {away(q)} <= {JUMP} * {before}"
        spread.append(f"case when {reached} then 1000 * ({name}_{q} - {name}_q50) div {normal} else 0 end")
        before = away(q)
    fences = {f"high_{name}": f"{name}_q50 + {SPREADS} * greatest({', '.join(spread)})"}
    if low:
        fences[f"low_{name}"] = f"{name}_q50 - {SPREADS} * greatest({unit}, 1000 * ({name}_q50 - {name}_q10) div {LADDER['q90']})"
    return fences


def quantiles(sketch: DataFrame) -> DataFrame:
    """_llm_lang, _llm_source and the quantiles of the group, drawn towards its language's and the corpus's, as <measure>_<quantile>."""
    corpus = _quantiles(sketch)
    language = written(_shrunk(_quantiles(sketch, "lang"), corpus, ["measure"]), "language-quantiles")
    own = _shrunk(_quantiles(sketch, "lang", "source"), language, ["lang", "measure"])
    wide = [F.max(F.when(F.col("measure") == m, F.col(q))).alias(f"{m}_{q}") for m in (*MEASURES, *SIZES) for q in QUANTILES]
    return own.groupBy(F.col("lang").alias("_llm_lang"), F.col("source").alias("_llm_source")).agg(*wide)


def thresholds(sketch: DataFrame) -> DataFrame:
    """_llm_lang, _llm_source and the fences of the group."""
    fences = {k: v for name in MEASURES for k, v in _fences(name).items()}
    return quantiles(sketch).select("_llm_lang", "_llm_source", *(F.expr(v).alias(f"_llm_{k}") for k, v in fences.items()))


def verdicts(measured: DataFrame) -> DataFrame:
    """measured (written, with METRICS, lang, source) plus base_failed and kept."""
    named = measured.drop("base_failed", "kept").withColumns({"_llm_lang": F.coalesce("lang", F.lit("")), "_llm_source": F.coalesce("source", F.lit(""))})
    key = ["_llm_lang", "_llm_source"]
    sizes = named.groupBy(*key).agg(F.count("*").alias("_llm_rows"))
    fences = written(sizes.join(thresholds(written(sketches(measured), "sketches")), key, "left"), "thresholds")
    total = fences.agg(F.sum("_llm_rows")).first()[0] or 0
    joined = uneven_join(named, fences, key, "_llm_rows", total)
    good = ~base_failed()
    for name, value in _measures().items():
        good &= value <= F.col(f"_llm_high_{name}")
        if MEASURES[name][1]:
            good &= value >= F.col(f"_llm_low_{name}")
    out = joined.withColumn("base_failed", base_failed()).withColumn("kept", F.coalesce(good, F.lit(False)))
    return out.drop(*(c for c in out.columns if c.startswith("_llm_")))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the metrics, base_failed and kept of every document."""
    measured = written(with_metrics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-metrics")
    return verdicts(measured).select("doc_id", *METRICS, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    return through(docs, lambda inner: verdicts(written(with_metrics(inner), "quality-docs")).where("kept"))


def _sql() -> str:
    ratios = {"symbols": "1000 * (n_symbols - n_bars) // n_words", "capitals": "1000 * n_capitals // greatest(word_chars, 1)", "dup_lines": "1000 * n_dup_lines // n_words", "repeats": "1000 * n_repeat_words // n_words", "word_length": "1000 * word_chars // n_words"}

    def level(name: str, keys: str) -> str:
        at = ", ".join(f"min(bucket) FILTER (upto * 1000 >= total * {t}) AS {q}" for q, t in QUANTILES.items())
        return f"""{name} AS (SELECT {keys} measure, max(total) AS docs, {at}
  FROM (SELECT {keys} measure, bucket, sum(n) OVER (PARTITION BY {keys} measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys} measure) AS total FROM (SELECT {keys} measure, bucket, sum(n) AS n FROM sketch GROUP BY {keys} measure, bucket)) GROUP BY {keys} measure)"""

    def shrunk(name: str, keys: str, own: str, above: str, using: str) -> str:
        mean = ", ".join(f"({own}.docs * {own}.{q} + {SHRINK} * {above}.{q}) // ({own}.docs + {SHRINK}) AS {q}" for q in QUANTILES)
        return f"{name} AS (SELECT {keys} measure, {mean} FROM {own} JOIN {above} USING ({using}))"

    ratios |= SIZES
    wide = ", ".join(f"max({q}) FILTER (measure = '{m}') AS {m}_{q}" for m in (*MEASURES, *SIZES) for q in QUANTILES)
    fences = ", ".join(f"{v.replace(' div ', ' // ')} AS {k}" for name in MEASURES for k, v in _fences(name).items())
    bad = " OR ".join(f"(measure = '{m}' AND (value > high_{m}{f' OR value < low_{m}' if low else ''}))" for m, (_, low) in MEASURES.items())
    union = " UNION ALL ".join(f"SELECT rn, lang, source, '{m}' AS measure, {r} AS value FROM passed" for m, r in ratios.items())
    blank = "[\\x09-\\x0D ]"
    return f"""WITH base AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT rn, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM base),
grams AS (SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM grams) WHERE c > 1),
repeated AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rn),
lines AS (SELECT rn, sum(c - 1) AS n FROM (SELECT rn, line, count(*) AS c FROM (SELECT rn, unnest(string_split(text, chr(10))) AS line FROM base) WHERE regexp_replace(line, '{blank}', '', 'g') <> '' GROUP BY rn, line) GROUP BY rn),
m AS MATERIALIZED (SELECT rn, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{blank}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals, CAST(len(list_filter(w, lambda x: x = '|')) AS BIGINT) AS n_bars
  FROM base JOIN words USING (rn) LEFT JOIN lines USING (rn) LEFT JOIN repeated USING (rn)),
j AS (SELECT *, n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed FROM m),
passed AS (SELECT * FROM j WHERE NOT base_failed),
v AS (SELECT *, greatest(length(bin(value)) - {BITS}, 0) AS e FROM ({union})),
sketch AS (SELECT lang, source, measure, (value // CAST(pow(2, e) AS BIGINT)) * CAST(pow(2, e) AS BIGINT) AS bucket, count(*) AS n FROM v GROUP BY ALL),
{level("own_q", "lang, source,")}, {level("lan_q", "lang,")}, {level("cor_q", "")},
{shrunk("lan_s", "lang,", "lan_q", "cor_q", "measure")}, {shrunk("own_s", "lang, source,", "own_q", "lan_s", "lang, measure")},
fences AS (SELECT lang, source, {fences} FROM (SELECT lang, source, {wide} FROM own_s GROUP BY lang, source)),
bad AS (SELECT DISTINCT rn FROM v JOIN fences USING (lang, source) WHERE {bad})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_bars, base_failed, NOT base_failed AND rn NOT IN (SELECT rn FROM bad) AS kept FROM j"""


SQL = _sql()
