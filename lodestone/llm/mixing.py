"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's size is its characters. Its rate is the mean number of times a document of it is to appear: its target share
of the corpus's size over its actual share. A document's count is the inverse of the Poisson distribution of that mean
at a number in [0, 1) hashed from seed and doc_id (from the text where doc_id is null), so the same document always has
the same count, on any cluster. Each document is exploded by its count; documents of count 0 vanish, which is the method.
Copies are then shuffled over all partitions and sorted by a hash, a random order of the whole corpus.

A null source is the source "". A source with no characters has rate 1. Repeated rows, and different rows of one id, get the same count
each. Null and empty texts are replicated like others. Very long texts are only copied, never opened. Equal mix_keys (of rows that have id and copy in common) may come in either order. An empty
table gives no rows. Columns named rate, copy or mix_key, in any case, are replaced by `mix` and kept by `mixed`; others don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions, through, uneven_join, written

SEED = 20
#: Without given weights a source's target weight is its size to this power: small sources are raised, none vanishes.
TEMPER = 0.7
#: Means above this are drawn as a sum of draws of equal means, since exp(-mean) must not vanish.
_MOST_MEAN = 256
_FULL = float(1 << 52)


def _name() -> Column:
    return F.coalesce(F.col("source"), F.lit(""))


def rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """source, docs (how many it has), rate and cdf: the cumulative Poisson probabilities of 0, 1, ... for each of its draws.

    weights: relative target weights by source; sources that are not named have weight 0. None: size ** TEMPER.
    """
    sizes = docs.groupBy(_name().alias("source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"), F.count("*").alias("docs"))
    if weights is None:
        weight = F.pow("size", F.lit(TEMPER))
    else:
        weight = F.coalesce(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    sized = written(sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0)), "source-sizes")
    total = sized.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()  # two numbers
    size, all_weights = total["size"] or 0.0, total["weight"] or 0.0
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.col("weight") / F.lit(all_weights or 1.0) * F.lit(size) / F.greatest("size", F.lit(1.0)))
    rated = sized.select("source", "docs", rate.alias("rate")).withColumn("draws", F.greatest(F.ceil(F.col("rate") / _MOST_MEAN), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("draws")
    start = F.exp(-mean)
    terms = F.sequence(F.lit(1), (F.ceil(mean + 12 * F.sqrt(mean)) + 40).cast("int"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return rated.withColumn("cdf", F.aggregate(terms, F.struct(start.alias("p"), F.array(start).alias("cdf")), add)["cdf"])


def _hash(*parts: Column) -> Column:
    """md5 of the seed, the document and the given parts."""
    document = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.coalesce("text", F.lit(""))))
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), document, *parts).cast("binary"))


def _uniform(*parts: Column) -> Column:
    return F.conv(F.substring(_hash(*parts), 1, 13), 16, 10).cast("double") / F.lit(_FULL)


def mix(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs (doc_id, text, source and any others), each row as often as its count, in random order.

    Added: rate, copy (1, 2, ...) and mix_key, by which partitions are sorted. Columns of docs with these names are replaced.
    """
    return through(docs, lambda inner: _mix(inner, weights), ("rate", "copy", "mix_key"))


def _mix(docs: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    table = written(rates(docs, weights), "source-rates").withColumnsRenamed({"source": "_llm_source", "docs": "_llm_docs", "draws": "_llm_draws", "cdf": "_llm_cdf"})
    total = table.agg(F.sum("_llm_docs")).first()[0] or 0
    joined = uneven_join(docs.withColumn("_llm_source", _name()), table, "_llm_source", "_llm_docs", total)
    draw = lambda n, j: n + F.size(F.filter("_llm_cdf", lambda c: c <= _uniform(F.lit("count"), j.cast("string"))))
    single = F.size(F.filter("_llm_cdf", lambda c: c <= F.col("_llm_u")))
    count = F.when(F.col("_llm_draws") == 1, single).otherwise(F.aggregate(F.sequence(F.lit(1), "_llm_draws"), F.lit(0), draw))
    counted = joined.withColumn("_llm_u", _uniform(F.lit("count"), F.lit("1"))).withColumn("_llm_count", count).where("_llm_count > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), "_llm_count")))
    keyed = copies.withColumn("mix_key", F.substring(_hash(F.lit("order"), F.col("copy").cast("string")), 1, 16))
    out = keyed.select(*docs.columns, "rate", "copy", "mix_key")
    return out.repartition(2 * partitions(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key")


def mixed(docs: DataFrame) -> DataFrame:
    """mix with the columns of docs only."""
    return through(docs, lambda inner: _mix(inner, None))


#: For rates up to _MOST_MEAN.
SQL = f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS rn, coalesce(source, '') AS s, coalesce(CAST(doc_id AS VARCHAR), 'null ' || coalesce(text, '')) AS key FROM documents),
sizes AS (SELECT s, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM d GROUP BY s),
weights AS (SELECT *, CASE WHEN size > 0 THEN pow(size, {TEMPER}) ELSE 0.0 END AS weight FROM sizes),
rates AS (SELECT s, CASE WHEN size = 0 THEN 1.0 ELSE weight / (SELECT sum(weight) FROM weights) * (SELECT sum(size) FROM weights) / size END AS rate FROM weights),
cdf AS (SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates UNION ALL SELECT s, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate)) + 40),
u AS (SELECT *, CAST('0x' || substr(md5('{SEED}|' || key || '|count|1'), 1, 13) AS BIGINT) / {_FULL!r} AS u FROM d),
counts AS (SELECT u.rn, u.doc_id, u.text, u.lang, u.source, u.n_chars, u.key, cdf.rate, count(*) AS n FROM u JOIN cdf ON u.s = cdf.s AND cdf.c <= u.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS rate, CAST(copy AS INTEGER) AS copy, substr(md5('{SEED}|' || key || '|order|' || copy), 1, 16) AS mix_key FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counts)"""
