"""Metrics in the Prometheus text format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{[^}]*\})?\s+([-+0-9.eE]+)$"


def parse(texts: DataFrame) -> DataFrame:
    """name and value, summed over label sets, of texts (column text)."""
    line = texts.select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(_LINE))
    return line.groupBy(F.regexp_extract("line", _LINE, 1).alias("name")).agg(F.sum(F.regexp_extract("line", _LINE, 2).try_cast("double")).alias("value"))


def pick(metrics: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """One row: for each output the first of its possible metrics that is there, else null."""
    value = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    return metrics.agg(*(F.coalesce(*map(value, options)).alias(out) for out, options in names.items()))
