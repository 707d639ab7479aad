"""Report sinks and synthetic inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(report: DataFrame, path: str) -> None:
    """A report as JSON and as CSV with a header; existing ones are not overwritten."""
    report.write.mode("errorifexists").json(f"{path}/json")
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in report.schema.fields]
    report.select(*flat).write.mode("errorifexists").option("header", "true").csv(f"{path}/csv")


def markdown(report: DataFrame) -> DataFrame:
    """Rows of a report as lines of a markdown table, headed by number -1 and -2."""
    names = report.columns
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names)), F.lit(" |"))
    head = report.sparkSession.createDataFrame([(-2, "| " + " | ".join(names) + " |"), (-1, "|" + "-|" * len(names))], "n long, line string")
    return head.unionByName(report.select(F.monotonically_increasing_id().alias("n"), line.alias("line")))


def synthetic_files(spark: SparkSession, n: int) -> DataFrame:
    """path and text of n source files with two symbols each."""
    number = F.format_string("%04d", "id")
    text = F.concat(F.lit("class Worker"), number, F.lit(":\n    def run(self):\n        return "), "id", F.lit("\n\ndef health"), number, F.lit("():\n    return True\n"))
    return spark.range(n).select(F.concat(F.lit("src/module_"), number, F.lit(".py")).alias("path"), text.alias("text"))


def synthetic_issues(spark: SparkSession, n: int) -> DataFrame:
    """number, title, body and html_url of n issues."""
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("number"), F.concat(F.lit("Issue "), "id").alias("title"), F.concat(F.lit("Worker "), "id", F.lit(" times out under load.")).alias("body"), F.concat(F.lit("https://example.org/issues/"), "id").alias("html_url"))
