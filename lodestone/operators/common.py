"""What operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast, after counting them.
BROADCAST_ROWS = 200_000
#: Characters of asked terms, all together, up to which every task may know them.
KNOWN_CHARACTERS = 1 << 25


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df for a broadcast if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def known(asked: DataFrame) -> bool:
    """Whether so few terms (a row for each query and term), of so few characters, are asked for that every task may know them all."""
    rows, characters = asked.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and characters <= KNOWN_CHARACTERS


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files are fewer than these (a small table in one file); else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def rank(*by: str, order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def top(df: DataFrame, k: int, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered; Spark prunes each partition to k before the shuffle."""
    return df.withColumn(name, rank(*by, order=order)).where(F.col(name) <= k)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir), where tables are written that cut a plan.

    A session on one machine without that setting gets a temporary folder; a cluster must name one.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        base = context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="lodestone-")
        context.setCheckpointDir(base)
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its plan ends here, it is computed once, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    if not found.inputFiles():  # an empty table has a file too; read by a schema, a folder without files would look like one
        raise RuntimeError(f"{path} has no file of what was written there: spark.checkpoint.dir is not shared by the driver and all executors")
    return found
