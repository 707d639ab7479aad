"""Helpers every operator of this subpackage uses: shared storage, tables written to cut lineage, joins and sums that stand uneven keys, row iteration."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Arrow rows a Python worker works on at once; bounds its memory when texts are long.
ARROW_ROWS = 1000

#: Rows up to which a small side is broadcast; above it the join shuffles.
BROADCAST_ROWS = 20_000

#: Ids up to which a set of documents is broadcast.
FLAGGED_ROWS = 100_000

#: Rows of a block in two-level prefix sums.
BLOCK = 1024


#: The columns of documents that operators read; all others pass through them unseen.
ROLES = ("doc_id", "text", "lang", "source")


def through(docs: DataFrame, operator, added: tuple[str, ...] = ()) -> DataFrame:
    """operator applied to docs, whatever docs' columns are called: the columns of docs, then those that operator adds.

    operator sees ROLES by their names and every other column under a name by its place that no operator uses; it may add columns
    and drop or repeat rows. Columns of docs named like an added one, in any case, are replaced.
    """
    taken = {a.lower() for a in added}
    names = [c for c in docs.columns if c.lower() not in taken]
    docs = docs.select(*(docs[f"`{c.replace('`', '``')}`"] for c in names))
    exact = set(names) & set(ROLES)
    role = lambda c: c if c in exact else next((r for r in ROLES if r == c.lower() and r not in exact), None)
    inside = [role(c) or f"own_{i}" for i, c in enumerate(names)]
    return operator(docs.toDF(*inside)).select(*inside, *added).toDF(*names, *added)


def portions(batches: Iterable[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of so many rows at most; empty ones are left out. Spark bounds the bytes of a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def groups(texts: list, rows: int = 200, size: int = 1 << 20) -> Iterator[list]:
    """Texts, or byte strings, in lists of so many at most, and of that length in all but for the last of a list."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if len(group) >= rows or held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir).

    Only where that setting is absent in a session on one machine (a test) a local folder is made; a cluster must name one.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df hinted for broadcast if a count proves it has at most that many rows; else unchanged, for a shuffled join.

    df should already be written, so that counting is cheap.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def uneven_join(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right (written, one row for each key) on columns that both have, however uneven their values.

    right's column weight (dropped) says how many rows of left have the key; total is their sum. Up to BROADCAST_ROWS keys
    right is broadcast. Beyond, keys with more than a BROADCAST_ROWS-th of all rows, which are fewer than that, are broadcast,
    and only the others shuffle. how: inner or left (then keys must not be null).
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(weight)), key, how)
    common = F.col(weight) > total / BROADCAST_ROWS
    keys = [key] if isinstance(key, str) else key
    often, seldom = F.broadcast(right.where(common).drop(weight)), right.where(~common).drop(weight)
    rest = left.join(F.broadcast(right.where(common).select(*keys)), key, "left_anti")
    return left.join(often, key).unionByName(rest.join(seldom, key, how))


def flagged(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """docs plus a boolean column: whether ids (doc_id) has the row's doc_id; a null id is in no table.

    Up to FLAGGED_ROWS different ids these are broadcast; beyond, both sides shuffle by id, without the rows of null id.
    """
    wanted = written(ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "flagged-ids").withColumn(name, F.lit(True))
    flag = F.coalesce(name, F.lit(False)).alias(name)
    docs = docs.drop(name)
    if wanted.limit(FLAGGED_ROWS + 1).count() <= FLAGGED_ROWS:
        return docs.join(F.broadcast(wanted), "doc_id", "left").select(*docs.columns, flag)
    known = docs.where("doc_id IS NOT NULL").join(wanted, "doc_id", "left").select(*docs.columns, flag)
    return known.unionByName(docs.where("doc_id IS NULL").withColumn(name, F.lit(False)))


def prefix_sums(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """df plus the sum of value over the rows before (by order, whole numbers from 0, each once for each by).

    In two levels: blocks of BLOCK places are summed up, and only their sums run through one window.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    bases = blocks.select(*by, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    summed = blocked.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0))).join(bases, [*by, "_block"])
    return summed.withColumn(name, F.col("_base") + F.col("_own")).drop("_block", "_base", "_own")


def tie() -> Column:
    """What orders rows of one id: a hash of the text, 20 bits, so that a common id can be split into ranges."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(1 << 20))


def drawn(key: Column, label: Column, counts: dict, each: int) -> Column:
    """Whether a row is among some three times `each` of its label, by a hashed key. counts: rows of each label.

    Keeps what a sample is chosen from small before any shuffle, however many partitions there are.
    """
    share = [x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, (3 * each + 50) / max(1, n)) * (1 << 30))))]
    return F.pmod(key, F.lit(1 << 30)) < F.create_map(*share)[label] if share else F.lit(False)


def sampled(rows: DataFrame, counts: dict, each: int, size: int) -> list[tuple]:
    """(text, label) of at most `each` rows of each label of rows (doc_id, text, label), of `size` characters in all.

    The sample for a model that the driver fits; counts: how many rows a label has; others are left out. Rows are taken by a hash of
    all three columns; one whose text does not fit any more is passed over; equal rows count once.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_h", F.xxhash64("doc_id", "text", F.col("label").cast("string"))).where(drawn(F.col("_h"), F.col("label"), counts, each))
    place = F.row_number().over(Window.partitionBy("label").orderBy("_h"))
    first = keyed.select("label", "_h", F.length("text").alias("n")).distinct().withColumn("r", place).where(F.col("r") <= each)
    chosen, left = set(), size
    for r in sorted(first.collect(), key=lambda r: (r["r"], str(r["label"]))):
        if r["n"] <= left:
            chosen.add(r["_h"])
            left -= r["n"]
    if not chosen:
        return []
    wanted = F.broadcast(spark.createDataFrame([(h,) for h in sorted(chosen)], "_h long"))
    found = keyed.join(wanted, "_h", "left_semi").dropDuplicates(["_h"]).select("_h", "text", "label").collect()
    return [(r["text"], r["label"]) for r in sorted(found)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_system(path: str):
    """The pyarrow file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A column's strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """batch plus new columns; a column of the same name is replaced."""
    keep = [n for n in batch.schema.names if n not in new]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in keep), *new.values()], names=[*keep, *new])


def map_adding(df: DataFrame, added: dict[str, str], function) -> DataFrame:
    """df with columns computed batch by batch in Python.

    added: name -> SQL type of each new column; function: batch -> dict of Arrow arrays by these names.
    Columns of df with such a name are dropped first.
    """
    df = df.drop(*added)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{n}` {t}" for n, t in added.items())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield with_columns(batch, function(batch))

    return df.mapInArrow(run, schema)
