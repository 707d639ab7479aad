"""Change rules between two revisions of a repository, and the chunks that follow from them.

A manifest of a revision has a row for each file: path, hash (of its content). Rules: the same revision changes nothing; a
revision that has no manifest any more means that everything is indexed anew; a file whose content is at a new path while the old path is
gone was renamed (the old one is deleted, the new one changed); a file whose content is at a new path while the old one stays
was copied, which is reported as a change of the path it was copied from, whose chunks are made anew, as a diff's name-status rows say it; other new or changed files are
changed; files that are gone are deleted. Files that didn't change keep their chunks and their locators of the old revision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def name_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """status (A, M, D, R or C), path and target (of R and C) between two manifests (path, hash).

    Of several paths with a content the smallest pairs first: the n-th gone path with the n-th new path of one hash. Files of one hash meet by counts
    within the hash, not pair by pair.
    """
    both = old.select("path", F.col("hash").alias("before")).join(new.select("path", F.col("hash").alias("after")), "path", "full_outer")
    changed = settled(both.where("before IS NULL OR after IS NULL OR before <> after"))
    place = lambda df, c: df.select(F.col(c).alias("hash"), "path").withColumn("n", F.expr("row_number() OVER (PARTITION BY hash ORDER BY path)"))
    gone, come = place(changed.where("after IS NULL"), "before"), place(changed.where("before IS NULL"), "after")
    renamed = settled(gone.join(come.withColumnRenamed("path", "target"), ["hash", "n"]).select("path", "target"))
    stays = old.join(new, ["path", "hash"], "left_semi").groupBy("hash").agg(F.min("path").alias("path"))
    fresh = changed.where("before IS NULL").join(renamed.select(F.col("target").alias("path")), "path", "left_anti").select(F.col("path").alias("target"), F.col("after").alias("hash"))
    copied = settled(fresh.join(stays, "hash").select("path", "target"))
    row = lambda df, status: df.select(F.lit(status).alias("status"), "path", F.lit(None).cast("string").alias("target"))
    return (
        renamed.select(F.lit("R").alias("status"), "path", "target")
        .unionByName(copied.select(F.lit("C").alias("status"), "path", "target"))
        .unionByName(row(changed.where("after IS NULL").join(renamed, "path", "left_anti"), "D"))
        .unionByName(row(fresh.join(copied, "target", "left_anti").select(F.col("target").alias("path")), "A"))
        .unionByName(row(changed.where("before IS NOT NULL AND after IS NOT NULL"), "M"))
    )


def changes(status: DataFrame) -> DataFrame:
    """path and change (changed or deleted) of name-status rows; each path once, changed before deleted."""
    pairs = F.when(F.col("status") == "R", F.array(F.struct(F.col("path").alias("path"), F.lit("deleted").alias("change")), F.struct(F.col("target").alias("path"), F.lit("changed").alias("change"))))
    single = F.array(F.struct(F.col("path").alias("path"), F.when(F.col("status") == "D", "deleted").otherwise("changed").alias("change")))
    return status.select(F.explode(F.coalesce(pairs, single)).alias("c")).groupBy("c.path").agg(F.min("c.change").alias("change"))


def revised(chunks: DataFrame, files: DataFrame, old: DataFrame | None, revision: str, previous: str | None, cut) -> tuple[DataFrame, str]:
    """The chunks (path, ...) of a new revision, and what was done: unchanged, updated or full.

    files: path, hash and text of the new revision; old: the previous revision's manifest, None if it is not known any more. cut: files ->
    chunks, with locators of the new revision. Only changed files are cut.
    """
    if previous == revision:
        return chunks, "unchanged"
    if previous is None or old is None:
        return cut(files), "full"
    moved = settled(changes(name_status(old, files.select("path", "hash"))))
    kept = chunks.join(moved, "path", "left_anti")
    return kept.unionByName(cut(files.join(moved.where("change = 'changed'"), "path", "left_semi"))), "updated"
