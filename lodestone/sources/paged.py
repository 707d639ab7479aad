"""Sources that answer page by page, as a Spark data source: pages are dealt to tasks, each stops at the end.

A page is a list of rows (dictionaries); one with fewer rows than a page has is the last. Task i of P asks for pages i, i + P, ... until it meets a
short page, so that no task need know how many there are, and every page before the end is read once. Errors of a page end the read with their message.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a page, and issues of a repository.
PER_PAGE, MAX_ISSUES = 100, 1000


class _Pages(InputPartition):
    def __init__(self, first: int, step: int):
        self.first, self.step = first, step


def _source(name: str, schema: str, get: Callable[[int], list[dict]], per_page: int, tasks: int, first: int):
    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Pages(first + i, tasks) for i in range(tasks)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            page = partition.first
            while True:
                rows = get(page)
                for place, row in enumerate(rows):
                    yield page, place, json.dumps(row)
                if len(rows) < per_page:
                    return
                page += partition.step

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Pages


def pages(spark: SparkSession, get: Callable[[int], list[dict]], schema: str, per_page: int = PER_PAGE, tasks: int = 8, first: int = 1) -> DataFrame:
    """page, place and the fields of schema of every row from page `first` on. get: number of a page -> its rows; it runs in tasks.

    To resume, begin at the page after the last full one that was read (`resume_at`).
    """
    name = "paged_rows"
    spark.dataSource.register(_source(name, "page int, place int, row string", get, per_page, tasks, first))
    rows = spark.read.format(name).load()
    return rows.select("page", "place", F.from_json("row", schema).alias("r")).select("page", "place", "r.*")


def resume_at(read: DataFrame, per_page: int = PER_PAGE) -> int:
    """The first page that must be asked for again: the last one that was read if it was short, else the one after it; 1 of nothing."""
    last = read.groupBy("page").agg(F.count("*").alias("n")).orderBy(F.desc("page")).first()
    return 1 if last is None else last["page"] if last["n"] < per_page else last["page"] + 1


def issues(rows: DataFrame, most: int = MAX_ISSUES) -> DataFrame:
    """The first `most` issues in order of the pages; pull requests are no issues and don't count."""
    return rows.where("pull_request IS NULL").orderBy("page", "place").limit(most)


def upserted(known: DataFrame, found: DataFrame, new_id: Column, key: str = "url", value: str = "content") -> DataFrame:
    """Get or create: each found key with its chunk_id, the known one if there is one, else new_id; and whether it is new, changed or known.

    known: key, chunk_id, value; found: key, value. The first of equal keys by value counts, so a key has one row.
    """
    once = found.groupBy(key).agg(F.min(value).alias(value))
    both = once.join(known.select(key, F.col("chunk_id").alias("_id"), F.col(value).alias("_old")), key, "left")
    status = F.when(F.col("_id").isNull(), "new").when(F.col("_old").eqNullSafe(F.col(value)), "known").otherwise("changed")
    return both.select(key, F.coalesce("_id", new_id).alias("chunk_id"), value, status.alias("status"))


def folder_of_pages(path: str) -> Callable[[int], list[dict]]:
    """get for pages that lie as JSON files page=N/*.json in a folder, one row a line; what has no file is empty."""

    def get(page: int) -> list[dict]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        rows = []
        for f in sorted(files.get_file_info(fs.FileSelector(f"{root}/page={page}", allow_not_found=True)), key=lambda f: f.path):
            if f.path.endswith(".json"):
                with files.open_input_stream(f.path) as stream:
                    rows += [json.loads(line) for line in stream.read().decode().splitlines()]
        return sorted(rows, key=lambda r: r["number"])

    return get
