"""Tables with versions: written aside, swapped in by one manifest, with conflicts detected.

A table is a folder of data folders and of manifests, one for each version. A manifest says which data folder holds each part,
the schema, and the table's properties. A commit writes its data to a new folder first and then creates the manifest of the next number, which
a file system lets only one writer do: the other one gets Conflict and may read again and retry (`change`). Readers take the newest manifest, so that
they see the old version or the new one, never a mixture; a writer that dies leaves a folder that no manifest names.

Rows are dealt to parts by a hash of a key (a source, say), so that a change rewrites only the parts it touches. A part has as many files
as the shuffle gives it: a key with very many rows is one part but not one task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARTS = 32
_NUMBER = "{:020d}.json"


class Conflict(Exception):
    """Another writer committed the version that this one wanted to."""


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    parts: dict[str, str]  # part -> its folder
    properties: dict = field(default_factory=dict)


class Files:
    """The few calls to the Hadoop file system of a path that Spark has no reader or writer for."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.at = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(path))] if self.fs.exists(self.at(path)) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Make a file with its whole text unless there is one: written under another name, then renamed, which does not overwrite."""
        aside = f"{path}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(aside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        claim = f"{path}.claim"  # exclusive creation is what decides: a rename may replace a file on a local disk
        try:
            self.fs.create(self.at(claim), False).close()
        except Py4JJavaError as problem:
            self.fs.delete(self.at(aside), False)
            if "FileAlreadyExists" in str(problem.java_exception) or "already exists" in str(problem.java_exception):
                return False
            raise
        return bool(self.fs.rename(self.at(aside), self.at(path)))

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


class Versions:
    """A versioned table in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, parts: int = PARTS):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts if key else 1
        self.files = Files(spark, path)

    def part(self) -> Column:
        """The part of a row, as text: of its key's hash."""
        if not self.key:
            return F.lit("0")
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.parts)).cast("string")

    def history(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The newest version, or a given one; None where there is none."""
        known = self.history()
        wanted = version if version is not None else known[-1] if known else None
        if wanted is None or wanted not in known:
            return None
        return Manifest(**json.loads(self.files.read(f"{self.path}/manifests/{_NUMBER.format(wanted)}")))

    def read(self, manifest: Manifest, parts: list[str] | None = None) -> DataFrame:
        """The rows of a version, or of some of its parts."""
        schema = StructType.fromJson(json.loads(manifest.schema))
        folders = sorted({f for p, f in manifest.parts.items() if parts is None or p in parts})
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, rows: DataFrame, base: Manifest | None, replaced: list[str] | None = None, properties: dict | None = None) -> Manifest:
        """The version after base: rows instead of the parts `replaced` (None: all). Conflict if that version exists by now.

        rows belong to replaced parts only. Properties of base stay unless given.
        """
        kept = {p: f for p, f in base.parts.items() if replaced is not None and p not in replaced} if base else {}
        known = StructType.fromJson(json.loads(base.schema)) if base else rows.schema
        types = lambda s: {f.name: f.dataType.simpleString() for f in s.fields}
        if types(rows.schema) == types(known):
            rows = rows.select(*known.names)
        elif kept:
            raise ValueError("a part can't have another schema than the table")
        schema = rows.schema.json()
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        rows.withColumn("_part", self.part()).write.partitionBy("_part").parquet(folder)
        new = {n.split("=", 1)[1]: f"{folder}/{n}" for n in self.files.names(folder) if n.startswith("_part=")}
        made = Manifest((base.version if base else 0) + 1, schema, {**kept, **new}, (base.properties if base else {}) | (properties or {}))
        if not self.files.create(f"{self.path}/manifests/{_NUMBER.format(made.version)}", json.dumps(made.__dict__)):
            self.files.delete(folder)
            raise Conflict(f"version {made.version} of {self.path} is another writer's")
        return made

    def change(self, step: Callable[[Manifest | None], tuple[DataFrame, list[str] | None] | None], attempts: int = 5, properties: dict | None = None) -> Manifest | None:
        """Commit step(newest manifest) -> (rows, replaced parts), again from the newest version after each conflict; None from step changes nothing."""
        for attempt in range(1, attempts + 1):
            base = self.manifest()
            made = step(base)
            if made is None:
                return base
            try:
                return self.commit(made[0], base, made[1], properties)
            except Conflict:
                if attempt == attempts:
                    raise
        return None

    def touched(self, keys: DataFrame) -> list[str]:
        """The parts that keys (a table with the key column) belong to: `parts` names at most."""
        return sorted(r[0] for r in keys.select(self.part().alias("p")).distinct().collect())

    def replace(self, rows: DataFrame) -> Manifest | None:
        """All rows of each key that rows has are replaced by these."""

        def step(base: Manifest | None) -> tuple[DataFrame, list[str] | None]:
            if base is None:
                return rows, None
            parts = self.touched(rows)
            others = self.read(base, parts).join(rows.select(self.key).distinct(), self.key, "left_anti")
            return others.unionByName(rows), parts

        return self.change(step)

    def upsert(self, rows: DataFrame, on: str) -> Manifest | None:
        """Rows replace those of equal `on` under the same key; others are added. Rows come once for each `on`."""

        def step(base: Manifest | None) -> tuple[DataFrame, list[str] | None]:
            if base is None:
                return rows, None
            parts = self.touched(rows)
            others = self.read(base, parts).join(rows.select(self.key, on), [self.key, on], "left_anti")
            return others.unionByName(rows), parts

        return self.change(step)

    def delete(self, gone: DataFrame, on: str) -> Manifest | None:
        """Rows whose `on` is in gone are deleted; only parts that have one are rewritten, none if there is none."""

        def step(base: Manifest | None) -> tuple[DataFrame, list[str] | None] | None:
            if base is None:
                return None
            wanted = gone.select(on).distinct()
            parts = self.touched(self.read(base).select(*{self.key, on}).join(wanted, on, "left_semi"))
            return (self.read(base, parts).join(wanted, on, "left_anti"), parts) if parts else None

        return self.change(step)

    def cleaned(self, keep: int = 2) -> list[str]:
        """Delete data folders that none of the newest `keep` versions names. Not while others write: theirs are named by none yet."""
        named = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for v in self.history()[-keep:] for f in self.manifest(v).parts.values()}
        gone = [n for n in self.files.names(self.path) if n.startswith("data-") and n not in named]
        for n in gone:
            self.files.delete(f"{self.path}/{n}")
        return gone
