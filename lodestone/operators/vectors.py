"""The vector table: a versioned table keyed by chunk, in parts by source, made by one encoder.

The manifest's properties name the encoder (its fingerprint: backend, model, dimensions, chunk size and overlap). A table of another
fingerprint is no table: it is made anew. Changes rewrite only the parts that they touch and are committed as a whole; concurrent ones retry (operators.versions).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Manifest, Versions


class VectorTable:
    """chunk_id, source_id, vector. encode: chunks (chunk_id, source_id, content, ...) -> chunk_id, source_id, vector."""

    def __init__(self, spark: SparkSession, path: str, fingerprint: dict, encode: Callable[[DataFrame], DataFrame], parts: int = 32):
        self.fingerprint, self.encode = {"encoder": fingerprint}, encode
        self.versions = Versions(spark, path, "source_id", parts)

    def manifest(self) -> Manifest | None:
        """The newest version if this table's encoder made it."""
        newest = self.versions.manifest()
        return newest if newest and {"encoder": newest.properties.get("encoder")} == self.fingerprint else None

    def read(self) -> DataFrame:
        manifest = self.manifest()
        if manifest is None:
            raise LookupError("there is no vector table of this encoder")
        return self.versions.read(manifest)

    def rebuild(self, chunks: DataFrame) -> Manifest:
        return self.versions.change(lambda base: (self._rows(chunks), None), properties=self.fingerprint)

    def _rows(self, chunks: DataFrame) -> DataFrame:
        return self.encode(chunks).select("chunk_id", "source_id", "vector")

    def _current(self) -> None:
        if self.versions.manifest() is not None:
            self.read()

    def upsert(self, chunks: DataFrame) -> Manifest:
        """Chunks' vectors replace those of the same chunk; a chunk whose source changed loses its old row."""
        if self.manifest() is None:
            return self.rebuild(chunks)

        def step(base: Manifest) -> tuple[DataFrame, list[str]]:
            rows = self._rows(chunks)
            ids = rows.select("chunk_id").distinct()
            held = self.versions.read(base).select("chunk_id", "source_id").join(ids, "chunk_id", "left_semi")
            parts = sorted({*self.versions.touched(chunks), *self.versions.touched(held)})
            return self.versions.read(base, parts).join(ids, "chunk_id", "left_anti").unionByName(rows), parts

        return self.versions.change(step)

    def delete_chunks(self, ids: DataFrame) -> Manifest | None:
        self._current()
        return self.versions.delete(ids, "chunk_id")

    def delete_source(self, sources: DataFrame) -> Manifest | None:
        self._current()
        return self.versions.delete(sources, "source_id")

    def replace_source(self, chunks: DataFrame) -> Manifest | None:
        """All vectors of the sources that chunks have are replaced."""
        if self.manifest() is None:
            return self.rebuild(chunks)
        return self.versions.replace(self._rows(chunks))

    def diverging(self, chunks: DataFrame) -> DataFrame:
        """source_id, vectors and chunks of the sources whose numbers of vectors and active chunks differ."""
        wanted = chunks.groupBy("source_id").agg(F.count("*").alias("chunks"))
        manifest = self.manifest()
        held = self.versions.read(manifest) if manifest else self.encode(chunks.limit(0))
        both = held.groupBy("source_id").agg(F.count("*").alias("vectors")).join(wanted, "source_id", "full_outer")
        zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("vectors", "chunks")]
        return both.select("source_id", *zero).where("vectors <> chunks")

    def synchronize(self, chunks: DataFrame) -> Manifest | None:
        """Vectors of exactly the active chunks: all made anew without a table of this encoder, else those of the sources that diverge; nothing if none does."""
        if self.manifest() is None:
            return self.rebuild(chunks)

        def step(base: Manifest) -> tuple[DataFrame, list[str]] | None:
            sources = self.diverging(chunks).select("source_id")
            parts = self.versions.touched(sources)
            if not parts:
                return None
            others = self.versions.read(base, parts).join(sources, "source_id", "left_anti")
            return others.unionByName(self._rows(chunks.join(sources, "source_id", "left_semi"))), parts

        return self.versions.change(step)
