"""Flat token files: per shard one file of unsigned ids, and beside it 64-bit offsets and document ids.

`shard-00007.bin`: the ids of its documents, one after the other, unsigned 16- or 32-bit
little-endian integers (16 where the vocabulary allows).
`shard-00007.off`: the magic `LODETOK2`, the width of an id in bytes, then n + 1 offsets in ids, all as 64-bit unsigned integers.
`shard-00007.doc`: for each document its id (64 bits, signed) and one byte, 0 where the id is null.

All three can be mapped into memory, and are written and read as streams. Shards are ranges of doc_id in ascending order (null
first; rows of one id by `shared.tie`, then text), of some SHARD_CHARACTERS characters at most; an id that very many rows have is split by tie. A document's
place among all ids is its shard's base plus its offset; bases are prefix sums of the shards' totals. A task writes under names of
its own and renames at the end, so a task run twice leaves the same files.

Null texts are empty: such a document has its end id only. Repeated rows are separate documents. A text is encoded whole, so memory
follows the longest one. An empty table makes an empty manifest and no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import encoder, tokenizer_path
from .shared import file_system, partitions, portions, prefix_sums, shared_dir, tie, written

_MAGIC = b"LODETOK2"
_HEADER = 16
_DOCUMENT = np.dtype([("id", "<i8"), ("known", "u1")])
#: Characters that a shard is meant to have at most.
SHARD_CHARACTERS = 1 << 30
#: Documents, and ids, that a reader holds at once (or one document).
READ_DOCUMENTS, READ_IDS = 50_000, 1_000_000


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) into token files under path; return the manifest: shard, documents, tokens, base.

    The manifest has a row for each shard that has documents. shards: by the characters of docs unless given.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count = shards or max(2 * partitions(spark), -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARACTERS))
    fs, folder = file_system(path)
    fs.create_dir(folder, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        fs, folder = file_system(path)
        tag, files, documents, tokens = uuid.uuid4().hex, {}, 0, 0
        width, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
        for batch in portions(batches):
            if not files:
                files = {kind: fs.open_output_stream(f"{folder}/shard-{shard:05d}.{kind}.{tag}") for kind in ("bin", "off", "doc")}
                files["off"].write(_MAGIC + np.array([width, 0], "<u8").tobytes())  # the first offset is 0
            ids = [raw + end for raw in enc.raw([x or "" for x in batch.column(1).to_pylist()])]
            for raw in ids:
                files["bin"].write(raw)
            ends = tokens + np.cumsum([len(raw) // width for raw in ids])
            files["off"].write(ends.astype("<u8").tobytes())
            names = np.zeros(len(ids), _DOCUMENT)
            names["id"] = batch.column(0).fill_null(0).to_numpy()
            names["known"] = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            files["doc"].write(names.tobytes())
            documents, tokens = documents + len(ids), int(ends[-1])
        for kind, file in files.items():
            file.close()
            fs.move(f"{folder}/shard-{shard:05d}.{kind}.{tag}", f"{folder}/shard-{shard:05d}.{kind}")
        if files:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "documents": [documents], "tokens": [tokens]})

    tied = rows.withColumn("tie", tie())
    ordered = tied.repartitionByRange(count, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    manifest = written(ordered.mapInArrow(write, "shard int, documents long, tokens long"), "token-manifest")
    return prefix_sums(manifest, [], "shard", "tokens", "base")


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit) of every document in the files."""

    def pieces(open_file, documents: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Document records, offsets and ids of runs of documents."""
        with open_file("off") as off, open_file("doc") as doc, open_file("bin") as ids:
            head = off.read_at(_HEADER, 0)
            if head[: len(_MAGIC)] != _MAGIC:
                raise ValueError(f"{path} has a file that is no token index")
            width = int(np.frombuffer(head, "<u8", 1, len(_MAGIC))[0])
            for first in range(0, documents, READ_DOCUMENTS):
                n = min(READ_DOCUMENTS, documents - first)
                offsets = np.frombuffer(off.read_at(8 * (n + 1), _HEADER + 8 * first), "<u8").astype(np.int64)
                names = np.frombuffer(doc.read_at(_DOCUMENT.itemsize * n, _DOCUMENT.itemsize * first), _DOCUMENT)
                at = 0
                while at < n:
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ_IDS, "right")) - 1)
                    raw = ids.read_at(int(offsets[to] - offsets[at]) * width, int(offsets[at]) * width)
                    yield names[at:to], offsets[at : to + 1], np.frombuffer(raw, f"<u{width}")
                    at = to

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, folder = file_system(path)
        local = isinstance(fs, pafs.LocalFileSystem)
        for batch in portions(batches):
            for shard, documents, base in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                name = f"{folder}/shard-{shard:05d}"
                open_file = lambda kind, name=name: pa.memory_map(f"{name}.{kind}") if local else fs.open_input_file(f"{name}.{kind}")
                for names, offsets, ids in pieces(open_file, documents):
                    raw, cuts = ids.astype("<u4").tobytes(), (4 * (offsets - offsets[0])).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.ascontiguousarray(names["id"]), mask=names["known"] == 0),
                            pa.array(offsets[:-1] + base),
                            pa.array(np.diff(offsets)),
                            pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    dealt = manifest.select("shard", "documents", "base").repartition(max(1, manifest.count()))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write docs to token files in the shared folder and read them back."""
    path = shared_dir(docs.sparkSession, "token-files")
    return read_token_files(docs.sparkSession, path, write_token_files(docs, path))
