"""Files, repositories and issue exports as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.python import python_symbols
from ..operators import chunking as C

#: Bytes of a file and files of a repository that are read.
MAX_BYTES, MAX_FILES = 25 * 1024 * 1024, 2000


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path (below root), text and file_hash of the admitted files below a directory; invalid bytes become replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/") + "/")
    path = F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/")
    below = F.when(F.startswith(path, base), F.substring(path, len(root.rstrip("/")) + 2, 1 << 20)).otherwise(path)
    kept = raw.withColumn("path", below).where(C.admitted(F.col("path")) & (F.col("length") <= max_bytes))
    return kept.select("path", F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8").alias("text"), F.sha2("content", 256).alias("file_hash"))


def enumerated(files: DataFrame, max_bytes: int = MAX_BYTES, most: int = MAX_FILES, strict: bool = False) -> DataFrame:
    """Admitted files (path, length and others) in order of their paths, the first `most`, with place; strict: an error if there are more.

    The order is a top-k: each task keeps `most` paths.
    """
    kept = files.where(C.admitted(F.col("path")) & (F.col("length") <= max_bytes))
    if strict and kept.limit(most + 1).count() > most:
        raise ValueError(f"the repository exceeds {most} indexable files")
    first = kept.orderBy("path").limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy("path")).cast("long") - 1)  # `most` rows


def routed(files: DataFrame) -> DataFrame:
    """Chunks of files (path, text): markdown by section, Python by its syntax tree, other code by declaration, other texts by lines. Long parts are cut into windows.

    path, start_line, end_line, heading, block_type, content, locator. A file's parts are made in its own row; what has no symbols as
    Python (broken sources) is read by declaration, and what has no parts at all by lines.
    """
    suffix = C.suffix(F.col("path"))
    is_code = suffix.isin(*(s for s in C.TEXT_SUFFIXES if s not in C.PROSE_SUFFIXES))
    l = F.col("_lines")
    part = lambda x, kind, heading: F.struct(x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), heading.alias("heading"), kind.alias("block_type"), x["content"].alias("content"))
    by_section = F.transform(C.section_parts(l), lambda x: part(x, F.lit("section"), x["heading"]))
    by_line = F.transform(C.declaration_parts(l), lambda x: part(x, F.lit("symbol"), x["name"]))
    symbol = lambda x: F.struct(x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), x["name"].alias("heading"), x["kind"].alias("block_type"), F.array_join(F.slice(l, x["start_line"], x["end_line"] - x["start_line"] + 1), "\n").alias("content"))
    parsed = python_symbols(F.when(suffix.isin(".py", ".pyi"), F.col("text")).otherwise(""))
    read = files.withColumn("_lines", C.lines(F.coalesce("text", F.lit("")))).withColumn("_symbols", parsed)
    none = F.array().cast("array<struct<start_line:int,end_line:int,heading:string,block_type:string,content:string>>")
    parts = F.when(suffix.isin(".md", ".markdown", ".rst"), by_section).when(F.size("_symbols") > 0, F.transform("_symbols", symbol)).when(is_code, by_line).otherwise(none)
    whole = F.struct(F.lit(1).alias("start_line"), F.size(l).alias("end_line"), F.lit(None).cast("string").alias("heading"), F.when(is_code, "code").otherwise("text").alias("block_type"), F.coalesce("text", F.lit("")).alias("content"))
    made = read.withColumn("_parts", parts)
    each = made.select("path", (F.size("_parts") == 0).alias("_whole"), F.inline(F.when(F.size("_parts") > 0, F.col("_parts")).otherwise(F.array(whole))))
    long = F.col("_whole") | (F.length("content") > 2 * C.SIZE)
    columns = ["path", "start_line", "end_line", "heading", "block_type", "content", "locator"]
    cut = C.windows(each.where(long).select("path", "heading", "block_type", F.col("start_line").alias("_first"), F.col("content").alias("text")), first_line=F.col("_first"))
    fits = each.where(~long).withColumn("locator", C.line_locator(F.col("path"), F.col("start_line"), F.col("end_line")))
    return fits.select(*columns).unionByName(cut.select(*columns))


def issues(raw: DataFrame) -> DataFrame:
    """number, title, content and locator of exported issues; pull requests are no issues."""
    kept = raw.where("pull_request IS NULL") if "pull_request" in raw.columns else raw
    content = F.concat_ws("\n\n", "title", F.coalesce("body", F.lit("")))
    return kept.select(F.col("number").cast("int").alias("number"), "title", content.alias("content"), F.concat(F.lit("issue-"), "number", F.lit(" "), "html_url").alias("locator"))


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON file (an array of objects)."""
    return spark.read.option("multiLine", "true").schema("id string, question string, reference_answer string, required_evidence array<string>, expected_sources array<string>, expected_tools array<string>, category string, answerable boolean").json(path)
