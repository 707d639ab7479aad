"""Queries that write, change and reread tables: versions, vectors, revisions, pages, sequenced logs, cells."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cells, revisions
from ..operators import retrieval as R
from ..operators.common import settled, shared_folder
from ..operators.vectors import VectorTable
from ..operators.versions import Versions
from ..sources import paged
from ..streaming import trace
from .common import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("""WITH a AS (SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 10 <> 0),
b AS (SELECT * FROM a WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id + 1000000, source, 0 FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 3 = 0),
u AS (SELECT doc_id, source, n_chars * 2 AS n_chars FROM documents WHERE doc_id % 4 = 0 AND source NOT IN ('src1', 'src2')),
c AS (SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM u) UNION ALL SELECT * FROM u)
SELECT doc_id, source, n_chars FROM c WHERE doc_id % 11 <> 5""")
def versioned_table(spark, sf):
    """A table of documents by source that is written, has sources replaced, rows upserted and rows deleted, each a version; the last one reread."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    t = Versions(spark, _folder(spark, "versions"), "source")
    t.commit(d.where("doc_id % 10 <> 0"), None)
    t.replace(d.where("source IN ('src1', 'src2') AND doc_id % 3 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), "source", F.lit(0).cast("long").alias("n_chars")))
    t.upsert(d.where("doc_id % 4 = 0 AND source NOT IN ('src1', 'src2')").withColumn("n_chars", F.col("n_chars") * 2), "doc_id")
    t.delete(t.read(t.manifest()).where("doc_id % 11 = 5").select("doc_id"), "doc_id")
    return t.read(t.manifest())


def _stored(spark, sf):
    """Stored vectors stand for what an encoder makes of chunks; a label is a source."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("source_id"), F.col("embedding").alias("vector"))


def _doubled(rows):
    return rows.withColumn("vector", F.transform("vector", lambda x: x * 2))


_ENCODER = {"embedding_backend": "stored", "embedding_model": "none", "embedding_dimensions": 64, "chunk_size": 1200, "chunk_overlap": 120}


@query("""WITH e AS (SELECT vec_id AS chunk_id, CAST(label AS VARCHAR) AS source_id, embedding[1] AS first FROM embeddings),
u AS (SELECT chunk_id, source_id, CASE WHEN chunk_id % 10 = 7 THEN first * 2 ELSE first END AS first FROM e WHERE chunk_id % 50 <> 7 OR chunk_id % 10 = 7),
d AS (SELECT * FROM u WHERE chunk_id % 11 <> 5 AND source_id <> '2'),
r AS (SELECT * FROM d WHERE source_id <> '4' UNION ALL SELECT chunk_id, source_id, first FROM e WHERE source_id = '4' AND chunk_id % 2 = 0)
SELECT chunk_id, source_id, round(CAST(first AS DOUBLE), 6) AS first FROM r""")
def vector_table(spark, sf):
    """Vectors built, upserted, deleted by chunk and by source, and one source replaced; then reread."""
    rows = _stored(spark, sf)
    t = VectorTable(spark, _folder(spark, "vectors"), _ENCODER, lambda c: c)
    t.rebuild(rows.where("chunk_id % 50 <> 7"))
    t.upsert(_doubled(rows.where("chunk_id % 10 = 7")))
    t.delete_chunks(rows.where("chunk_id % 11 = 5").select("chunk_id"))
    t.delete_source(spark.createDataFrame([("2",)], "source_id string"))
    t.replace_source(rows.where("source_id = '4' AND chunk_id % 2 = 0"))
    return t.read().select("chunk_id", "source_id", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query("""WITH e AS (SELECT vec_id AS chunk_id, CAST(label AS VARCHAR) AS source_id, embedding[1] AS first FROM embeddings),
v AS (SELECT source_id, count(*) FILTER (chunk_id % 50 <> 7 OR CAST(source_id AS INTEGER) % 3 <> 0) AS vectors, count(*) AS chunks FROM e GROUP BY source_id)
SELECT chunk_id, source_id, round(CAST(CASE WHEN vectors <> chunks THEN first ELSE first * 2 END AS DOUBLE), 6) AS first, 1 AS rebuilt FROM e JOIN v USING (source_id)""")
def vector_table_sync(spark, sf):
    """Sources that lack vectors are made anew, the others keep theirs; a table of another encoder's fingerprint is made anew as a whole."""
    rows = _stored(spark, sf)
    path = _folder(spark, "vectors")
    VectorTable(spark, path, {**_ENCODER, "embedding_model": "older"}, lambda c: c).rebuild(rows.limit(0))
    t = VectorTable(spark, path, _ENCODER, lambda c: c)
    rebuilt = int(t.manifest() is None)
    t.synchronize(_doubled(rows.where("chunk_id % 50 <> 7 OR CAST(source_id AS INT) % 3 <> 0")))
    t.synchronize(rows)
    return t.read().select("chunk_id", "source_id", F.round(F.col("vector")[0].cast("double"), 6).alias("first"), F.lit(rebuilt).alias("rebuilt"))


def _manifests(spark, sf):
    """Two revisions: documents renamed, copied, changed, deleted and added; equal texts make several paths of one content."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    path = lambda folder: F.concat(F.lit(f"{folder}/"), "doc_id", F.lit(".md")).alias("path")
    old = d.where("doc_id % 13 <> 0").select(path("src"), F.sha2("text", 256).alias("hash"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    stay = d.where("doc_id % 11 <> 0").select(F.when((F.col("doc_id") % 10 == 1), path("lib")).otherwise(path("src")).alias("path"), text.alias("text"))
    new = stay.unionByName(d.where("doc_id % 10 = 2").select(path("copy"), "text")).select("path", F.sha2("text", 256).alias("hash"), "text")
    return settled(old), settled(new)


_REVISIONS = """o AS (SELECT 'src/' || doc_id || '.md' AS path, sha256(text) AS hash FROM documents WHERE doc_id % 13 <> 0),
n AS (SELECT CASE WHEN doc_id % 10 = 1 THEN 'lib/' ELSE 'src/' END || doc_id || '.md' AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT 'copy/' || doc_id || '.md', sha256(text) FROM documents WHERE doc_id % 10 = 2),
gone AS (SELECT path, hash, row_number() OVER (PARTITION BY hash ORDER BY path) AS i FROM o WHERE path NOT IN (SELECT path FROM n)),
come AS (SELECT path, hash, row_number() OVER (PARTITION BY hash ORDER BY path) AS i FROM n WHERE path NOT IN (SELECT path FROM o)),
ren AS (SELECT gone.path, come.path AS target FROM gone JOIN come USING (hash, i)),
same AS (SELECT hash, min(path) AS path FROM o SEMI JOIN n USING (path, hash) GROUP BY hash),
cop AS (SELECT same.path, come.path AS target FROM come JOIN same USING (hash) WHERE come.path NOT IN (SELECT target FROM ren)),
st AS (SELECT 'R' AS status, path, target FROM ren UNION ALL SELECT 'C', path, target FROM cop UNION ALL SELECT 'D', path, NULL FROM gone WHERE path NOT IN (SELECT path FROM ren)
  UNION ALL SELECT 'A', path, NULL FROM come WHERE path NOT IN (SELECT target FROM ren) AND path NOT IN (SELECT target FROM cop) UNION ALL SELECT 'M', path, NULL FROM o JOIN n USING (path) WHERE o.hash <> n.hash)"""


@query(f"WITH {_REVISIONS} SELECT status, path, target FROM st")
def revision_name_status(spark, sf):
    """What a diff's name-status says of two revisions: renames and copies by content."""
    old, new = _manifests(spark, sf)
    return revisions.name_status(old, new.select("path", "hash"))


@query(f"""WITH {_REVISIONS}, ch AS (SELECT path, min(change) AS change FROM (SELECT path, CASE WHEN status IN ('R', 'D') THEN 'deleted' ELSE 'changed' END AS change FROM st UNION ALL SELECT target, 'changed' FROM st WHERE status = 'R') GROUP BY path),
kept AS (SELECT path, 'repo@old/' || path AS locator FROM o WHERE path NOT IN (SELECT path FROM ch) UNION ALL SELECT path, 'repo@new/' || path FROM n WHERE path IN (SELECT path FROM ch WHERE change = 'changed'))
SELECT step, path, locator FROM (SELECT 'updated' AS step, path, locator FROM kept UNION ALL SELECT 'unchanged', path, 'repo@old/' || path FROM o UNION ALL SELECT 'full', path, 'repo@new/' || path FROM n)""")
def revision_chunks(spark, sf):
    """Chunks after a new revision (files that didn't change keep their old locators), after the same one, and after one whose predecessor is lost."""
    old, new = _manifests(spark, sf)
    before = old.select("path", F.concat(F.lit("repo@old/"), "path").alias("locator"))
    cut = lambda files: files.select("path", F.concat(F.lit("repo@new/"), "path").alias("locator"))
    made = [revisions.revised(before, new, known, "new", previous, cut) for known, previous in ((old, "old"), (old, "new"), (None, "lost"))]
    out = [rows.select(F.lit(step).alias("step"), "path", "locator") for rows, step in made]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS number, text, conv_id FROM conversations), i AS (SELECT * FROM r WHERE number % 9 <> 0 ORDER BY number LIMIT 1000)
SELECT CAST(number AS INTEGER) AS number, 'Turn ' || number || chr(10) || chr(10) || text AS content, 'issue-' || number || ' https://example.org/issues/' || number AS locator FROM i""")
def paged_issues(spark, sf):
    """Turns of conversations as a tracker's issues, every ninth a pull request, read page by page: the first thousand issues."""
    from ..sources import files

    # numbered in order of conversation and turn: places in a range, and the sizes of the ranges before it
    ordered = settled(table(spark, sf, "conversations").repartitionByRange(8, "conv_id", "turn").sortWithinPartitions("conv_id", "turn").select("text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")))
    sizes = ordered.groupBy("part").count().withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.col("base") + F.col("place") + 1
    rows = ordered.join(F.broadcast(sizes.select("part", "base")), "part").select(number.alias("number"), F.concat(F.lit("Turn "), number).alias("title"), F.col("text").alias("body"), F.concat(F.lit("https://example.org/issues/"), number).alias("html_url"), F.when(number % 9 == 0, F.lit("{}")).alias("pull_request"))
    path = _folder(spark, "pages")
    rows.withColumn("page", F.floor((F.col("number") - 1) / paged.PER_PAGE) + 1).repartition("page").write.partitionBy("page").json(path)
    read = paged.pages(spark, paged.folder_of_pages(path), "number long, title string, body string, html_url string, pull_request string")
    return files.issues(paged.issues(read)).select("number", "content", "locator")


@query("""WITH r AS (SELECT url, html AS content FROM pages WHERE page_id % 4 <> 0), f AS (SELECT url, min(content) AS content FROM r GROUP BY url),
k AS (SELECT url, min(page_id) AS chunk_id, min(CASE WHEN page_id % 3 = 0 THEN html || '!' ELSE html END) AS content FROM pages WHERE page_id % 5 <> 0 GROUP BY url)
SELECT f.url, coalesce(k.chunk_id, 1000000 + length(f.url)) AS chunk_id, CASE WHEN k.chunk_id IS NULL THEN 'new' WHEN k.content = f.content THEN 'known' ELSE 'changed' END AS status FROM f LEFT JOIN k USING (url)""")
def web_results_registered(spark, sf):
    """Results of a search provider get the chunk of their address, or a new one."""
    p = table(spark, sf, "pages")
    known = p.where("page_id % 5 <> 0").groupBy("url").agg(F.min("page_id").alias("chunk_id"), F.min(F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))).alias("content"))
    found = p.where("page_id % 4 <> 0").select("url", F.col("html").alias("content"))
    return paged.upserted(known, found, (1000000 + F.length("url")).cast("long")).select("url", "chunk_id", "status")


def _log(spark, sf):
    """Events of users as runs' traces, written in two goes; the second one restarts from the first one's state."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    base = _folder(spark, "trace")
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{base}/events")
        trace.append(spark.readStream.schema(e.schema).parquet(f"{base}/events"), f"{base}/log", f"{base}/state")
    return spark.read.parquet(f"{base}/log").drop("batch")


_LOG = """o AS (SELECT user_id AS run_id, event_id, event_type, ts, event_id % 2 AS half FROM events),
l AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY half, ts, event_id) AS sequence, event_id, event_type, half = 1 AND ts < max(CASE WHEN half = 0 THEN ts END) OVER (PARTITION BY run_id) AS late FROM o)"""


@query(f"WITH {_LOG} SELECT run_id, sequence, event_id, event_type, coalesce(late, false) AS late FROM l")
def trace_log(spark, sf):
    """The log of all runs with gap-free numbers over two batches and a restart; events that came late say so."""
    return _log(spark, sf).select("run_id", "sequence", "event_id", "event_type", "late")


@query(f"""WITH {_LOG}, t AS (SELECT run_id, min(sequence) AS terminal FROM l WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY run_id)
SELECT run_id, sequence, event_id FROM l LEFT JOIN t USING (run_id) WHERE sequence > CASE WHEN run_id % 2 = 0 THEN 2 ELSE 0 END AND (terminal IS NULL OR sequence <= terminal)""")
def trace_tail(spark, sf):
    """What readers get that have seen two events of every second run: the rest up to a terminal event."""
    log = _log(spark, sf)
    last = table(spark, sf, "events").agg(F.max("event_type")).first()[0]
    seen = log.where("run_id % 2 = 0").select("run_id", F.lit(2).cast("long").alias("sequence")).distinct()
    return trace.tail(log, seen, (last,)).select("run_id", "sequence", "event_id")


@query("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def cell_recall(spark, sf):
    """Whether the cells' ten nearest of every fiftieth vector are nine tenths or more of the exact ones."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    each = cells.recall(cell_hits(spark, v, asked), R.dense(v, asked, 10))
    return each.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("reached"))


def cell_hits(spark, vectors, asked, k=10):
    fitted = cells.fit(vectors, k=k)
    return settled(cells.search(cells.build(vectors, fitted, _folder(spark, "cells")), fitted, asked, k))


@query()
def cell_topk(spark, sf):
    """The ten nearest vectors of every fiftieth vector by cells, residual codes and exact rescoring; about the exact ones, so without SQL."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return cell_hits(spark, v, v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector"))
