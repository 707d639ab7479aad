"""Queries of the read API: filters, pages, joins and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.common import rank
from .common import CHUNKS, chunks, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {CHUNKS} SELECT chunk_id, source_id, category FROM chunks WHERE status = 'completed'")
def active_chunks_join(spark, sf):
    """Chunks of completed sources; sources are few and counted before they are broadcast."""
    from ..operators.common import bounded

    c = chunks(spark, sf)
    sources = c.select("source_id", "status").distinct().where("status = 'completed'").select("source_id")
    return c.join(bounded(sources), "source_id").select("chunk_id", "source_id", "category")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%e_n%' OR p_brand ILIKE '%#1%'")
def name_ilike_filter(spark, sf):
    """% and _ in the input are wildcards."""
    return table(spark, sf, "part").where(F.col("p_name").ilike("%e_n%") | F.col("p_brand").ilike("%#1%")).select("p_partkey", "p_name", "p_brand")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority = '1-URGENT'")
def in_list_filter(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_orderstatus")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 = 3")
def json_field_filter(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").where(k % 7 == 3).select("event_id", k.alias("k"))


@query("SELECT o_orderkey, o_custkey, CAST((SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS BIGINT) AS total, CAST(ceil((SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') / 20.0) AS BIGINT) AS pages FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def page_sources(spark, sf):
    """The third page of twenty, newest first, with the number of pages."""
    kept = table(spark, sf, "orders").where("o_orderstatus <> 'F'")
    total = kept.agg(F.count("*").alias("total"))
    page = kept.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(40).limit(20)
    return page.join(F.broadcast(total)).select("o_orderkey", "o_custkey", "total", F.ceil(F.col("total") / 20).alias("pages"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%1%' ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 15")
def page_history(spark, sf):
    c = table(spark, sf, "customer").where((F.col("c_mktsegment") == "BUILDING") & F.col("c_name").ilike("%1%"))
    return c.orderBy(F.desc("c_acctbal"), F.desc("c_custkey")).limit(15).select("c_custkey", "c_name")


@query("SELECT c_custkey, count(o_orderkey) AS active, coalesce(arg_max(o_orderkey, (o_orderdate, o_orderkey)), -1) AS latest FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus IN ('O', 'P') GROUP BY c_custkey")
def active_ingestion_left_join(spark, sf):
    """Each customer's active orders, and the latest of them."""
    o = table(spark, sf, "orders").where("o_orderstatus IN ('O', 'P')").groupBy("o_custkey").agg(F.count("*").alias("active"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    c = table(spark, sf, "customer").select("c_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("latest", F.lit(-1)).alias("latest"))


@query("SELECT source, doc_id AS id, text FROM documents WHERE doc_id = 42")
def resource_lookup(spark, sf):
    return table(spark, sf, "documents").where("doc_id = 42").select("source", F.col("doc_id").alias("id"), "text")


@query("SELECT user_id, 'S' || CAST(event_id % 12 + 1 AS VARCHAR) AS evidence_id, event_id FROM events ORDER BY user_id, evidence_id")
def detail_order(spark, sf):
    """Evidence ids sort as text: S10 before S2."""
    e = table(spark, sf, "events")
    return e.select("user_id", F.concat(F.lit("S"), (F.col("event_id") % 12 + 1).cast("string")).alias("evidence_id"), "event_id").orderBy("user_id", "evidence_id")


_PER = lambda t, key, name: f"(SELECT {key} AS id, count(*) AS {name} FROM {t} GROUP BY 1)"


@query(f"""SELECT c_custkey AS run_id, coalesce(events, 0) AS events, coalesce(evidence, 0) AS evidence, coalesce(citations, 0) AS citations, coalesce(calls, 0) AS calls FROM customer LEFT JOIN {_PER("events", "user_id", "events")} a ON a.id = c_custkey
LEFT JOIN {_PER("orders", "o_custkey", "evidence")} b ON b.id = c_custkey LEFT JOIN {_PER("documents", "doc_id", "citations")} c ON c.id = c_custkey LEFT JOIN {_PER("conversations", "conv_id", "calls")} d ON d.id = c_custkey""")
def run_fan_in(spark, sf):
    """A run's rows in four tables; each is counted before it is joined, so none multiplies another."""
    out = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"))
    for name, key, count in (("events", "user_id", "events"), ("orders", "o_custkey", "evidence"), ("documents", "doc_id", "citations"), ("conversations", "conv_id", "calls")):
        counted = table(spark, sf, name).groupBy(F.col(key).alias("run_id")).agg(F.count("*").alias(count))
        out = out.join(counted, "run_id", "left").withColumn(count, F.coalesce(count, F.lit(0)))
    return out


_SEQ = "seq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events)"


def _sequenced(spark, sf):
    return table(spark, sf, "events").withColumn("sequence", rank("user_id", order=[F.asc("ts"), F.asc("event_id")]))


@query(f"WITH {_SEQ} SELECT user_id, CAST(max(sequence) AS INTEGER) AS latest FROM seq GROUP BY user_id")
def latest_sequence(spark, sf):
    return _sequenced(spark, sf).groupBy("user_id").agg(F.max("sequence").alias("latest"))


@query(f"WITH {_SEQ} SELECT user_id, event_id, CAST(sequence AS INTEGER) AS sequence FROM seq WHERE sequence > 50")
def event_tail(spark, sf):
    return _sequenced(spark, sf).where("sequence > 50").select("user_id", "event_id", "sequence")


@query(f"""WITH {_SEQ}, v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sequence) AS a, row_number() OVER (PARTITION BY user_id ORDER BY sequence DESC) AS z, count(*) OVER (PARTITION BY user_id) AS n FROM seq WHERE event_type <> 'view')
SELECT user_id, event_id, CAST(sequence AS INTEGER) AS sequence FROM v WHERE n <= 14 OR a <= 6 OR z <= 8""")
def timeline_fold(spark, sf):
    """Long timelines show their first six and last eight events."""
    w = Window.partitionBy("user_id")
    v = _sequenced(spark, sf).where("event_type <> 'view'")
    v = v.select("*", rank("user_id", order=[F.asc("sequence")]).alias("a"), rank("user_id", order=[F.desc("sequence")]).alias("z"), F.count("*").over(w).alias("n"))
    return v.where("n <= 14 OR a <= 6 OR z <= 8").select("user_id", "event_id", "sequence")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, sha256(trim(text)) ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def duplicate_marker_rows(spark, sf):
    """Rows that repeat an earlier one's place and trimmed content; first ones are found by an aggregation."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.sha2(F.trim("text"), 256).alias("content"))
    first = d.groupBy("source", "content").agg(F.min("doc_id").alias("first"))
    return d.join(first, ["source", "content"]).where("doc_id <> first").select("source", "doc_id")


@query(f"""WITH {_SEQ} SELECT user_id, count(*) = max(sequence) AND min(sequence) = 1 AS contiguous, arg_min(event_type, sequence) AS first_event, arg_max(event_type, sequence) AS last_event FROM seq GROUP BY user_id""")
def trace_contract_checks(spark, sf):
    s = _sequenced(spark, sf)
    return s.groupBy("user_id").agg(((F.count("*") == F.max("sequence")) & (F.min("sequence") == 1)).alias("contiguous"), F.min_by("event_type", "sequence").alias("first_event"), F.max_by("event_type", "sequence").alias("last_event"))


@query("""WITH r(q, k, c, e) AS (VALUES ('ok?', 5, 20, 6), ('x', 5, 20, 6), ('fine', 25, 20, 6), ('fine', 5, 4, 6), ('fine', 0, 200, 6))
SELECT q, k, c, list_filter([CASE WHEN length(trim(q)) NOT BETWEEN 2 AND 4000 THEN 'question' END, CASE WHEN k NOT BETWEEN 1 AND 20 THEN 'top_k' END, CASE WHEN c NOT BETWEEN 1 AND 100 OR c < e THEN 'candidate_k' END], lambda x: x IS NOT NULL) AS errors FROM r""".replace("list_filter(", "array_to_string(list_filter(").replace("IS NOT NULL) AS errors", "IS NOT NULL), ',') AS errors"))
def request_validation(spark, sf):
    rows = spark.createDataFrame([("ok?", 5, 20, 6), ("x", 5, 20, 6), ("fine", 25, 20, 6), ("fine", 5, 4, 6), ("fine", 0, 200, 6)], "q string, k int, c int, e int")
    bad = F.array(F.when(~F.length(F.trim("q")).between(2, 4000), "question"), F.when(~F.col("k").between(1, 20), "top_k"), F.when(~F.col("c").between(1, 100) | (F.col("c") < F.col("e")), "candidate_k"))
    return rows.select("q", "k", "c", F.array_join(F.filter(bad, lambda x: x.isNotNull()), ",").alias("errors"))


@query("SELECT event_id, string_split('run_' || user_id || ':S' || event_id % 9, ':')[-1] AS evidence_id FROM events")
def evidence_suffix(spark, sf):
    full = F.concat(F.lit("run_"), "user_id", F.lit(":S"), F.col("event_id") % 9)
    return table(spark, sf, "events").select("event_id", F.substring_index(full, ":", -1).alias("evidence_id"))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 2 = 1 AS retryable FROM events UNION ALL SELECT -1, 'broken', -1, true")
def dto_projection(spark, sf):
    """Rows as the API gives them: JSON decoded (of broken JSON nothing is left, here -1), 0 and 1 as booleans."""
    e = table(spark, sf, "events").select("event_id", "event_type", "props").unionByName(spark.createDataFrame([(-1, "broken", "{not json")], "event_id long, event_type string, props string"))
    return e.select("event_id", "event_type", F.coalesce(F.from_json("props", "k int")["k"], F.lit(-1)).alias("k"), (F.abs("event_id") % 2).cast("boolean").alias("retryable"))


@query("SELECT c_nationkey, max(CAST(o_orderdate AS VARCHAR)) AS latest FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey")
def latest_update(spark, sf):
    """The latest change of each group, compared as text."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("c_nationkey").agg(F.max(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("latest"))


@query("SELECT conv_id AS run_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, count(*) FILTER (role = 'user') AS questions FROM conversations GROUP BY conv_id")
def first_last_events(spark, sf):
    return table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("run_id")).agg(F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.count(F.when(F.col("role") == "user", 1)).alias("questions"))
