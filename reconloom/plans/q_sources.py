"""Queries: files written and read again, and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from reconloom.plans import q_matching, q_reports  # noqa: F401  their tables go into logs
from reconloom.operators import decide
from reconloom.plans.catalog import ORACLES, QUERIES, register
from reconloom.plans.context import BASE, DECIDED, batch
from reconloom.sources import batches, io, logs


def _folder(spark, name: str) -> str:
    return io.shared_folder(spark, name)


@register("scan_text_csv", BASE + " SELECT b_id::VARCHAR AS \"B_id\", coalesce(array_to_string(gold, ','), '') AS keys, ' x ' AS \"Usage\" FROM stmt s LEFT JOIN gold ON gold.b_id = s.b_id".replace("SELECT b_id::", "SELECT s.b_id::"))
def scan_text_csv(spark, sf_dir):
    """Written as CSV and read as text: blanks stay '', spaces stay."""
    b, path = batch(spark, sf_dir), _folder(spark, "csv")
    d = b.queries.join(b.gold, "b_id", "left").select(F.col("b_id").cast("string").alias("B_id"), F.coalesce(F.array_join("gold", ","), F.lit("")).alias("targetAllocation"), F.lit(" x ").alias("Usage"))
    io.write_csv(d, path)
    return io.read_text_csv(spark, path, io.SOLUTION_COLUMNS).withColumnRenamed("targetAllocation", "keys")


@register("scan_typed_csv", "SELECT lpad(n_nationkey::VARCHAR, 4, '0') AS id, n_name, n_regionkey FROM nation")
def scan_typed_csv(spark, sf_dir):
    """Types inferred, one column forced to text (its leading zeros stay)."""
    path = _folder(spark, "typed")
    io.write_csv(batch(spark, sf_dir).read("nation").select(F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("id"), "n_name", "n_regionkey"), path)
    return io.read_typed_csv(spark, path, {"id": "string"})


@register("scan_audit", DECIDED + " SELECT CASE WHEN escalate THEN 'escalate' ELSE 'auto_close' END AS decision, exception_class, count(*) AS rows, sum(topk_size)::BIGINT AS candidates, sum(b_cents)::BIGINT AS cents FROM decided GROUP BY ALL")
def scan_audit(spark, sf_dir):
    """The audit written as JSON lines and read under its schema."""
    path = _folder(spark, "audit")
    io.write_jsonl(decide.audit(batch(spark, sf_dir).decided, "main"), path)
    n = F.coalesce(F.sum(F.when(F.col("candidates").isNotNull(), F.size("candidates"))), F.lit(0))
    return io.read_audit(spark, path).groupBy("decision", "exception_class").agg(F.count("*").alias("rows"), n.cast("long").alias("candidates"), F.sum("b_amount_cents").alias("cents"))


@register("scan_manifest", BASE + " SELECT class, count(*) AS rows, count_if(b_id % 4 = 0) AS with_timing, sum(b_id)::BIGINT AS ids FROM stmt GROUP BY class")
def scan_manifest(spark, sf_dir):
    """A manifest of all statement rows written and exploded again."""
    path = _folder(spark, "manifest")
    hit = F.when(F.col("b_id") % 4 == 0, F.array(F.lit("timing"))).otherwise(F.array().cast("array<string>"))
    io.write_manifest(batch(spark, sf_dir).stmt.select("b_id", "class", hit.alias("corruptions")), path)
    m = io.read_manifest(spark, path)
    return m.groupBy("class").agg(F.count("*").alias("rows"), F.count_if(F.array_contains("corruptions", "timing")).alias("with_timing"), F.sum("b_id").alias("ids"))


@register("scan_log", "SELECT o_orderkey::VARCHAR AS id, (o_orderkey % 97)::VARCHAR AS rate FROM orders WHERE o_orderkey % 3 = 0")
def scan_log(spark, sf_dir):
    """Figures taken out of log lines by a pattern."""
    path = _folder(spark, "log")
    k = F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("  run "), k, F.lit(": "), (F.col("o_orderkey") % 97).cast("string"), F.lit(" rec/s"))).otherwise(F.concat(F.lit("noise "), k))
    batch(spark, sf_dir).read("orders").select(line.alias("value")).write.mode("overwrite").text(path)
    return io.read_log(spark, path, r"^\s*run (\d+): (\d+) rec/s", ["id", "rate"])


@register("pruned_scan", "SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY l_orderkey")
def pruned_scan(spark, sf_dir):
    """Two columns and a filter, both of which reach the Parquet scan."""
    return batch(spark, sf_dir).read("lineitem").filter("l_shipdate >= TIMESTAMP '1997-01-01'").select("l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))


@register("append_new", "WITH e AS (SELECT o_orderkey AS id, 'old' AS v, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' END AS error FROM orders WHERE o_orderkey % 2 = 0), g AS (SELECT * FROM e WHERE error IS NULL), f AS (SELECT o_orderkey AS id, 'new' AS v, NULL::VARCHAR AS error FROM orders WHERE o_orderkey % 3 = 0) SELECT v, count(*) AS rows, sum(id)::BIGINT AS ids FROM (SELECT * FROM g UNION ALL SELECT f.* FROM f ANTI JOIN g ON f.id = g.id) GROUP BY v")
def append_new(spark, sf_dir):
    """A file that is resumed, twice: good records stay, failed ones are made again, known ids are skipped."""
    path = _folder(spark, "append")
    o = batch(spark, sf_dir).read("orders").select(F.col("o_orderkey").alias("id"))
    old = o.filter("id % 2 = 0").select("id", F.lit("old").alias("v"), F.when(F.col("id") % 5 == 0, "failed").alias("error"))
    new = o.filter("id % 3 = 0").select("id", F.lit("new").alias("v"), F.lit(None).cast("string").alias("error"))
    for rows in (old, new, new):
        io.append_json(spark, path, rows, "id")
    d = spark.read.schema(old.schema).json(path).filter("error is null")
    return d.groupBy("v").agg(F.count("*").alias("rows"), F.sum("id").alias("ids"))


@register("export_files", DECIDED + ", q AS (SELECT * FROM judged WHERE escalate) SELECT * FROM (SELECT 'summary' AS file, 1::BIGINT AS rows, count_if(NOT escalate)::BIGINT AS figure FROM judged UNION ALL SELECT 'queue', count(*), coalesce(sum(abs(b_cents)), 0)::BIGINT FROM q UNION ALL SELECT 'detail', count(*), coalesce(sum(abs(b_cents)), 0)::BIGINT FROM q)")
def export_files(spark, sf_dir):
    """Summary, queue and detail documents written as JSON, read again and counted (the curve has a query of its own)."""
    from reconloom.operators import evidence, exposure

    b, path = batch(spark, sf_dir), _folder(spark, "export")
    queue = exposure.ranked_queue(b.judged)
    detail = evidence.detail(decide.audit(b.posted.filter("escalate"), "main"), b.stmt)
    io.write_export(path, exposure.headline(b.judged), exposure.retired_curve(queue), queue.select("rank", "b_id", "exposure_cents"), detail.select("b_id", "doc"))
    one = lambda name, figure, schema: spark.read.schema(schema).json(f"{path}/{name}").agg(F.lit(name).alias("file"), F.count("*").alias("rows"), F.sum(figure).alias("figure"))
    out = one("summary", "auto_rows", "auto_rows long").unionByName(one("queue", "exposure_cents", "exposure_cents long"))
    return out.unionByName(one("detail", "doc.transaction.exposure_cents", "b_id string, doc struct<transaction: struct<exposure_cents: bigint>>"))


@register("latest_records", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id % 7 <> 0 GROUP BY user_id")
def latest_records(spark, sf_dir):
    """The last record of each key that is not an error."""
    e = batch(spark, sf_dir).read("events").select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 7 == 0, "failed").alias("error"))
    return io.latest(e, "user_id", "event_id").select("user_id", "event_id", "event_type")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@register("file_inventory", " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) AS rows, max(n) AS columns, count(*) * max(n) AS cells FROM {t}, (SELECT count(*) AS n FROM duckdb_columns() WHERE table_name = '{t}')" for t in _TABLES))
def file_inventory(spark, sf_dir):
    """The tables of the input folder: rows, columns, cells; a table may be a folder of files."""
    return io.table_inventory(spark, sf_dir, list(_TABLES))


@register("queue_sink", DECIDED + ", q AS (SELECT abs(b_cents) AS v, row_number() OVER (ORDER BY abs(b_cents) DESC, b_id) AS rank FROM decided WHERE escalate) SELECT ((rank - 1) // 1000)::INT AS page, count(*) AS rows, max(v) AS largest FROM q GROUP BY 1")
def queue_sink(spark, sf_dir):
    """The ranked queue written as JSON, a folder a page, and read again."""
    from reconloom.operators import exposure

    path = _folder(spark, "pages")
    q = exposure.ranked_queue(batch(spark, sf_dir).decided).select("rank", "b_id", "exposure_cents")
    io.write_pages(q, path)
    d = spark.read.schema("rank long, b_id long, exposure_cents long, page int").json(path)
    return d.groupBy("page").agg(F.count("*").alias("rows"), F.max("exposure_cents").alias("largest"))


#: Blocks of the log: heading, query whose table is written, column of labels.
_BLOCKS = (("PRICING THE GATES", "gate_pricing", "gate"), ("THRESHOLD SWEEP", "threshold_sweep", "t"), ("SCORE BY STRATUM", "score_by_stratum", "stratum"))


def _block_sql(heading: str, name: str, label: str) -> str:
    figures = f"SELECT {label}::VARCHAR AS label, COLUMNS(* EXCLUDE ({label}))::DOUBLE FROM ({ORACLES[name]})"
    return f"SELECT '{heading}' AS heading, label, \"column\", value FROM ({figures}) UNPIVOT INCLUDE NULLS (value FOR \"column\" IN (COLUMNS(* EXCLUDE (label))))"


@register("scan_log_blocks", " UNION ALL ".join(_block_sql(*b) for b in _BLOCKS))
def scan_log_blocks(spark, sf_dir):
    """The tables of gates, thresholds and scores written as blocks of a run log, and every figure read back from the lines under their headings."""
    path = _folder(spark, "run-log")
    logs.write_log([(heading, QUERIES[name](spark, sf_dir), label) for heading, name, label in _BLOCKS], path)
    return logs.read_blocks(spark, path).select("heading", "label", "column", F.col("value").cast("double").alias("value"))


@register("append_batches", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'b0' WHEN o_orderkey % 3 = 0 THEN 'b1' ELSE 'b2' END AS v FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def append_batches(spark, sf_dir):
    """Three batches that share keys, appended out of order, one of them twice and once more with other rows: each id once, from the first batch that has it."""
    path, o = _folder(spark, "batches"), batch(spark, sf_dir).read("orders").select(F.col("o_orderkey").alias("id"))
    part = lambda n, v: o.filter(F.col("id") % n == 0).withColumn("v", F.lit(v))
    for rows, number in ((part(5, "b2"), 2), (part(2, "b0"), 0), (part(3, "b1"), 1), (part(3, "b1"), 1), (part(7, "late"), 1)):
        batches.append_batch(rows, path, number, "id")
    return batches.read_batches(spark, path, "id long, v string", "id")
