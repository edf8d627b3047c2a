"""Nested numbers, comparison of results, search by trigrams, run logs, batches that survive a crash."""

from __future__ import annotations

import datetime as dt
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reconloom.functions.nested import numbers_of
from reconloom.operators import compare, text_index
from reconloom.sources import batches, io, logs


def test_numbers_of_any_nesting(spark):
    schema = "id int, v struct<a: int, b: string, c: array<struct<x: double, y: array<string>>>, d: map<string, map<int, boolean>>, e: boolean, f: date, g: binary, h: decimal(6,2)>"
    rows = [(1, (7, "at 12.5% and -3, not x9", [(0.25, ["one 1,000", None]), (None, None)], {"k 44": {5: True}}, True, dt.date(2024, 3, 9), b"8", None)), (2, (None, None, None, None, None, None, None, None)), (3, None)]
    d = spark.createDataFrame(rows, schema)
    got = {r.id: sorted(r.n) for r in d.select("id", numbers_of(F.col("v"), d.schema["v"].dataType).alias("n")).collect()}
    assert got == {1: sorted([7.0, 12.5, -3.0, 0.25, 1000.0, 44.0, 5.0, 2024.0, 3.0, 9.0]), 2: [], 3: []}


# Comparison


def planted(spark, seed=1):
    """(left, right, differences): rows with null and repeated keys, nested columns, numbers near each other."""
    r = random.Random(seed)
    rows = [(i % 190 if i % 17 else None, f"s{r.randrange(5)}", round(r.uniform(-9, 9), 6), [i, None]) for i in range(400)]
    schema = "k int, s string, v double, a array<int>"
    near = [(k, s, v + 4e-4, a) for k, s, v, a in rows]
    near[10] = (*near[10][:2], near[10][2] + 1, near[10][3])
    near[11] = (near[11][0], "other", *near[11][2:])
    near[12] = (*near[12][:3], [0])
    gone = near.pop(40)
    near += [(999, "new", 0.0, None), near[50]]
    r.shuffle(near)
    return spark.createDataFrame(rows, schema), spark.createDataFrame(near, schema).repartition(5), (rows, gone)


def test_comparison_lists_what_was_planted(spark):
    rows = [(i, f"s{i % 5}", i / 7, [i, None]) for i in range(300)] + [(None, "n", 0.0, None)] * 2
    schema = "k int, s string, v double, a array<int>"
    right = [(k, s, v + 4e-4, a) for k, s, v, a in rows]
    right[10] = (10, "s0", right[10][2] + 1, [10, None])
    right[11] = (11, "other", *right[11][2:])
    right[12] = (*right[12][:3], [0])
    right = [x for x in right if x[0] != 40] + [(999, "new", 0.0, None), right[50], right[-1]]
    random.Random(1).shuffle(right)
    left, other = spark.createDataFrame(rows, schema), spark.createDataFrame(right, schema).repartition(5).select("v", "a", "s", "k")
    for buckets in (1, 64, compare.BUCKETS):
        got = Counter((r.k, r.nth, r.column, r.left if r.column is None else None, r.right if r.column is None else None) for r in compare.compare(left, other, ["k"], {"v": 0.001}, buckets).collect())
        assert got == Counter([(10, 1, "v", None, None), (11, 1, "s", None, None), (12, 1, "a", None, None), (40, 1, None, None, "missing"), (999, 1, None, "missing", None), (50, 2, None, "missing", None), (None, 3, None, "missing", None)])
    assert not compare.equal(left, other, ["k"], {"v": 0.001})
    assert compare.compare(left, other, ["k"]).count() > 290  # without a tolerance all prices differ


def test_comparison_of_equal_results_moves_nothing(spark):
    a, b, _ = planted(spark)
    assert compare.equal(a, a.repartition(7).select("a", "v", "s", "k"), ["k"]) and compare.differing_buckets(a, a, ["k"]).isEmpty()
    assert compare.equal(a.limit(0), a.limit(0), ["k"]) and not compare.equal(a, a.limit(0), ["k"])
    few = compare.differing_buckets(a.filter("k < 5"), a.filter("k < 4"), ["k"])
    assert few.count() == 1
    with pytest.raises(ValueError, match="columns differ"):
        compare.compare(a, b.drop("s"), ["k"])


# Search


def test_search_equals_scan_and_reads_less(spark, tmp_path):
    r = random.Random(4)
    words = ["amount", "amend", "Ledger", "ÄRGER", "x", "", "missing counterparty", "aaaa", "100%", "a_b"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(6))), r.choice([None, f"ref {i}", "common common"])) for i in range(600)] + [(600, "the only zyzzyva", None)]
    d = spark.createDataFrame(rows, "id long, t string, u string").withColumn("gram", F.lit("clash"))
    texts, path = [F.col("t"), F.col("u")], str(tmp_path / "index")
    text_index.build(d, "id", texts, path)
    for needle in ("zyzzyva", "am", "", "amo", "LEDGER", "ärger", "common c", "mon co", "100%", "a_b", "aaaaa", "ref 12", "nowhere", "amount  am", "amount amount"):
        want = sorted(i for i, t, u in rows if needle.lower() in t.lower() or needle.lower() in (u or "").lower())
        got = text_index.search(d, "id", texts, path, needle)
        assert sorted(x.id for x in got.collect()) == want, needle
        assert got.columns == d.columns or set(got.columns) == set(d.columns)
    # A needle of one gram reads one folder of 256.
    posts = text_index.candidates(spark, path, "zyz")
    folders = {f.split("bucket=")[1].split("/")[0] for f in posts.inputFiles() if "bucket=" in f}
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and len(folders) >= 1
    assert text_index.candidates(spark, path, "zyzzyva").count() == 1


def test_index_of_nothing(spark, tmp_path):
    d = spark.createDataFrame([], "id long, t string")
    text_index.build(d, "id", [F.col("t")], str(tmp_path / "index"))
    assert text_index.search(d, "id", [F.col("t")], str(tmp_path / "index"), "some").count() == 0


# Logs

LOG = """
FINAL REPORT of nothing, no rule above
============================================================
FIRST BLOCK
============================================================

  wall clock            12.5 s
  throughput          1,594.0 records/sec
  note without a figure

  gate              escalates  wrong  pts/pt
  ------------------------------------------
  keys > 1              2,136    195    11.1
  dup_ref                 352     11     n/a
  odd line of words

  after the table          7
============================================================
SECOND BLOCK
============================================================
  threshold  match
  ----------------
  0.5        98.3
  OFF        -1
"""
WANT = Counter(
    [("FIRST BLOCK", "wall clock", "s", "12.5"), ("FIRST BLOCK", "throughput", "records/sec", "1594.0"), ("FIRST BLOCK", "keys > 1", "escalates", "2136"), ("FIRST BLOCK", "keys > 1", "wrong", "195"), ("FIRST BLOCK", "keys > 1", "pts/pt", "11.1")]
    + [("FIRST BLOCK", "dup_ref", "escalates", "352"), ("FIRST BLOCK", "dup_ref", "wrong", "11"), ("FIRST BLOCK", "dup_ref", "pts/pt", None), ("FIRST BLOCK", "after the table", "", "7"), ("SECOND BLOCK", "0.5", "match", "98.3"), ("SECOND BLOCK", "OFF", "match", "-1")]
)


@pytest.mark.parametrize("cut", [None, 40, 97])
def test_log_blocks_whatever_the_splits(spark, tmp_path, cut):
    """One file in one split, or in many splits that break anywhere."""
    (tmp_path / "run.log").write_text(LOG)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        if cut:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = Counter((r.heading, r.label, r.column, r.value) for r in logs.read_blocks(spark, str(tmp_path / "run.log")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == WANT


def test_written_log_gives_its_tables_back(spark, tmp_path):
    """Over several files, with long labels and many rows."""
    a = spark.range(3000).select(F.concat(F.lit("row "), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit(" of a rather long label")).alias("name"), (F.col("id") * 7).alias("n"), F.when(F.col("id") % 3 != 0, F.col("id") / 8).alias("x"))
    b = spark.createDataFrame([("p", True)], "k string, flag boolean")
    logs.write_log([("FIRST", a, "name"), ("SECOND", b, "k")], str(tmp_path / "log"))
    got = {(r.heading, r.label, r.column): r.value for r in logs.read_blocks(spark, str(tmp_path / "log")).collect()}
    want = {("FIRST", r["name"], c): None if r[c] is None else str(r[c]) for r in a.collect() for c in ("n", "x")} | {("SECOND", "p", "flag"): "true"}
    assert got == want


# Batches


def test_batches_repeated_crashed_and_at_once(spark, tmp_path):
    path = str(tmp_path / "sink")
    rows = lambda lo, hi, v: spark.range(lo, hi).withColumn("v", F.lit(v))
    read = lambda: Counter((r.id, r.v) for r in batches.read_batches(spark, path, "id long, v string", "id").collect())
    assert read() == Counter()
    assert batches.append_batch(rows(0, 50, "a"), path, 0, "id") and not batches.append_batch(rows(0, 50, "again"), path, 0, "id")
    # A writer that died: rows aside, and a batch without a place.
    rows(500, 600, "dead").write.parquet(f"{path}/_aside/dead/rows")

    class Boom(Exception):
        pass

    def fail(*a, **k):
        raise Boom

    real = batches._fs
    spark_fs = real(spark, path)

    class Broken:
        def __getattr__(self, name):
            return fail if name == "rename" else getattr(spark_fs[0], name)

    batches._fs = lambda s, p: (Broken(), spark_fs[1])
    try:
        with pytest.raises(Boom):
            batches.append_batch(rows(40, 90, "b"), path, 1, "id")
    finally:
        batches._fs = real
    assert read() == Counter({(i, "a"): 1 for i in range(50)})
    # The same batch by several writers at once.
    done = []
    writers = [threading.Thread(target=lambda: done.append(batches.append_batch(rows(40, 90, "b"), path, 1, "id"))) for _ in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sum(done) == 1
    assert read() == Counter({(i, "a"): 1 for i in range(50)} | {(i, "b"): 1 for i in range(50, 90)})
    twice = rows(90, 95, "c").unionByName(rows(90, 95, "d")).unionByName(rows(90, 95, "c"))
    batches.append_batch(twice, path, 2, "id")
    assert {v for (i, v), n in read().items() if i >= 90} == {"c"} and all(n == 1 for n in read().values())


def test_stream_appends_each_id_once_over_restarts(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "id long, v string"
    for n in range(3):
        spark.range(10 * n, 10 * n + 15).withColumn("v", F.lit(f"f{n}")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        batches.append_stream(stream, sink, "id", state).awaitTermination()
    want = {i: f"f{min(n for n in range(3) if 10 * n <= i < 10 * n + 15)}" for i in range(35)}
    assert {r.id: r.v for r in batches.read_batches(spark, sink, schema, "id").collect()} == want
    # The state is lost: all files come again under numbers that are taken.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    batches.append_stream(stream, sink, "id", state + "-new").awaitTermination()
    got = batches.read_batches(spark, sink, schema, "id").collect()
    assert len(got) == 35 and {r.id: r.v for r in got} == want


def test_inventory_counts_by_schema(spark, tmp_path):
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(5).withColumn("x", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "b"))
    spark.range(0).coalesce(1).write.parquet(str(tmp_path / "c"))
    got = sorted((r["rows"], r["columns"], r["cells"]) for r in io.inventory(spark, str(tmp_path), "*.parquet").collect())
    assert got == [(0, 1, 0), (5, 2, 10), (7, 1, 7)]


def test_inventory_of_tables_in_several_files(spark, tmp_path):
    """A table that is a folder of files is one row, an empty one has its columns."""
    from reconloom.plans import all_queries
    from reconloom.plans.q_sources import _TABLES

    for i, name in enumerate(_TABLES):
        d = spark.range(10 * i, numPartitions=1 + i % 3).selectExpr("id", "id AS b", *(["id AS c"] if i % 2 else []))
        d.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {tuple(r) for r in all_queries()[0]["file_inventory"](spark, str(tmp_path)).select("file", "rows", "columns", "cells").collect()}
    assert got == {(f"{n}.parquet", 10 * i, 2 + i % 2, 10 * i * (2 + i % 2)) for i, n in enumerate(_TABLES)}
