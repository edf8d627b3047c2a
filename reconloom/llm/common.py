"""What the operators share: the shared folder, tables that cut lineage, and rows of one key in a stream."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where the session sets none (tests on one machine), a temporary folder is made and set.
    """
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_reconloom_dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        own = spark._reconloom_dir = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    The rows survive the loss of any executor, and later stages do not repeat the work before.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the cores where it comes in fewer parts than there are, as one small file does; other tables stay as they are read.

    For operators that spend long on a row. The rows are the same.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def held_out(doc_id: str | Column) -> Column:
    """Rows that no model learns from: crc32 of doc_id as text, mod 4, is 2. A null id counts as the text ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 4 == 2


def labelled_sample(df: DataFrame, id_col: str, bound: int) -> DataFrame:
    """About `bound` rows at most, chosen by a hash of the id (all of them if there are fewer)."""
    n = df.count()
    if n <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has the default of 10,000, which is a lot of memory in texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def _trim() -> None:
    """Hand freed memory back to the machine, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def give_back() -> None:
    """Hand what Arrow and Python have freed back to the machine; at the end of a task whose memory others need."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()


def tidy(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """rows, a function on a partition's batches, that gives back memory when the partition is over: workers are used again, by other operators too."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, done=None) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, so that few texts are Python objects at a time.

    At the end of the partition `done` is called and freed memory goes back: workers are used again, by other operators too.
    """
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        if done is not None:
            done()
        give_back()


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """From batches sorted by keys (no nulls in them), one table for each stretch of equal keys.

    Holds one group and one batch at a time; the caller bounds its groups.
    """
    open_parts: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t.column(k).to_numpy() for k in keys]
        change = np.zeros(t.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        edges = [0, *starts.tolist(), t.num_rows]
        for i in range(len(edges) - 1):
            key = tuple(c[edges[i]] for c in cols)
            part = t.slice(edges[i], edges[i + 1] - edges[i])
            if open_parts and key != last:
                yield pa.concat_tables(open_parts)
                open_parts = []
            open_parts.append(part)
            last = key
    if open_parts:
        yield pa.concat_tables(open_parts)
    open_parts = []
    give_back()


#: Rows up to which a table of a few short columns is broadcast (tens of MB); beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000


def small(t: DataFrame) -> DataFrame:
    """A written table of short rows, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(t) if t.count() <= BROADCAST_ROWS else t


def packed(df: DataFrame, **cols: Column) -> DataFrame:
    """df with each row packed into the struct `row`, beside cols: names of the user's columns can't clash with any other."""
    return df.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in cols.items()])


def unpacked(df: DataFrame) -> DataFrame:
    """The rows that `packed` packed, with their own columns."""
    return df.select("row.*")


def leave_one(df: DataFrame, gone: DataFrame, twins: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df without the rows whose (id, raw_key of the text) is in gone, but with one row for each key in twins; df's columns.

    gone and twins are written tables of distinct (id, raw_key). Of the rows of a key in twins the one stays whose JSON is
    least, should they differ in other columns. Texts move only where gone is too large to broadcast.
    """
    keyed = packed(df, id=F.col(id_col), raw_key=F.xxhash64(text_col))

    def having(keys: DataFrame, how: str) -> DataFrame:
        named = small(keys).select(F.col("id").alias("key_id"), F.col("raw_key").alias("key"))
        return keyed.join(named, F.col("id").eqNullSafe(F.col("key_id")) & (F.col("raw_key") == F.col("key")), how)

    rest = unpacked(having(gone, "left_anti"))
    if twins.isEmpty():
        return rest
    one = having(twins, "left_semi").groupBy("id", "raw_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rest.unionByName(unpacked(one))


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(v, root): the smallest vertex of the component of each vertex of edges (u, v), by alternating stars.

    Each round joins edges with the least neighbour of their ends, so that no vertex's edges are gathered,
    and writes the new edges; a chain of n vertices takes about log n rounds.
    """

    def ordered(e: DataFrame) -> DataFrame:
        return e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    e = table(ordered(edges), name)
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join has two plain inputs and a vertex with very many edges can be split over tasks.
        low = table(least(both).withColumn("m", F.least("u", "m")), name)
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = ordered(large)
        low = least(large)
        small = large.join(low, "u")
        e = table(ordered(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))), name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).collect()[0]
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    # A root once: counted first by a sixteenth of its edges, so that not a row of each task that read one comes together.
    tops = e.groupBy("v", F.pmod(F.xxhash64("u"), F.lit(16)).alias("part")).agg(F.count("*").alias("n")).groupBy("v").agg(F.sum("n").alias("n")).filter("n > 0")
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(tops.select("v", F.col("v").alias("root")))
