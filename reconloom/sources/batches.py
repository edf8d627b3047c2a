"""An append that survives a crash: batches with numbers, each written as a whole or not at all.

A batch is written aside and then moved to its place, which is one step of the file system. A batch that is there already is not written
again, whoever comes second, so a repeated or concurrent one changes nothing. A writer that dies leaves only what lies aside, and readers never
look there. Where two batches hold the same key, the batch with the smaller number has it, whichever was written first.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def append_batch(fresh: DataFrame, path: str, number: int, key: str) -> bool:
    """Write fresh as batch `number` below path; False if it is there already. Of rows that share a key the first by content stays."""
    spark = fresh.sparkSession
    fs, to = _fs(spark, path)
    place = to(f"{path}/batch={number}")
    if fs.exists(place):
        return False
    once = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.to_json(F.struct(*fresh.columns))))).filter("_n = 1").drop("_n")
    aside = f"{path}/_aside/{uuid.uuid4().hex}"
    once.write.parquet(f"{aside}/rows")
    fs.mkdirs(place.getParent())
    # Renaming to a name that exists would put the folder inside it, so a writer that comes second is told apart by what it finds there.
    moved = not fs.exists(place) and fs.rename(to(f"{aside}/rows"), place)
    inside = to(f"{path}/batch={number}/rows")
    if fs.exists(inside):
        fs.delete(inside, True)
        moved = False
    fs.delete(to(aside), True)
    return bool(moved)


def read_batches(spark: SparkSession, path: str, schema, key: str) -> DataFrame:
    """The rows of all batches, each key once: from the batch with the smallest number. An absent folder gives no rows."""
    try:
        d = spark.read.schema(f"{schema}, batch int" if isinstance(schema, str) else T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", path).parquet(f"{path}/batch=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    first = d.groupBy(F.col(key).alias("_k")).agg(F.min("batch").alias("_b"))
    return d.join(first, d[key].eqNullSafe(F.col("_k")) & (F.col("batch") == F.col("_b"))).drop("_k", "_b", "batch")


def append_stream(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append what a stream brings until it has caught up. A restart repeats at most the batch that was under way, which then is there or is written."""
    writer = stream.writeStream.foreachBatch(lambda d, n: append_batch(d, path, n, key) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
