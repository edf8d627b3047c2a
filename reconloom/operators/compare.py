"""Comparison of two results, whatever their order: which rows differ, and in what.

Rows are hashed and the hashes summed by bucket of the key. Buckets with equal sums and counts are left alone; only rows of the
others meet their partners. Two equal results cost one small aggregate each, and a few differences move a few buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 65_536


def _quantum(c: Column, tolerance: float) -> Column:
    """The step of a number on a scale of the tolerance: values further apart than that never share one."""
    return F.floor(c.cast("double") / tolerance)


def _sums(df: DataFrame, key: list[str], tolerances: dict[str, float], buckets: int, name: str) -> DataFrame:
    parts = [_quantum(F.col(c), tolerances[c]) if c in tolerances else F.col(c) for c in df.columns]
    row = F.xxhash64(*[F.coalesce(F.to_json(F.struct(p.alias("v"))), F.lit("")) for p in parts])
    d = df.select(F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("bucket"), row.alias("h"))
    return d.groupBy("bucket").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias(f"sum_{name}"), F.count("*").alias(f"n_{name}"))


def differing_buckets(left: DataFrame, right: DataFrame, key: list[str], tolerances: dict[str, float] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(bucket): buckets of the key whose rows are not the same on both sides; at most `buckets` rows."""
    a, b = (_sums(d, key, tolerances or {}, buckets, n) for d, n in ((left, "l"), (right, "r")))
    return a.join(b, "bucket", "full").filter(~(F.col("sum_l").eqNullSafe(F.col("sum_r")) & F.col("n_l").eqNullSafe(F.col("n_r")))).select("bucket")


def compare(left: DataFrame, right: DataFrame, key: list[str], tolerances: dict[str, float] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(key, nth, column, left, right): one row for each difference, values as text; none if the results are equal as multisets.

    column is null where a row has no partner: `left` or `right` then says 'missing' for the side that lacks it. Rows that share a key are
    paired in the order of their other columns as JSON. tolerances: by column, how far numbers may be apart. Nulls equal nulls, also in keys. Both sides need
    the same columns, in any order.
    """
    tolerances = tolerances or {}
    columns = left.columns
    if set(columns) != set(right.columns):
        raise ValueError(f"columns differ: {sorted(set(columns) ^ set(right.columns))}")
    right = right.select(columns)
    rest = [c for c in columns if c not in key]
    bad = F.broadcast(differing_buckets(left, right, key, tolerances, buckets))  # at most `buckets` numbers

    def drilled(d: DataFrame, name: str) -> DataFrame:
        inside = d.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets))).join(bad.withColumnRenamed("bucket", "_bucket"), "_bucket", "left_semi")
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.to_json(F.struct(*rest)) if rest else F.lit(0)))  # rows of one key
        return inside.withColumn("nth", nth).select(F.struct(*key).alias("k"), "nth", F.struct(*[F.col(c) for c in rest], F.lit(True).alias("_in")).alias(name))

    both = drilled(left, "l").join(drilled(right, "r"), ["k", "nth"], "full")
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")

    def differs(c: str) -> Column:
        a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
        if c in tolerances:
            return ~(a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerances[c], F.lit(False)))
        return ~a.eqNullSafe(b)

    found = [F.when(differs(c), F.struct(F.lit(c).alias("column"), text("l", c).alias("left"), text("r", c).alias("right"))) for c in rest]
    alone = F.struct(F.lit(None).cast("string").alias("column"), F.when(F.col("l").isNull(), "missing").alias("left"), F.when(F.col("r").isNull(), "missing").alias("right"))
    pair = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<struct<column:string,left:string,right:string>>")
    rows = both.withColumn("d", F.explode(F.when(F.col("l").isNull() | F.col("r").isNull(), F.array(alone)).otherwise(pair)))
    return rows.select(*[F.col("k")[c].alias(c) for c in key], "nth", "d.column", "d.left", "d.right")


def equal(left: DataFrame, right: DataFrame, key: list[str], tolerances: dict[str, float] | None = None) -> bool:
    return compare(left, right, key, tolerances).isEmpty()
