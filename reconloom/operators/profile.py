"""Data profiling: schema, fill, counts, cross tables, dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconloom.functions.amounts import percent, rate
from reconloom.operators.quantiles import quantiles


def distinct_counts(df: DataFrame) -> DataFrame:
    """(i, n_unique): how many different values each column of df has, by its place; columns without any do not appear.

    Every value becomes a row (place, value), and equal ones are one again within their task, then over all, before they are counted. What
    moves is a row for each different value of a task, however many columns there are, and no row holds more than one column.
    Values of over 64 bytes go as their SHA-256 and length.
    """
    value = lambda c: F.to_json(F.struct(F.col(c).alias("v"))) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c).cast("string")
    short = lambda v: F.when(F.octet_length(v) <= 64, v).otherwise(F.concat(F.sha2(v, 256), F.lit(":"), F.octet_length(v).cast("string")))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.when(F.col(c).isNotNull(), short(value(c))).alias("v")) for i, c in enumerate(df.columns)])).alias("x")).select("x.*")
    return long.filter("v is not null").groupBy("i", "v").agg(F.lit(1).alias("one")).groupBy("i").agg(F.count("*").alias("n_unique"))


def schema_profile(df: DataFrame, order: str) -> DataFrame:
    """(column, type, rows, nulls, null_pct, n_unique, first) of every column; first is the value, as text, of the least `order` that has one.

    One pass for what is summed, one for the different values. Floating-point numbers are told apart as they are written.
    """
    aggs = [F.count("*").alias("_n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(c).alias(f"_c{i}"), F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_f{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("_n").alias("rows"), (F.col("_n") - F.col(f"_c{i}")).alias("nulls"), F.col(f"_f{i}").alias("first")) for i, (c, t) in enumerate(df.dtypes)])
    d = one.select(F.explode(rows).alias("r")).select("r.*").join(F.broadcast(distinct_counts(df)), "i", "left")  # a row for each column
    return d.withColumns({"n_unique": F.coalesce("n_unique", F.lit(0)), "null_pct": percent(F.col("nulls"), F.col("rows"))}).drop("i")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """df with place, from 1: a random order by md5 of seed and key, the same in every run. Places are counted by ranges of the hash, not in one task."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    d = df.withColumn("_h", h).withColumn("_range", F.substring("_h", 1, 3))
    counts = d.groupBy("_range").agg(F.count("*").alias("_c"))
    before = counts.select("_range", F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # 4,096 ranges
    inner = F.row_number().over(Window.partitionBy("_range").orderBy("_h", key))
    return d.withColumn("_in", inner).join(F.broadcast(before), "_range").withColumn("place", F.col("_in") + F.col("_before")).drop("_h", "_range", "_in", "_before")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    g = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return value_counts(df, column).orderBy(F.desc("n"), "value").limit(n)


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample deviation, min, quartiles, max."""
    d = df.agg(F.count(column).alias("count"), F.round(F.avg(column), 4).alias("mean"), F.round(F.stddev_samp(column), 4).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    return d.crossJoin(F.broadcast(quantiles(df, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, digits=4)))  # a row each


def fill_rate(df: DataFrame, columns: list[str], side: Column) -> DataFrame:
    """(column, side, filled_pct): the share of values that are neither null nor ''."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), (F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias("filled")) for c in columns])
    return df.select(side.alias("side"), F.explode(pairs).alias("p")).groupBy("p.column", "side").agg(percent(F.count_if("p.filled"), F.count("*")).alias("filled_pct"))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n) with margins, 'All' on either side."""
    g = df.cube(row, column).agg(F.grouping(row).alias("gr"), F.grouping(column).alias("gc"), F.count("*").alias("n"))
    name = lambda c, flag: F.when(F.col(flag) == 1, "All").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return g.select(name(row, "gr").alias(row), name(column, "gc").alias(column), "n")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys of the left, those also in the right, and the fraction, both ways."""
    def one(a: DataFrame, b: DataFrame, tag: str) -> DataFrame:
        k = a.select(key).distinct()
        return k.join(b.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").agg(F.count("*").alias(f"{tag}_keys"), F.count("_hit").alias(f"{tag}_covered"), rate(F.count("_hit"), F.count("*")).alias(f"{tag}_fraction"))

    return one(left, right, "left").crossJoin(F.broadcast(one(right, left, "right")))


def set_operations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(op, n): ids in both, in either alone, in any."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    parts = {"both": a.intersect(b), "left_only": a.subtract(b), "right_only": b.subtract(a), "any": a.union(b).distinct()}
    return reduce(DataFrame.unionAll, [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, d in parts.items()])


def date_range(df: DataFrame, column: str) -> DataFrame:
    d = F.col(column)
    return df.agg(F.min(d).cast("string").alias("first"), F.max(d).cast("string").alias("last"), F.datediff(F.max(d), F.min(d)).alias("span_days"), F.count_distinct(d).alias("distinct_days"))


def year_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.year(column).alias("year")).agg(F.count("*").alias("n"))


def temporal_overlap(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """One row: the share of test dates within the range of train, and at or before its end, with a verdict."""
    edge = train.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    d = test.select(F.col(column).alias("d")).crossJoin(F.broadcast(edge))
    inside, before = F.count_if(F.col("d").between(F.col("lo"), F.col("hi"))), F.count_if(F.col("d") <= F.col("hi"))
    r = d.agg(F.count("*").alias("rows"), rate(inside, F.count("*")).alias("inside"), rate(before, F.count("*")).alias("not_after"))
    return r.withColumn("verdict", F.when(F.col("not_after") >= 0.95, "overlapping").when(F.col("not_after") <= 0.05, "temporal split").otherwise("partial overlap"))


def sign_convention(df: DataFrame, side: str, kind: str, cents: str) -> DataFrame:
    """(side, kind, rows, negative_pct, positive_pct)."""
    c = F.col(cents)
    return df.groupBy(side, kind).agg(F.count("*").alias("rows"), percent(F.count_if(c < 0), F.count("*")).alias("negative_pct"), percent(F.count_if(c > 0), F.count("*")).alias("positive_pct"))


def label_completeness(stmt: DataFrame, solution: DataFrame) -> DataFrame:
    """One row: statement rows, with a label, blank, in the solution. Both: b_id, keys (null or empty is blank)."""
    d = stmt.select("b_id").join(solution.select("b_id", F.size(F.coalesce("keys", F.array().cast("array<string>"))).alias("n"), F.lit(True).alias("_in")), "b_id", "left")
    filled = F.count_if(F.col("n") > 0)
    return d.agg(F.count("*").alias("rows"), filled.alias("filled"), (F.count("*") - filled).alias("blank"), F.count("_in").alias("in_solution"), rate(filled, F.count("*")).alias("filled_rate"))


def encoding_share(labels: DataFrame, column: str) -> DataFrame:
    """One row: non-blank labels and the share that is bracketed."""
    t = F.trim(F.col(column))
    d = labels.filter(t != "")
    return d.agg(F.count("*").alias("labels"), F.count_if(t.startswith("[")).alias("bracketed"), percent(F.count_if(t.startswith("[")), F.count("*")).alias("bracketed_pct"))


def checks(facts: DataFrame) -> DataFrame:
    """Assumption checks (title, ok share) as a table: OK at 1, BROKEN below 0.9, NUANCED between. facts: title, share."""
    return facts.select("title", "share", F.when(F.col("share") >= 1, "OK").when(F.col("share") < 0.9, "BROKEN").otherwise("NUANCED").alias("status"))
