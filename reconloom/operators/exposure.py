"""Value-weighted measures over decisions.

decided: b_id, b_cents, escalate, ok (answer equals label), exception_class, triggers, top1, margin, ...
Exposure of a row is its absolute amount. A wrong automatic close and an escalation expose all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconloom.functions.amounts import amount_bucket, magnitude, magnitude_label, percent
from reconloom.operators.decide import TRIGGERS

#: Percents of the queue at which the curve is read.
DECILES = (1, 5, 10, 25, 50, 75, 100)


def headline(decided: DataFrame) -> DataFrame:
    """One row: rows and value closed, correct, wrong and escalated; precision by rows and by value."""
    v, auto, ok = F.abs("b_cents"), ~F.col("escalate"), F.col("ok")
    s = lambda c: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    n = F.count_if
    return decided.agg(
        F.count("*").alias("rows"),
        n(auto).alias("auto_rows"),
        n(auto & ok).alias("auto_correct_rows"),
        n(auto & ~ok).alias("auto_wrong_rows"),
        F.coalesce(F.sum(v), F.lit(0)).alias("total_cents"),
        s(auto).alias("auto_cents"),
        s(auto & ok).alias("auto_correct_cents"),
        s(auto & ~ok).alias("exposure_cents"),
        s(~auto).alias("queue_cents"),
        percent(n(auto & ok), n(auto)).alias("precision_by_rows"),
        percent(s(auto & ok), s(auto)).alias("precision_by_value"),
    )


def queue_by_class(decided: DataFrame) -> DataFrame:
    v, ok = F.abs("b_cents"), F.col("ok")
    g = decided.filter("escalate").groupBy("exception_class").agg(
        F.count("*").alias("rows"), F.sum(v).alias("exposure_cents"), F.coalesce(F.sum(F.when(ok, v)), F.lit(0)).alias("would_be_correct_cents"), F.coalesce(F.sum(F.when(~ok, v)), F.lit(0)).alias("would_be_wrong_cents")
    )
    return g.withColumn("pct_of_queue", percent(F.col("exposure_cents"), F.sum("exposure_cents").over(Window.partitionBy())))


def queue_by_trigger(decided: DataFrame) -> DataFrame:
    """As by class, for each trigger (a row counts for all that fired; triggers that never fired have zeros), with a verdict."""
    v, ok = F.abs("b_cents"), F.col("ok")
    own = decided.filter("escalate").withColumn("trigger", F.explode("triggers")).groupBy("trigger").agg(
        F.count("*").alias("rows"), F.count_if(ok).alias("correct_rows"), F.sum(v).alias("exposure_cents"), F.coalesce(F.sum(F.when(ok, v)), F.lit(0)).alias("would_be_correct_cents")
    )
    dim = decided.sparkSession.createDataFrame([(t,) for t in TRIGGERS], "trigger string")
    d = dim.join(own, "trigger", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rows", "correct_rows", "exposure_cents", "would_be_correct_cents")})
    share = F.col("correct_rows") * 100
    verdict = F.when(F.col("rows") == 0, "never fired").when(share >= 50 * F.col("rows"), "COSTING COVERAGE").when(share <= 20 * F.col("rows"), "earning its keep").otherwise("mixed")
    return d.withColumn("verdict", verdict)


def ranked_queue(decided: DataFrame) -> DataFrame:
    """Escalated rows by exposure, ranked from 1; ties to the smaller b_id.

    Ranks over the whole queue come from a range sort: ranks within a range of exposures plus the counts of the ranges above.
    """
    q = decided.filter("escalate").withColumn("exposure_cents", F.abs("b_cents"))
    return global_rank(q, [F.desc("exposure_cents"), F.asc("b_id")], magnitude_of="exposure_cents")


#: Rows in a range of ranks, and ranges at most.
RANGE_ROWS, MOST_RANGES = 100_000, 256


def global_rank(df: DataFrame, order: list, magnitude_of: str, name: str = "rank") -> DataFrame:
    """Row numbers over all rows without bringing them to one task: rows are cut into ranges of the order and counted.

    order must begin with `magnitude_of`, descending, then b_id, ascending. Range ends are taken from approximate quantiles of
    the value, so ranges hold near-equal numbers of rows however many there are; within a range of one
    value b_id is cut as well. The number of ranges follows the rows, one for each RANGE_ROWS.
    """
    fractions = [i / MOST_RANGES for i in range(1, MOST_RANGES)]
    v = F.col(magnitude_of)
    seen = df.agg(F.count("*").alias("n"), F.percentile_approx(v, fractions, 10_000).alias("q"), F.min("b_id").alias("low"), F.max("b_id").alias("high")).collect()[0]  # one row
    parts = max(1, min(MOST_RANGES, seen["n"] // RANGE_ROWS))
    ends = sorted({seen["q"][i * MOST_RANGES // parts - 1] for i in range(1, parts)})
    at_end = v.isin(ends) if ends else F.lit(False)
    # A value with very many rows is an end, and its rows, in order of b_id, are cut by that. They are the last of their range, as the order is descending.
    width = F.lit(max(1.0, ((seen["high"] or 0) - (seen["low"] or 0) + 1) / parts))
    d = df.withColumns({"_part": _range_of(v, ends), "_at_end": at_end.cast("int"), "_sub": F.when(at_end, F.floor((F.col("b_id") - F.lit(seen["low"] or 0)) / width)).otherwise(0)})
    keys = ["_part", "_at_end", "_sub"]
    counts = d.groupBy(*keys).agg(F.count("*").alias("_n"))
    above = counts.withColumn("_above", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_part"), "_at_end", "_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return inner.join(F.broadcast(above.select(*keys, "_above")), keys).withColumn(name, F.col("_r") + F.col("_above")).drop("_r", "_above", *keys)  # a few times MOST_RANGES rows at most


def _range_of(value: Column, ends: list) -> Column:
    """How many of the sorted ends are at most the value, by bisection."""
    if not ends:
        return F.lit(0)
    m = len(ends) // 2
    return F.when(value < ends[m], _range_of(value, ends[:m])).otherwise(m + 1 + _range_of(value, ends[m + 1 :]))


def cumulative(df: DataFrame, rank: str, value: str, name: str, chunk: int = 4096, keys: tuple[str, ...] = ()) -> DataFrame:
    """Running sum of value by rank, from sums of chunks of ranks and running sums within a chunk."""
    d = df.withColumn("_chunk", F.floor((F.col(rank) - 1) / chunk))
    sums = d.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inner = F.sum(value).over(Window.partitionBy(*keys, "_chunk").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_in", inner).join(before, [*keys, "_chunk"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before", "_chunk")


def retired_curve(queue: DataFrame) -> DataFrame:
    """(pct, rows_reviewed, retired_pct): the share of exposure in the top pct % of a ranked queue; row counts round half to even."""
    d = cumulative(queue.select("rank", "exposure_cents"), "rank", "exposure_cents", "cum")
    total = d.agg(F.count("*").alias("n"), F.sum("exposure_cents").alias("total"))
    points = total.withColumn("pct", F.explode(F.array(*map(F.lit, DECILES)))).withColumn("rank", F.greatest(F.lit(1), F.bround(F.col("n") * F.col("pct") / F.lit(100.0), 0).cast("long")))
    return d.join(F.broadcast(points), "rank").select("pct", F.col("rank").alias("rows_reviewed"), percent(F.col("cum"), F.col("total")).alias("retired_pct"))


def random_curve(queue: DataFrame, permutations: int = 20) -> DataFrame:
    """(pct, mean_pct, sd_pct): the same under orders by md5 of permutation and b_id; population deviation.

    Ranges of hashes are counted and summed; only the rows of the ranges that a point falls in, a few of thousands, are put in order and move.
    """
    reps = queue.select("b_id", "exposure_cents").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    h = F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col("b_id").cast("string")))
    d = reps.withColumn("h", h).withColumn("range", F.substring("h", 1, 3))
    counts = d.groupBy("rep", "range").agg(F.count("*").alias("c"), F.sum("exposure_cents").alias("s"))
    back = Window.partitionBy("rep").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("rep", "range", F.col("c").alias("own"), F.coalesce(F.sum("c").over(back), F.lit(0)).alias("c0"), F.coalesce(F.sum("s").over(back), F.lit(0)).alias("s0"))
    total = queue.agg(F.count("*").alias("n"), F.sum("exposure_cents").alias("total"))
    points = total.withColumn("pct", F.explode(F.array(*map(F.lit, DECILES)))).withColumn("rank", F.greatest(F.lit(1), F.bround(F.col("n") * F.col("pct") / F.lit(100.0), 0).cast("long")))
    at = before.join(F.broadcast(points), (F.col("rank") > F.col("c0")) & (F.col("rank") <= F.col("c0") + F.col("own"))).groupBy("rep", "range", "c0", "s0").agg(F.collect_list(F.struct("pct", "rank", "total")).alias("points"))  # at most a row a point and permutation
    w = Window.partitionBy("rep", "range").orderBy("h", "b_id")
    few = d.join(F.broadcast(at), ["rep", "range"])
    e = few.withColumn("c", F.row_number().over(w)).withColumn("s", F.sum("exposure_cents").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.select((F.col("c") + F.col("c0")).alias("place"), (F.col("s") + F.col("s0")).alias("cum"), F.explode("points").alias("p")).filter("place = p.rank")
    share = F.col("cum") * 100.0 / F.col("p.total")
    return e.groupBy(F.col("p.pct").alias("pct")).agg(F.round(F.avg(share), 3).alias("mean_pct"), F.round(F.stddev_pop(share), 3).alias("sd_pct"))


def magnitude_table(decided: DataFrame) -> DataFrame:
    """By power of ten of the amount: rows, value, escalation rate, precision of what was closed."""
    auto, ok = ~F.col("escalate"), F.col("ok")
    g = decided.groupBy(magnitude("b_cents").alias("exp10")).agg(
        F.count("*").alias("rows"), F.sum(F.abs("b_cents")).alias("value_cents"), percent(F.count_if("escalate"), F.count("*")).alias("escalation_pct"), F.count_if(auto).alias("auto_rows"), percent(F.count_if(auto & ok), F.count_if(auto)).alias("precision_pct")
    )
    return g.withColumn("pct_of_rows", percent(F.col("rows"), F.sum("rows").over(Window.partitionBy()))).withColumn("bucket", magnitude_label("exp10"))


def magnitude_slope(table: DataFrame, min_rows: int = 30, min_buckets: int = 3) -> DataFrame:
    """One row: the slope of precision over the number of the bucket, of buckets with enough rows; null if they are too few."""
    solid = table.filter((F.col("auto_rows") >= min_rows) & F.col("precision_pct").isNotNull()).withColumn("x", F.row_number().over(Window.orderBy("exp10")) - 1)
    return solid.agg(F.count("*").alias("buckets"), F.round(F.when(F.count("*") >= min_buckets, F.regr_slope("precision_pct", "x")), 6).alias("slope"))


def amount_table(decided: DataFrame) -> DataFrame:
    """Rows and value by fixed amount bucket."""
    number, label = amount_bucket("b_cents")
    return decided.groupBy(number.alias("bucket_ord"), label.alias("bucket")).agg(F.count("*").alias("rows"), F.sum(F.abs("b_cents")).alias("value_cents"))


def search_queue(queue: DataFrame, kind: str | None = None, text: str = "") -> DataFrame:
    """Queue rows of a class whose id, class or triggers contain a text, whatever the case."""
    t = F.lit(text.lower())
    hit = F.contains(F.lower(F.col("b_id").cast("string")), t) | F.contains(F.lower("exception_class"), t) | F.exists("triggers", lambda x: F.contains(F.lower(x), t))
    return queue.filter(hit if kind is None else hit & (F.col("exception_class") == kind))


def pages(queue: DataFrame, size: int = 1000) -> DataFrame:
    return queue.withColumn("page", F.floor((F.col("rank") - 1) / size).cast("int"))


def stratified_sample(queue: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows taken in turn from each exception class, within a class by md5 of seed and id."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b_id").cast("string")))
    d = queue.withColumn("h", h).withColumn("turn", F.row_number().over(Window.partitionBy("exception_class").orderBy("h", "b_id"))).filter(F.col("turn") <= n)
    return d.orderBy("turn", "exception_class").limit(n)


def batch_shares(decided: DataFrame) -> DataFrame:
    """(part, cents, share_pct): what of the batch's value was closed rightly, wrongly, or waits in the queue."""
    h = headline(decided)
    parts = F.array(*[F.struct(F.lit(n).alias("part"), F.col(c).alias("cents")) for n, c in (("closed", "auto_cents"), ("closed rightly", "auto_correct_cents"), ("closed wrongly", "exposure_cents"), ("queue", "queue_cents"))])
    return h.select("total_cents", F.explode(parts).alias("p")).select("p.part", "p.cents", percent(F.col("p.cents"), F.col("total_cents")).alias("share_pct"))


def ticker(decided: DataFrame, n: int = 5) -> DataFrame:
    """(kind, place, name, figure, more): the lines of a ticker: the first n of the queue, its classes by value, and precision by rows and by value."""
    text = lambda c: F.upper(F.replace(c, F.lit("_"), F.lit(" ")))
    top = ranked_queue(decided).filter(F.col("rank") <= n).select(F.lit("queue").alias("kind"), F.col("rank").cast("long").alias("place"), text(F.col("exception_class")).alias("name"), F.col("exposure_cents").cast("double").alias("figure"), F.lit(None).cast("double").alias("more"))
    queue = decided.filter("escalate").groupBy("exception_class").agg(F.count("*").alias("rows"), F.sum(F.abs("b_cents")).alias("v"))
    place = F.row_number().over(Window.orderBy(F.desc("v"), "exception_class")).cast("long")  # a row a class
    classes = queue.select(F.lit("class").alias("kind"), place.alias("place"), text(F.col("exception_class")).alias("name"), F.col("v").cast("double").alias("figure"), F.col("rows").cast("double").alias("more"))
    last = headline(decided).select(F.lit("precision").alias("kind"), F.lit(1).cast("long").alias("place"), F.lit("AUTO-CLOSE PRECISION").alias("name"), F.col("precision_by_rows").alias("figure"), F.col("precision_by_value").alias("more"))
    return top.unionByName(classes).unionByName(last)
