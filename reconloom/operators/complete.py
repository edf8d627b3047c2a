"""Set completion: which further keys of the top candidates belong to the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconloom.functions.text import shares_run

FEATURES = ("rank", "score", "score_gap", "score_ratio", "log_diff", "log_diff_top", "log_diff_sum", "same_amount", "day_gap", "same_date", "shares_query_run", "shares_top_run", "distinct_keys", "candidates", "log_length")


def features(ranked: DataFrame) -> DataFrame:
    """One row for each distinct key of the top candidates other than the first one's, at its first rank, with 15 features."""
    w = Window.partitionBy("b_id").orderBy("rank")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(c).over(whole)
    d = ranked.select(
        "*",
        first("allocation").alias("top_key"),
        first("score").alias("top_score"),
        first("a_cents").alias("top_cents"),
        first("a_vd").alias("top_vd"),
        first("a_text").alias("top_text"),
        F.size(F.collect_set("allocation").over(whole)).alias("distinct_keys"),
        F.count("*").over(whole).alias("candidates"),
        F.row_number().over(Window.partitionBy("b_id", "allocation").orderBy("rank")).alias("_nth"),
    ).filter("_nth = 1 and allocation <> top_key")
    return _measured(d)


def features_of(nested: DataFrame, text) -> DataFrame:
    """The same of candidates in arrays, in the order of rank: nested: b_id, b_cents, b_vd, b_attrs, candidates (rank, a_id, score, amount_cents, ref, allocation, vd). text: function of a candidate's ref and allocation."""
    d = nested.withColumn("_keys", F.col("candidates.allocation")).select("b_id", "b_cents", "b_vd", "b_attrs", F.get("candidates", F.lit(0)).alias("_top"), F.size(F.array_distinct("_keys")).alias("distinct_keys"), F.size("candidates").alias("candidates"), "_keys", F.explode_outer("candidates").alias("c"))  # outer: else a filter on the array is made, which evaluates it again
    d = d.filter((F.col("c.allocation") != F.col("_top.allocation")) & (F.array_position("_keys", F.col("c.allocation")) == F.col("c.rank")))
    t = "_top"
    d = d.select(
        "b_id", "b_cents", "b_vd", "b_attrs", "distinct_keys", "candidates", "c.allocation", "c.a_id", "c.rank", "c.score", F.col("c.amount_cents").alias("a_cents"), F.col("c.vd").alias("a_vd"), text(F.col("c.ref"), F.col("c.allocation")).alias("a_text"),
        F.col(f"{t}.score").alias("top_score"), F.col(f"{t}.amount_cents").alias("top_cents"), F.col(f"{t}.vd").alias("top_vd"), text(F.col(f"{t}.ref"), F.col(f"{t}.allocation")).alias("top_text"),
    )
    return _measured(d)


def _measured(d: DataFrame) -> DataFrame:
    """The 15 features of further keys beside the top one."""
    log_diff = lambda c: F.log1p(F.abs(c).cast("double"))
    a, b, t = F.col("a_cents"), F.col("b_cents"), F.col("top_cents")
    return d.select(
        "b_id",
        F.col("allocation").alias("key"),
        "a_id",
        "rank",
        "score",
        (F.col("top_score") - F.col("score")).alias("score_gap"),
        F.when(F.col("top_score") > 0, F.col("score") / F.col("top_score")).otherwise(0.0).alias("score_ratio"),
        log_diff(a - b).alias("log_diff"),
        log_diff(t - b).alias("log_diff_top"),
        log_diff(a + t - b).alias("log_diff_sum"),
        (a == t).cast("int").alias("same_amount"),
        F.datediff("a_vd", "b_vd").alias("day_gap"),
        (F.col("a_vd") == F.col("top_vd")).cast("int").alias("same_date"),
        shares_run("b_attrs", "a_text").cast("int").alias("shares_query_run"),
        shares_run("top_text", "a_text").cast("int").alias("shares_top_run"),
        "distinct_keys",
        F.col("candidates").cast("int").alias("candidates"),
        F.log1p(F.length("a_text").cast("double")).alias("log_length"),
    )


def rule_probability() -> Column:
    """A stand-in for a classifier, in whole percents so that thresholds compare exactly."""
    return (20 * F.col("same_amount") + 25 * F.col("same_date") + 30 * F.col("shares_query_run") + 15 * F.col("shares_top_run") + F.least(F.lit(10), F.floor(F.col("score") * 10))).cast("int")


def accepted_keys(feats: DataFrame, percent: Column, threshold: int = 50) -> DataFrame:
    """(b_id, added): keys at or above the threshold in rank order, with their percents."""
    rows = feats.withColumn("p", percent).filter(F.col("p") >= threshold)
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("key").alias("allocation_key"), F.col("p").alias("percent"))))  # at most four
    return rows.groupBy("b_id").agg(ordered.alias("added"))


#: A threshold above every percent: completion is off.
OFF = 200


def correct_between(feats: DataFrame, percent: Column, tops: DataFrame, gold: DataFrame) -> DataFrame:
    """(b_id, gold, above, upto): the thresholds at which a row's answer is its label: those over `above` up to `upto`; none if upto <= above.

    tops: every b_id with its top key or null. A key is in the answer at thresholds up to its percent. So the answer is right from the
    percent of the surest wrong key on, to that of the least sure right one. A row is read once, whatever the number of thresholds.
    """
    keys = feats.withColumn("p", percent).groupBy("b_id").agg(F.collect_list(F.struct("key", "p")).alias("found"))  # at most four
    none = F.array().cast("array<string>")
    d = tops.join(gold, "b_id", "left").withColumn("gold", F.coalesce("gold", none)).join(keys, "b_id", "left")
    found = F.coalesce("found", F.array().cast("array<struct<key:string,p:int>>"))
    wrong = F.array_max(F.transform(F.filter(found, lambda x: ~F.array_contains("gold", x["key"])), lambda x: x["p"]))
    rest = F.array_except("gold", F.array("top_key"))
    of = lambda g: F.coalesce(F.array_max(F.transform(F.filter(found, lambda x: x["key"] == g), lambda x: x["p"])), F.lit(-1))
    least = F.array_min(F.transform(rest, of))
    never, always = F.lit(-1), F.lit(1 << 20)
    upto = F.when(F.col("top_key").isNull(), F.when(F.size("gold") == 0, always).otherwise(never)).when(~F.array_contains("gold", F.col("top_key")), never).otherwise(F.coalesce(least, always))
    above = F.when(F.col("top_key").isNull(), never).otherwise(F.coalesce(wrong, never))
    return d.select("b_id", "gold", above.cast("int").alias("above"), upto.cast("int").alias("upto"))


def right_at(t: int | Column) -> Column:
    """Whether a row of `correct_between` is right at a threshold."""
    t = F.lit(t) if isinstance(t, int) else t
    return (F.col("above") < t) & (t <= F.col("upto"))


def sweep(intervals: DataFrame, thresholds: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, t, correct, rows, gained, lost): at each threshold, how many rows are right, and how many only with or only without completion.

    Rows are counted by where among the thresholds their interval begins and ends; only this table, of a few dozen rows a group, meets
    the thresholds.
    """
    ts = sorted(thresholds)
    place = lambda c: F.size(F.filter(F.array(*[F.lit(t) for t in ts]), lambda t: t <= F.col(c)))
    bins = intervals.groupBy(*by, place("above").alias("i"), place("upto").alias("j"), right_at(OFF).alias("off")).agg(F.count("*").alias("n"))
    at = bins.select("*", F.posexplode(F.array(*[F.lit(t) for t in ts])).alias("k", "t"))
    on = (F.col("i") <= F.col("k")) & (F.col("k") < F.col("j"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return at.groupBy(*by, "t").agg(n(on).alias("correct"), F.sum("n").alias("rows"), n(on & ~F.col("off")).alias("gained"), n(~on & F.col("off")).alias("lost"))


def answers(feats: DataFrame, percent: Column, tops: DataFrame, t: int) -> DataFrame:
    """(b_id, keys): the sorted answer of each row at one threshold."""
    added = feats.withColumn("p", percent).filter(F.col("p") >= t).groupBy("b_id").agg(F.collect_set("key").alias("added"))  # at most four
    none = F.array().cast("array<string>")
    answer = F.when(F.col("top_key").isNull(), none).otherwise(F.array_union(F.array("top_key"), F.coalesce("added", none)))
    return tops.join(added, "b_id", "left").select("b_id", F.array_sort(answer).alias("keys"))


def operating_points(swept: DataFrame, shipped: int = 50, points: float = 0.02) -> DataFrame:
    """(t, match_pct, against_off, shipped, in_band) of a `sweep` that has OFF: in_band while the rate stays within some points of the first one's."""
    off = F.broadcast(swept.filter(F.col("t") == OFF).select(F.col("correct").alias("o"), F.col("rows").alias("n")))  # one row
    w = Window.orderBy("t")  # a row for each threshold
    on = swept.filter(F.col("t") != OFF).crossJoin(off)
    near = F.abs(F.col("correct") - F.first("correct").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) <= F.floor(F.col("rows") * F.lit(points) / 100)
    flat = on.withColumn("near", near).withColumn("in_band", F.bool_and("near").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return flat.select("t", F.round(F.col("correct") * 100.0 / F.col("rows"), 3).alias("match_pct"), F.round((F.col("correct") - F.col("o")) * 100.0 / F.col("n"), 3).alias("against_off"), (F.col("t") == shipped).alias("shipped"), "in_band")
