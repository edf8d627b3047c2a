"""Sensitivity of retrieval to the window of days and to the tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconloom.functions.amounts import TOLERANCES, percent
from reconloom.operators.blocking import ONE_SIDED, SYMMETRIC
from reconloom.operators.quantiles import quantiles


def window_table(pairs: DataFrame, gold: DataFrame, queries: DataFrame, windows=SYMMETRIC + ONE_SIDED) -> DataFrame:
    """For each window: rows, ceiling (a gold key survives), top-1 in gold, gold among the top five, match, abstained, precision.

    pairs: b_id, a_id, gap (days), allocation, score. queries: b_id. The answer is the best pair's key. The ends of all windows cut the gaps into
    elementary intervals, and a window is some of these. Of each interval only the best five pairs are kept, and whether any pair is true:
    the best five of a window are among the best fives of its intervals. One shuffle by statement row does all of it.
    """
    ends = sorted({e for _, lo, hi in windows for e in (lo, hi + 1)})
    at = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("gap")))
    true = F.coalesce(F.array_contains("gold", F.col("allocation")), F.lit(False))
    d = pairs.select("b_id", "a_id", "gap", "allocation", "score").join(gold, "b_id", "left").repartition("b_id")
    d = d.select("b_id", at.alias("at"), (-F.col("score")).alias("s"), "a_id", "allocation", true.alias("true"))
    cell = Window.partitionBy("b_id", "at")
    d = d.withColumns({"nth": F.row_number().over(cell.orderBy("s", "a_id", "allocation")), "any": F.max("true").over(cell)}).filter("nth <= 5")
    # Five for each interval at most, in the order of ranking.
    best = d.groupBy("b_id").agg(F.array_sort(F.collect_list(F.struct("s", "a_id", "allocation", "true", "at", "any"))).alias("p"))
    per = queries.join(gold, "b_id", "left").join(best, "b_id", "left").select(F.coalesce(F.size(F.coalesce("gold", F.array().cast("array<string>"))), F.lit(0)).alias("n_gold"), "p")
    each = []
    for _, lo, hi in windows:
        first, last = ends.index(lo) + 1, ends.index(hi + 1)
        inside = F.filter("p", lambda x: x["at"].between(first, last))  # noqa: B023
        five = F.exists(F.slice(inside, 1, 5), lambda x: x["true"])
        each.append(F.struct(F.get(inside, F.lit(0))["allocation"].alias("top"), F.get(inside, F.lit(0))["true"].alias("hit"), F.coalesce(five, F.lit(False)).alias("five"), F.coalesce(F.exists(inside, lambda x: x["any"]), F.lit(False)).alias("ceiling")))
    per = per.select("n_gold", F.posexplode(F.array(*each)).alias("ord", "w")).select("n_gold", "ord", "w.*")
    hit, none = F.coalesce("hit", F.lit(False)), F.col("top").isNull()
    match = F.when(none, F.col("n_gold") == 0).otherwise((F.col("n_gold") == 1) & hit)
    out = none & (F.col("n_gold") > 0)
    n = F.count("*")
    names = F.array(*[F.lit(name) for name, _, _ in windows])
    return per.groupBy("ord").agg(
        n.alias("rows"), F.count_if("ceiling").alias("ceiling"), F.count_if(hit).alias("top1"), F.count_if("five").alias("top5"), F.count_if(match).alias("match"), F.count_if(out).alias("abstained"), percent(F.count_if(match), n).alias("match_pct"), percent(F.count_if(match), n - F.count_if(out)).alias("precision_pct")
    ).withColumn("window", F.element_at(names, F.col("ord") + 1))


def deltas(table: DataFrame) -> DataFrame:
    """The change of each symmetric window against the one before."""
    w = Window.orderBy("ord")
    sym = table.filter(F.col("ord") < len(SYMMETRIC))
    return sym.select("ord", "window", "match", (F.col("match") - F.lag("match").over(w)).alias("match_delta"), (F.col("ceiling") - F.lag("ceiling").over(w)).alias("ceiling_delta"))


def verdict(table: DataFrame, chosen: str = "pm07", narrow: tuple[str, ...] = ("pm03", "pm05"), wide: tuple[str, ...] = ("pm14", "pm30")) -> DataFrame:
    """One row on the ceiling: at the chosen window, lost by narrowing, gained by widening, the knee, and plateau or edge.

    A plateau: neither changes the ceiling by a quarter of a point. The knee is the first window within 0.1 points of the best.
    """
    share = F.round(F.col("ceiling") * 100.0 / F.col("rows"), 3)
    sym = table.filter(F.col("ord") < len(SYMMETRIC)).withColumn("c", share)
    at = lambda names, f: f(F.when(F.col("window").isin(*names), F.col("c")))
    one = sym.agg(at((chosen,), F.max).alias("ceiling_pct"), at(narrow, F.min).alias("lo"), at(wide, F.max).alias("hi"), F.max("c").alias("best"))
    near = sym.crossJoin(F.broadcast(one)).filter("c >= best - 0.1").groupBy("ceiling_pct", "lo", "hi").agg(F.min_by("window", "ord").alias("knee"))
    lost, gained = F.round(F.col("ceiling_pct") - F.col("lo"), 3), F.round(F.col("hi") - F.col("ceiling_pct"), 3)
    return near.select("ceiling_pct", lost.alias("lost_narrowing"), gained.alias("gained_widening"), "knee", F.when((lost < 0.25) & (gained < 0.25), "plateau").otherwise("edge").alias("verdict"))


def gap_distribution(gaps: DataFrame) -> DataFrame:
    """One row: true pairs, before, same day and after, within 1, 3 and 7 days, percentiles of the absolute gap."""
    g = F.abs("gap")
    r = gaps.agg(F.count("*").alias("rows"), F.count_if(F.col("gap") < 0).alias("before"), F.count_if(F.col("gap") == 0).alias("same_day"), F.count_if(F.col("gap") > 0).alias("after"), *[F.count_if(g <= n).alias(f"within_{n}") for n in (1, 3, 7)])
    return r.crossJoin(F.broadcast(quantiles(gaps, g, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, digits=4)))  # a row each


def tolerance_table(flagged: DataFrame, gold: DataFrame, led: DataFrame, queries: DataFrame) -> DataFrame:
    """For each tolerance: pairs, rows with a candidate, rows whose gold survives. flagged: b_id, a_id and the in_ flags."""
    keys = flagged.join(led.select("a_id", "allocation"), "a_id").join(gold, "b_id", "left").withColumn("true", F.coalesce(F.array_contains("gold", F.col("allocation")), F.lit(False)))
    names = F.array(*[F.when(F.col(f"in_{n}"), F.lit(n)) for n, _, _ in TOLERANCES])
    d = keys.withColumn("tolerance", F.explode(F.filter(names, lambda x: x.isNotNull())))
    g = d.groupBy("tolerance", "b_id").agg(F.count("*").alias("n"), F.bool_or("true").alias("survives")).groupBy("tolerance").agg(F.sum("n").alias("pairs"), F.count("*").alias("with_candidate"), F.count_if("survives").alias("survives"))
    total = queries.agg(F.count("*").alias("queries"))
    return g.crossJoin(F.broadcast(total)).withColumns({"pool_mean": F.round(F.col("pairs") / F.col("queries"), 6), "ceiling_pct": percent(F.col("survives"), F.col("queries"))})


def tolerance_summary(counts: DataFrame, true: DataFrame, queries: DataFrame) -> DataFrame:
    """The table of `tolerance_table` from `blocking.tolerance_counts` of all ledger rows and of those with a gold key. A tolerance without any pair has no row."""
    one = lambda n, total, some: F.struct(F.lit(n).alias("tolerance"), F.sum(f"n_{n}").alias(total), F.count_if(F.col(f"n_{n}") > 0).alias(some)).alias(n)
    each = lambda d, *names: d.agg(*[one(n, *names) for n, _, _ in TOLERANCES]).select(F.explode(F.array(*[n for n, _, _ in TOLERANCES])).alias("t")).select("t.*")
    g = each(counts, "pairs", "with_candidate").join(F.broadcast(each(true, "_n", "survives").drop("_n")), "tolerance").filter("with_candidate > 0")  # six rows
    total = queries.agg(F.count("*").alias("queries"))
    return g.crossJoin(F.broadcast(total)).withColumns({"pool_mean": F.round(F.col("pairs") / F.col("queries"), 6), "ceiling_pct": percent(F.col("survives"), F.col("queries"))})


def flat_band(sweep: DataFrame, points: float = 0.02) -> DataFrame:
    """One row: the last threshold up to which the match rate stays within some points of the first one's. sweep: t, correct, rows."""
    w = Window.orderBy("t")
    first = F.first("correct").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = F.abs(F.col("correct") - first) <= F.floor(F.col("rows") * F.lit(points) / 100)
    d = sweep.withColumn("near", near).withColumn("flat", F.bool_and("near").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.agg(F.min("t").alias("from_t"), F.max(F.when(F.col("flat"), F.col("t"))).alias("to_t"))
