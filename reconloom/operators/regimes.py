"""Groups of ledger rows: their shape, how they add up to the statement, and whether keys rebuild them.

groups: b_id, b_cents, group (the ledger rows that truly belong, as a_id), with one row for each ledger row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconloom.functions.amounts import percent, rate
from reconloom.functions.keys import canonical
from reconloom.functions.text import shares_run
from reconloom.operators.quantiles import quantiles


def regime(total: Column, equal: Column, b_cents: Column) -> Column:
    """partition (the rows sum to the amount) before repeat (a row has the amount) before neither; within a cent."""
    return F.when(F.abs(total - b_cents) <= 1, "partition").when(equal >= 1, "repeat").otherwise("neither")


def group_sums(members: DataFrame) -> DataFrame:
    """members: b_id, b_cents, a_id, a_cents. One row for each b_id: n_a, n_equal, total, regime, residual."""
    g = members.groupBy("b_id", "b_cents").agg(F.count("*").alias("n_a"), F.count_if(F.abs(F.col("a_cents") - F.col("b_cents")) <= 1).alias("n_equal"), F.sum("a_cents").alias("total"))
    return g.withColumns({"regime": regime(F.col("total"), F.col("n_equal"), F.col("b_cents")), "residual": F.abs(F.col("total") - F.col("b_cents"))})


def residuals_by_shape(groups: DataFrame) -> DataFrame:
    """By number of ledger rows (4 stands for more): how far sums are from the amount: exact to a cent, within one unit, median, 95th percentile, largest."""
    r, d = F.col("residual"), groups.withColumn("shape", F.least("n_a", F.lit(4)))
    sums = d.groupBy("shape").agg(F.count("*").alias("rows"), percent(F.count_if(r <= 1), F.count("*")).alias("exact_pct"), percent(F.count_if(r <= 100), F.count("*")).alias("within_unit_pct"), F.max(r).alias("largest"))
    return sums.join(quantiles(d, "residual", {"median": 0.5, "p95": 0.95}, ["shape"], 4), "shape")


def regime_shares(groups: DataFrame) -> DataFrame:
    g = groups.groupBy("regime").agg(F.count("*").alias("rows"))
    return g.withColumn("pct", percent(F.col("rows"), F.sum("rows").over(Window.partitionBy()), 2))


def rebuilt(gold: DataFrame, led: DataFrame) -> DataFrame:
    """(b_id, a_id): every ledger row that carries a key of the label, once."""
    return gold.select("b_id", F.explode("gold").alias("allocation")).join(led, "allocation").select("b_id", "a_id", "a_cents").distinct()


def reconstruction(true: DataFrame, again: DataFrame) -> DataFrame:
    """One row for each b_id of true: sets exact, over or under, and the regime of both. true, again: b_id, b_cents, a_id, a_cents."""
    tags = ("true", "rebuilt")
    one = lambda d, tag: d.select("b_id", "b_cents", "a_id", "a_cents", *[F.lit(int(t == tag)).alias(t) for t in tags])
    equal = F.when(F.abs(F.col("a_cents") - F.col("b_cents")) <= 1, 1).otherwise(0)
    # Sets are compared by counts: of ledger rows on either side and on both. Dealt by b_id once, nothing is gathered.
    sums = [F.max("b_cents").alias("b_cents"), *[F.sum(c).alias(f"{n}_{t}") for t in tags for n, c in (("n", F.col(t)), ("equal", F.col(t) * equal), ("total", F.col(t) * F.col("a_cents")))]]
    rows = one(true, "true").unionAll(one(again, "rebuilt")).repartition("b_id").groupBy("b_id", "a_id").agg(*sums)
    t, r = F.col("n_true") > 0, F.col("n_rebuilt") > 0
    again_ = [F.sum(c).alias(c) for c in rows.columns if c.startswith(("n_", "equal_", "total_"))]
    d = rows.groupBy("b_id").agg(F.max("b_cents").alias("b_cents"), *again_, F.count_if(t).alias("own"), F.count_if(r).alias("found"), F.count_if(t & r).alias("both")).filter("own > 0")
    kind = F.when((F.col("both") == F.col("own")) & (F.col("both") == F.col("found")), "exact").when(F.col("found") > F.col("own"), "over").otherwise("under")
    regimes = [F.when(F.col(f"n_{t}") > 0, regime(F.col(f"total_{t}"), F.col(f"equal_{t}"), F.col("b_cents"))).alias(f"regime_{t}") for t in tags]
    return d.select("b_id", kind.alias("sets"), *regimes, *[F.bround(F.try_divide(f"equal_{t}", f"n_{t}"), 1).alias(f"fraction_{t}") for t in tags])


def confusion(recon: DataFrame) -> DataFrame:
    return recon.groupBy("regime_true", "regime_rebuilt", "sets").agg(F.count("*").alias("rows"))


def fraction_histogram(recon: DataFrame) -> DataFrame:
    """Share of groups by fraction of rows at the very amount, for true and rebuilt groups, and the difference."""
    def side(tag: str) -> DataFrame:
        g = recon.groupBy(F.col(f"fraction_{tag}").alias("fraction")).agg(F.count("*").alias("n"))
        return g.select("fraction", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2).alias(f"pct_{tag}"))

    d = side("true").join(side("rebuilt"), "fraction", "full").na.fill(0.0, ["pct_true", "pct_rebuilt"])
    return d.withColumn("error", F.round(F.col("pct_rebuilt") - F.col("pct_true"), 2))


def shapes(stmt: DataFrame, members: DataFrame) -> DataFrame:
    """(shape, groups, exact, within_100, residual median, p95, max): groups by 'nA:nB', numbers from 3 and 10 up clipped."""
    n = members.groupBy("b_id").agg(F.count("*").alias("n_a"), F.sum("a_cents").alias("total"))
    d = stmt.select("b_id", "b_cents").join(n, "b_id", "full").na.fill(0, ["n_a", "total"])
    clip = F.when(F.col("n_a") >= 10, "10+").when(F.col("n_a") >= 3, "3+").otherwise(F.col("n_a").cast("string"))
    d = d.select(F.concat(clip, F.lit(":1")).alias("shape"), F.abs(F.col("total") - F.col("b_cents")).alias("r"))
    r = F.col("r")
    g = d.groupBy("shape").agg(F.count("*").alias("groups"), F.count_if(r <= 1).alias("exact"), F.count_if(r <= 100).alias("within_100"), F.max(r).alias("residual_max"))
    return g.join(quantiles(d, "r", {"residual_median": 0.5, "residual_p95": 0.95}, ["shape"], 3), "shape")


def one_sided(stmt: DataFrame, members: DataFrame) -> DataFrame:
    """One row: groups, those without ledger rows, those without statement row."""
    n = members.groupBy("b_id").agg(F.count("*").alias("n_a"))
    d = stmt.select("b_id", F.lit(1).alias("n_b")).join(n, "b_id", "full")
    return d.agg(F.count("*").alias("groups"), F.count_if(F.col("n_a").isNull()).alias("statement_only"), F.count_if(F.col("n_b").isNull()).alias("ledger_only"))


def label_consistency(groups: DataFrame) -> DataFrame:
    """groups: match_id, keys. One row: groups, those with one key set, key sets, those of one group."""
    d = groups.select("match_id", F.array_join(canonical("keys"), ",").alias("k"))
    a = d.groupBy("match_id").agg(F.count_distinct("k").alias("n")).agg(F.count("*").alias("groups"), F.count_if(F.col("n") == 1).alias("groups_with_one_set"))
    b = d.groupBy("k").agg(F.count_distinct("match_id").alias("n")).agg(F.count("*").alias("sets"), F.count_if(F.col("n") == 1).alias("sets_of_one_group"))
    return a.crossJoin(F.broadcast(b))


def label_sets(gold: DataFrame, members: DataFrame) -> DataFrame:
    """One row: labels, equal to the group's key set, contained in it. gold: b_id, gold; members: b_id, allocation."""
    own = members.groupBy("b_id").agg(F.collect_set("allocation").alias("own"))
    d = gold.join(own, "b_id", "left")
    none = F.array().cast("array<string>")
    o = F.coalesce("own", none)
    return d.agg(F.count("*").alias("labels"), F.count_if(canonical("gold") == canonical(o)).alias("equal"), F.count_if(F.size(F.array_except("gold", o)) == 0).alias("contained"))


def set_sizes(splits: DataFrame) -> DataFrame:
    """splits: split, keys. (split, bucket, rows, pct): label set sizes 0 to 3 and 4+, with the largest and those over 15."""
    n = F.size(canonical("keys"))
    b = F.when(n >= 4, "4+").otherwise(n.cast("string"))
    g = splits.groupBy("split", b.alias("bucket")).agg(F.count("*").alias("rows"), F.max(n).alias("largest"), F.count_if(n > 15).alias("over_15"))
    return g.withColumn("pct", percent(F.col("rows"), F.sum("rows").over(Window.partitionBy("split")), 2))


def step_one(ranked: DataFrame, gold: DataFrame, led: DataFrame, stmt: DataFrame) -> DataFrame:
    """One row about labels of several keys: what their further keys' ledger rows have in common with the first answer."""
    multi = gold.filter(F.size("gold") >= 2)
    top = ranked.filter("rank = 1").select("b_id", F.col("allocation").alias("top_key"))
    d = multi.join(top, "b_id").filter(F.array_contains("gold", F.col("top_key"))).join(stmt.select("b_id", "b_cents"), "b_id")
    rows = d.select("b_id", "b_cents", "top_key", F.explode("gold").alias("allocation")).join(led.select("allocation", "a_cents", "a_vd", "a_id", "a_text"), "allocation")
    is_top = F.col("allocation") == F.col("top_key")
    per = rows.groupBy("b_id", "b_cents").agg(F.sum("a_cents").alias("all_cents"), F.coalesce(F.sum(F.when(is_top, F.col("a_cents"))), F.lit(0)).alias("top_cents"), F.min_by("a_vd", F.when(is_top, F.col("a_id"))).alias("top_vd"), F.min_by("a_text", F.when(is_top, F.col("a_id"))).alias("top_text"))
    extra = rows.filter(~is_top).groupBy("b_id", "allocation").agg(F.min_by("a_vd", "a_id").alias("vd"), F.min_by("a_text", "a_id").alias("text")).join(per.select("b_id", "top_vd", "top_text"), "b_id")
    second = ranked.join(top, "b_id").filter(F.col("allocation") != F.col("top_key")).groupBy("b_id").agg(F.min_by("allocation", "rank").alias("second"))
    s = d.join(second, "b_id").agg(F.count("*").alias("with_second"), F.count_if(F.array_contains("gold", F.col("second"))).alias("second_in_gold"))
    gap = lambda c: F.abs(F.col(c) - F.col("b_cents"))
    p = per.agg(F.count("*").alias("top_in_gold"), F.count_if(gap("all_cents") <= 1).alias("sum_exact"), F.count_if(gap("top_cents") <= 1).alias("top_exact"), F.count_if(gap("all_cents") < gap("top_cents")).alias("sum_closer"))
    e = extra.agg(F.count("*").alias("extra_keys"), F.count_if(F.col("vd") == F.col("top_vd")).alias("same_date"), F.count_if(shares_run("top_text", "text")).alias("shares_run"))
    return multi.agg(F.count("*").alias("multi_key")).crossJoin(F.broadcast(p)).crossJoin(F.broadcast(e)).crossJoin(F.broadcast(s))


def pool_stats(sizes: DataFrame, column: str) -> DataFrame:
    """One row: queries, mean and median of all and of non-empty pools, empty pools."""
    c = F.col(column)
    one = sizes.agg(F.count("*").alias("queries"), F.round(F.avg(c), 6).alias("mean"), F.count_if(c == 0).alias("empty"), F.round(F.avg(F.when(c > 0, c)), 6).alias("mean_nonempty"), rate(F.count_if(c > 0), F.count("*")).alias("nonempty_rate"))
    return one.crossJoin(F.broadcast(quantiles(sizes, column, {"median": 0.5})))  # a row each


def worked_examples(members: DataFrame, by: str = "regime") -> DataFrame:
    """The first group of each regime (or shape: its number of rows, 4 for more) among those of several rows, with all its ledger rows, their sum and residual."""
    g = group_sums(members).filter("n_a >= 2").withColumn("shape", F.least("n_a", F.lit(4)))
    first = g.groupBy(by).agg(F.min("b_id").alias("b_id"))
    return g.join(first, [by, "b_id"]).select(by, "b_id", "total", "residual").join(members.select("b_id", "b_cents", "a_id", "a_cents"), "b_id")
