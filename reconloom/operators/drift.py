"""Signed balance drift of automatic closes, priced over the keys that answer and label differ in, and gates on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconloom.functions.amounts import amount_bucket, percent
from reconloom.functions.keys import stratum
from reconloom.operators.quantiles import quantiles

#: Fixed value: points of coverage a refused filter cost for a point of precision: the yardstick of the verdict.
REFUSED_RATE = 31.36


def key_amounts(led: DataFrame) -> DataFrame:
    """(allocation, low, high, n_amounts) of each ledger key."""
    return led.groupBy("allocation").agg(F.min("a_cents").alias("low"), F.max("a_cents").alias("high"), F.count_distinct("a_cents").alias("n_amounts"))


def key_ranges(led: DataFrame) -> DataFrame:
    """`key_amounts`, where n_amounts is 2 for any number above one: needs no count of different amounts, so rows move once."""
    d = led.groupBy("allocation").agg(F.min("a_cents").alias("low"), F.max("a_cents").alias("high"))
    return d.withColumn("n_amounts", F.when(F.col("low").isNull(), 0).when(F.col("low") == F.col("high"), 1).otherwise(2).cast("long"))


def drift_rows(decided: DataFrame, gold: DataFrame, prices: DataFrame) -> DataFrame:
    """One row for each automatic close: drift as an interval of cents, and whether it is exact.

    A posted key that the label lacks adds its price: that of the candidate with the least rank, else the
    key's amounts as an interval. A label key that was not posted is subtracted, so the low end takes its
    highest amount. Keys without any price are counted, and make the row inexact.
    """
    return priced(differences(decided, gold), prices)


def differences(decided: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each automatic close, without its price: measures, `seen`: the sum of the keys that its own candidates price, and `rest`: the other keys (allocation, side) that answer and label differ in."""
    none = F.array().cast("array<string>")
    auto = decided.filter(~F.col("escalate")).join(gold, "b_id", "left").withColumn("gold", F.coalesce("gold", none))
    auto = auto.withColumn("posted", F.array_sort("answer_keys"))
    of = lambda k: F.filter("candidates", lambda c: c["allocation"] == k)
    shown = lambda k: F.array_min(F.transform(of(k), lambda c: F.struct(c["rank"], c["amount_cents"].alias("cents"))))["cents"]
    more = F.transform(F.array_except("posted", "gold"), lambda k: F.struct(k.alias("allocation"), F.lit(1).alias("side"), shown(k).alias("shown")))
    less = F.transform(F.array_except("gold", "posted"), lambda k: F.struct(k.alias("allocation"), F.lit(-1).alias("side"), F.lit(None).cast("long").alias("shown")))
    diff = F.when(F.col("posted") == F.col("gold"), F.array().cast("array<struct<allocation:string,side:int,shown:bigint>>")).otherwise(F.concat(more, less))
    exact_rows = F.filter("candidates", lambda c: c["exact_amount"])
    auto = auto.withColumns({"_diff": diff, "_exact": exact_rows})
    rest = F.transform(F.filter("_diff", lambda k: k["shown"].isNull()), lambda k: F.struct(k["allocation"].alias("allocation"), k["side"].alias("side")))
    return auto.select(
        "b_id",
        "b_cents",
        F.abs("b_cents").alias("abs_b"),
        (F.col("posted") == F.col("gold")).alias("ok"),
        F.size("posted").alias("n_posted"),
        F.size("gold").alias("n_gold"),
        stratum("gold").alias("stratum"),
        "dup_ref",
        F.size("candidates").alias("n_cands"),
        F.size("_exact").alias("n_exact_cand"),
        F.size(F.array_distinct("_exact.allocation")).alias("n_exact_keys"),
        F.arrays_overlap("gold", F.array_distinct("candidates.allocation")).alias("gold_in_pool"),
        F.aggregate(F.filter("_diff", lambda k: k["shown"].isNotNull()), F.lit(0).cast("long"), lambda acc, k: acc + k["shown"]).alias("seen"),
        rest.alias("rest"),
    )


def priced(found: DataFrame, prices: DataFrame) -> DataFrame:
    """`differences` with drift_lo, drift_hi, exact and unpriceable. Only keys that a row's candidates do not price meet the prices."""
    parts = found.filter(F.size("rest") > 0).select("b_id", F.explode("rest").alias("k")).select("b_id", "k.*").join(prices, "allocation", "left")
    low, high = (F.when(F.col("side") == 1, F.col(x)).otherwise(-F.col(y)) for x, y in (("low", "high"), ("high", "low")))
    sums = parts.groupBy("b_id").agg(F.sum(low).alias("lo"), F.sum(high).alias("hi"), F.bool_and(F.coalesce(F.col("n_amounts") == 1, F.lit(False))).alias("exact"), F.count_if(F.col("n_amounts").isNull()).alias("unpriceable"))
    out = found.drop("rest").join(sums, "b_id", "left")
    end = lambda c, name: (F.col("seen") + F.coalesce(c, F.lit(0))).alias(name)
    own = [c for c in found.columns if c not in ("seen", "rest")]
    return out.select(*own, end("lo", "drift_lo"), end("hi", "drift_hi"), F.coalesce("exact", F.lit(True)).alias("exact"), F.coalesce("unpriceable", F.lit(0)).alias("unpriceable"))


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def totals() -> list[Column]:
    """net and gross over exact rows, and the intervals that the others leave open."""
    e, lo, hi = F.col("exact"), F.col("drift_lo"), F.col("drift_hi")
    net, gross = _sum(F.when(e, lo)), _sum(F.when(e, F.abs(lo)))
    least = F.when((lo <= 0) & (hi >= 0), 0).otherwise(F.least(F.abs(lo), F.abs(hi)))
    return [
        F.count("*").alias("rows"),
        F.count_if(~F.col("ok")).alias("differing"),
        F.count_if(e).alias("exact_rows"),
        net.alias("net"),
        gross.alias("gross"),
        (gross - F.abs(net)).alias("cancelled"),
        (net + _sum(F.when(~e, lo))).alias("net_lo"),
        (net + _sum(F.when(~e, hi))).alias("net_hi"),
        (gross + _sum(F.when(~e, least))).alias("gross_lo"),
        (gross + _sum(F.when(~e, F.greatest(F.abs(lo), F.abs(hi))))).alias("gross_hi"),
    ]


def headline(rows: DataFrame) -> DataFrame:
    return rows.agg(*totals())


def by(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(*totals())


def by_amount(rows: DataFrame) -> DataFrame:
    number, label = amount_bucket("b_cents")
    return by(rows, number.alias("bucket_ord"), label.alias("bucket"))


def direction(rows: DataFrame) -> DataFrame:
    """By stratum: drift turned to the direction of the statement's amount, over exact rows."""
    d = F.col("drift_lo") * F.signum("b_cents").cast("long")
    return rows.filter("exact").groupBy("stratum").agg(F.count("*").alias("rows"), _sum(d).alias("toward"), F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"), F.count_if(d == 0).alias("zero"))


def computability(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: keys with one and with several amounts; rows exact, bounded, with keys without price; widths of intervals."""
    k = prices.agg(F.count_if(F.col("n_amounts") == 1).alias("keys_one_amount"), F.count_if(F.col("n_amounts") > 1).alias("keys_more_amounts"))
    width = F.when(~F.col("exact"), F.col("drift_hi") - F.col("drift_lo"))
    r = rows.agg(F.count_if("exact").alias("exact_rows"), F.count_if(~F.col("exact")).alias("bounded_rows"), F.count_if(F.col("unpriceable") > 0).alias("unpriceable_rows"), F.max(width).alias("width_max"))
    return k.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(quantiles(rows, width, {"width_median": 0.5})))  # a row each


def outcomes(rows: DataFrame) -> DataFrame:
    """Flags: correct, wrong, and wrong with drift zero, not zero, or not known."""
    wrong = ~F.col("ok")
    return rows.withColumns({"correct": F.col("ok"), "wrong": wrong, "wrong_zero": wrong & F.col("exact") & (F.col("drift_lo") == 0), "wrong_nonzero": wrong & F.col("exact") & (F.col("drift_lo") != 0), "wrong_bounded": wrong & ~F.col("exact")})


def blind_spot(rows: DataFrame) -> DataFrame:
    """One row: wrong closes that a balance check can't see, might not see, and sees."""
    o = outcomes(rows)
    straddles = F.col("wrong_bounded") & (F.col("drift_lo") <= 0) & (F.col("drift_hi") >= 0)
    return o.agg(F.count_if("wrong").alias("wrong"), F.count_if("wrong_zero").alias("invisible"), F.count_if(straddles).alias("straddling"), F.count_if(F.col("wrong") & ~F.col("wrong_zero") & ~straddles).alias("visible"))


_OUTCOMES = ("correct", "wrong", "wrong_zero", "wrong_nonzero", "wrong_bounded")


def pool_structure(rows: DataFrame) -> DataFrame:
    """Outcomes by number of exact keys and repeated reference, with a row over all (nulls)."""
    o = outcomes(rows)
    sums = [F.count("*").alias("rows"), *[F.count_if(c).alias(c) for c in _OUTCOMES]]
    total = o.agg(*sums).select(F.lit(None).cast("int").alias("n_exact_keys"), F.lit(None).cast("boolean").alias("dup_ref"), "*")
    return o.groupBy("n_exact_keys", "dup_ref").agg(*sums).unionByName(total)


def _gates() -> Column:
    k, r, d = F.col("n_exact_keys") > 1, F.col("n_exact_cand") > 1, F.col("dup_ref")
    each = (("exact keys > 1", k), ("exact rows > 1", r), ("dup_ref", d), ("keys>1 or dup", k | d), ("keys>1 and dup", k & d))
    return F.array(*[F.struct(F.lit(n).alias("gate"), c.alias("hit")) for n, c in each])


def gate_pricing(rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """What each gate would escalate, of wrong and correct closes, and coverage and precision after it. all_rows: every decision."""
    base = rows.agg(F.count("*").alias("auto0"), F.count_if("ok").alias("ok0")).crossJoin(F.broadcast(all_rows.agg(F.count("*").alias("n_all"))))
    g = outcomes(rows).withColumn("g", F.explode(_gates())).select("*", "g.gate", "g.hit")
    n = lambda c: F.count_if(F.col("hit") & F.col(c))
    g = g.groupBy("gate").agg(F.count_if("hit").alias("escalates"), *[n(c).alias(c if c != "correct" else "correct_escalated") for c in _OUTCOMES], F.count_if(~F.col("hit")).alias("after"), F.count_if(~F.col("hit") & F.col("ok")).alias("ok_after"))
    d = g.crossJoin(F.broadcast(base))
    coverage, precision = F.col("after") * 100.0 / F.col("n_all"), F.try_divide(F.col("ok_after") * 100.0, F.col("after"))
    gain = precision - F.col("ok0") * 100.0 / F.col("auto0")
    lost = F.col("auto0") * 100.0 / F.col("n_all") - coverage
    return d.select(
        "gate", "escalates", "wrong", "wrong_zero", "wrong_nonzero", "wrong_bounded", "correct_escalated", F.round(coverage, 3).alias("coverage"), F.round(precision, 3).alias("precision"), F.round(F.when(gain > 1e-12, lost / gain), 1).alias("points_per_point")
    )


def gate_state(priced: DataFrame, rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """(keys, dup, gate, escalates, coverage, precision) for the four positions of two switches."""
    which = F.when(F.col("gate") == "exact keys > 1", F.struct(F.lit(True).alias("keys"), F.lit(False).alias("dup"))).when(F.col("gate") == "dup_ref", F.struct(F.lit(False).alias("keys"), F.lit(True).alias("dup"))).when(F.col("gate") == "keys>1 or dup", F.struct(F.lit(True).alias("keys"), F.lit(True).alias("dup")))
    on = priced.withColumn("s", which).filter("s is not null").select("s.keys", "s.dup", "gate", "escalates", "coverage", "precision")
    off = rows.agg(F.count("*").alias("auto0"), F.count_if("ok").alias("ok0")).crossJoin(F.broadcast(all_rows.agg(F.count("*").alias("n_all"))))
    return on.unionByName(off.select(F.lit(False).alias("keys"), F.lit(False).alias("dup"), F.lit("none").alias("gate"), F.lit(0).cast("long").alias("escalates"), percent(F.col("auto0"), F.col("n_all")).alias("coverage"), percent(F.col("ok0"), F.col("auto0")).alias("precision")))


def gate_lift(rows: DataFrame) -> DataFrame:
    """For each signal: its rate among invisible errors against its rate among all closes, and a verdict."""
    signals = F.array(*[F.struct(F.lit(n).alias("signal"), c.alias("hit")) for n, c in (("exact keys > 1", F.col("n_exact_keys") > 1), ("exact rows > 1", F.col("n_exact_cand") > 1), ("dup_ref", F.col("dup_ref")))])
    g = outcomes(rows).withColumn("s", F.explode(signals)).groupBy(F.col("s.signal").alias("signal")).agg(
        F.count_if("wrong_zero").alias("invisible"), F.count_if(F.col("wrong_zero") & F.col("s.hit")).alias("caught"), F.count("*").alias("rows"), F.count_if("s.hit").alias("hits")
    )
    recall, base = F.try_divide(F.col("caught").cast("double"), F.col("invisible")), F.try_divide(F.col("hits").cast("double"), F.col("rows"))
    lift = F.try_divide(recall, base)
    verdict = F.when(recall.isNull(), "nothing to catch").when((recall >= 0.9) & (lift >= 2), "concentrated").otherwise("not concentrated")
    return g.select("signal", "invisible", "caught", F.round(recall, 6).alias("recall"), F.round(base, 6).alias("base"), F.round(lift, 6).alias("lift"), verdict.alias("verdict"))


def gate_verdict(priced: DataFrame) -> DataFrame:
    """Each gate with what its price says against the yardstick."""
    return priced.select("gate", "points_per_point", F.when(F.col("points_per_point").isNull(), "gains nothing").when(F.col("points_per_point") >= 0.8 * REFUSED_RATE, "refuse").otherwise("consider").alias("verdict"))


def residue(rows: DataFrame, n: int = 20) -> DataFrame:
    """The largest wrong closes with exactly one exact key, which no pool signal shows."""
    return outcomes(rows).filter("wrong and n_exact_keys = 1").orderBy(F.desc("abs_b"), "b_id").limit(n).select("b_id", "abs_b", "stratum", "drift_lo", "drift_hi", "exact")


def largest(rows: DataFrame, n: int = 10) -> DataFrame:
    """The largest exact drifts, as worked examples."""
    return rows.filter("exact and drift_lo <> 0").orderBy(F.desc(F.abs("drift_lo")), "b_id").limit(n).select("b_id", "b_cents", "n_posted", "n_gold", "drift_lo")


def concentration(rows: DataFrame) -> DataFrame:
    """Share of gross drift by the rows that hold it, by stratum."""
    g = rows.filter("exact").groupBy("stratum").agg(_sum(F.abs("drift_lo")).alias("gross"))
    return g.withColumn("pct", percent(F.col("gross"), F.sum("gross").over(Window.partitionBy())))


def examples(rows: DataFrame, decided: DataFrame, gold: DataFrame, prices: DataFrame, n: int = 5) -> DataFrame:
    """(b_id, drift_lo, side, allocation, low, high): the n largest exact drifts, with every key that was posted or is in the label alone, and its amounts."""
    top = rows.filter("exact and drift_lo <> 0").orderBy(F.desc(F.abs("drift_lo")), "b_id").limit(n).select("b_id", "drift_lo")
    d = F.broadcast(top).join(decided.select("b_id", "answer_keys"), "b_id").join(gold, "b_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))
    one = lambda a, b, name: F.transform(F.array_except(a, b), lambda k: F.struct(F.lit(name).alias("side"), k.alias("allocation")))
    keys = d.select("b_id", "drift_lo", F.explode(F.concat(one("answer_keys", "gold", "posted"), one("gold", "answer_keys", "label"))).alias("k")).select("b_id", "drift_lo", "k.*")
    return keys.join(prices.select("allocation", "low", "high"), "allocation", "left")
