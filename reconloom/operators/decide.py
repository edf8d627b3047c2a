"""Decisions: close automatically, or escalate with a reason. No function here takes labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconloom.functions.keys import encode_keys

#: Triggers, in the order in which they are listed.
TRIGGERS = ("no_candidate", "completion_added", "fee_band_only", "low_confidence")

#: The grid of thresholds.
GRID_TOP1 = (0.0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15)
GRID_MARGIN = (0.0, 0.005, 0.01, 0.02, 0.04, 0.08)


def candidates(ranked: DataFrame) -> DataFrame:
    """(b_id, candidates): the ranked pairs of each statement row in one array; a table that has `candidates` already stays."""
    if "candidates" in ranked.columns:
        return ranked.select("b_id", "candidates")
    c = F.struct("rank", "a_id", F.round("score", 6).alias("score"), F.col("a_cents").alias("amount_cents"), (F.col("a_cents") - F.col("b_cents")).alias("amount_delta_cents"), (F.abs(F.col("a_cents") - F.col("b_cents")) <= 1).alias("exact_amount"), F.col("a_ref").alias("ref"), "allocation")
    return ranked.groupBy("b_id").agg(F.array_sort(F.collect_list(c)).alias("candidates"))  # at most five


def basis(stmt: DataFrame, ranked: DataFrame, added: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """One row for each statement row with everything that a decision needs.

    ranked: pairs with their rank, or `candidates` of each row. added: (b_id, added array of (rank, allocation_key, percent)). topk_size is the number of candidates
    kept; pool_size, where `pool` (b_id, pool_size) is given, the number before that.
    """
    d = stmt.select("b_id", "b_cents").join(candidates(ranked), "b_id", "left").join(added, "b_id", "left")
    first, second = F.get("candidates", F.lit(0)), F.get("candidates", F.lit(1))
    none = F.array().cast("array<string>")
    refs = F.col("candidates.ref")
    out = d.select(
        "b_id",
        "b_cents",
        F.col("candidates").isNotNull().alias("has"),
        F.coalesce(F.size("candidates"), F.lit(0)).alias("topk_size"),
        first["a_id"].alias("top1_a_id"),
        first["score"].alias("top1"),
        F.round(first["score"] - F.coalesce(second["score"], F.lit(0.0)), 6).alias("margin"),
        F.coalesce(first["exact_amount"], F.lit(False)).alias("exact1"),
        F.coalesce(F.size(refs) != F.size(F.array_distinct(refs)), F.lit(False)).alias("dup_ref"),
        F.coalesce(F.size("added"), F.lit(0)).alias("added_count"),
        F.when(F.col("candidates").isNull(), none).otherwise(F.concat(F.array(first["allocation"]), F.coalesce(F.transform("added", lambda x: x["allocation_key"]), none))).alias("answer_keys"),
        "candidates",
        "added",
    ).withColumn("topk_size", F.when(F.col("has"), F.col("topk_size")).otherwise(0)).withColumn("added_count", F.when(F.col("added").isNull(), 0).otherwise(F.col("added_count")))
    if pool is not None:
        out = out.join(pool, "b_id", "left").withColumn("pool_size", F.coalesce("pool_size", F.lit(0)))
    return out


def decide(base: DataFrame, min_top1: float = 0.3, min_margin: float = 0.01) -> DataFrame:
    """base with a flag for each trigger, escalate and exception_class; the first class that applies, in this order."""
    false = F.lit(False)
    no = ~F.col("has")
    add = F.col("added_count") > 0
    fee = F.col("has") & ~F.col("exact1")
    low = F.coalesce(F.col("has") & ((F.col("top1") < min_top1) | (F.col("margin") < min_margin)), false)
    kind = F.when(no, "missing_counterparty").when(F.col("dup_ref") & add, "duplicate_reference_suspected").when(fee, "fee_band_match").when(add, "incomplete_set").when(low, "ambiguous_allocation").otherwise("")
    out = base.withColumns({"no_candidate": no, "completion_added": add, "fee_band_only": fee, "low_confidence": low, "escalate": no | add | fee | low, "exception_class": kind})
    fired = F.filter(F.array(*[F.when(F.col(t), F.lit(t)) for t in TRIGGERS]), lambda x: x.isNotNull())
    return out.withColumn("triggers", fired)


def audit(decided: DataFrame, batch: str) -> DataFrame:
    """The audit record of each row, nested as it is written."""
    return decided.select(
        F.lit(batch).alias("batch"),
        F.col("b_id").cast("string").alias("b_id"),
        F.col("b_cents").alias("b_amount_cents"),
        F.col("topk_size").cast("long").alias("pool_size"),
        F.transform("candidates", lambda c: F.struct(c["rank"].alias("rank"), c["a_id"].cast("string").alias("a_id"), c["score"].alias("score"), c["amount_cents"].alias("amount_cents"), c["amount_delta_cents"].alias("amount_delta_cents"), c["exact_amount"].alias("exact_amount"))).alias("candidates"),
        F.col("top1_a_id").cast("string").alias("top1_a_id"),
        F.col("top1").alias("top1_score"),
        "margin",
        F.col("exact1").alias("exact_amount_top1"),
        F.col("dup_ref").alias("duplicate_reference_among_candidates"),
        F.transform("added", lambda a: F.struct(a["allocation_key"].alias("allocation_key"), (a["percent"] / 100).alias("probability"))).alias("added_keys"),
        "triggers",
        "exception_class",
        F.when(F.col("escalate"), "escalate").otherwise("auto_close").alias("decision"),
        "answer_keys",
    )


def exceptions(decided: DataFrame) -> DataFrame:
    """The escalated rows as they go to the exceptions file."""
    return decided.filter("escalate").select("b_id", "exception_class", F.array_join("triggers", "|").alias("triggers"), encode_keys("answer_keys").alias("proposed_answer"), F.col("top1").alias("top1_score"), "margin")


def grid(base: DataFrame, gold: DataFrame, top1s: list[float], margins: list[float]) -> DataFrame:
    """For each pair of thresholds: how often low_confidence fires, alone too, coverage and precision; labels enter here only to tune on training rows.

    A row is binned once: by how many thresholds of either kind it reaches. It passes a pair of thresholds if it reaches both, so the counts
    are sums over all bins from there on, of a table with a row for each bin and kind, whatever the number of rows.
    """
    spark = base.sparkSession
    top1s, margins = sorted(set(top1s)), sorted(set(margins))
    none = F.array().cast("array<string>")
    ok = F.array_sort("answer_keys") == F.array_sort(F.coalesce("gold", none))
    others = ~F.col("has") | (F.col("added_count") > 0) | (F.col("has") & ~F.col("exact1"))
    reached = lambda c, ts: F.size(F.filter(F.array(*[F.lit(float(t)) for t in ts]), lambda t: F.coalesce(F.col(c) >= t, F.lit(True))))
    # Rows without a candidate are never low; nor is a null score or margin.
    bin_ = lambda c, ts: F.when(F.col("has"), reached(c, ts)).otherwise(len(ts))
    rows = base.join(gold, "b_id", "left").select(bin_("top1", top1s).alias("i"), bin_("margin", margins).alias("j"), others.alias("others"), ok.alias("ok"))
    sums = {"n": F.count("*"), "ok": F.count_if("ok"), "auto": F.count_if(~F.col("others")), "auto_ok": F.count_if(~F.col("others") & F.col("ok"))}
    bins = rows.groupBy("i", "j").agg(*[c.alias(k) for k, c in sums.items()])
    # The lattice: one more place than thresholds, as a row may reach none. Sums from each place on, first along one axis, then along the other.
    lattice = spark.createDataFrame([(i, j) for i in range(len(top1s) + 1) for j in range(len(margins) + 1)], "i int, j int")
    full = lattice.join(F.broadcast(bins), ["i", "j"], "left").na.fill(0)  # as many rows as the lattice
    for axis, other in (("i", "j"), ("j", "i")):
        w = Window.partitionBy(other).orderBy(F.desc(axis)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        full = full.select("i", "j", *[F.sum(k).over(w).alias(k) for k in sums])
    at = full.filter("i > 0 and j > 0").select(F.element_at(F.array(*[F.lit(float(t)) for t in top1s]), F.col("i")).alias("min_top1"), F.element_at(F.array(*[F.lit(float(m)) for m in margins]), F.col("j")).alias("min_margin"), *sums)
    whole = full.filter("i = 0 and j = 0").select(*[F.col(k).alias(f"all_{k}") for k in sums])
    x = at.crossJoin(F.broadcast(whole))  # one row
    pc = lambda a, b: F.round(F.try_divide(a * 100.0, b), 3)
    c = F.col
    low, low_ok, only, only_ok = c("all_n") - c("n"), c("all_ok") - c("ok"), c("all_auto") - c("auto"), c("all_auto_ok") - c("auto_ok")
    return x.select(
        "min_top1",
        "min_margin",
        low.alias("lc_fired"),
        pc(low_ok, low).alias("lc_correct_pct"),
        only.alias("lc_only"),
        pc(only_ok, only).alias("lc_only_correct_pct"),
        c("auto").alias("auto_closed"),
        pc(c("auto"), c("all_n")).alias("auto_coverage_pct"),
        pc(c("auto_ok"), c("auto")).alias("auto_precision_pct"),
    )


def select_thresholds(table: DataFrame, ceiling: float = 50.0) -> DataFrame:
    """One row: of the points that catch more wrong than right the one of most coverage, else both thresholds 0 (dropped)."""
    good = table.filter((F.col("lc_fired") > 0) & (F.col("lc_correct_pct") < ceiling))
    best = good.agg(F.max_by(F.struct("min_top1", "min_margin"), F.struct("auto_coverage_pct", -F.col("min_top1"), -F.col("min_margin"))).alias("b"))
    return best.select(F.coalesce("b.min_top1", F.lit(0.0)).alias("min_top1"), F.coalesce("b.min_margin", F.lit(0.0)).alias("min_margin"), F.col("b").isNull().alias("dropped"))
