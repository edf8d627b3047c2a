"""Operators on small tables: against brute force, identities, and edge cases."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from reconloom.functions.amounts import fee_band
from reconloom.operators import blocking, chain, decide, drift, exposure, learned, profile, regimes, scoring, synth, windows
from reconloom.sources import io

B = "b_id long, ccy string, account string, b_cents long, b_vd date"
A = "a_id long, ccy string, account string, a_cents long, a_vd date, allocation string"


def sides(spark, n=120, seed=1):
    r = random.Random(seed)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=r.randrange(40))
    cents = lambda: r.choice([1, -1]) * r.choice([1000, 1001, 1002, 950, 2000, 5, 0, 104, 99_999, 95_000, 100_000])
    b = [(i, "USD", r.choice("XY"), cents(), day()) for i in range(n)]
    a = [(i, "USD", r.choice("XY"), cents(), day(), f"k{i % 50}") for i in range(n)]
    return b, a, spark.createDataFrame(b, B), spark.createDataFrame(a, A)


def pairs(df):
    return sorted((r.b_id, r.a_id) for r in df.select("b_id", "a_id").collect())


@pytest.mark.parametrize(("tol", "lo", "hi"), [(0, -7, 7), (1, -7, 7), (1, -3, 0), (100, -7, 7), (1, -1_000_000, 1_000_000)])
def test_band_join_is_brute_force(spark, tol, lo, hi):
    b, a, bd, ad = sides(spark)
    want = sorted((x[0], y[0]) for x in b for y in a if x[2] == y[2] and abs(x[3] - y[3]) <= tol and lo <= (y[4] - x[4]).days <= hi)
    assert pairs(blocking.band_join(bd, ad, tol, lo, hi)) == want


def test_fee_join_is_brute_force(spark):
    b, a, bd, ad = sides(spark)
    def ok(x, y):
        return abs(x - y) <= 1 or ((x > 0) - (x < 0) == (y > 0) - (y < 0) and abs(y) * 100 >= abs(x) * 95 and abs(y) <= abs(x))
    want = sorted((x[0], y[0]) for x in b for y in a if x[2] == y[2] and ok(x[3], y[3]) and abs((y[4] - x[4]).days) <= 7)
    assert pairs(blocking.fee_candidates(bd, ad)) == want


def test_tolerances_are_brute_force(spark):
    b, a, bd, ad = sides(spark)
    got = {(r.b_id, r.a_id) for r in blocking.tolerance_candidates(bd, ad).filter("in_r5").collect()}
    assert got == {(x[0], y[0]) for x in b for y in a if x[2] == y[2] and abs(x[3] - y[3]) * 20 <= abs(x[3]) and abs((y[4] - x[4]).days) <= 7}


@pytest.mark.parametrize(("lo", "hi"), [(-7, 7), (-1_000_000, 1_000_000)])
def test_pool_sizes_are_counted(spark, lo, hi):
    b, a, bd, ad = sides(spark)
    got = {r.b_id: r.date_pool for r in blocking.date_pool_sizes(bd, ad, lo, hi).collect()}
    assert got == {x[0]: sum(x[2] == y[2] and lo <= (y[4] - x[4]).days <= hi for y in a) for x in b}


def test_ceiling_grows_with_the_window(spark):
    _, _, bd, ad = sides(spark)
    gold = bd.select("b_id", F.array(F.concat(F.lit("k"), (F.col("b_id") % 50).cast("string"))).alias("gold"))
    p = blocking.windowed(bd, ad).withColumn("score", F.lit(0.5))
    t = [r.ceiling for r in windows.window_table(p, gold, bd.select("b_id")).filter("ord < 10").orderBy("ord").collect()]
    assert len(t) == 10 and t == sorted(t)


def test_scorer(spark):
    pred = spark.createDataFrame([(" 1 ", "A", 1), ("2", "", 1), ("3", "B", 1), ("4", "", 1), ("9", "Z", 1)], "B_id string, targetAllocation string, other int")
    sol = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "A"), ("4", ""), ("5", "[A,B]"), ("6", None)], "B_id string, targetAllocation string")
    m = {r.stratum: r for r in scoring.score(spark, pred, sol).collect()}
    o = m["overall"]
    assert (o.total, o.correct, o.wrong, o.abstained, o.predicted) == (6, 3, 1, 2, 4)
    assert m["blank"].correct == 2 and m["multi_key"].abstained == 1
    with pytest.raises(ValueError, match="targetAllocation"):
        scoring.score(spark, pred.drop("targetAllocation"), sol)


def test_empty_strata_have_null_rates(spark):
    one = spark.createDataFrame([(1, ["A"])], "b_id long, keys array<string>")
    m = {r.stratum: r for r in scoring.metrics(scoring.compare(one, one)).collect()}
    assert m["multi_key"].total == 0 and m["multi_key"].match_rate is None


@pytest.mark.parametrize(
    ("has", "exact", "dup", "added", "top", "margin", "want"),
    [
        (False, False, False, 0, None, None, "missing_counterparty"),
        (True, False, True, 1, 0.9, 0.5, "duplicate_reference_suspected"),
        (True, False, False, 1, 0.9, 0.5, "fee_band_match"),
        (True, True, False, 1, 0.9, 0.5, "incomplete_set"),
        (True, True, True, 0, 0.1, 0.5, "ambiguous_allocation"),
        (True, True, True, 0, 0.9, 0.5, ""),
    ],
)
def test_class_precedence(spark, has, exact, dup, added, top, margin, want):
    d = spark.createDataFrame([(1, has, exact, dup, added, top, margin)], "b_id long, has boolean, exact1 boolean, dup_ref boolean, added_count int, top1 double, margin double")
    r = decide.decide(d).collect()[0]
    assert r.exception_class == want and r.escalate == (want != "")


def test_decisions_take_no_labels():
    import inspect

    for f in (decide.basis, decide.decide, decide.audit):
        assert not {"gold", "labels", "ok"} & set(inspect.signature(f).parameters)


def decided(spark):
    c = "array<struct<rank:int,allocation:string,amount_cents:long,exact_amount:boolean>>"
    rows = [
        (1, 100, False, ["A"], [(1, "A", 100, True)], False),
        (2, 200, False, ["B"], [(1, "B", 200, True), (2, "C", 200, True)], True),
        (3, -300, False, ["D"], [(1, "D", -300, True)], False),
        (4, 50, True, [], None, False),
    ]
    return spark.createDataFrame(rows, f"b_id long, b_cents long, escalate boolean, answer_keys array<string>, candidates {c}, dup_ref boolean")


def test_drift_bounds(spark):
    gold = spark.createDataFrame([(1, ["A"]), (2, ["C"]), (3, ["D", "K"])], "b_id long, gold array<string>")
    led = spark.createDataFrame([("A", 100), ("B", 200), ("C", 200), ("D", -300), ("K", 5), ("K", 9)], "allocation string, a_cents long")
    r = {x.b_id: x for x in drift.drift_rows(decided(spark), gold, drift.key_amounts(led)).collect()}
    assert set(r) == {1, 2, 3}
    assert (r[1].drift_lo, r[1].drift_hi, r[1].ok, r[1].exact) == (0, 0, True, True)
    assert (r[2].drift_lo, r[2].drift_hi, r[2].ok) == (0, 0, False) and r[2].gold_in_pool
    assert (r[3].drift_lo, r[3].drift_hi, r[3].exact) == (-9, -5, False)
    assert all(x.drift_lo <= x.drift_hi and (not x.exact or x.drift_lo == x.drift_hi) for x in r.values())


def test_drift_cancels(spark):
    rows = spark.createDataFrame([(1, 358_73, 358_73, True, False), (2, -358_73, -358_73, True, False), (3, 0, 0, True, True)], "b_id long, drift_lo long, drift_hi long, exact boolean, ok boolean")
    h = drift.headline(rows).collect()[0]
    assert (h.net, h.gross, h.cancelled) == (0, 717_46, 717_46)


def test_gate_identities(spark, sf_dir):
    from reconloom.plans.context import batch

    b = batch(spark, sf_dir)
    for r in drift.gate_pricing(b.drift, b.decided).collect():
        assert r.escalates == r.wrong + r.correct_escalated and r.wrong == r.wrong_zero + r.wrong_nonzero + r.wrong_bounded
    assert b.drift.filter("ok and (drift_lo <> 0 or drift_hi <> 0)").isEmpty()


@pytest.mark.parametrize(("amounts", "b", "want"), [([20323500] * 6, 20323500, "repeat"), ([10, 0], 10, "partition"), ([4, 5], 10, "partition"), ([3, 3], 10, "neither")])
def test_regimes(spark, amounts, b, want):
    m = spark.createDataFrame([(1, b, i, a) for i, a in enumerate(amounts)], "b_id long, b_cents long, a_id long, a_cents long")
    assert regimes.group_sums(m).collect()[0].regime == want


def test_curve_rounds_half_to_even(spark):
    q = spark.range(3133).select((F.col("id") + 1).alias("rank"), F.lit(1).cast("long").alias("exposure_cents"))
    r = {x.pct: x.rows_reviewed for x in exposure.retired_curve(q).collect()}
    assert r[50] == 1566 and r[100] == 3133


def test_global_rank_is_row_number(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0, 1, 5, 127, 128, 129, 10**9, r.randrange(10**12)])) for i in range(500)]
    d = spark.createDataFrame(rows, "b_id long, exposure_cents long")
    got = exposure.global_rank(d, [F.desc("exposure_cents"), F.asc("b_id")], "exposure_cents").orderBy("rank").collect()
    assert [(x.rank, x.b_id) for x in got] == [(i + 1, b) for i, (b, _) in enumerate(sorted(rows, key=lambda t: (-t[1], t[0])))]


def test_reports_do_not_depend_on_order(spark, sf_dir):
    from reconloom.plans.context import batch

    d = batch(spark, sf_dir).judged
    assert exposure.headline(d.orderBy(F.rand(1))).collect() == exposure.headline(d.repartition(7)).collect()


def test_append_new(spark):
    s = "id long, v string, error string"
    old = spark.createDataFrame([(1, "a", None), (2, "b", "failed")], s)
    new = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, "z", None), (3, "zz", None)], s)
    assert sorted((r.id, r.v) for r in io.append_new(old, new, "id").collect()) == [(1, "a"), (2, "y"), (3, "z")]


def test_csv_keeps_spaces_and_blanks(spark, tmp_path):
    d = spark.createDataFrame([(" K ", '["a"]', "")], io.strings(io.SOLUTION_COLUMNS))
    io.write_csv(d, str(tmp_path / "x"))
    assert io.read_text_csv(spark, str(tmp_path / "x"), io.SOLUTION_COLUMNS).collect() == d.collect()


def test_synthetic_shares(spark):
    stmt, led, manifest = synth.generate(spark, 20_000, seed=7)
    n = {r["class"]: r["count"] for r in stmt.groupBy("class").count().collect()}
    assert abs(n["one_to_one"] / 20_000 - 0.937) < 0.01 and abs(n["repeat"] / 20_000 - 0.039) < 0.006
    assert abs(manifest.agg(F.avg("n_distractors")).collect()[0][0] - 1.0) < 0.05
    assert synth.generate(spark, 50, seed=7)[0].collect() == synth.generate(spark, 50, seed=7)[0].collect()
    part = led.filter("not distractor").join(stmt.filter("class = 'partition'").select(F.col("b_id").alias("b_owner"), "b_cents"), "b_owner").groupBy("b_owner", "b_cents").agg(F.sum("a_cents").alias("s"))
    assert part.filter("s <> b_cents").isEmpty()


def test_empty_tables(spark):
    _, _, bd, ad = sides(spark)
    none = ad.limit(0)
    assert blocking.band_join(bd, none).isEmpty()
    assert {tuple(r.keys) for r in blocking.exact_amount_baseline(bd, none).collect()} == {()}
    assert profile.value_counts(none, "allocation").isEmpty()


def test_fee_predicate_matches_plan(spark):
    _, _, bd, ad = sides(spark)
    p = blocking.fee_candidates(bd, ad)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_streaming_band_join(spark, tmp_path):
    from reconloom.streaming.matching import band_join_stream

    t = dt.datetime(2024, 1, 1)
    b, a = "b_id long, ccy string, account string, b_cents long, b_ts timestamp", "a_id long, ccy string, account string, a_cents long, a_ts timestamp"
    spark.createDataFrame([(1, "U", "X", 100, t), (2, "U", "X", 500, t)], b).write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([(7, "U", "X", 101, t + dt.timedelta(days=3)), (8, "U", "X", 500, t + dt.timedelta(days=9))], a).write.parquet(str(tmp_path / "a"))
    q = band_join_stream(spark.readStream.schema(b).parquet(str(tmp_path / "b")), spark.readStream.schema(a).parquet(str(tmp_path / "a")))
    s = q.writeStream.format("memory").queryName("matched").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    s.processAllAvailable()
    s.stop()
    assert [(r.b_id, r.a_id) for r in spark.table("matched").collect()] == [(1, 7)]


def test_manifest_holds_all_statement_rows(spark, sf_dir, tmp_path, monkeypatch):
    """Every statement row is in the written manifest, and no group gathers a class."""
    from reconloom.plans import context, q_sources

    monkeypatch.setattr(q_sources, "_folder", lambda spark, name: str(tmp_path / name))
    q_sources.scan_manifest(spark, sf_dir).collect()
    m = spark.read.json(str(tmp_path / "manifest")).select(F.explode("groups").alias("g")).select("g.b_ids", "g.class")
    assert m.agg(F.max(F.size("b_ids"))).collect()[0][0] == 1
    assert sorted(map(tuple, m.select(F.explode("b_ids"), "class").collect())) == sorted(map(tuple, context.batch(spark, sf_dir).stmt.select("b_id", "class").collect()))


def test_global_rank_over_ranges(spark, monkeypatch):
    """Ranks over many ranges, with a value that a third of the rows have, are those of one sort."""
    r = random.Random(3)
    rows = [(i, 500 if i % 3 == 0 else r.choice([0, 7, r.randrange(10**r.randrange(1, 9))])) for i in range(3000)]
    r.shuffle(rows)
    monkeypatch.setattr(exposure, "RANGE_ROWS", 50)
    d = spark.createDataFrame(rows, "b_id long, v long")
    got = {x.b_id: x["rank"] for x in exposure.global_rank(d, [F.desc("v"), F.asc("b_id")], "v").collect()}
    assert got == {b: k + 1 for k, (b, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    assert exposure.global_rank(d.limit(0), [F.desc("v"), F.asc("b_id")], "v").isEmpty()


def test_policy_never_reads_labels_of_other_rows(spark, sf_dir):
    """Decisions of odd rows under a policy fitted on even ones: the same whatever odd labels are, and no worse than the point rule's.

    The tables hold rows that no policy can get right: fees and partitions in crowds, labels that lack a key.
    """
    from reconloom.plans.context import batch

    b = batch(spark, sf_dir)
    even = F.col("b_id") % 2 == 0
    wrong = b.gold.withColumn("gold", F.when(even, F.col("gold")).otherwise(F.array(F.lit("x"), F.lit("y"))))
    one, two = (chain.fit_policy(b.stmt, b.ranked, b.feats, g, even) for g in (b.gold, wrong))
    assert one.ceiling == two.ceiling >= learned.LEAST_RECALL and one.model is not None
    assert (one.min_top1, one.min_margin) == (two.min_top1, two.min_margin)
    odd = [d.filter(~even) for d in (b.stmt, b.ranked, b.feats)]
    decided = {r.b_id: r for r in chain.apply_policy(*odd, one).select("b_id", "escalate", "answer_keys").collect()}
    assert decided == {r.b_id: r for r in chain.apply_policy(*odd, two).select("b_id", "escalate", "answer_keys").collect()}
    gold = {r.b_id: sorted(r.gold) for r in b.gold.collect()}
    auto = [r for r in decided.values() if not r.escalate]
    assert len(decided) == b.stmt.filter(~even).count()
    precision = lambda rows: sum(sorted(r.answer_keys) == gold.get(r.b_id, []) for r in rows) / len(rows)
    rule = [r for r in b.decided.filter(~even).select("b_id", "escalate", "answer_keys").collect() if not r.escalate]
    assert len(auto) / len(decided) > 0.5 and precision(auto) > 0.8
    # Of all rows the trees close more rightly than the rule does.
    assert len(auto) * precision(auto) > len(rule) * precision(rule)


def test_policy_below_the_gate(spark, sf_dir):
    """Where labels can't be formed from the candidates, completion is off."""
    from reconloom.plans.context import batch

    b = batch(spark, sf_dir)
    far = b.gold.withColumn("gold", F.array(F.lit("no"), F.lit("such")))
    p = chain.fit_policy(b.stmt, b.ranked, b.feats, far, F.col("b_id") % 2 == 0)
    assert p.model is None and p.ceiling == 0
    assert chain.apply_policy(b.stmt, b.ranked, b.feats, p).filter("completion_added").isEmpty()


def test_generator_laws(spark):
    """Sizes by class, distractors at a high rate and fees follow the configuration."""
    stmt, led, manifest = synth.generate(spark, 4000, 3, {"classes": {"one_to_one": 0.5, "repeat": 0.3, "neither": 0.1, "partition": 0.1, "unmatchable": 0.0}, "distractors": 12.0})
    m = manifest.toPandas()
    for name, (least, most, more) in synth.DEFAULTS["sizes"].items():
        n = m[m["class"] == name]["n_keys"]
        assert n.min() == least and n.max() <= most
        assert abs((n > least).mean() - more) < 0.09
    assert abs(m["n_distractors"].mean() - 12) < 0.3 and abs(m["n_distractors"].var() - 12) < 1.5
    d = stmt.filter(F.array_contains("corruptions", "fee")).join(led.filter("not distractor"), stmt["b_id"] == led["b_owner"]).select(F.abs("b_cents").alias("b"), (F.abs("b_cents") - F.abs("a_cents")).alias("fee")).toPandas()
    assert (d["fee"] >= 0).all() and (d["fee"] < d["b"]).all()
    fixed, percent = d["fee"] > 0.0201 * d["b"], d["fee"] > 500_000
    assert not (fixed & percent).any() and fixed.any() and percent.any()


def test_chain_with_two_rankers(spark, sf_dir):
    from reconloom.plans import all_queries

    got = {(r.ranker, r.cut): r for r in all_queries()[0]["synthetic_chain"](spark, sf_dir).collect()}
    assert {k[0] for k in got} == {"text", "nearness"}
    rate = {k: r.match_rate for k, r in got.items()}
    one = next(c for _, c in got if c.endswith("one_to_one"))
    assert 0.5 < rate["text", one] < 1 and rate["text", one] > rate["nearness", one]
