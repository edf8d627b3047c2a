"""Mechanisms for tables with hot values: ranks by narrowing, joins by cells, lattices of thresholds, windows from intervals, counts of all columns."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reconloom.functions.amounts import TOLERANCES
from reconloom.operators import blocking, complete, decide, profile, quantiles, windows

# Quantiles


@pytest.mark.parametrize("kind", ["long", "double"])
@pytest.mark.parametrize("bins", [16, 1024])
def test_quantiles_equal_sorting(spark, kind, bins):
    """Hot values, ties, both signs, large numbers, single values, a group of nulls only."""
    r = random.Random(bins)
    value = (lambda: r.choice([0, 0, 5, -3, r.randrange(-(10**12), 10**12), r.randrange(100)])) if kind == "long" else (lambda: r.choice([0.0, -1.5, r.gauss(0, 1), r.uniform(-1e9, 1e9), 1e-12]))
    groups = {"hot": [value() for _ in range(700)], "one": [value()], "two": [value(), value()], "same": [value()] * 40, None: [value() for _ in range(9)], "none": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("hot", None)] + ([("hot", float("nan"))] if kind == "double" else [])
    r.shuffle(rows)
    d = spark.createDataFrame(rows, f"g string, v {kind}").repartition(4)
    qs = {"q0": 0.0, "q1": 0.25, "mid": 0.5, "p95": 0.95, "q100": 1.0}
    got = {x.g: x for x in quantiles.quantiles(d, "v", qs, ["g"], bins=bins).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, q in qs.items():
            want = float(np.quantile(np.array(vs, float), q)) if vs else None
            assert got[g][name] == (want if want is None else pytest.approx(want, rel=1e-12, abs=1e-12)), (g, name)


def test_quantiles_without_rows(spark):
    none = spark.createDataFrame([], "g string, v long")
    assert [tuple(r) for r in quantiles.quantiles(none, "v", {"mid": 0.5}).collect()] == [(None,)]
    assert quantiles.quantiles(none, "v", {"mid": 0.5}, ["g"]).count() == 0


def test_no_task_gathers_values(spark):
    """Between rounds there is a row for each rank, and a round moves bins, not values."""
    d = spark.range(200_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 1_000_003).alias("v"), F.lit(1).cast("long").alias("c"))
    ranks = spark.createDataFrame([("g", 100_000)], "g string, rank long")
    out = quantiles.ranked_values(d, ranks, True)
    assert out.collect()[0].value == sorted(x * 7919 % 1_000_003 for x in range(200_000))[100_000]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower() and "collect_list" not in plan.lower()


# Joins by cells

B, A = "b_id long, ccy string, account string, b_cents long, b_vd date", "a_id long, ccy string, account string, a_cents long, a_vd date"


def hot_sides(spark, n=500, seed=1):
    """Half of all rows at one amount, a few amounts around it and on both sides of 0, the rest anywhere."""
    r = random.Random(seed)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(r.randrange(400))
    amount = lambda: r.choice([1_000_000, 1_000_000, 1_000_000, r.choice([999_999, 1_000_001, 950_000, 949_999, 1_050_000, 0, 1, -1, 30, -70, 100]), r.randrange(-3_000_000, 3_000_000)])
    side = lambda m: [(i, r.choice(["U", "U", "E"]), "X", amount(), day()) for i in range(m)]
    b, a = side(n), side(n + 100)
    return b, a, spark.createDataFrame(b, B).repartition(4), spark.createDataFrame(a, A).repartition(4)


def brute(b, a, keep, low=-7, high=7):
    return Counter((x[0], y[0]) for x in b for y in a if x[1:3] == y[1:3] and low <= (y[4] - x[4]).days <= high and keep(y[3], x[3]))


@pytest.mark.parametrize("most", [3, 10, 20_000])
def test_joins_equal_brute_force_with_a_hot_amount(spark, most):
    b, a, bd, ad = hot_sides(spark)
    pairs = lambda d: Counter((r.b_id, r.a_id) for r in d.collect())
    for tolerance in (0, 1, 4, 5, 100):
        assert pairs(blocking.band_join(bd, ad, tolerance, most=most)) == brute(b, a, lambda x, y: abs(x - y) <= tolerance)  # noqa: B023
    assert pairs(blocking.band_join(bd, ad, 1, -1_000_000, 1_000_000, most=most)) == brute(b, a, lambda x, y: abs(x - y) <= 1, -(10**6), 10**6)
    fee = lambda x, y: abs(x - y) <= 1 or ((x > 0) - (x < 0) == (y > 0) - (y < 0) and abs(x) * 100 >= abs(y) * 95 and abs(x) <= abs(y))
    assert pairs(blocking.fee_candidates(bd, ad, most=most)) == brute(b, a, fee)
    inside = {n: (lambda x, y, c=c, p=p: abs(x - y) * 10**6 <= c * 10**6 + abs(y) * p if p else abs(x - y) <= c) for n, c, p in TOLERANCES}
    flagged = blocking.tolerance_candidates(bd, ad, most=most)
    assert pairs(flagged) == brute(b, a, lambda x, y: inside["r5"](x, y) or inside["c100"](x, y))
    for n, f in inside.items():
        assert pairs(flagged.filter(f"in_{n}")) == brute(b, a, f), n


def test_a_hot_cell_is_cut_evenly(spark):
    """Half of all rows at one amount and day: the fullest task gets at most three times the median's rows, on either side."""
    r = random.Random(5)
    rows = lambda n: [(i, "U", "X", 1_000_000 if i % 2 else r.randrange(10**7), dt.date(2024, 1, 1 if i % 2 else 1 + r.randrange(28))) for i in range(n)]
    cell = lambda d, c: d.withColumn("_c", F.col(c)).withColumn("_d", F.lit(0))
    bd, ad = cell(spark.createDataFrame(rows(4000), B), "b_cents"), cell(spark.createDataFrame(rows(6000), A), "a_cents")
    left, right, key = blocking.dealt(bd, ad, ["ccy", "account", "_c", "_d"], 100)
    assert key[-2:] == ["_pa", "_pb"]
    for d in (left, right):
        cells = d.groupBy(*key).count()
        assert cells.agg(F.max("count")).collect()[0][0] <= 150
        tasks = sorted(x["count"] for x in d.repartition(16, *key).groupBy(F.spark_partition_id().alias("t")).count().collect())
        assert tasks[-1] <= 3 * tasks[len(tasks) // 2]


def test_sides_without_a_hot_cell_stay(spark):
    _, _, bd, ad = hot_sides(spark, 50)
    plan = blocking.band_join(bd, ad)._jdf.queryExecution().executedPlan().toString()
    assert "_pa" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# Thresholds


def test_grid_equals_rows_times_points(spark):
    r = random.Random(2)
    rows = [(i, h := r.random() < 0.9, r.choice([0.0, 0.02, 0.05, 0.1, 0.3, 0.15]) if h else None, r.choice([0.0, 0.005, 0.0049, 0.02, 0.5]) if h else None, h and r.random() < 0.8, int(r.random() < 0.2), [f"k{r.randrange(2)}"]) for i in range(400)]
    base = spark.createDataFrame(rows, "b_id long, has boolean, top1 double, margin double, exact1 boolean, added_count int, answer_keys array<string>")
    gold = spark.createDataFrame([(i, ["k0"]) for i in range(0, 400, 2)], "b_id long, gold array<string>")
    ts, ms = [0.0, 0.02, 0.1, 0.15], [0.0, 0.005, 0.02]
    got = {(x.min_top1, x.min_margin): x for x in decide.grid(base, gold, ts, ms).collect()}
    assert len(got) == 12
    for (t, m), x in got.items():
        low = [h and (p < t or g < m) for _, h, p, g, *_ in rows]
        other = [not h or n > 0 or (h and not e) for _, h, _, _, e, n, _ in rows]
        ok = [k == (["k0"] if i % 2 == 0 else []) for i, *_, k in rows]
        auto = [not a and not b for a, b in zip(low, other, strict=True)]
        only = [a and not b for a, b in zip(low, other, strict=True)]
        share = lambda a, b: round(100 * sum(u and v for u, v in zip(a, b, strict=True)) / sum(a), 3) if sum(a) else None
        assert (x.lc_fired, x.lc_only, x.auto_closed) == (sum(low), sum(only), sum(auto))
        assert (x.lc_correct_pct, x.lc_only_correct_pct, x.auto_precision_pct) == (share(low, ok), share(only, ok), share(auto, ok))
        assert x.auto_coverage_pct == round(100 * sum(auto) / 400, 3)


def test_sweep_equals_answers_at_each_threshold(spark):
    r = random.Random(3)
    keys = ["k1", "k2", "k3", "k4"]
    feats, tops, gold = [], [], []
    for i in range(300):
        top = r.choice([None, "k0", "k0", "k0"])
        tops.append((i, top))
        if top:
            feats += [(i, k, r.choice([10, 49, 50, 55, 56, 95, 100])) for k in r.sample(keys, r.randrange(4))]
        g = r.sample(["k0", *keys], r.randrange(4))
        if g:
            gold.append((i, g))
    fd, td, gd = spark.createDataFrame(feats, "b_id long, key string, p0 int"), spark.createDataFrame(tops, "b_id long, top_key string"), spark.createDataFrame(gold, "b_id long, gold array<string>")
    ts = (50, 55, 60, 95, complete.OFF)
    got = {x.t: x for x in complete.sweep(complete.correct_between(fd, F.col("p0"), td, gd), ts).collect()}
    label, seconds = {i: sorted(g) for i, g in gold}, {}
    for i, k, p in feats:
        seconds.setdefault(i, []).append((k, p))
    right = lambda t: [sorted({top, *(k for k, p in seconds.get(i, []) if p >= t)}) == label.get(i, []) if top else label.get(i, []) == [] for i, top in tops]
    off = right(complete.OFF)
    for t in ts:
        on = right(t)
        assert (got[t].correct, got[t].rows) == (sum(on), 300)
        assert (got[t].gained, got[t].lost) == (sum(a and not b for a, b in zip(on, off, strict=True)), sum(b and not a for a, b in zip(on, off, strict=True)))
        answers = {x.b_id: x["keys"] for x in complete.answers(fd, F.col("p0"), td, t).collect()}
        assert answers == {i: sorted({top, *(k for k, p in seconds.get(i, []) if p >= t)}) if top else [] for i, top in tops}


# Windows


def test_window_table_equals_each_window_by_itself(spark):
    """Rows with far more pairs than five, true ones among the last, ties of score, no pairs, no labels."""
    r = random.Random(6)
    pairs, gold = [], []
    for b in range(60):
        n = r.choice([0, 1, 3, 40])
        pairs += [(b, 1000 * b + i, r.choice([0, 1, -1, 7, -7, 8, 14, -30, 31, 60, 61, -400, 900]), f"k{r.randrange(12)}", r.choice([0.1, 0.5, 0.5, round(r.random(), 2)])) for i in range(n)]
        if r.random() < 0.8:
            gold.append((b, [f"k{x}" for x in r.sample(range(12), r.choice([1, 1, 3]))]))
    pd_, gd = spark.createDataFrame(pairs, "b_id long, a_id long, gap int, allocation string, score double"), spark.createDataFrame(gold, "b_id long, gold array<string>")
    got = {x.window: x for x in windows.window_table(pd_, gd, spark.range(60).withColumnRenamed("id", "b_id")).collect()}
    label = dict(gold)
    for name, lo, hi in blocking.SYMMETRIC + blocking.ONE_SIDED:
        want = Counter()
        for b in range(60):
            mine = sorted(((-s, a, k) for x, a, g, k, s in pairs if x == b and lo <= g <= hi))
            g = label.get(b, [])
            want["ceiling"] += any(k in g for _, _, k in mine)
            want["top5"] += any(k in g for _, _, k in mine[:5])
            want["top1"] += bool(mine) and mine[0][2] in g
            want["match"] += (len(g) == 1 and mine[0][2] in g) if mine else not g
            want["abstained"] += not mine and bool(g)
        assert {k: got[name][k] for k in ("ceiling", "top5", "top1", "match", "abstained")} == {k: want[k] for k in ("ceiling", "top5", "top1", "match", "abstained")}, name
        assert got[name].rows == 60


# Counts of all columns


def test_distinct_counts_of_all_columns(spark):
    r = random.Random(9)
    long = "x" * 100
    rows = [(r.randrange(5), r.choice([None, "a", "b", ""]), r.choice([long + "1", long + "2", long + "1"]), [r.randrange(2)], None, 1.5 if i % 3 else None) for i in range(500)]
    d = spark.createDataFrame(rows, "a int, b string, c string, d array<int>, e string, f double").repartition(4)
    got = {r["i"]: r["n_unique"] for r in profile.distinct_counts(d).collect()}
    assert got == {0: 5, 1: 3, 2: 2, 3: 2, 5: 1}
    one = {r["column"]: r for r in profile.schema_profile(d, "a").collect()}
    assert one["e"].n_unique == 0 and one["e"].nulls == 500 and one["a"].n_unique == 5
    assert "Expand" not in profile.distinct_counts(d)._jdf.queryExecution().executedPlan().toString()


# Scores of pairs


def scored_by_hand(pairs, b, a):
    """Cosine of tf * (ln((1 + N) / (1 + df)) + 1) over n-grams of 3 to 5 characters that two texts or more have."""
    import math

    grams = lambda t: Counter(t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1))
    counted = {("a", k): grams(t) for k, t in a.items()} | {("b", k): grams(t) for k, t in b.items()}
    df = Counter(g for c in counted.values() for g in c)
    w = {k: {g: tf * (math.log((1 + len(counted)) / (1 + df[g])) + 1) for g, tf in c.items() if df[g] >= 2} for k, c in counted.items()}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) or 1.0 for k, v in w.items()}
    return {(i, j): round(sum(x * w["a", j].get(g, 0.0) for g, x in w["b", i].items()) / norm["b", i] / norm["a", j], 6) for i, j in pairs}


@pytest.mark.parametrize("small", [True, False])
def test_scores_of_pairs(spark, monkeypatch, small):
    """By weights that tasks hold, and by a join where frequencies are too many; texts of many kinds; tables cut anywhere."""
    from reconloom.operators import ranking

    monkeypatch.setattr(ranking, "BROADCAST_GRAMS", 4_000_000 if small else 0)
    monkeypatch.setattr(ranking, "CHARACTERS", 40)
    r = random.Random(4)
    text = lambda: r.choice(["", "ab", "aaaaaaaa", "x" * 300]) if r.random() < 0.2 else "".join(r.choice("ab1é語😀") for _ in range(r.randrange(3, 40)))
    b, a = {i: text() for i in range(30)}, {i: text() for i in range(1000, 1060)}
    pairs = [(i, j) for i in b for j in a if r.random() < 0.5]
    stmt, led = spark.createDataFrame(list(b.items()), "b_id long, b_text string"), spark.createDataFrame(list(a.items()), "a_id long, a_text string")
    given = spark.createDataFrame(pairs, "b_id long, a_id long").join(stmt, "b_id").join(led, "a_id")
    got = ranking.score_pairs(given, stmt, led)
    assert {(x.b_id, x.a_id): x.score for x in got.collect()} == pytest.approx(scored_by_hand(pairs, b, a), abs=2e-6)
    assert ("ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()) is small


def test_pairs_and_weights_are_not_kept(spark, sf_dir):
    """Scoring adds no join to that of the pairs, and keeps neither weights nor pairs beyond the best five."""
    from reconloom.plans.context import Batch

    b = Batch(spark, sf_dir)
    joins = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(b.scored) == joins(b.pairs)
    assert not b.scored.is_cached and not hasattr(b, "a_vectors")
    b.release()


def test_longest_run(spark):
    """Against every substring; digits of other scripts are none."""
    from reconloom.functions import text

    r = random.Random(9)
    rows = [("".join(r.choice("01x") for _ in range(r.randrange(0, 30))), "".join(r.choice("01x") for _ in range(r.randrange(0, 400)))) for _ in range(200)]
    rows += [("", "1" * 20), ("1" * 20, "1" * 20), ("1" * 20, "1" * 9), ("٠١٢٣٤٥٦٧", "٠١٢٣٤٥٦٧"), (None, "1" * 9), ("1" * 9, None), ("a1234567\n1234567b", "1234567\n1234567")]
    want = [max((k for k in range(7, 13) for i in range(len(a or "") - k + 1) if all(c in "0123456789" for c in a[i : i + k]) and a[i : i + k] in (b or "")), default=0) for a, b in rows]
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a string, b string").select("i", text.longest_run("a", "b").alias("n"), text.shares_run("a", "b").alias("s"))
    got = sorted(d.collect())
    assert [x.n for x in got] == want and [x.s for x in got] == [n > 0 for n in want] and len(set(want)) > 3


@pytest.mark.parametrize("most", [3, 20_000])
@pytest.mark.parametrize("window", [(-7, 7), (0, 30)])
def test_tolerances_are_counted_without_pairs(spark, monkeypatch, most, window):
    """Against pairs by brute force, with a hot amount, nulls, and cells that reach over the tables of a task."""
    b, a, bd, ad = hot_sides(spark)
    cells = blocking._cells
    monkeypatch.setattr(blocking, "_cells", lambda batches, key, rows: cells((t.slice(i, 7) for t in batches for i in range(0, t.num_rows, 7)), key, 50))
    nulls = [(9000, None, "X", 5, dt.date(2024, 1, 1)), (9001, "U", "X", None, dt.date(2024, 1, 1)), (9002, "U", "X", 5, None)]
    bd, ad = bd.unionAll(spark.createDataFrame(nulls, B)), ad.unionAll(spark.createDataFrame(nulls, A))
    got = {r.b_id: r for r in blocking.tolerance_counts(bd, ad, low=window[0], high=window[1], most=most).collect()}
    for n, c, p in TOLERANCES:
        pairs = brute(b, a, lambda x, y: abs(x - y) * 10**6 <= c * 10**6 + abs(y) * p if p else abs(x - y) <= c, *window)  # noqa: B023
        assert {i: r[f"n_{n}"] for i, r in got.items() if r[f"n_{n}"]} == dict(Counter(i for i, _ in pairs)), n


def test_tolerance_sweep_forms_no_pairs(spark, sf_dir):
    """Nothing is joined by cells: the plan's joins are those with labels and of a row each."""
    from reconloom.plans import all_queries

    plan = all_queries()[0]["tolerance_sweep"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if " Join " in line or "Join Inner" in line]
    assert joins and not any("_d#" in line for line in joins)


@pytest.mark.parametrize("window", [(-7, 7), (-30, 0), (0, 30), (3, 9), (-9, -3)])
def test_fee_band_is_counted_without_pairs(spark, window):
    """Against the predicate by brute force, for both signs, amounts near 0 and windows on one side."""
    b, a, _, _ = hot_sides(spark, seed=3)
    r = random.Random(8)
    b, a = (side + [(2000 + i, "U", "X", r.randrange(-25, 26), dt.date(2024, 1, 1) + dt.timedelta(r.randrange(40))) for i in range(150)] for side in (b, a))
    near = {"c1": blocking.NEAR["c1"], "fee": blocking.fee_ends}
    got = {x.b_id: x for x in blocking.near_counts(spark.createDataFrame(b, B), spark.createDataFrame(a, A), low=window[0], high=window[1], near=near).collect()}
    sign = lambda x: (x > 0) - (x < 0)
    band = {"c1": lambda x, y: abs(x - y) <= 1, "fee": lambda x, y: abs(x - y) <= 1 or (sign(x) == sign(y) and abs(x) * 100 >= abs(y) * 95 and abs(x) <= abs(y))}
    for n, f in band.items():
        assert {i: x[f"n_{n}"] for i, x in got.items() if x[f"n_{n}"]} == dict(Counter(i for i, _ in brute(b, a, f, *window))), n


@pytest.mark.parametrize("name", ["pool_after_amount", "amount_survival", "fee_widening", "one_sided_window"])
def test_counts_form_no_pairs(spark, sf_dir, name):
    from reconloom.plans import all_queries

    plan = all_queries()[0][name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any("_d#" in line for line in plan.splitlines() if "Join " in line)


def test_a_band_join_repeats_rows_little(spark):
    """A statement row looks in four cells at most, two and a half in the mean; they were six."""
    b, a, bd, ad = hot_sides(spark)
    seen = []
    real = blocking.dealt
    try:
        blocking.dealt = lambda x, y, key, most: seen.append((x.count(), y.count())) or real(x, y, key, most)
        blocking.band_join(bd, ad)
    finally:
        blocking.dealt = real
    assert seen[0][0] < 2.8 * len(b) and seen[0][1] == len(a)


def test_suspects_hold_every_heavy_cell(spark):
    """Cells are counted by buckets first; those with too many rows are found, and nothing is cut where no bucket is full."""
    d = spark.range(3000).selectExpr("id AS b_id", "id AS a_id", "IF(id < 500, 7L, id) AS k")
    found = {r.k for r in d.filter(F.pmod(F.xxhash64("k"), F.lit(blocking.BUCKETS)).isin(blocking.suspects(d, d, ["k"], 400))).collect()}
    assert 7 in found and len(found) < 50
    assert blocking.suspects(d, d, ["k"], 600) == [] and blocking.dealt(d, d, ["k"], 600)[2] == ["k"] and len(blocking.dealt(d, d, ["k"], 400)[2]) == 3


def test_reconstruction_gathers_nothing(spark):
    """Exact, over, under, of equal size but different, and without any rebuilt row; no array of ids."""
    from reconloom.operators import regimes

    schema = "b_id long, b_cents long, a_id long, a_cents long"
    true = spark.createDataFrame([(1, 10, 1, 4), (1, 10, 2, 6), (2, 5, 3, 5), (3, 9, 4, 1), (3, 9, 5, 2), (4, 7, 6, 7), (5, 8, 7, 8)], schema)
    again = spark.createDataFrame([(1, 10, 1, 4), (1, 10, 2, 6), (2, 5, 3, 5), (2, 5, 9, 50), (3, 9, 4, 1), (4, 7, 8, 3), (6, 1, 1, 1)], schema)
    d = regimes.reconstruction(true, again)
    assert {(r.b_id, r.sets, r.regime_true, r.regime_rebuilt, r.fraction_true, r.fraction_rebuilt) for r in d.collect()} == {
        (1, "exact", "partition", "partition", 0.0, 0.0), (2, "over", "partition", "repeat", 1.0, 0.5), (3, "under", "neither", "neither", 0.0, 0.0), (4, "under", "partition", "neither", 1.0, 0.0), (5, "under", "partition", None, 1.0, None),
    }
    assert "collect" not in d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [4, 20_000])
def test_best_pairs_are_brute_force(spark, most, monkeypatch):
    """The five best of each row, of joined and scored pairs; what moves between tasks has no text; heavy cells; few pairs at a time."""
    from reconloom.operators import ranking

    monkeypatch.setattr(ranking, "PAIRS", 7)
    r = random.Random(5)
    word = lambda: "".join(r.choice("ab1 ") for _ in range(r.randrange(0, 9)))
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(r.randrange(70))
    row = lambda i: (i, "USD", r.choice(["x", "y", None]), r.choice([0, 1, -1, 5000, 5001, -70_000, 70_001, 68_000, None]), day(), word())
    schema = "{0}_id long, ccy string, account string, {0}_cents long, {0}_vd date, {0}_text string"
    b, a = spark.createDataFrame([row(i) for i in range(120)], schema.format("b")), spark.createDataFrame([row(i) for i in range(200)], schema.format("a"))
    frequency = ranking.document_frequency(ranking.corpus_of(b, a))
    both = b.select(F.col("b_id").alias("id"), "b_text").join(a.select(F.col("a_id").alias("id"), "a_text"), "id", "full")
    of = {s: F.element_at(F.create_map(*[F.lit(x) for x in sum(((q.id, q[f"{s}_text"] or "") for q in both.collect()), ())]), F.col("id")) for s in "ba"}
    for fee in (False, True):
        pairs = blocking.fee_candidates(b, a) if fee else blocking.band_join(b, a)
        want = {(x.b_id, x["rank"]): (x.a_id, round(x.score * 1e6)) for x in ranking.top_k(ranking.score_pairs(pairs, b, a, frequency=frequency)).collect()}
        reach, ends = (F.floor(F.abs("b_cents") / 20) + 2, blocking.fee_ends) if fee else (F.lit(1), blocking.NEAR["c1"])
        found = ranking.best_pairs(b.drop("b_text"), a.drop("a_text"), frequency.weights, ends, (of["b"], of["a"]), reach, most=most)
        got = {(x.b_id, i + 1): (y.a_id, -y.less) for x in found.collect() for i, y in enumerate(x.best)}
        assert got == want and len(got) > 100
        assert "text" not in [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line][0]


def test_what_the_chain_keeps_has_no_text(spark, sf_dir):
    """Kept pairs are ids, amounts and days; judged postings have no candidates; drift meets prices with unpriced keys alone."""
    from reconloom.plans.context import Batch

    b = Batch(spark, sf_dir)
    assert "string" not in b.best.schema["best"].dataType.simpleString()
    assert not {"candidates", "added", "answer_keys"} & set(b.judged.columns)
    assert b.differences.filter("ok and size(rest) > 0").isEmpty()
    b.release()
