"""What tasks do with the pairs and texts of their cells, against brute force."""

from __future__ import annotations

import random
from collections import Counter
from math import log, sqrt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reconloom.operators import blocking, chain, ranking, synth


def _texts(n, r):
    return ["".join(r.choice("ab1 é😀") for _ in range(r.choice([0, 1, 2, 3, 5, 9, 30, 70]))) for _ in range(n)] + ["x" * 300 + "ab1", ""]


def _cut(t):
    return Counter(t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1))


def _hash(g):
    return int(ranking._counted([g], np.array([len(g)]), len(g), len(g))[1][0])


@pytest.mark.parametrize("characters", [40, 50_000])
def test_texts_are_weighed_as_rows_of_a_table(monkeypatch, characters):
    """n-grams, their frequencies and cosines of texts of any lengths, pairs few and many."""
    monkeypatch.setattr(ranking, "CHARACTERS", characters)
    r = random.Random(3)
    texts = _texts(150, r)
    cut = [_cut(t) for t in texts]
    df = Counter(g for c in cut for g in c)
    found = pa.Table.from_batches(list(ranking._frequencies([pa.record_batch([pa.array(texts[:70])], names=["t"]), pa.record_batch([pa.array([*texts[70:], None])], names=["t"])])))
    g, n = (found.column(c).to_numpy() for c in ("g", "df"))
    assert dict(zip(g.view(np.uint64).tolist(), n.tolist())) == {_hash(x): k for x, k in df.items()}
    often = n > 1
    w = ranking.Weights(g[often].view(np.uint64), np.log((1 + len(texts)) / (1 + n[often])) + 1)
    weight = {x: log((1 + len(texts)) / (1 + k)) + 1 for x, k in df.items() if k > 1}
    vec = [{x: k * weight[x] for x, k in c.items() if x in weight} for c in cut]
    norm = [sqrt(sum(x * x for x in v.values())) or 1 for v in vec]
    cos = lambda i, j: sum(x * vec[j].get(k, 0) for k, x in vec[i].items()) / norm[i] / norm[j]
    every = [(i, j) for i in range(0, 150, 3) for j in range(152)]
    for pairs in (every, [p for p in every if r.random() < 0.02]):
        bi, ai = (np.array(x) for x in zip(*pairs))
        for many in (None, 5, 1000):
            assert np.allclose(w.dots(texts, texts, bi, ai, many), [cos(i, j) for i, j in pairs], rtol=0, atol=1e-12)


@pytest.mark.parametrize("most", [30, 20_000])
def test_generated_chain_moves_no_pairs(spark, monkeypatch, most):
    """The chain whose rankers work in tasks decides as the chain over joined pairs, ties of score and id too, and joins no pairs."""
    monkeypatch.setattr(ranking, "PAIRS", 500)
    monkeypatch.setattr(ranking.best_pairs, "__defaults__", tuple(most if x == blocking.CELL else x for x in ranking.best_pairs.__defaults__))
    stmt, led, _ = synth.generate(spark, 700, seed=5, config={"log10_cents": [3, 5], "dates": ["2023-03-01", "2023-03-25"], "distractors": 3.0})
    twin = led.filter("a_id % 3 = 0").withColumn("a_id", F.col("a_id") + 500)  # equal scores
    led = led.unionByName(twin).persist()
    stmt = stmt.persist()
    pairs = blocking.fee_candidates(stmt, led)
    show = lambda d: {r.b_id: (r.answer_keys, r.top1_a_id, r.top1, r.margin, r.topk_size, r.exception_class) for r in d.collect()}
    for within, joined in ((None, chain.by_text), (chain.NearnessInTask(), chain.by_nearness)):
        d = chain.run_fee(stmt, led, within)
        want = show(chain.run(stmt, led, pairs, joined))
        assert show(d) == want and len(want) == 700
        assert most < 100 or not [line for line in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "_c#" in line]  # heavy cells are joined with their list
    assert pairs.count() > 3_000


def test_random_curve_orders_few_rows(spark):
    """The curve of whole orders by hash, ties of rank and short queues too; only rows of the ranges of points are put in order."""
    from hashlib import md5
    from statistics import mean, pstdev

    from reconloom.operators import exposure

    r = random.Random(2)
    for n in (1, 5, 3000):
        rows = [(i, r.randrange(1, 10**6)) for i in range(n)]
        queue = spark.createDataFrame(rows, "b_id long, exposure_cents long").repartition(3)
        d = exposure.random_curve(queue, 4)
        want = {}
        for pct in exposure.DECILES:
            k, shares = max(1, round(n * pct / 100.0)), []
            for rep in range(4):
                order = sorted(rows, key=lambda x: (md5(f"{rep}|{x[0]}".encode()).hexdigest(), x[0]))
                shares.append(sum(v for _, v in order[:k]) * 100.0 / sum(v for _, v in rows))
            want[pct] = (mean(shares), pstdev(shares))
        got = {x.pct: (x.mean_pct, x.sd_pct) for x in d.collect()}
        assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=6e-4) for p in want)
    plan = d._jdf.queryExecution().optimizedPlan().toString().splitlines()
    lines = [x for x in plan if "Window [row_number" in x]
    assert lines and any("Join Inner" in x for x in plan[plan.index(lines[0]) :])


def test_rows_are_made_without_lambdas_or_repeats(spark, sf_dir):
    """Ledger rows are made, and rows dealt to cells, by generated code: no interpreted function, and no filter that makes an array again."""
    from reconloom.sources import adapter

    stmt, led = adapter.sides(spark, sf_dir)
    b, a, _ = blocking.cells(stmt.select("b_id", *blocking.BLOCK, "b_cents", "b_vd"), led.select("a_id", *blocking.BLOCK, "a_cents", "a_vd"), blocking.BLOCK, F.lit(1), 0.08, -7, 7, 4)
    for d in (led, b, a):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and not [x for x in plan.splitlines() if "Filter" in x and "size(" in x]
    assert led.groupBy("b_owner").count().agg(F.max("count")).first()[0] > 10
