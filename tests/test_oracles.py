"""Every registered query against its SQL, and queries without SQL for their shape."""

from __future__ import annotations

import pytest

from reconloom.plans import all_queries
from reconloom.plans.context import BASE, CAND, DRIFT, FEATS, RANKED
from tests.helpers import duck_rows, spark_rows

QUERIES, ORACLES = all_queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(duck, ORACLES[name])


#: Queries that measure errors: on rows without errors any result would do.
MEASURES = {
    "drift_headline": (), "drift_by_stratum": (), "drift_by_duplicate": ("cancelled",), "drift_buckets": (), "drift_direction": (), "drift_computability": (), "drift_concentration": (), "blind_spot": (), "pool_structure": (), "gate_pricing": (),
    "gate_lift": (), "gate_verdict": (), "residue": (), "largest_drifts": (), "drift_rows": (), "exposure_headline": (), "completion_effect": (), "grounded_check": (), "investigation_rollup": (), "number_tokens": (), "ungrounded_numbers": (),
}


@pytest.mark.parametrize("name", sorted(MEASURES))
def test_measures_have_something_to_measure(name, duck):
    """No column of numbers is all zero or null, none of flags all the same way, none of texts all empty."""
    cur = duck.execute(ORACLES[name])
    names, rows = [d[0] for d in cur.description], cur.fetchall()
    assert rows
    for k, column in enumerate(names):
        values = [r[k] for r in rows]
        assert any(v not in (None, 0, "", False) for v in values), column
        if all(isinstance(v, bool) for v in values) and len(values) > 20:
            assert len(set(values)) == 2, column


#: What the derived tables have to hold, so that the matching operators can fail: SQL that counts it, of which every column must be positive.
EXERCISED = {
    "pools": CAND + ", p AS (SELECT b_id, count(*) AS n, count_if(a_id // 100 <> b_id) AS o FROM cand GROUP BY b_id) SELECT count_if(n > 5) AS over_5, count_if(n > 50) AS over_50, count_if(o > 0) > 0.33 * count(*) AS a_third_with_others FROM p",
    "cents": CAND + " SELECT count_if(abs(a_cents - b_cents) = 0) AS exact, count_if(a_cents - b_cents = 1) AS more, count_if(b_cents - a_cents = 1) AS less FROM cand",
    "keys": BASE + ", k AS (SELECT allocation, count(*) AS n FROM led GROUP BY 1) SELECT count_if(n = 2) AS two, count_if(n >= 3) AS more FROM k",
    "labels": BASE + " SELECT count_if(len(gold) = 2) AS two, count_if(len(gold) = 3) AS three, count_if(len(gold) > 3) AS more, count_if(len(gold) > 15) AS tail, max(len(gold)) >= 19 AS largest FROM gold",
    "currencies": BASE + " SELECT count(DISTINCT ccy) > 1 AS two, count_if(b_cents > 0) AS positive, count_if(b_cents < 0) AS negative FROM stmt",
    "cut": RANKED + ", c AS (SELECT count(*) AS n FROM scored GROUP BY b_id) SELECT count_if(n > 5) AS cut, (SELECT count(*) FROM ranked WHERE rank = 5) AS fifth FROM c",
    "distinct keys": FEATS + " SELECT count_if(distinct_keys < candidates) AS fewer_keys FROM feats",
    "gates": DRIFT + " SELECT count_if((n_exact_keys > 1) <> (n_exact_cand > 1)) AS keys_and_rows_differ, count_if(n_exact_keys > 1) AS keys, count_if(dup_ref) AS refs FROM drift",
    "label sets": ORACLES["label_sets"].replace("SELECT count(*) AS labels, count_if(gold = own) AS equal", "SELECT count(*) - count_if(gold = own) AS unequal, count_if(gold = own) AS equal, count(*) - count_if(len(list_intersect(gold, own)) = len(gold)) AS not_contained"),
    "consistency": ORACLES["label_consistency"],
    "one side": ORACLES["one_sided_groups"],
    "first step": ORACLES["step_one"],
    "tolerances": f"SELECT count(DISTINCT pairs) = 6 AS all_differ FROM ({ORACLES['tolerance_sweep']})",
    "fractions": f"SELECT count_if(pct_true > 0) > 2 AS true_shares, count_if(pct_rebuilt > 0) > 2 AS rebuilt_shares FROM ({ORACLES['fraction_histogram']})",
    "partitions": f"SELECT correct FROM ({ORACLES['per_class']}) WHERE cut = 'class:partition'",
    "verdicts": f"SELECT count(DISTINCT verdict) > 1 AS differ FROM ({ORACLES['gate_verdict']})",
}


@pytest.mark.parametrize("name", sorted(EXERCISED))
def test_derived_tables_exercise_matching(name, duck):
    cur = duck.execute(EXERCISED[name])
    row = dict(zip([d[0] for d in cur.description], cur.fetchone(), strict=True))
    assert all(v > 0 for v in row.values()), row


def test_verdicts_differ(duck):
    assert len({r[0] for r in duck.execute(f"SELECT verdict FROM ({ORACLES['gate_lift']})").fetchall()}) > 1
    assert {"incomplete_set", "ambiguous_allocation"} <= {r[0] for r in duck.execute(f"SELECT exception_class FROM ({ORACLES['exception_class']})").fetchall()}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry(spark, monkeypatch, sf_dir):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "SMOKE_DIR", sf_dir)
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_optional_import_elsewhere():
    """Nothing outside the optional subpackage imports it, but for the entry file."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "reconloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "reconloom.llm" not in p.read_text(), p
