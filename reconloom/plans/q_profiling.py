"""Queries: regimes, group shapes and data profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from reconloom.functions.keys import encode_keys
from reconloom.operators import compare, profile, regimes
from reconloom.plans.catalog import register
from reconloom.plans.context import BASE, batch

_MEM = BASE + ", mem AS (SELECT s.b_id, s.b_cents, a.a_id, a.a_cents, a.allocation FROM stmt s JOIN led a ON a.b_owner = s.b_id AND a.n <> 9), gs AS (SELECT b_id, b_cents, count(*) AS n_a, count_if(abs(a_cents - b_cents) <= 1) AS n_equal, sum(a_cents)::BIGINT AS total FROM mem GROUP BY b_id, b_cents), gr AS (SELECT *, CASE WHEN abs(total - b_cents) <= 1 THEN 'partition' WHEN n_equal >= 1 THEN 'repeat' ELSE 'neither' END AS regime, abs(total - b_cents) AS residual FROM gs)"


def _members(b):
    return b.stmt.select("b_id", "b_cents").join(b.led.filter("n <> 9").select(F.col("b_owner").alias("b_id"), "a_id", "a_cents", "allocation"), "b_id")


@register("regimes", _MEM + " SELECT regime, count(*) AS rows, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM gr WHERE n_a >= 2 GROUP BY regime")
def regime_shares(spark, sf_dir):
    return regimes.regime_shares(regimes.group_sums(_members(batch(spark, sf_dir))).filter("n_a >= 2"))


@register("amount_residuals", _MEM + " SELECT b_id, n_a, n_equal, total, regime, residual FROM gr")
def amount_residuals(spark, sf_dir):
    return regimes.group_sums(_members(batch(spark, sf_dir))).drop("b_cents")


@register("residuals_by_shape", _MEM + """, sh AS (SELECT *, least(n_a, 4) AS shape FROM gr) SELECT shape, count(*) AS rows, round(count_if(residual <= 1) * 100.0 / count(*), 3) AS exact_pct, round(count_if(residual <= 100) * 100.0 / count(*), 3) AS within_unit_pct,
  median(residual) AS median, round(quantile_cont(residual, 0.95), 4) AS p95, max(residual) AS largest FROM sh GROUP BY shape""")
def residuals_by_shape(spark, sf_dir):
    return regimes.residuals_by_shape(regimes.group_sums(_members(batch(spark, sf_dir))))


@register("seeded_order", "SELECT o_orderkey, row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) AS place FROM orders")
def seeded_order(spark, sf_dir):
    return profile.shuffled(batch(spark, sf_dir).read("orders").select("o_orderkey"), "o_orderkey", 7)


@register("worked_examples", _MEM + ", fi AS (SELECT regime, min(b_id) AS b_id FROM gr WHERE n_a >= 2 GROUP BY regime) SELECT gr.regime, gr.b_id, gr.total, gr.residual, mem.b_cents, a_id, a_cents FROM fi JOIN gr ON gr.b_id = fi.b_id JOIN mem ON mem.b_id = fi.b_id")
def worked_examples(spark, sf_dir):
    return regimes.worked_examples(_members(batch(spark, sf_dir)))


@register("worked_examples_by_shape", _MEM + ", sh AS (SELECT *, least(n_a, 4) AS shape FROM gr WHERE n_a >= 2), fi AS (SELECT shape, min(b_id) AS b_id FROM sh GROUP BY shape) SELECT sh.shape, sh.b_id, sh.total, sh.residual, mem.b_cents, a_id, a_cents FROM fi JOIN sh ON sh.b_id = fi.b_id JOIN mem ON mem.b_id = fi.b_id")
def worked_examples_by_shape(spark, sf_dir):
    return regimes.worked_examples(_members(batch(spark, sf_dir)), "shape")


_REC = _MEM + """, two AS (SELECT b_id FROM mem GROUP BY b_id HAVING count(*) >= 2), tg AS (SELECT b_id, 'USD_' || b_id // 64 AS k, a_id, a_cents, b_cents FROM mem WHERE b_id IN (SELECT b_id FROM two)),
ag AS (SELECT DISTINCT x.b_id, x.b_cents, y.a_id, y.a_cents FROM (SELECT DISTINCT b_id, b_cents, k FROM tg) x JOIN (SELECT * FROM tg) y ON x.k = y.k),
sd AS (SELECT 't' AS s, b_id, b_cents, a_id, a_cents FROM tg UNION ALL SELECT 'r', b_id, b_cents, a_id, a_cents FROM ag),
ss AS (SELECT s, b_id, CASE WHEN abs(sum(a_cents) - b_cents) <= 1 THEN 'partition' WHEN count_if(abs(a_cents - b_cents) <= 1) >= 1 THEN 'repeat' ELSE 'neither' END AS regime, round_even(count_if(abs(a_cents - b_cents) <= 1) / count(*), 1) AS fraction, list_sort(list(DISTINCT a_id)) AS ids FROM sd GROUP BY s, b_id, b_cents),
rc AS (SELECT t.b_id, CASE WHEN t.ids = r.ids THEN 'exact' WHEN len(r.ids) > len(t.ids) THEN 'over' ELSE 'under' END AS sets, t.regime AS regime_true, r.regime AS regime_rebuilt, t.fraction AS fraction_true, r.fraction AS fraction_rebuilt FROM ss t JOIN ss r ON t.b_id = r.b_id AND t.s = 't' AND r.s = 'r')"""


def _reconstruction(b):
    """Groups rebuilt through keys that several statements share."""
    mem = _members(b)
    two = mem.groupBy("b_id").count().filter("count >= 2").select("b_id")
    true = mem.join(two, "b_id", "left_semi").withColumn("k", F.concat(F.lit("USD_"), F.floor(F.col("b_id") / 64).cast("string")))
    led = true.select(F.col("k").alias("allocation"), "a_id", "a_cents")
    keys = true.groupBy("b_id").agg(F.collect_set("k").alias("gold"))
    again = regimes.rebuilt(keys, led).join(true.select("b_id", "b_cents").distinct(), "b_id")
    return regimes.reconstruction(true.select("b_id", "b_cents", "a_id", "a_cents"), again)


@register("reconstruction", _REC + " SELECT regime_true, regime_rebuilt, sets, count(*) AS rows FROM rc GROUP BY ALL")
def reconstruction(spark, sf_dir):
    return regimes.confusion(_reconstruction(batch(spark, sf_dir)))


@register("fraction_histogram", _REC + """, a AS (SELECT fraction_true AS fraction, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS p FROM rc GROUP BY 1), b AS (SELECT fraction_rebuilt AS fraction, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS p FROM rc GROUP BY 1)
SELECT coalesce(a.fraction, b.fraction) AS fraction, coalesce(a.p, 0) AS pct_true, coalesce(b.p, 0) AS pct_rebuilt, round(coalesce(b.p, 0) - coalesce(a.p, 0), 2) AS error FROM a FULL JOIN b ON a.fraction = b.fraction""")
def fraction_histogram(spark, sf_dir):
    return regimes.fraction_histogram(_reconstruction(batch(spark, sf_dir)))


@register("group_shape", _MEM + """, sh AS (SELECT CASE WHEN coalesce(n_a, 0) >= 10 THEN '10+' WHEN coalesce(n_a, 0) >= 3 THEN '3+' ELSE coalesce(n_a, 0)::VARCHAR END || ':1' AS shape, abs(coalesce(total, 0) - s.b_cents) AS r FROM stmt s LEFT JOIN gs ON gs.b_id = s.b_id)
SELECT shape, count(*) AS groups, count_if(r <= 1) AS exact, count_if(r <= 100) AS within_100, round(quantile_cont(r, 0.5), 3) AS residual_median, round(quantile_cont(r, 0.95), 3) AS residual_p95, max(r) AS residual_max FROM sh GROUP BY shape""")
def group_shape(spark, sf_dir):
    b = batch(spark, sf_dir)
    return regimes.shapes(b.stmt, _members(b))


@register("one_sided_groups", _MEM + " SELECT count(*) AS groups, count_if(m.b_id IS NULL) AS statement_only, count_if(s.b_id IS NULL) AS ledger_only FROM (SELECT * FROM stmt WHERE b_id % 13 <> 0) s FULL JOIN (SELECT DISTINCT b_owner AS b_id FROM led WHERE n <> 9) m ON m.b_id = s.b_id")
def one_sided_groups(spark, sf_dir):
    """All ledger groups against statements of which, by rule, every thirteenth has not come in."""
    b = batch(spark, sf_dir)
    return regimes.one_sided(b.stmt.filter("b_id % 13 <> 0"), b.led.filter("n <> 9").select(F.col("b_owner").alias("b_id")))


@register("label_consistency", BASE + """, d AS (SELECT b_id % 300 AS match_id, CASE WHEN b_id % 300 % 7 = 0 AND b_id // 300 % 2 = 0 THEN 'x' ELSE 'k' || (b_id % 300) END AS k FROM stmt)
SELECT (SELECT count(DISTINCT match_id) FROM d) AS groups, (SELECT count(*) FROM (SELECT match_id FROM d GROUP BY match_id HAVING count(DISTINCT k) = 1)) AS groups_with_one_set, (SELECT count(DISTINCT k) FROM d) AS sets, (SELECT count(*) FROM (SELECT k FROM d GROUP BY k HAVING count(DISTINCT match_id) = 1)) AS sets_of_one_group""")
def label_consistency(spark, sf_dir):
    k = F.col("b_id")
    key = F.when((k % 300 % 7 == 0) & (F.floor(k / 300) % 2 == 0), "x").otherwise(F.concat(F.lit("k"), (k % 300).cast("string")))
    return regimes.label_consistency(batch(spark, sf_dir).queries.select((k % 300).alias("match_id"), F.array(key).alias("keys")))


@register("label_sets", _MEM + ", own AS (SELECT b_id, list_sort(list(DISTINCT allocation)) AS own FROM mem GROUP BY b_id) SELECT count(*) AS labels, count_if(gold = own) AS equal, count_if(len(list_intersect(gold, own)) = len(gold)) AS contained FROM gold JOIN own ON own.b_id = gold.b_id")
def label_sets(spark, sf_dir):
    b = batch(spark, sf_dir)
    return regimes.label_sets(b.gold, _members(b))


_SPLIT = BASE + ", sp AS (SELECT CASE WHEN s.b_id % 5 = 0 THEN 'solution' ELSE 'train' END AS split, coalesce(len(gold), 0) AS n FROM stmt s LEFT JOIN gold ON gold.b_id = s.b_id)"


@register("set_sizes", _SPLIT + " SELECT split, CASE WHEN n >= 4 THEN '4+' ELSE n::VARCHAR END AS bucket, count(*) AS rows, max(n) AS largest, count_if(n > 15) AS over_15, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 2) AS pct FROM sp GROUP BY 1, 2")
def set_sizes(spark, sf_dir):
    b = batch(spark, sf_dir)
    d = b.queries.join(b.gold, "b_id", "left").select(F.when(F.col("b_id") % 5 == 0, "solution").otherwise("train").alias("split"), F.col("gold").alias("keys"))
    return regimes.set_sizes(d)


@register("label_completeness", BASE + ", so AS (SELECT s.b_id, coalesce(len(gold), 0) AS n FROM stmt s LEFT JOIN gold ON gold.b_id = s.b_id WHERE s.b_id % 9 <> 0) SELECT count(*) AS rows, count_if(n > 0) AS filled, count(*) - count_if(coalesce(n, 0) > 0) AS blank, count(so.b_id) AS in_solution, round(count_if(n > 0) / count(*), 6) AS filled_rate FROM stmt LEFT JOIN so ON so.b_id = stmt.b_id")
def label_completeness(spark, sf_dir):
    b = batch(spark, sf_dir)
    sol = b.queries.filter("b_id % 9 <> 0").join(b.gold, "b_id", "left").select("b_id", F.col("gold").alias("keys"))
    return profile.label_completeness(b.queries, sol)


@register("encoding_share", BASE + " SELECT count(*) AS labels, count_if(len(gold) > 1) AS bracketed, round(count_if(len(gold) > 1) * 100.0 / count(*), 3) AS bracketed_pct FROM gold")
def encoding_share(spark, sf_dir):
    return profile.encoding_share(batch(spark, sf_dir).gold.select(encode_keys("gold").alias("label")), "label")


@register("schema_profile", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_unique, round((count(*) - count({c})) * 100.0 / count(*), 3) AS null_pct, {f} AS first FROM customer" for c, t in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")) for f in [f"arg_min({c}::VARCHAR, c_custkey) FILTER ({c} IS NOT NULL)"]) + ")")
def schema_profile(spark, sf_dir):
    return profile.schema_profile(batch(spark, sf_dir).read("customer"), "c_custkey")


@register("value_counts", "SELECT o_orderstatus AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 3) AS pct FROM orders GROUP BY 1")
def value_counts(spark, sf_dir):
    return profile.value_counts(batch(spark, sf_dir).read("orders"), "o_orderstatus")


@register("top_values", "SELECT l_suppkey AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 3) AS pct FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_values(spark, sf_dir):
    return profile.top_values(batch(spark, sf_dir).read("lineitem"), "l_suppkey")


@register("describe", "SELECT count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS max FROM orders")
def describe(spark, sf_dir):
    return profile.describe(batch(spark, sf_dir).read("orders"), "o_totalprice")


_FILL = ("lang", "source", "text")


@register("fill_rate", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS side, round(count_if(coalesce({c}, '') <> '') * 100.0 / count(*), 3) AS filled_pct FROM documents GROUP BY 2" for c in _FILL))
def fill_rate(spark, sf_dir):
    return profile.fill_rate(batch(spark, sf_dir).read("documents"), list(_FILL), F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B"))


@register("crosstab", "SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'All' ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'All' ELSE l_linestatus END AS l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def crosstab(spark, sf_dir):
    return profile.crosstab(batch(spark, sf_dir).read("lineitem"), "l_returnflag", "l_linestatus")


@register("semi_coverage", "WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT (SELECT count(*) FROM a) AS left_keys, (SELECT count(*) FROM a SEMI JOIN b ON a.k = b.k) AS left_covered, round((SELECT count(*) FROM a SEMI JOIN b ON a.k = b.k) / (SELECT count(*) FROM a), 6) AS left_fraction, (SELECT count(*) FROM b) AS right_keys, (SELECT count(*) FROM b SEMI JOIN a ON a.k = b.k) AS right_covered, round((SELECT count(*) FROM b SEMI JOIN a ON a.k = b.k) / (SELECT count(*) FROM b), 6) AS right_fraction")
def semi_coverage(spark, sf_dir):
    b = batch(spark, sf_dir)
    return profile.coverage(b.read("customer").select(F.col("c_custkey").alias("k")), b.read("orders").select(F.col("o_custkey").alias("k")), "k")


@register("set_operations", "WITH a AS (SELECT DISTINCT doc_id AS k FROM documents), b AS (SELECT DISTINCT doc_id + 500 AS k FROM labels) SELECT 'both' AS op, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'left_only', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'right_only', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'any', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)")
def set_operations(spark, sf_dir):
    b = batch(spark, sf_dir)
    return profile.set_operations(b.read("documents").select(F.col("doc_id").alias("k")), b.read("labels").select((F.col("doc_id") + 500).alias("k")), "k")


@register("date_range", BASE + " SELECT min(a_vd)::VARCHAR AS first, max(a_vd)::VARCHAR AS last, max(a_vd) - min(a_vd) AS span_days, count(DISTINCT a_vd) AS distinct_days FROM led")
def date_range(spark, sf_dir):
    return profile.date_range(batch(spark, sf_dir).led, "a_vd")


@register("year_counts", BASE + " SELECT year(b_vd)::INT AS year, count(*) AS n FROM stmt GROUP BY 1")
def year_counts(spark, sf_dir):
    return profile.year_counts(batch(spark, sf_dir).stmt, "b_vd")


@register("temporal_overlap", BASE + """, e AS (SELECT min(b_vd) AS lo, max(b_vd) AS hi FROM stmt WHERE b_id % 3 <> 0 AND year(b_vd) < 1997), t AS (SELECT round(count_if(b_vd BETWEEN lo AND hi) / count(*), 6) AS inside, round(count_if(b_vd <= hi) / count(*), 6) AS not_after, count(*) AS rows FROM stmt, e WHERE b_id % 3 = 0)
SELECT rows, inside, not_after, CASE WHEN not_after >= 0.95 THEN 'overlapping' WHEN not_after <= 0.05 THEN 'temporal split' ELSE 'partial overlap' END AS verdict FROM t""")
def temporal_overlap(spark, sf_dir):
    s = batch(spark, sf_dir).stmt
    return profile.temporal_overlap(s.filter((F.col("b_id") % 3 != 0) & (F.year("b_vd") < 1997)), s.filter("b_id % 3 = 0"), "b_vd")


@register("sign_convention", BASE + ", u AS (SELECT 'A' AS side, CASE WHEN a_cents > 0 THEN 'CR' ELSE 'DR' END AS kind, a_cents AS c FROM led UNION ALL SELECT 'B', CASE WHEN b_cents > 0 THEN 'DR' ELSE 'CR' END, b_cents FROM stmt) SELECT side, kind, count(*) AS rows, round(count_if(c < 0) * 100.0 / count(*), 3) AS negative_pct, round(count_if(c > 0) * 100.0 / count(*), 3) AS positive_pct FROM u GROUP BY side, kind")
def sign_convention(spark, sf_dir):
    b = batch(spark, sf_dir)
    a = b.led.select(F.lit("A").alias("side"), F.when(F.col("a_cents") > 0, "CR").otherwise("DR").alias("kind"), F.col("a_cents").alias("c"))
    s = b.stmt.select(F.lit("B").alias("side"), F.when(F.col("b_cents") > 0, "DR").otherwise("CR").alias("kind"), F.col("b_cents").alias("c"))
    return profile.sign_convention(a.unionByName(s), "side", "kind", "c")


@register("assumption_checks", BASE + """, f AS (SELECT 'keys are unique to a row' AS title, round((SELECT count(DISTINCT allocation) FROM led) / (SELECT count(*) FROM led), 6) AS share UNION ALL SELECT 'every statement has a ledger row', round((SELECT count(DISTINCT b_id) FROM gold) / (SELECT count(*) FROM stmt), 6) UNION ALL SELECT 'ledger date is the statement date', round((SELECT count_if(a_vd = b_vd) / count(*) FROM led JOIN stmt ON b_id = b_owner), 6))
SELECT title, share, CASE WHEN share >= 1 THEN 'OK' WHEN share < 0.9 THEN 'BROKEN' ELSE 'NUANCED' END AS status FROM f""")
def assumption_checks(spark, sf_dir):
    b = batch(spark, sf_dir)
    facts = [
        ("keys are unique to a row", b.led.agg(F.round(F.count_distinct("allocation") / F.count("*"), 6).alias("share"))),
        ("every statement has a ledger row", b.queries.join(b.gold, "b_id", "left").agg(F.round(F.count("gold") / F.count("*"), 6).alias("share"))),
        ("ledger date is the statement date", b.led.join(b.stmt.select(F.col("b_id").alias("b_owner"), "b_vd"), "b_owner").agg(F.round(F.count_if(F.col("a_vd") == F.col("b_vd")) / F.count("*"), 6).alias("share"))),
    ]
    out = [d.select(F.lit(t).alias("title"), "share") for t, d in facts]
    return profile.checks(out[0].unionAll(out[1]).unionAll(out[2]))


@register("compare_results", """SELECT o_orderkey, 1 AS nth, CASE o_orderkey % 1000 WHEN 7 THEN 'o_totalprice' WHEN 11 THEN 'o_orderstatus' END AS "column", o_orderkey % 1000 IN (109) AS left_missing, o_orderkey % 1000 = 108 AS right_missing FROM orders WHERE o_orderkey % 1000 IN (7, 11, 108)
UNION ALL SELECT o_orderkey, 2, NULL, true, false FROM orders WHERE o_orderkey % 1000 = 109 UNION ALL SELECT -1, 1, NULL, true, false""")
def compare_results(spark, sf_dir):
    """Orders against themselves with planted differences: amounts, states, rows left out, repeated and put in; prices within a hundredth are equal."""
    left = batch(spark, sf_dir).read("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    r = F.col("o_orderkey") % 1000
    right = left.filter(r != 108).withColumns({"o_totalprice": F.col("o_totalprice") + F.when(r == 7, 5.0).otherwise(0.000001), "o_orderstatus": F.when(r == 11, "Z").otherwise(F.col("o_orderstatus"))})
    right = right.unionByName(right.filter(r == 109)).unionByName(left.limit(1).withColumn("o_orderkey", F.lit(-1).cast(left.schema["o_orderkey"].dataType))).repartition(8)
    d = compare.compare(left, right, ["o_orderkey"], {"o_totalprice": 0.01})
    return d.select("o_orderkey", "nth", "column", F.coalesce(F.col("column").isNull() & (F.col("left") == "missing"), F.lit(False)).alias("left_missing"), F.coalesce(F.col("column").isNull() & (F.col("right") == "missing"), F.lit(False)).alias("right_missing"))
