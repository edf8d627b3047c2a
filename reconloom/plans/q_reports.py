"""Queries: exposure, queue, drift and gates over the decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.functions.amounts import AMOUNT_BUCKETS, money, plain
from reconloom.operators import drift, exposure, text_index, treemap
from reconloom.plans.catalog import register
from reconloom.plans.context import BASE, DECIDED, DRIFT, batch
from reconloom.sources.io import shared_folder

_QUEUE = DECIDED + ", q AS (SELECT *, abs(b_cents) AS exposure_cents, row_number() OVER (ORDER BY abs(b_cents) DESC, b_id) AS rank FROM judged WHERE escalate)"


def _pc(a, b, d=3):
    return f"round({a} * 100.0 / nullif({b}, 0), {d})"


@register("exposure_headline", DECIDED + f""", e AS (SELECT *, abs(b_cents) AS v, NOT escalate AS au FROM judged)
SELECT count(*) AS rows, count_if(au) AS auto_rows, count_if(au AND ok) AS auto_correct_rows, count_if(au AND NOT ok) AS auto_wrong_rows, sum(v)::BIGINT AS total_cents, coalesce(sum(CASE WHEN au THEN v END), 0)::BIGINT AS auto_cents, coalesce(sum(CASE WHEN au AND ok THEN v END), 0)::BIGINT AS auto_correct_cents,
  coalesce(sum(CASE WHEN au AND NOT ok THEN v END), 0)::BIGINT AS exposure_cents, coalesce(sum(CASE WHEN NOT au THEN v END), 0)::BIGINT AS queue_cents, {_pc('count_if(au AND ok)', 'count_if(au)')} AS precision_by_rows, {_pc('sum(CASE WHEN au AND ok THEN v END)', 'sum(CASE WHEN au THEN v END)')} AS precision_by_value FROM e""")
def exposure_headline(spark, sf_dir):
    return exposure.headline(batch(spark, sf_dir).judged)


_SUMS = "count(*) AS rows, sum(exposure_cents)::BIGINT AS exposure_cents, coalesce(sum(CASE WHEN ok THEN exposure_cents END), 0)::BIGINT AS would_be_correct_cents"


@register("queue_by_class", _QUEUE + f" SELECT exception_class, {_SUMS}, coalesce(sum(CASE WHEN NOT ok THEN exposure_cents END), 0)::BIGINT AS would_be_wrong_cents, round(sum(exposure_cents) * 100.0 / sum(sum(exposure_cents)) OVER (), 3) AS pct_of_queue FROM q GROUP BY exception_class")
def queue_by_class(spark, sf_dir):
    return exposure.queue_by_class(batch(spark, sf_dir).judged)


@register("queue_by_trigger", _QUEUE + """, tn AS (SELECT unnest(['no_candidate', 'completion_added', 'fee_band_only', 'low_confidence']) AS trigger),
ex AS (SELECT unnest(triggers) AS trigger, ok, exposure_cents FROM q),
g AS (SELECT tn.trigger, count(ok) AS rows, count_if(coalesce(ok, false)) AS correct_rows, coalesce(sum(exposure_cents), 0)::BIGINT AS exposure_cents, coalesce(sum(CASE WHEN ok THEN exposure_cents END), 0)::BIGINT AS would_be_correct_cents FROM tn LEFT JOIN ex ON ex.trigger = tn.trigger GROUP BY tn.trigger)
SELECT *, CASE WHEN rows = 0 THEN 'never fired' WHEN correct_rows * 100 >= 50 * rows THEN 'COSTING COVERAGE' WHEN correct_rows * 100 <= 20 * rows THEN 'earning its keep' ELSE 'mixed' END AS verdict FROM g""")
def queue_by_trigger(spark, sf_dir):
    return exposure.queue_by_trigger(batch(spark, sf_dir).judged)


@register("ranked_queue", _QUEUE + " SELECT rank, b_id, exposure_cents, exception_class, array_to_string(triggers, '|') AS triggers FROM q")
def ranked_queue(spark, sf_dir):
    return exposure.ranked_queue(batch(spark, sf_dir).judged).select("rank", "b_id", "exposure_cents", "exception_class", F.array_join("triggers", "|").alias("triggers"))


@register("queue_pages", _QUEUE + " SELECT ((rank - 1) // 1000)::INT AS page, count(*) AS rows, min(rank) AS first_rank, sum(exposure_cents)::BIGINT AS cents FROM q GROUP BY 1")
def queue_pages(spark, sf_dir):
    p = exposure.pages(exposure.ranked_queue(batch(spark, sf_dir).judged))
    return p.groupBy("page").agg(F.count("*").alias("rows"), F.min("rank").alias("first_rank"), F.sum("exposure_cents").alias("cents"))


@register("queue_search", _QUEUE + " SELECT rank, b_id, exception_class FROM q WHERE exception_class = 'missing_counterparty' AND (contains(b_id::VARCHAR, '12') OR contains(lower(exception_class), '12') OR len(list_filter(triggers, lambda t: contains(lower(t), '12'))) > 0)")
def queue_search(spark, sf_dir):
    q = exposure.ranked_queue(batch(spark, sf_dir).judged)
    return exposure.search_queue(q, "missing_counterparty", "12").select("rank", "b_id", "exception_class")


_POINTS = ", pt AS (SELECT pct, greatest(1, round_even(n * pct / 100.0, 0))::BIGINT AS k, total FROM (SELECT unnest([1, 5, 10, 25, 50, 75, 100]) AS pct), (SELECT count(*) AS n, sum(exposure_cents) AS total FROM q))"


@register("retired_curve", _QUEUE + _POINTS + ", c AS (SELECT rank, sum(exposure_cents) OVER (ORDER BY rank) AS cum FROM q) SELECT pct, k AS rows_reviewed, round(cum * 100.0 / total, 3) AS retired_pct FROM c JOIN pt ON k = rank")
def retired_curve(spark, sf_dir):
    return exposure.retired_curve(exposure.ranked_queue(batch(spark, sf_dir).judged))


@register("random_curve", _QUEUE + _POINTS + """, r AS (SELECT rep, b_id, exposure_cents, md5(rep || '|' || b_id) AS h FROM q, (SELECT unnest(range(20)) AS rep)),
c AS (SELECT rep, row_number() OVER (PARTITION BY rep ORDER BY h, b_id) AS rk, sum(exposure_cents) OVER (PARTITION BY rep ORDER BY h, b_id ROWS UNBOUNDED PRECEDING) AS cum FROM r)
SELECT pct, round(avg(cum * 100.0 / total), 3) AS mean_pct, round(stddev_pop(cum * 100.0 / total), 3) AS sd_pct FROM c JOIN pt ON k = rk GROUP BY pct""")
def random_curve(spark, sf_dir):
    return exposure.random_curve(exposure.ranked_queue(batch(spark, sf_dir).judged))


_MAG = "CASE WHEN v = 0 THEN -3 WHEN v < 10 THEN -2 WHEN v < 100 THEN -1 " + " ".join(f"WHEN v < {10 ** (k + 3)} THEN {k}" for k in range(14)) + " ELSE 14 END"
_MAGT = DECIDED + f""", mg AS (SELECT *, {_MAG} AS exp10 FROM (SELECT *, abs(b_cents) AS v FROM judged)),
mt AS (SELECT exp10, count(*) AS rows, sum(v)::BIGINT AS value_cents, {_pc('count_if(escalate)', 'count(*)')} AS escalation_pct, count_if(NOT escalate) AS auto_rows, {_pc('count_if(NOT escalate AND ok)', 'count_if(NOT escalate)')} AS precision_pct, round(count(*) * 100.0 / sum(count(*)) OVER (), 3) AS pct_of_rows FROM mg GROUP BY exp10)"""


@register("magnitude_buckets", _MAGT + " SELECT * FROM mt")
def magnitude_buckets(spark, sf_dir):
    return exposure.magnitude_table(batch(spark, sf_dir).judged).drop("bucket")


@register("magnitude_slope", _MAGT + ", so AS (SELECT precision_pct, row_number() OVER (ORDER BY exp10) - 1 AS x FROM mt WHERE auto_rows >= 30 AND precision_pct IS NOT NULL) SELECT count(*) AS buckets, round(CASE WHEN count(*) >= 3 THEN regr_slope(precision_pct, x) END, 6) AS slope FROM so")
def magnitude_slope(spark, sf_dir):
    return exposure.magnitude_slope(exposure.magnitude_table(batch(spark, sf_dir).judged))


def _bucket(v):
    ends = AMOUNT_BUCKETS[:-1]
    n = "CASE " + " ".join(f"WHEN {v} < {e} THEN {i}" for i, (e, _) in enumerate(ends)) + f" ELSE {len(ends)} END"
    t = "CASE " + " ".join(f"WHEN {v} < {e} THEN '{x}'" for e, x in ends) + f" ELSE '{AMOUNT_BUCKETS[-1][1]}' END"
    return n, t


_BN, _BT = _bucket("abs(b_cents)")


@register("amount_buckets", BASE + f" SELECT {_BN} AS bucket_ord, {_BT} AS bucket, count(*) AS rows, sum(abs(b_cents))::BIGINT AS value_cents FROM stmt GROUP BY ALL")
def amount_buckets(spark, sf_dir):
    return exposure.amount_table(batch(spark, sf_dir).stmt)


@register("stratified_sample", _QUEUE + ", t AS (SELECT *, md5('0|' || b_id) AS h FROM q), u AS (SELECT *, row_number() OVER (PARTITION BY exception_class ORDER BY h, b_id) AS turn FROM t) SELECT b_id, exception_class, turn FROM u ORDER BY turn, exception_class LIMIT 25")
def stratified_sample(spark, sf_dir):
    return exposure.stratified_sample(exposure.ranked_queue(batch(spark, sf_dir).judged), 25).select("b_id", "exception_class", "turn")


_SHORT = lambda t: "CASE WHEN c < 0 THEN '-' ELSE '' END || CASE " + t + "WHEN v >= 1e9 THEN format('{:,.2f}', v / 1e9) || 'B' WHEN v >= 1e6 THEN format('{:,.2f}', v / 1e6) || 'M' WHEN v >= 1e3 THEN format('{:,.2f}', v / 1e3) || 'K' ELSE format('{:,.2f}', v) END"


@register("money_text", f"""WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * (CASE o_orderkey % 5 WHEN 0 THEN c // 1000 WHEN 1 THEN c WHEN 2 THEN c * 1009 WHEN 3 THEN c * 100003 ELSE c * 100000007 END) AS c
  FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders))
SELECT o_orderkey, {_SHORT('')} AS short, {_SHORT("WHEN v >= 1e12 THEN format('{:,.2f}', v / 1e12) || 'T' ")} AS short_t, CASE WHEN c < 0 THEN '-' ELSE '' END || (abs(c) // 100) || '.' || lpad((abs(c) % 100)::VARCHAR, 2, '0') AS long FROM (SELECT *, abs(c) / 100 AS v FROM m)""")
def money_text(spark, sf_dir):
    """Amounts from cents to trillions, written short (with and without T) and in full."""
    k, c = F.col("o_orderkey") % 5, F.round(F.col("o_totalprice") * 100).cast("long")
    c = F.when(k == 0, F.floor(c / 1000)).when(k == 1, c).when(k == 2, c * 1009).when(k == 3, c * 100003).otherwise(c * 100000007)
    d = batch(spark, sf_dir).read("orders").select("o_orderkey", (F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1) * c).alias("c"))
    return d.select("o_orderkey", money("c").alias("short"), money("c", trillions=True).alias("short_t"), plain("c").alias("long"))


_TOT = """count(*) AS rows, count_if(NOT ok) AS differing, count_if(exact) AS exact_rows, coalesce(sum(CASE WHEN exact THEN drift_lo END), 0)::BIGINT AS net, coalesce(sum(CASE WHEN exact THEN abs(drift_lo) END), 0)::BIGINT AS gross,
  (coalesce(sum(CASE WHEN exact THEN abs(drift_lo) END), 0) - abs(coalesce(sum(CASE WHEN exact THEN drift_lo END), 0)))::BIGINT AS cancelled, coalesce(sum(drift_lo), 0)::BIGINT AS net_lo, coalesce(sum(CASE WHEN exact THEN drift_lo ELSE drift_hi END), 0)::BIGINT AS net_hi,
  coalesce(sum(CASE WHEN exact THEN abs(drift_lo) WHEN drift_lo <= 0 AND drift_hi >= 0 THEN 0 ELSE least(abs(drift_lo), abs(drift_hi)) END), 0)::BIGINT AS gross_lo, coalesce(sum(CASE WHEN exact THEN abs(drift_lo) ELSE greatest(abs(drift_lo), abs(drift_hi)) END), 0)::BIGINT AS gross_hi"""


@register("key_amounts", DRIFT + " SELECT allocation, low, high, n_amounts FROM prices")
def key_amounts(spark, sf_dir):
    return batch(spark, sf_dir).prices


@register("drift_rows", DRIFT + " SELECT * FROM drift")
def drift_rows(spark, sf_dir):
    return batch(spark, sf_dir).drift


@register("drift_headline", DRIFT + f" SELECT {_TOT} FROM drift")
def drift_headline(spark, sf_dir):
    return drift.headline(batch(spark, sf_dir).drift)


@register("drift_by_stratum", DRIFT + f" SELECT stratum, {_TOT} FROM drift GROUP BY stratum")
def drift_by_stratum(spark, sf_dir):
    return drift.by(batch(spark, sf_dir).drift, "stratum")


@register("drift_by_duplicate", DRIFT + f" SELECT dup_ref, {_TOT} FROM drift GROUP BY dup_ref")
def drift_by_duplicate(spark, sf_dir):
    return drift.by(batch(spark, sf_dir).drift, "dup_ref")


@register("drift_buckets", DRIFT + f" SELECT {_BN} AS bucket_ord, {_BT} AS bucket, {_TOT} FROM drift GROUP BY 1, 2")
def drift_buckets(spark, sf_dir):
    return drift.by_amount(batch(spark, sf_dir).drift)


@register("drift_direction", DRIFT + " SELECT stratum, count(*) AS rows, coalesce(sum(d), 0)::BIGINT AS toward, count_if(d > 0) AS up, count_if(d < 0) AS down, count_if(d = 0) AS zero FROM (SELECT stratum, drift_lo * sign(b_cents)::BIGINT AS d FROM drift WHERE exact) GROUP BY stratum")
def drift_direction(spark, sf_dir):
    return drift.direction(batch(spark, sf_dir).drift)


@register("drift_computability", DRIFT + " SELECT (SELECT count_if(n_amounts = 1) FROM prices) AS keys_one_amount, (SELECT count_if(n_amounts > 1) FROM prices) AS keys_more_amounts, count_if(exact) AS exact_rows, count_if(NOT exact) AS bounded_rows, count_if(unpriceable > 0) AS unpriceable_rows, median(CASE WHEN NOT exact THEN drift_hi - drift_lo END) AS width_median, max(CASE WHEN NOT exact THEN drift_hi - drift_lo END) AS width_max FROM drift")
def drift_computability(spark, sf_dir):
    b = batch(spark, sf_dir)
    return drift.computability(b.drift, b.ranges)


@register("drift_concentration", DRIFT + " SELECT stratum, coalesce(sum(abs(drift_lo)), 0)::BIGINT AS gross, round(sum(abs(drift_lo)) * 100.0 / nullif(sum(sum(abs(drift_lo))) OVER (), 0), 3) AS pct FROM drift WHERE exact GROUP BY stratum")
def drift_concentration(spark, sf_dir):
    return drift.concentration(batch(spark, sf_dir).drift)


@register("blind_spot", DRIFT + " SELECT count_if(wrong) AS wrong, count_if(wrong_zero) AS invisible, count_if(wrong_bounded AND drift_lo <= 0 AND drift_hi >= 0) AS straddling, count_if(wrong AND NOT wrong_zero AND NOT (wrong_bounded AND drift_lo <= 0 AND drift_hi >= 0)) AS visible FROM outc")
def blind_spot(spark, sf_dir):
    return drift.blind_spot(batch(spark, sf_dir).drift)


_OUT = "count(*) AS rows, count_if(ok) AS correct, count_if(wrong) AS wrong, count_if(wrong_zero) AS wrong_zero, count_if(wrong_nonzero) AS wrong_nonzero, count_if(wrong_bounded) AS wrong_bounded"


@register("pool_structure", DRIFT + f" SELECT n_exact_keys, dup_ref, {_OUT} FROM outc GROUP BY GROUPING SETS ((n_exact_keys, dup_ref), ())")
def pool_structure(spark, sf_dir):
    return drift.pool_structure(batch(spark, sf_dir).drift)


_GP = DRIFT + """, g AS (SELECT *, unnest([{'gate': 'exact keys > 1', 'hit': n_exact_keys > 1}, {'gate': 'exact rows > 1', 'hit': n_exact_cand > 1}, {'gate': 'dup_ref', 'hit': dup_ref}, {'gate': 'keys>1 or dup', 'hit': n_exact_keys > 1 OR dup_ref}, {'gate': 'keys>1 and dup', 'hit': n_exact_keys > 1 AND dup_ref}]) AS gt FROM outc),
b0 AS (SELECT count(*) AS auto0, count_if(ok) AS ok0, (SELECT count(*) FROM decided) AS n_all FROM drift),
gx AS (SELECT gt.gate AS gate, count_if(gt.hit) AS escalates, count_if(gt.hit AND wrong) AS wrong, count_if(gt.hit AND wrong_zero) AS wrong_zero, count_if(gt.hit AND wrong_nonzero) AS wrong_nonzero, count_if(gt.hit AND wrong_bounded) AS wrong_bounded, count_if(gt.hit AND ok) AS correct_escalated, count_if(NOT gt.hit) AS after, count_if(NOT gt.hit AND ok) AS ok_after FROM g GROUP BY 1),
gy AS (SELECT *, after * 100.0 / n_all AS cov, ok_after * 100.0 / nullif(after, 0) AS prec, ok_after * 100.0 / nullif(after, 0) - ok0 * 100.0 / auto0 AS gain, auto0 * 100.0 / n_all - after * 100.0 / n_all AS lost FROM gx, b0),
gp AS (SELECT gate, escalates, wrong, wrong_zero, wrong_nonzero, wrong_bounded, correct_escalated, round(cov, 3) AS coverage, round(prec, 3) AS precision, round(CASE WHEN gain > 1e-12 THEN lost / gain END, 1) AS points_per_point FROM gy)"""


@register("gate_pricing", _GP + " SELECT * FROM gp")
def gate_pricing(spark, sf_dir):
    b = batch(spark, sf_dir)
    return drift.gate_pricing(b.drift, b.decided)


@register("gate_verdict", _GP + " SELECT gate, points_per_point, CASE WHEN points_per_point IS NULL THEN 'gains nothing' WHEN points_per_point >= 0.8 * 31.36 THEN 'refuse' ELSE 'consider' END AS verdict FROM gp")
def gate_verdict(spark, sf_dir):
    b = batch(spark, sf_dir)
    return drift.gate_verdict(drift.gate_pricing(b.drift, b.decided))


@register("gate_state", _GP + """, st(keys, dup, gate) AS (VALUES (true, false, 'exact keys > 1'), (false, true, 'dup_ref'), (true, true, 'keys>1 or dup')),
n0 AS (SELECT false AS keys, false AS dup, 'none' AS gate, 0::BIGINT AS escalates, round(auto0 * 100.0 / n_all, 3) AS coverage, round(ok0 * 100.0 / auto0, 3) AS precision FROM b0)
SELECT keys, dup, st.gate, escalates, coverage, precision FROM st JOIN gp ON gp.gate = st.gate UNION ALL SELECT * FROM n0""")
def gate_state(spark, sf_dir):
    """What each position of two switches (several exact keys, repeated references) escalates, and coverage and precision with it."""
    b = batch(spark, sf_dir)
    return drift.gate_state(drift.gate_pricing(b.drift, b.decided), b.drift, b.decided)


@register("gate_lift", DRIFT + """, s AS (SELECT wrong_zero, unnest([{'n': 'exact keys > 1', 'h': n_exact_keys > 1}, {'n': 'exact rows > 1', 'h': n_exact_cand > 1}, {'n': 'dup_ref', 'h': dup_ref}]) AS s FROM outc),
t AS (SELECT s.n AS signal, count_if(wrong_zero) AS invisible, count_if(wrong_zero AND s.h) AS caught, count_if(wrong_zero AND s.h) / nullif(count_if(wrong_zero), 0) AS r, count_if(s.h) / count(*) AS b FROM s GROUP BY 1)
SELECT signal, invisible, caught, round(r, 6) AS recall, round(b, 6) AS base, round(r / nullif(b, 0), 6) AS lift, CASE WHEN r IS NULL THEN 'nothing to catch' WHEN r >= 0.9 AND r / nullif(b, 0) >= 2 THEN 'concentrated' ELSE 'not concentrated' END AS verdict FROM t""")
def gate_lift(spark, sf_dir):
    return drift.gate_lift(batch(spark, sf_dir).drift)


@register("residue", DRIFT + " SELECT b_id, abs_b, stratum, drift_lo, drift_hi, exact FROM outc WHERE wrong AND n_exact_keys = 1 ORDER BY abs_b DESC, b_id LIMIT 20")
def residue(spark, sf_dir):
    return drift.residue(batch(spark, sf_dir).drift)


@register("largest_drifts", DRIFT + " SELECT b_id, b_cents, n_posted, n_gold, drift_lo FROM drift WHERE exact AND drift_lo <> 0 ORDER BY abs(drift_lo) DESC, b_id LIMIT 10")
def largest_drifts(spark, sf_dir):
    return drift.largest(batch(spark, sf_dir).drift)


@register("treemap")
def treemap_layout(spark, sf_dir):
    q = exposure.queue_by_class(batch(spark, sf_dir).judged)
    return treemap.layout(q.select(F.lit("main").alias("batch"), F.col("exception_class").alias("label"), F.col("exposure_cents").alias("value")))


@register("drift_examples", DRIFT + """, tp AS (SELECT b_id, drift_lo FROM drift WHERE exact AND drift_lo <> 0 ORDER BY abs(drift_lo) DESC, b_id LIMIT 5),
k AS (SELECT tp.*, answer_keys AS a, coalesce(gold, []::VARCHAR[]) AS g FROM tp JOIN posted p ON p.b_id = tp.b_id LEFT JOIN gold ON gold.b_id = tp.b_id),
e AS (SELECT b_id, drift_lo, 'posted' AS side, unnest(list_filter(list_distinct(a), lambda x: NOT list_contains(g, x))) AS allocation FROM k UNION ALL SELECT b_id, drift_lo, 'label', unnest(list_filter(list_distinct(g), lambda x: NOT list_contains(a, x))) FROM k)
SELECT e.*, low, high FROM e LEFT JOIN prices ON prices.allocation = e.allocation""")
def drift_examples(spark, sf_dir):
    b = batch(spark, sf_dir)
    return drift.examples(b.drift, b.posted, b.gold, b.ranges)


@register("batch_shares", DECIDED + """, h AS (SELECT sum(abs(b_cents))::BIGINT AS t, coalesce(sum(CASE WHEN NOT escalate THEN abs(b_cents) END), 0)::BIGINT AS a, coalesce(sum(CASE WHEN NOT escalate AND ok THEN abs(b_cents) END), 0)::BIGINT AS c, coalesce(sum(CASE WHEN escalate THEN abs(b_cents) END), 0)::BIGINT AS q FROM judged)
SELECT p.n AS part, p.v AS cents, round(p.v * 100.0 / t, 3) AS share_pct FROM (SELECT t, unnest([{'n': 'closed', 'v': a}, {'n': 'closed rightly', 'v': c}, {'n': 'closed wrongly', 'v': a - c}, {'n': 'queue', 'v': q}]) AS p FROM h)""")
def batch_shares(spark, sf_dir):
    return exposure.batch_shares(batch(spark, sf_dir).judged)


@register("ticker", DECIDED + """, q AS (SELECT *, row_number() OVER (ORDER BY abs(b_cents) DESC, b_id) AS rank FROM judged WHERE escalate), c AS (SELECT exception_class, count(*) AS n, sum(abs(b_cents)) AS v FROM judged WHERE escalate GROUP BY 1)
SELECT 'queue' AS kind, rank AS place, upper(replace(exception_class, '_', ' ')) AS name, abs(b_cents)::DOUBLE AS figure, NULL::DOUBLE AS more FROM q WHERE rank <= 5
UNION ALL SELECT 'class', row_number() OVER (ORDER BY v DESC, exception_class), upper(replace(exception_class, '_', ' ')), v::DOUBLE, n::DOUBLE FROM c
UNION ALL SELECT 'precision', 1, 'AUTO-CLOSE PRECISION', round(count_if(NOT escalate AND ok) * 100.0 / count_if(NOT escalate), 3), round(sum(CASE WHEN NOT escalate AND ok THEN abs(b_cents) ELSE 0 END) * 100.0 / sum(CASE WHEN NOT escalate THEN abs(b_cents) END), 3) FROM judged""")
def ticker(spark, sf_dir):
    return exposure.ticker(batch(spark, sf_dir).judged)


_NEEDLES = ("123", "ambig", "DATE_S", "99")


@register("queue_search_index", _QUEUE + " SELECT needle, rank, b_id FROM q, (SELECT unnest(" + str(list(_NEEDLES)) + ") AS needle) WHERE contains(b_id::VARCHAR, lower(needle)) OR contains(lower(exception_class), lower(needle)) OR len(list_filter(triggers, lambda t: contains(lower(t), lower(needle)))) > 0")
def queue_search_index(spark, sf_dir):
    """Several searches of the queue through an index of trigrams; the SQL scans."""
    q = exposure.ranked_queue(batch(spark, sf_dir).judged)
    texts = [F.col("b_id").cast("string"), F.col("exception_class"), F.array_join("triggers", "\n")]
    path = shared_folder(spark, "trigrams")
    text_index.build(q, "b_id", texts, path)
    found = [text_index.search(q, "b_id", texts, path, n).select(F.lit(n).alias("needle"), "rank", "b_id") for n in _NEEDLES]
    return reduce(DataFrame.unionByName, found)
