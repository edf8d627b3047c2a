"""Queries: decisions, exceptions, thresholds, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from reconloom.functions.text import numbers, proposes_match, ungrounded
from reconloom.operators import chain, complete, decide, evidence, exposure, learned, scoring, synth
from reconloom.operators.blocking import exact_amount_baseline
from reconloom.plans.catalog import register
from reconloom.plans.context import DECIDED, FEATS, batch, with_fee

_BASE = "b_id, b_cents, has, topk_size, top1_a_id, top1, margin, exact1, dup_ref, added_count"


@register("basis", DECIDED + f" SELECT {_BASE}, array_to_string(answer_keys, '|') AS answer FROM base")
def basis(spark, sf_dir):
    return batch(spark, sf_dir).base.select(*_BASE.split(", "), F.array_join("answer_keys", "|").alias("answer"))


@register("triggers", DECIDED + " SELECT b_id, no_candidate, completion_added, fee_band_only, low_confidence, escalate, array_to_string(triggers, '|') AS triggers FROM decided")
def triggers(spark, sf_dir):
    return batch(spark, sf_dir).decided.select("b_id", *decide.TRIGGERS, "escalate", F.array_join("triggers", "|").alias("triggers"))


@register("exception_class", DECIDED + " SELECT exception_class, escalate, count(*) AS rows FROM decided GROUP BY ALL")
def exception_class(spark, sf_dir):
    return batch(spark, sf_dir).decided.groupBy("exception_class", "escalate").agg(F.count("*").alias("rows"))


@register("exceptions_file", DECIDED + " SELECT b_id, exception_class, array_to_string(triggers, '|') AS triggers, CASE WHEN len(answer_keys) = 0 THEN '' WHEN len(answer_keys) = 1 THEN answer_keys[1] ELSE '[' || array_to_string(answer_keys, ',') || ']' END AS proposed_answer, top1 AS top1_score, margin FROM decided WHERE escalate")
def exceptions_file(spark, sf_dir):
    return decide.exceptions(batch(spark, sf_dir).decided)


@register("audit_records", DECIDED + " SELECT b_id::VARCHAR AS b_id, b_cents AS b_amount_cents, topk_size AS pool_size, topk_size AS n_candidates, added_count AS n_added, CASE WHEN escalate THEN 'escalate' ELSE 'auto_close' END AS decision, array_to_string(answer_keys, '|') AS answer FROM decided")
def audit_records(spark, sf_dir):
    a = decide.audit(batch(spark, sf_dir).decided, "main")
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return a.select("b_id", "b_amount_cents", "pool_size", n("candidates").alias("n_candidates"), n("added_keys").alias("n_added"), "decision", F.array_join("answer_keys", "|").alias("answer"))


_SUMMARY = " SELECT count_if(NOT escalate) AS auto_closed, count_if(escalate) AS escalated, round(count_if(NOT escalate) * 100.0 / count(*), 3) AS coverage, round(count_if(NOT escalate AND ok) * 100.0 / count_if(NOT escalate), 3) AS precision, round(count_if(ok) * 100.0 / count(*), 3) AS overall_match, count_if(no_candidate) AS no_candidate FROM judged"


def _summary(d):
    auto, n = ~F.col("escalate"), F.count_if
    pc = lambda a, b: F.round(F.try_divide(a * 100.0, b), 3)
    return d.agg(n(auto).alias("auto_closed"), n(~auto).alias("escalated"), pc(n(auto), F.count("*")).alias("coverage"), pc(n(auto & F.col("ok")), n(auto)).alias("precision"), pc(n(F.col("ok")), F.count("*")).alias("overall_match"), n(F.col("no_candidate")).alias("no_candidate"))


@register("decision_summary", DECIDED + _SUMMARY)
def decision_summary(spark, sf_dir):
    return _summary(batch(spark, sf_dir).judged)


@register("decision_summary_fee", with_fee(DECIDED) + _SUMMARY)
def decision_summary_fee(spark, sf_dir):
    """The whole chain again with candidates that may be short by a fee."""
    return _summary(batch(spark, sf_dir, fee=True).judged)


@register("exception_class_fee", with_fee(DECIDED) + " SELECT exception_class, escalate, count(*) AS rows FROM decided GROUP BY ALL")
def exception_class_fee(spark, sf_dir):
    return batch(spark, sf_dir, fee=True).decided.groupBy("exception_class", "escalate").agg(F.count("*").alias("rows"))


_T, _M = decide.GRID_TOP1, decide.GRID_MARGIN
_GRID = DECIDED + f""", gp AS (SELECT t AS min_top1, m AS min_margin FROM (SELECT unnest({list(_T)})::DOUBLE AS t), (SELECT unnest({list(_M)})::DOUBLE AS m)),
gx AS (SELECT min_top1, min_margin, list_sort(answer_keys) = coalesce(gold, []::VARCHAR[]) AS ok, no_candidate OR completion_added OR fee_band_only AS others, coalesce(has AND (top1 < min_top1 OR margin < min_margin), false) AS low FROM decided d LEFT JOIN gold ON gold.b_id = d.b_id, gp),
gt AS (SELECT min_top1, min_margin, count_if(low) AS lc_fired, CASE WHEN count_if(low) > 0 THEN round(count_if(low AND ok) * 100.0 / count_if(low), 3) END AS lc_correct_pct, count_if(low AND NOT others) AS lc_only,
  CASE WHEN count_if(low AND NOT others) > 0 THEN round(count_if(low AND NOT others AND ok) * 100.0 / count_if(low AND NOT others), 3) END AS lc_only_correct_pct, count_if(NOT low AND NOT others) AS auto_closed,
  round(count_if(NOT low AND NOT others) * 100.0 / count(*), 3) AS auto_coverage_pct, CASE WHEN count_if(NOT low AND NOT others) > 0 THEN round(count_if(NOT low AND NOT others AND ok) * 100.0 / count_if(NOT low AND NOT others), 3) END AS auto_precision_pct FROM gx GROUP BY ALL)"""


@register("grid_low_confidence", _GRID + " SELECT * FROM gt")
def grid_low_confidence(spark, sf_dir):
    b = batch(spark, sf_dir)
    return decide.grid(b.base, b.gold, list(_T), list(_M))


@register("selected_thresholds", _GRID + """, s AS (SELECT arg_max({'t': min_top1, 'm': min_margin}, {'c': auto_coverage_pct, 't': -min_top1, 'm': -min_margin}) AS b FROM gt WHERE lc_fired > 0 AND lc_correct_pct < 50)
SELECT coalesce(b.t, 0) AS min_top1, coalesce(b.m, 0) AS min_margin, b IS NULL AS dropped FROM s""")
def selected_thresholds(spark, sf_dir):
    b = batch(spark, sf_dir)
    return decide.select_thresholds(decide.grid(b.base, b.gold, list(_T), list(_M)))


@register("fee_widening", DECIDED + """, fee AS (SELECT s.b_id, count(*) AS n FROM stmt s JOIN led a ON s.ccy = a.ccy AND s.account = a.account AND a.a_vd BETWEEN s.b_vd - 7 AND s.b_vd + 7 AND (abs(a_cents - b_cents) <= 1 OR (sign(a_cents) = sign(b_cents) AND abs(a_cents) * 100 >= abs(b_cents) * 95 AND abs(a_cents) <= abs(b_cents))) GROUP BY s.b_id)
SELECT class, count(*) AS rows, count_if(topk_size > 0) AS with_exact, count_if(coalesce(n, 0) > 0) AS with_fee FROM stmt s JOIN base ON base.b_id = s.b_id LEFT JOIN fee ON fee.b_id = s.b_id GROUP BY class""")
def fee_widening(spark, sf_dir):
    """Rows with candidates by class, with exact amounts and with the fee band."""
    from reconloom.operators.blocking import NEAR, fee_ends, near_counts

    b = batch(spark, sf_dir)
    d = b.stmt.select("b_id", "class").join(near_counts(b.stmt, b.led, near={"c1": NEAR["c1"], "fee": fee_ends}), "b_id", "left")
    return d.groupBy("class").agg(F.count("*").alias("rows"), F.count_if(F.col("n_c1") > 0).alias("with_exact"), F.count_if(F.col("n_fee") > 0).alias("with_fee"))


_LINE = "concat_ws('; ', topk_size || ' cand', CASE WHEN has THEN 'top1=' || CAST(CAST(top1 AS DECIMAL(12, 6)) AS DECIMAL(12, 4)) END, CASE WHEN has THEN 'margin=' || CAST(CAST(margin AS DECIMAL(12, 6)) AS DECIMAL(12, 4)) END, CASE WHEN exact1 THEN 'exact' ELSE 'no-exact-amount' END, CASE WHEN dup_ref THEN 'dup-ref' END, CASE WHEN added_count > 0 THEN '+' || added_count || ' added (p max ' || printf('%.3f', list_max(list_transform(added, lambda x: x.p)) / 100) || ')' END, CASE WHEN NOT has THEN 'empty pool' END)"


@register("evidence_line", DECIDED + f" SELECT b_id, {_LINE} AS line FROM decided")
def evidence_line(spark, sf_dir):
    return batch(spark, sf_dir).decided.select("b_id", evidence.one_line().alias("line"))


@register("trace_steps", DECIDED + """, tr AS (SELECT b_id, unnest(list_filter([{'n': 'block', 'd': topk_size || ' kept'}, CASE WHEN has THEN {'n': 'rank', 'd': 'top1 ' || CAST(CAST(top1 AS DECIMAL(12, 6)) AS DECIMAL(12, 4))} END, CASE WHEN added_count > 0 THEN {'n': 'complete', 'd': '+' || added_count} END,
  CASE WHEN len(triggers) > 0 THEN {'n': 'trigger', 'd': array_to_string(triggers, '|')} END, {'n': 'decide', 'd': CASE WHEN escalate THEN 'escalate: ' || exception_class ELSE 'auto_close' END}], lambda x: x IS NOT NULL)) AS s FROM decided)
SELECT s.n AS name, s.d AS detail, count(*) AS rows FROM tr GROUP BY ALL""")
def trace_steps(spark, sf_dir):
    return evidence.trace(batch(spark, sf_dir).decided).groupBy("name", "detail").agg(F.count("*").alias("rows"))


@register("detail_documents", DECIDED + " SELECT d.b_id::VARCHAR AS b_id, CASE WHEN escalate THEN 'escalate' ELSE 'auto_close' END AS decision, abs(d.b_cents) AS exposure_cents, CASE WHEN d.b_cents > 0 THEN 'DR' ELSE 'CR' END AS dr_cr, b_vd::VARCHAR AS value_date, b_attrs AS attributes, topk_size AS n_candidates FROM decided d JOIN stmt s ON s.b_id = d.b_id")
def detail_documents(spark, sf_dir):
    b = batch(spark, sf_dir)
    d = evidence.detail(decide.audit(b.decided, "main"), b.stmt)
    t = "doc.transaction"
    return d.select("b_id", "doc.decision", f"{t}.exposure_cents", F.col(f"{t}.debit_or_credit").alias("dr_cr"), f"{t}.value_date", f"{t}.attributes", F.col("doc.candidate_pool_size").alias("n_candidates"))


_NUMBERS = r"regexp_extract_all(' ' || {t}, '(?:^|[^\w.])([-+]?\d[\d,]*(?:\.\d+)?%?)', 1)"
_PROPOSES = r"regexp_matches({t}, '(?i)\bis (?:the|a) (?:correct|right|true) match\b|\bshould be matched to\b|\bmatch(?:es)? (?:to )?candidate\b|\bcandidate \d+ is (?:the )?(?:correct|right|best|likely)\b|\bI recommend matching\b|\bthe correct allocation is\b')"


def _free(text: str, values: str, counts: str) -> str:
    """SQL: the numbers of a text that neither the values, as they are or rounded to the decimals written, nor counts give (those listed, and 0 to the first)."""
    value = "try_cast(regexp_replace(regexp_replace(x, '[,%]', '', 'g'), '^\\+', '') AS DOUBLE)"
    ten = "pow(10, len(regexp_extract(x, '\\.(\\d+)', 1)))"
    given = f"list_concat(list_concat({values}, list_transform({counts}, lambda n: n::DOUBLE)), list_transform(range(({counts})[1]::BIGINT + 1), lambda n: n::DOUBLE))"
    return f"list_filter({_NUMBERS.format(t=text)}, lambda x: len(list_filter({given}, lambda v: v = {value} OR abs(round_even(v * {ten}, 0) / {ten} - {value}) < 1e-9)) = 0)"


_EXPLAINED = DECIDED + """, vals AS (SELECT b_id, flatten(list([rank::DOUBLE, a_id::DOUBLE, round(score, 6), a_cents::DOUBLE, (a_cents - b_cents)::DOUBLE])) AS v FROM ranked GROUP BY b_id),
ex AS (SELECT d.*, list_concat(list_filter([d.b_cents::DOUBLE, top1, margin], lambda x: x IS NOT NULL), coalesce(v, []::DOUBLE[])) AS v,
  'Amount in cents ' || CASE WHEN d.b_id % 3 = 0 THEN d.b_cents + 1 ELSE d.b_cents END || ' with ' || (topk_size + CASE WHEN d.b_id % 4 = 0 THEN 9 ELSE 0 END) || ' candidates' || coalesce(', score ' || CAST(CAST(top1 AS DECIMAL(12, 6)) AS DECIMAL(12, 4)), '') || CASE WHEN d.b_id % 5 = 0 THEN '. It should be matched to the first' ELSE '' END AS t
  FROM decided d LEFT JOIN vals ON vals.b_id = d.b_id WHERE escalate)""" + f", gr AS (SELECT b_id, {_free('t', 'v', '[topk_size, len(triggers), added_count]')} AS free, {_PROPOSES.format(t='t')} AS proposes FROM ex)"


def _with_text(decided):
    """Explanations of the escalated rows made by rule: some amounts and counts are not those of the evidence, some propose a match."""
    k = F.col("b_id")
    amount = F.col("b_cents") + F.when(k % 3 == 0, 1).otherwise(0)
    count = F.col("topk_size") + F.when(k % 4 == 0, 9).otherwise(0)
    score = F.coalesce(F.concat(F.lit(", score "), F.format_string("%.4f", "top1")), F.lit(""))
    text = F.concat(F.lit("Amount in cents "), amount.cast("string"), F.lit(" with "), count.cast("string"), F.lit(" candidates"), F.when(F.col("has"), score).otherwise(""), F.when(k % 5 == 0, ". It should be matched to the first").otherwise(""))
    return decided.withColumn("explanation", text)


def _explained(spark, sf_dir):
    return evidence.groundedness(_with_text(batch(spark, sf_dir).decided.filter("escalate")))


def _plain(c: str) -> str:
    return f"CASE WHEN {c} < 0 THEN '-' ELSE '' END || (abs({c}) // 100) || '.' || lpad((abs({c}) % 100)::VARCHAR, 2, '0')"


def _nums(t: str) -> str:
    value = "try_cast(regexp_replace(regexp_replace(x, '[,%]', '', 'g'), '^\\+', '') AS DOUBLE)"
    return f"list_filter(list_transform({_NUMBERS.format(t=t)}, lambda x: {value}), lambda v: v IS NOT NULL)"


_CATS = lambda *xs: "flatten([" + ", ".join(xs) + "])"
_NESTED = (
    _EXPLAINED
    + ", cn AS (SELECT b_id, flatten(list("
    + _CATS("[rank::DOUBLE, a_cents::DOUBLE, (a_cents - b_cents)::DOUBLE, round(score, 6)]", _nums("a_id::VARCHAR"), _nums(f"({_plain('a_cents')})"), _nums(f"({_plain('(a_cents - b_cents)')})"))
    + ")) AS v FROM ranked GROUP BY b_id), ev AS (SELECT ex.*, list_distinct("
    + _CATS(
        "[s.b_cents::DOUBLE, topk_size::DOUBLE]", _nums("s.b_id::VARCHAR"), _nums(f"({_plain('s.b_cents')})"), _nums("s.b_vd::VARCHAR"), _nums("s.b_refs"), _nums("s.b_attrs"), "coalesce(cn.v, []::DOUBLE[])",
        "coalesce(flatten(list_transform(added, lambda a: list_concat([a.p / 100.0], " + _nums("a.key") + "))), []::DOUBLE[])",
    )
    + ") AS nv FROM ex JOIN stmt s ON s.b_id = ex.b_id LEFT JOIN cn ON cn.b_id = ex.b_id)"
)


def _recorded(spark, sf_dir):
    b = batch(spark, sf_dir)
    return evidence.evidence_record(_with_text(b.decided.filter("escalate")), b.stmt)


@register("evidence_numbers", _NESTED + f" SELECT ev.b_id, {_plain('ev.b_cents')} AS amount, topk_size AS candidates, added_count AS added, len(nv) AS numbers, list_max(nv) AS largest, list_min(nv) AS smallest FROM ev")
def evidence_numbers(spark, sf_dir):
    """The nested evidence of each escalated row, and what numbers a walk through it finds."""
    d = _recorded(spark, sf_dir)
    d = d.withColumn("nv", evidence.evidence_numbers(d))
    return d.select("b_id", "evidence.transaction.amount", F.greatest(F.size("evidence.candidates"), F.lit(0)).alias("candidates"), F.greatest(F.size("evidence.added_keys"), F.lit(0)).alias("added"), F.size("nv").cast("long").alias("numbers"), F.array_max("nv").alias("largest"), F.array_min("nv").alias("smallest"))


@register("grounded_nested", _NESTED + f" SELECT b_id, array_to_string(free, '|') AS ungrounded, len(free) = 0 AS grounded FROM (SELECT b_id, {_free('t', 'nv', '[topk_size, len(triggers), added_count]')} AS free FROM ev)")
def grounded_nested(spark, sf_dir):
    """Explanations checked against all numbers of the nested evidence."""
    return evidence.grounded_in(_recorded(spark, sf_dir)).select("b_id", F.array_join("ungrounded", "|").alias("ungrounded"), "grounded")


@register("detail_investigated", _EXPLAINED + """ SELECT d.b_id::VARCHAR AS b_id, CASE WHEN escalate THEN 'escalate' ELSE 'auto_close' END AS decision, CASE WHEN gr.b_id IS NOT NULL THEN 'm' || (gr.b_id % 2) END AS model, len(free) = 0 AS grounded, gr.b_id IS NOT NULL AS investigated
FROM decided d LEFT JOIN gr ON gr.b_id = d.b_id""")
def detail_investigated(spark, sf_dir):
    """Detail documents with the investigation of each escalated row in them."""
    b = batch(spark, sf_dir)
    found = _explained(spark, sf_dir).select(F.col("b_id").cast("string").alias("b_id"), F.concat(F.lit("m"), (F.col("b_id") % 2).cast("string")).alias("model"), "explanation", "grounded", "proposes")
    d = evidence.detail(decide.audit(b.decided, "main"), b.stmt, found)
    return d.select("b_id", "doc.decision", "doc.investigation.model", "doc.investigation.grounded", F.col("doc.investigation").isNotNull().alias("investigated"))


@register("trigger_reasons", with_fee(DECIDED) + """, rs AS (SELECT b_id, unnest(list_filter([
  CASE WHEN no_candidate THEN {'t': 'no_candidate', 'r': 'nothing came through blocking (pool of ' || topk_size || '): proposed as no match'} END,
  CASE WHEN low_confidence THEN {'t': 'low_confidence', 'r': 'score ' || CAST(CAST(top1 AS DECIMAL(12, 6)) AS DECIMAL(12, 4)) || ' or margin ' || CAST(CAST(margin AS DECIMAL(12, 6)) AS DECIMAL(12, 4)) || ' is below its floor'} END,
  CASE WHEN completion_added THEN {'t': 'completion_added', 'r': added_count || ' further keys at ' || array_to_string(list_transform(added, lambda a: printf('%.3f', a.p / 100)), ', ')} END], lambda x: x IS NOT NULL)) AS s FROM decided)
SELECT b_id, s.t AS trigger, s.r AS reason FROM rs UNION ALL SELECT b_id, 'fee_band_only', '' FROM decided WHERE fee_band_only""")
def trigger_reasons(spark, sf_dir):
    """Why each trigger fired, over candidates that may be short by a fee; of those the SQL only says that they are."""
    d = evidence.trigger_reasons(batch(spark, sf_dir, fee=True).decided)
    return d.withColumn("reason", F.when(F.col("trigger") == "fee_band_only", "").otherwise(F.col("reason")))


@register("fee_settings", " UNION ALL ".join(f"SELECT '{name}' AS setting, CASE WHEN b_id % 2 = 0 THEN 'even' ELSE 'odd' END AS batch, count(*) AS rows, count_if(NOT escalate) AS auto_closed, count_if(no_candidate) AS no_candidate, round(count_if(NOT escalate) * 100.0 / count(*), 3) AS coverage, round(count_if(NOT escalate AND ok) * 100.0 / count_if(NOT escalate), 3) AS precision FROM ({sql} SELECT * FROM judged) GROUP BY 2" for name, sql in (("exact", DECIDED), ("fee", with_fee(DECIDED)))))
def fee_settings(spark, sf_dir):
    """Both candidate settings on both halves of the statement."""
    n, pc, auto = F.count_if, (lambda a, b: F.round(F.try_divide(a * 100.0, b), 3)), ~F.col("escalate")
    out = None
    for name, fee in (("exact", False), ("fee", True)):
        d = batch(spark, sf_dir, fee=fee).judged.groupBy(F.when(F.col("b_id") % 2 == 0, "even").otherwise("odd").alias("batch"))
        one = d.agg(F.count("*").alias("rows"), n(auto).alias("auto_closed"), n(F.col("no_candidate")).alias("no_candidate"), pc(n(auto), F.count("*")).alias("coverage"), pc(n(auto & F.col("ok")), n(auto)).alias("precision")).select(F.lit(name).alias("setting"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("policy_comparison")
def policy_comparison(spark, sf_dir):
    """The exposure report of odd ids under the boosted trees with fitted thresholds, beside the point rule that stands in for them elsewhere."""
    b = batch(spark, sf_dir)
    _, trees = _learned(spark, sf_dir)
    none, out = F.array().cast("array<string>"), None
    for name, d in (("trees", trees), ("rule", b.decided.filter("b_id % 2 = 1"))):
        judged = d.join(b.gold, "b_id", "left").withColumn("ok", F.array_sort("answer_keys") == F.coalesce("gold", none))
        one = exposure.headline(judged).select(F.lit(name).alias("policy"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("grounded_check", _EXPLAINED + " SELECT b_id, array_to_string(free, '|') AS ungrounded, len(free) = 0 AS grounded, proposes FROM gr")
def grounded_check(spark, sf_dir):
    return _explained(spark, sf_dir).select("b_id", F.array_join("ungrounded", "|").alias("ungrounded"), "grounded", "proposes")


@register("investigation_rollup", _EXPLAINED + """ SELECT 'm' || (b_id % 2) AS model, count(*) AS explanations, count_if(len(free) > 0) AS not_grounded, count_if(proposes) AS proposing, count_if(len(free) > 0 AND NOT proposes) AS number_only, count_if(len(free) = 0 AND proposes) AS proposal_only, count_if(len(free) > 0 AND proposes) AS both_reasons,
  count_if(b_id % 7 <> 0) AS with_probability FROM gr GROUP BY 1""")
def investigation_rollup(spark, sf_dir):
    """By model: how many explanations fail, for which reasons, and how many came with a probability."""
    k = F.col("b_id")
    d = _explained(spark, sf_dir).withColumns({"model": F.concat(F.lit("m"), (k % 2).cast("string")), "probability": F.when(k % 7 != 0, 0.5)})
    return evidence.roll_up(d)


@register("number_tokens", f"SELECT doc_id, len({_NUMBERS.format(t='text')}) AS n, {_NUMBERS.format(t='text')}[1] AS first FROM documents WHERE text IS NOT NULL")
def number_tokens(spark, sf_dir):
    d = batch(spark, sf_dir).read("documents").filter("text is not null")
    return d.select("doc_id", F.size(numbers("text")).cast("long").alias("n"), F.get(numbers("text"), F.lit(0)).alias("first"))


_PHRASES = ("It should be matched to X", "candidate 3 is likely", "matches candidate A")


@register("proposal_tripwire", f"SELECT item_id, {_PROPOSES.format(t='t')} AS proposes FROM (SELECT item_id, coalesce(text, '') || CASE item_id % 4 " + " ".join(f"WHEN {i} THEN '. {p}'" for i, p in enumerate(_PHRASES)) + " ELSE '' END AS t FROM benchmark)")
def proposal_tripwire(spark, sf_dir):
    """Whole texts, three of four with a phrase at the end."""
    more = F.coalesce(F.get(F.array(*[F.lit(f". {p}") for p in _PHRASES]), (F.col("item_id") % 4).cast("int")), F.lit(""))
    return batch(spark, sf_dir).read("benchmark").select("item_id", proposes_match(F.concat(F.coalesce("text", F.lit("")), more)).alias("proposes"))


@register("ungrounded_numbers", "WITH o AS (SELECT o_orderkey, o_totalprice, o_custkey, 'The price is ' || CAST(CAST(o_totalprice AS DECIMAL(14, 2)) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS DECIMAL(14, 2)) || ' for customer ' || (o_custkey + o_orderkey % 2) || ' in ' || (o_orderkey % 7) || ' days' AS t FROM orders) "
    f"SELECT o_orderkey, array_to_string({_free('t', '[o_totalprice::DOUBLE, o_custkey::DOUBLE]', '[2]')}, '|') AS free FROM o")  # fmt: skip
def ungrounded_numbers(spark, sf_dir):
    """Texts that cite a price, a customer and a count, each of them wrong for some orders."""
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(14,2)") + F.when(k % 3 == 0, 1).otherwise(0)
    text = F.concat(F.lit("The price is "), price.cast("decimal(14,2)").cast("string"), F.lit(" for customer "), (F.col("o_custkey") + k % 2).cast("string"), F.lit(" in "), (k % 7).cast("string"), F.lit(" days"))
    free = ungrounded(text, F.array(F.col("o_totalprice").cast("double"), F.col("o_custkey").cast("double")), [F.lit(2)])
    return batch(spark, sf_dir).read("orders").select("o_orderkey", F.array_join(free, "|").alias("free"))


@register("classifier_candidates")
def classifier_candidates(spark, sf_dir):
    """Boosted trees fitted on even statement ids, candidates of odd ones judged."""
    b = batch(spark, sf_dir)
    even = F.col("b_id") % 2 == 0
    ceiling = chain.several_key_ceiling(b.ranked.filter(even), b.gold.filter(even))
    model = learned.fit(learned.labelled(b.feats.filter(even), b.gold.filter(even)), recall=ceiling)
    return learned.candidate_quality(learned.probabilities(model, learned.labelled(b.feats.filter(~even), b.gold.filter(~even))))


def _learned(spark, sf_dir):
    """(policy fitted on even statement ids, decisions of odd ones)."""
    b = batch(spark, sf_dir)
    even = F.col("b_id") % 2 == 0
    policy = chain.fit_policy(b.stmt, b.nested, b.feats, b.gold, even)
    return policy, chain.apply_policy(b.stmt.filter(~even), b.nested.filter(~even), b.feats.filter(~even), policy)


@register("learned_decisions")
def learned_decisions(spark, sf_dir):
    """The chain with the classifier and with thresholds fitted on even ids, on odd ids: coverage, precision, and what was fitted."""
    policy, decided = _learned(spark, sf_dir)
    none = F.array().cast("array<string>")
    judged = decided.join(batch(spark, sf_dir).gold, "b_id", "left").withColumn("ok", F.array_sort("answer_keys") == F.coalesce("gold", none))
    return _summary(judged).select("*", F.lit(policy.min_top1).alias("min_top1"), F.lit(policy.min_margin).alias("min_margin"), F.round(F.lit(policy.ceiling), 6).alias("ceiling"), F.lit(policy.model is not None).alias("completion"))


def _generated(spark, sf_dir):
    """(statement, ledger, truth) of a generated batch with as many groups as there are orders."""
    stmt, led, _ = synth.generate(spark, batch(spark, sf_dir).read("orders").count(), seed=7)
    keys = led.filter("not distractor").groupBy(F.col("b_owner").alias("b_id")).agg(F.collect_set("allocation").alias("keys"))
    return stmt, led, stmt.select("b_id").join(keys, "b_id", "left").select("b_id", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


@register("synthetic_batch")
def synthetic_batch(spark, sf_dir):
    """Classes of a generated batch as large as the orders table, with the exact-amount baseline's matches."""
    stmt, led, truth = _generated(spark, sf_dir)
    return scoring.by_class(scoring.compare(exact_amount_baseline(stmt, led), truth), stmt.select("b_id", "class", "corruptions"))


@register("synthetic_chain")
def synthetic_chain(spark, sf_dir):
    """A generated batch through the whole chain, with two rankers, scored by class."""
    stmt, led, truth = _generated(spark, sf_dir)
    stmt, led = stmt.persist(), led.persist()
    out = None
    for name, ranker in (("text", None), ("nearness", chain.NearnessInTask())):
        answers = chain.run_fee(stmt, led, ranker).select("b_id", F.col("answer_keys").alias("keys"))
        one = scoring.by_class(scoring.compare(answers, truth), stmt.select("b_id", "class", "corruptions")).withColumn("ranker", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@register("synthetic_too_easy")
def synthetic_too_easy(spark, sf_dir):
    stmt, led, truth = _generated(spark, sf_dir)
    return synth.too_easy(exact_amount_baseline(stmt, led), truth)


@register("accepted_keys", FEATS + " SELECT b_id, array_to_string(list(key ORDER BY rank), '|') AS keys, list(p ORDER BY rank)[1]::BIGINT AS first_percent FROM props WHERE p >= 50 GROUP BY b_id")
def accepted_keys(spark, sf_dir):
    d = complete.accepted_keys(batch(spark, sf_dir).feats, complete.rule_probability())
    return d.select("b_id", F.array_join(F.transform("added", lambda a: a["allocation_key"]), "|").alias("keys"), F.get("added", F.lit(0))["percent"].cast("long").alias("first_percent"))


@register("top_investigations", DECIDED + f", q AS (SELECT *, row_number() OVER (ORDER BY abs(b_cents) DESC, b_id) AS rank FROM decided WHERE escalate) SELECT b_id, rank, {_LINE} AS evidence FROM q WHERE rank <= 10")
def top_investigations(spark, sf_dir):
    q = exposure.ranked_queue(batch(spark, sf_dir).decided)
    return evidence.investigate(q, 10, lambda e: F.lit("")).select("b_id", "rank", "evidence")
