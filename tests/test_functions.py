"""Column functions on fixtures with known answers."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reconloom.functions import amounts, keys, text


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


@pytest.mark.parametrize(
    ("label", "want"),
    [(None, []), ("", []), ("nan", []), ("[]", []), ("[ ]", []), ("K1 ", ["K1 "]), ("[A,B]", ["A", "B"]), ('["A"]', ["A"]), ("['A', B]", ["A", " B"]), ("[A,,B]", ["A", "B"]), ("[A,A]", ["A"])],
)
def test_parse_keys(spark, label, want):
    assert one(spark, keys.parse_keys(F.lit(label)).alias("k")).k == want


def test_parse_keys_of_profiling_keeps_quotes(spark):
    assert one(spark, keys.parse_keys(F.lit('["A", B ]'), quotes=False).alias("k")).k == ['"A"', "B"]


@pytest.mark.parametrize(("ks", "want"), [([], ""), (["A"], "A"), (["A", "B", "A"], "[A,B]")])
def test_encode(spark, ks, want):
    a = F.array(*map(F.lit, ks)).cast("array<string>")
    assert one(spark, keys.encode_keys(a).alias("k")).k == want


def test_key_sets(spark):
    a, b = F.array(F.lit("y"), F.lit("x"), F.lit("x")), F.array(F.lit("x"), F.lit("y"))
    r = one(spark, keys.same_set(a, b).alias("same"), keys.subset(F.array(F.lit("x")), b).alias("sub"), keys.stratum(b).alias("s"), keys.key_fields(F.lit("U_2024_A_x_y")).alias("f"))
    assert (r.same, r["sub"], r.s, r.f) == (True, True, "multi_key", ["U", "2024", "A", "x_y"])


def test_cents(spark):
    r = one(spark, amounts.cents(F.lit("20893751.85")).alias("a"), amounts.cents(F.lit("20893751.86")).alias("b"), amounts.cents(F.lit("")).alias("c"), amounts.cents(F.lit("0.025")).alias("d"))
    assert (r.b - r.a, r.c, r.d) == (1, None, 2)


@pytest.mark.parametrize(("a", "ok"), [(9500, True), (9499, False), (10001, True), (10002, False), (-9700, False)])
def test_fee_band(spark, a, ok):
    assert one(spark, amounts.fee_band(F.lit(a), F.lit(10000)).alias("x")).x is ok


def test_money(spark):
    r = one(spark, amounts.money(F.lit(-358_73000000)).alias("a"), amounts.money(F.lit(125_037_000_000_000)).alias("b"), amounts.money(F.lit(125_037_000_000_000), trillions=True).alias("c"), amounts.plain(F.lit(-5)).alias("d"))
    assert (r.a, r.b, r.c, r.d) == ("-358.73M", "1,250.37B", "1.25T", "-0.05")


def test_magnitude(spark):
    ks = [one(spark, amounts.magnitude(F.lit(c)).alias("k")).k for c in (0, 5, 50, 100, 999, 1000, 123_456_789)]
    assert ks == [-3, -2, -1, 0, 0, 1, 6]


def test_digit_windows(spark):
    assert len(one(spark, text.digit_windows(F.lit("TUP 1234567890X")).alias("w")).w) == 4
    assert one(spark, text.digit_windows(F.lit("ab")).alias("w")).w == []
    assert one(spark, text.longest_run(F.lit("x12345678901y"), F.lit("a1234567890b")).alias("n")).n == 10


@pytest.mark.parametrize(("s", "want"), [("top-1", ["1"]), ("is -0.5, 47% of 1,200", ["-0.5", "47%", "1,200"]), ("v1.2", []), (None, [])])
def test_numbers(spark, s, want):
    assert one(spark, text.numbers(F.lit(s).cast("string")).alias("n")).n == want


@pytest.mark.parametrize(
    ("s", "free"),
    [("score 0.12 of 3", []), ("score 0.123456", []), ("score 0.13", ["0.13"]), ("amount -1,500", []), ("2 candidates", []), ("9 candidates", ["9"]), ("nothing", [])],
)
def test_grounded(spark, s, free):
    vals = F.array(F.lit(0.123456), F.lit(-1500.0))
    assert one(spark, text.ungrounded(F.lit(s), vals, [F.lit(3)]).alias("u")).u == free


@pytest.mark.parametrize(("s", "hit"), [("This is the correct match.", True), ("candidate 2 is likely", True), ("I recommend matching it", True), ("no view on that", False), (None, False)])
def test_tripwire(spark, s, hit):
    assert one(spark, text.proposes_match(F.lit(s)).alias("x")).x is hit


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["A", "B ", " C", "D4"]), max_size=4))
def test_encode_and_parse_are_inverse(spark, ks):
    a = F.array(*map(F.lit, ks)).cast("array<string>")
    want = sorted(set(ks))
    assert sorted(one(spark, keys.parse_keys(keys.encode_keys(a)).alias("k")).k) == want
