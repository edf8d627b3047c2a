"""Blocking: which ledger rows a statement row can be matched with.

Amount and date are part of the equality key: joins go by cells of both. One currency, one account, one amount
may hold half of all rows; a cell that they fill is cut into a grid.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconloom.functions.amounts import TOLERANCES, fee_band, tolerated

BLOCK = ("ccy", "account")
#: Windows of days (from, to), ledger date minus statement date, by name.
SYMMETRIC = tuple((f"pm{n:02d}", -n, n) for n in (0, 1, 2, 3, 5, 7, 14, 30, 60)) + (("all", -1_000_000, 1_000_000),)
ONE_SIDED = (("before07", -7, 0), ("after07", 0, 7), ("before30", -30, 0), ("after30", 0, 30))


def in_window(low: int = -7, high: int = 7) -> Column:
    return F.datediff("a_vd", "b_vd").between(low, high)


#: Rows of one side that a cell may hold before it is cut, heavy cells up to which their list is broadcast, and buckets in which cells are counted first.
CELL, HEAVY, BUCKETS = 20_000, 100_000, 1 << 16


def heavy_cells(b: DataFrame, a: DataFrame, key: list[str], most: int) -> DataFrame:
    """(key, _ka, _kb): the cells with more than `most` rows of a side, and into how many parts each side is cut. Counted, a row a cell."""
    n = lambda d, name: d.groupBy(*key).agg(F.count("*").alias(name))
    parts = lambda c: F.ceil(F.col(c) / most).cast("int")
    both = n(b, "_nb").join(n(a, "_na"), key)
    return both.filter(F.greatest("_na", "_nb") > most).select(*key, parts("_na").alias("_ka"), parts("_nb").alias("_kb"))


def suspects(b: DataFrame, a: DataFrame, key: list[str], most: int) -> list[int]:
    """The buckets of cells, by hash, with more than `most` rows of a side: no other bucket holds a heavy cell."""
    bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int").alias("_u")
    side = lambda d, name: d.select(bucket, F.lit(name).alias("_s"))
    full = side(b, "b").unionAll(side(a, "a")).groupBy("_u", "_s").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    return [r[0] for r in full.select("_u").distinct().collect()]  # at most BUCKETS numbers


def dealt(b: DataFrame, a: DataFrame, key: list[str], most: int = CELL) -> tuple[DataFrame, DataFrame, list[str]]:
    """(b, a, join key): both sides dealt to cells, where a cell of too many rows is a grid: each side is cut into parts, and repeated for the other's.

    A row of a heavy cell is in one part of its own side and meets all parts of the other, so every pair meets once, and no cell of the
    grid holds more than about `most` rows of either side. The number of heavy cells is at most the rows divided by `most`; they are looked for
    first, in the buckets that hold so many rows at all, and where there are none the sides stay as they are.
    """
    full = suspects(b, a, key, most)
    if not full:
        return b, a, key
    few = lambda d: d.filter(F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int").isin(full)) if len(full) <= 1000 else d
    heavy = heavy_cells(few(b), few(a), key, most).persist()
    n = heavy.count()
    if not n:
        heavy.unpersist()
        return b, a, key
    heavy = F.broadcast(heavy) if n <= HEAVY else heavy
    one = lambda c: F.coalesce(c, F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0), one(F.col(c)) - 1))
    part = lambda i, c: F.pmod(F.xxhash64(i), one(F.col(c))).cast("int")
    left = b.join(heavy, key, "left").withColumn("_pb", part("b_id", "_kb")).withColumn("_pa", every("_ka")).drop("_ka", "_kb")
    right = a.join(heavy, key, "left").withColumn("_pa", part("a_id", "_ka")).withColumn("_pb", every("_kb")).drop("_ka", "_kb")
    return left, right, [*key, "_pa", "_pb"]


def cell_join(b: DataFrame, a: DataFrame, accepts: Column, cell: Column, keep: Column, low: int, high: int, most: int = CELL, spans: int = 1) -> DataFrame:
    """b ⋈ a by cells of amount and date; all columns of both.

    accepts: the amount cells that a statement row looks in (an array of different numbers); cell: the one of a ledger row. Dates are cut into
    spans of `spans` windows, of which a statement row looks in two at most; a window of over a year is one span. So a pair has one cell, and comes
    once. `keep` is the exact predicate on amounts.
    """
    span = spans * (high - low + 1)
    look, own = (F.array(F.lit(0).cast("long")), F.lit(0).cast("long")) if high - low >= 400 else (F.sequence(F.floor((F.unix_date("b_vd") + low) / span), F.floor((F.unix_date("b_vd") + high) / span)), F.floor(F.unix_date("a_vd") / span))
    keyed = b.withColumn("_c", F.explode(accepts)).withColumn("_d", F.explode(look))
    other = a.withColumn("_c", cell).withColumn("_d", own)
    keyed, other, key = dealt(keyed, other, [*BLOCK, "_c", "_d"], most)
    return keyed.join(other, key).filter(keep & in_window(low, high)).drop(*key[len(BLOCK) :])


def band_join(b: DataFrame, a: DataFrame, tolerance: int = 1, low: int = -7, high: int = 7, most: int = CELL) -> DataFrame:
    """b ⋈ a on block, amount within `tolerance` cents, date within the window; all columns of both.

    Cells are 2 * tolerance + 1 cents wide, so that a statement row looks in two of them at most.
    """
    width = F.lit(2 * tolerance + 1).cast("long")
    start = lambda c: c - F.pmod(c, width)
    c = F.col("b_cents")
    accepts = F.sequence(start(c - tolerance), start(c + tolerance), width)
    return cell_join(b, a, accepts, start(F.col("a_cents")), F.abs(F.col("a_cents") - c) <= tolerance, low, high, most, spans=2)


def _step(c: Column) -> Column:
    """The amount's step on a scale of 8 % around 0 and up, the sign kept; never falls with the amount."""
    return F.signum(c).cast("long") * F.floor(F.log1p(F.abs(c).cast("double") / 50) / 0.08)


def range_join(b: DataFrame, a: DataFrame, lowest: Column, highest: Column, keep: Column, low: int = -7, high: int = 7, most: int = CELL) -> DataFrame:
    """b ⋈ a where the ledger amount is between lowest and highest (whole cents, of b's columns) and `keep` holds.

    Cells are steps of the logarithm; a statement row looks in those from its lowest amount's to its highest amount's, two or three for a few percent.
    """
    return cell_join(b, a, F.sequence(_step(lowest), _step(highest)), _step(F.col("a_cents")), keep, low, high, most)


def fee_candidates(b: DataFrame, a: DataFrame, tolerance: int = 1, most: int = CELL) -> DataFrame:
    """Exact amounts and amounts less a fee of at most 5 %."""
    c = F.col("b_cents")
    fee = F.floor(F.abs(c) / 20) + 1
    ends = (F.when(c > 0, c - fee).otherwise(c) - tolerance, F.when(c < 0, c + fee).otherwise(c) + tolerance)
    return range_join(b, a, *ends, fee_band(F.col("a_cents"), c, tolerance), most=most)


def tolerance_candidates(b: DataFrame, a: DataFrame, most: int = CELL) -> DataFrame:
    """(b_id, a_id, b_cents, a_cents): pairs at the widest tolerance, with a flag for each tolerance: in_exact, in_c1, in_c100, in_r01, in_r1, in_r5.

    A row can be in at 1.00 although it is out at 5 %, so the range is the wider of both; one join, and no pair comes twice.
    """
    c = F.col("b_cents")
    reach = F.greatest(F.lit(100), F.floor(F.abs(c) / 20) + 1)
    flags = {f"in_{n}": tolerated(F.col("a_cents"), c, cents, p) for n, cents, p in TOLERANCES}
    near = range_join(b.select("b_id", *BLOCK, "b_cents", "b_vd"), a.select("a_id", *BLOCK, "a_cents", "a_vd"), c - reach, c + reach, flags["in_r5"] | flags["in_c100"], most=most)
    return near.select("b_id", "a_id", "b_cents", "a_cents").withColumns(flags)


def _cells(batches, key: list[str], rows: int):
    """Tables of whole cells, about `rows` rows together, of a task's rows sorted by cell; with the cell's number of each row."""
    held, n = [], 0

    def whole(last: bool):
        t = pa.Table.from_batches(held)
        new = np.zeros(t.num_rows, bool)
        for k in key:
            c = t.column(k).combine_chunks()
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        end = t.num_rows if last else int(np.flatnonzero(new)[-1]) if new.any() else 0
        return t.slice(0, end), np.cumsum(new[:end]), t.slice(end).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            t, cell, held = whole(False)
            n = sum(x.num_rows for x in held)
            if t.num_rows:
                yield t, cell
    if held:
        yield whole(True)[:2]


def _within(cents: int, ppm: int):
    """Function of the statement's amounts: the least and the largest amount that a tolerance accepts, in whole numbers."""

    def ends(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.abs(c)
        reach = size // 1_000_000 * ppm + size % 1_000_000 * ppm // 1_000_000 if ppm else cents
        return c - reach, c + reach

    return ends


def fee_ends(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest amount in `amounts.fee_band` of the statement's amounts, at a tolerance of one cent; the band has no gap."""
    size = np.abs(c)
    least = size // 100 * 95 + -(-(size % 100 * 95) // 100)
    return np.where(c > 0, np.minimum(least, c - 1), c - 1), np.where(c < 0, np.maximum(-least, c + 1), c + 1)


#: What `near_counts` counts unless told otherwise; nothing may reach farther than a dollar or 5 %.
NEAR = {n: _within(cents, ppm) for n, cents, ppm in TOLERANCES}


def _near(cell: np.ndarray, table: pa.Table, low: int, high: int, near: list) -> tuple[np.ndarray, np.ndarray]:
    """(b_id, how many ledger rows of its cell and window are between the ends that each function of near gives, in its window). Ledger rows are put under every day that looks at them and sorted
    by amount, so that a count is the distance of two places."""
    b_id, cents, day = (table.column(c).to_numpy() for c in ("b_id", "cents", "day"))
    a = table.column("is_a").to_numpy(zero_copy_only=False)
    first = day.min() - max(high, 0)
    days = int(day.max() - first) + 1 - min(low, 0)
    group = cell.astype(np.int64) * days
    amounts, at = np.unique(cents[a], return_inverse=True)
    many = len(amounts) + 1
    own, c = (group[~a] + day[~a] - first) * many, cents[~a]
    out, sorted_ = np.empty((len(near), len(c)), np.int64), {}
    for i, (f, *window) in enumerate(near):
        from_, to = window or (low, high)
        if (from_, to) not in sorted_:
            under = (group[a] + day[a] - first)[:, None] - np.arange(from_, to + 1)
            sorted_ = {(from_, to): np.sort((under * many + at[:, None]).ravel())}
        keys = sorted_[from_, to]
        least, largest = f(c)
        ends = np.searchsorted(amounts, least, "left"), np.searchsorted(amounts, largest, "right")
        out[i] = np.searchsorted(keys, own + ends[1]) - np.searchsorted(keys, own + ends[0])
    return b_id[~a], out


def cells(b: DataFrame, a: DataFrame, by: tuple[str, ...], reach: Column, width: float, low: int, high: int, spans: int, most: int = CELL) -> tuple[DataFrame, DataFrame, list[str]]:
    """(b, a, key): rows with block, amount and date, dealt to cells of amounts (steps of the logarithm, `width` wide) and dates (`spans` windows).

    A statement row is in each cell that it looks in, `reach` cents (a column of b's) to either side; a ledger row is in one, so a pair has one cell. Heavy cells are cut to grids.
    """
    b, a = (d.dropna(subset=[*by, *more]) for d, more in ((b, ("b_cents", "b_vd")), (a, ("a_cents", "a_vd"))))
    c, span = F.col("b_cents"), spans * (high - low + 1)
    step = lambda x: F.signum(x).cast("long") * F.floor(F.log1p(F.abs(x).cast("double") / 100) / width)
    day = lambda x, n=0: F.floor((F.unix_date(x) + n) / span)
    every = lambda lo, hi: F.explode_outer(F.sequence(lo, hi))  # noqa: E731 - never empty; without outer a filter on the array is made, which evaluates it again
    keyed = b.withColumn("_c", every(step(c - reach), step(c + reach))).withColumn("_d", every(day("b_vd", low), day("b_vd", high)))
    other = a.withColumn("_c", step(F.col("a_cents"))).withColumn("_d", day("a_vd"))
    return dealt(keyed, other, [*by, "_c", "_d"], most)


def near_counts(b: DataFrame, a: DataFrame, by: tuple[str, ...] = BLOCK, low: int = -7, high: int = 7, most: int = CELL, near: dict | None = None) -> DataFrame:
    """(b_id, n_NAME for each name of near): for each statement row with any, how many ledger rows are within each tolerance, in the window, and equal in `by`.

    A value of near is a function of amounts, or that and a window (from, to) inside low and high of its own.
    No pair is formed: pairs at 5 % grow with the square of the tables. Rows are dealt to cells of amounts (within a factor of two) and dates,
    a heavy cell to a grid, and a task sorts the amounts of a cell and counts by their places.
    """
    reach = F.greatest(F.lit(100), F.floor(F.abs("b_cents") / 20) + 1)
    keyed, other, key = cells(b.select("b_id", *by, "b_cents", "b_vd"), a.select("a_id", *by, "a_cents", "a_vd"), by, reach, 0.7, low, high, 2, most)
    rows = keyed.select(*key, "b_id", F.lit(False).alias("is_a"), F.col("b_cents").alias("cents"), F.unix_date("b_vd").cast("long").alias("day"))
    rows = rows.unionByName(other.select(*key, F.lit(0).cast("long").alias("b_id"), F.lit(True).alias("is_a"), F.col("a_cents").alias("cents"), F.unix_date("a_vd").cast("long").alias("day")))
    near = near or NEAR
    names, ends = [f"n_{n}" for n in near], [f if isinstance(f, tuple) else (f,) for f in near.values()]

    def count(batches):
        for table, cell in _cells(batches, key, 100_000):
            b_id, n = _near(cell, table, low, high, ends)
            any_ = n.any(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(b_id[any_]), *map(pa.array, n[:, any_])], ["b_id", *names])

    found = rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(count, ", ".join(f"{n} long" for n in ("b_id", *names)))
    return found.groupBy("b_id").agg(*[F.sum(n).alias(n) for n in names])


def tolerance_counts(b: DataFrame, a: DataFrame, by: tuple[str, ...] = BLOCK, low: int = -7, high: int = 7, most: int = CELL) -> DataFrame:
    """(b_id, n_exact, n_c1, ...): the counts of `near_counts` for each of TOLERANCES."""
    return near_counts(b, a, by, low, high, most)


def cent_counts(b: DataFrame, a: DataFrame, by: tuple[str, ...] = BLOCK, low: int = -7, high: int = 7, most: int = CELL) -> DataFrame:
    """(b_id, n_c1): for each statement row with any, how many ledger rows are within a cent."""
    return near_counts(b, a, by, low, high, most, {"c1": NEAR["c1"]})


def date_pool_sizes(b: DataFrame, a: DataFrame, low: int = -7, high: int = 7) -> DataFrame:
    """(b_id, date_pool): how many ledger rows of the block are in the window, counted from daily counts, not by pairs."""
    daily = a.groupBy(*BLOCK, F.col("a_vd").alias("day")).agg(F.count("*").alias("n"))
    if high - low > 400:  # wider than the data's days: count days instead of enumerating the window
        days = b.select(*BLOCK, "b_vd").distinct().join(daily, list(BLOCK)).filter(F.datediff("day", "b_vd").between(low, high))
    else:
        want = b.select(*BLOCK, "b_vd").distinct().withColumn("day", F.explode(F.sequence(F.date_add("b_vd", low), F.date_add("b_vd", high))))
        days = want.join(daily, [*BLOCK, "day"])
    per_day = days.groupBy(*BLOCK, "b_vd").agg(F.sum("n").alias("n"))
    return b.select("b_id", *BLOCK, "b_vd").join(per_day, [*BLOCK, "b_vd"], "left").select("b_id", F.coalesce("n", F.lit(0)).alias("date_pool"))


def exact_amount_baseline(b: DataFrame, a: DataFrame) -> DataFrame:
    """(b_id, keys): the distinct keys of ledger rows with the very amount within 7 days; none gives an empty set."""
    hit = band_join(b, a, 0).groupBy("b_id").agg(F.array_sort(F.collect_set("allocation")).alias("keys"))
    return b.select("b_id").join(hit, "b_id", "left").select("b_id", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


def windowed(b: DataFrame, a: DataFrame, windows=SYMMETRIC + ONE_SIDED) -> DataFrame:
    """Pairs within 1 cent for each window: the amount join once, then a row for each window that the gap is in."""
    pairs = band_join(b, a, 1, -1_000_000, 1_000_000).withColumn("gap", F.datediff("a_vd", "b_vd"))
    names = F.filter(F.array(*[F.when(F.col("gap").between(lo, hi), F.lit(n)) for n, lo, hi in windows]), lambda x: x.isNotNull())
    return pairs.withColumn("window", F.explode(names))


def nearest_gap(b: DataFrame, a: DataFrame, gold: DataFrame) -> DataFrame:
    """(b_id, a_id, gap): of the ledger rows with a gold key the nearest in days, the smaller id on ties."""
    keyed = gold.withColumn("allocation", F.explode("gold")).join(a, "allocation").join(b.select("b_id", "b_vd"), "b_id")
    gap = F.datediff("a_vd", "b_vd")
    return keyed.groupBy("b_id").agg(F.min_by(F.struct("a_id", gap.alias("gap")), F.struct(F.abs(gap), "a_id")).alias("r")).select("b_id", "r.a_id", "r.gap")
