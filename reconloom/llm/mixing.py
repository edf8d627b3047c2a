"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Targets: sources share all tokens by weight; a source stops at `most` times its own size and the excess
goes to the others by weight. Blocks of equally many tokens are then allocated to the sources by highest
quotients t / (2k + 1), and a source's blocks to its shards in the same way, by the shards' sizes. In a
shard the blocks are those at the front of a seeded order of its documents; whole passes come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconloom.llm.common import packed, small, table, unpacked

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by code point, repeated.
WEIGHTS = (5, 2, 1)
#: At most so many blocks in all, and so many shards of a source; a shard has at least so many rows on average.
BLOCKS, SHARDS, SHARD_ROWS = 1 << 24, 4096, 512


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """sizes: one row a source (src_key, source, source_size). Adds weight and target.

    Of the sources ordered by most * size / weight the first ones stop at most * size; the others share
    what is left by weight, which is where repeated resharing ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    cap = F.col("source_size") * most
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src_key"))
    ranked = (
        sizes.withColumn("weight", w)
        .withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("capped", F.col("left") * F.col("weight") > F.col("cap") * F.col("weights"))
    )
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "src_key", "left", "weights"))).over(Window.partitionBy())
    return (
        ranked.withColumn("free", free)
        .withColumn("target", F.when(F.col("capped") | F.col("free").isNull(), F.col("cap").cast("double")).otherwise(F.col("free.left") * F.col("weight") / F.col("free.weights")))
        .select("src_key", "source", "source_size", "weight", "target", "total")
    )


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, out: str) -> DataFrame:
    """Adds `out`: the seats of each party of a group by highest quotients votes / (2k + 1), ties to the smaller party.

    seats is a column that is equal within a group. A divisor at either end brackets the result, so at
    most about two quotients a party are ranked, however many seats there are. No votes: no seats.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy()
    v, s = F.col(votes).cast("double"), F.col(seats).cast("double")
    p = (
        parties.withColumn("_v", F.sum(v).over(g))
        .withColumn("_n", F.sum(F.when(v > 0, 1).otherwise(0)).over(g))
        .withColumn("_low", F.when(v > 0, F.greatest(F.lit(0), F.floor(v * (s - F.col("_n") / 2) / F.col("_v") + 0.5) - 1)).otherwise(0).cast("long"))
        .withColumn("_high", F.when(v > 0, F.floor(v * (s + F.col("_n") / 2) / F.col("_v") + 0.5) + 1).otherwise(0).cast("long"))
        .withColumn("_rest", F.col(seats) - F.sum("_low").over(g))
    )
    keys = [*group, party]
    ranked = (
        p.filter("_high > _low")
        .select(*keys, "_rest", v.alias("_votes"), F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_k"))
        .withColumn("_q", F.col("_votes") / (2 * F.col("_k") + 1))
        .withColumn("_rank", F.row_number().over((Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(F.desc("_q"), F.asc(party), F.asc("_k"))))
        .filter("_rank <= _rest")
        .groupBy(*keys)
        .agg(F.count("*").alias("_won"))
    )
    return p.join(ranked, keys, "left").withColumn(out, F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_v", "_n", "_low", "_high", "_rest", "_won")


def _keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """The rows of df, packed, with size, src_key and h (the place in the seeded order)."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    d = packed(df, id=F.col(id_col), source=F.col(source_col), size=size, src_key=F.coalesce(F.concat(F.lit("v"), F.col(source_col)), F.lit("n")))
    return d.withColumn("h", F.md5(F.concat_ws("|", F.lit(f"mix{seed}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size"))))


def _sharded(keyed: DataFrame, sources: DataFrame) -> DataFrame:
    """keyed with shard: a source has as many as its own rows ask for."""
    joined = keyed.join(small(sources.select(F.col("src_key").alias("of_source"), "shards")), F.col("src_key") == F.col("of_source"))
    return joined.withColumn("shard", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("shards")).cast("int")).drop("of_source", "shards")


def _placed(keyed: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """(placed, sources). placed: a narrow row for each row of keyed: id, source, src_key, shard, h, size, source_size, target, passes, first (words of the last, partial pass)."""
    base = table(keyed.select("id", "source", "src_key", "h", "size"), "mix-base")
    rows = F.floor(F.count("*") / SHARD_ROWS)
    sources = table(base.groupBy("src_key", "source").agg(F.greatest(F.lit(1), F.least(F.lit(SHARDS), rows)).alias("shards"), F.sum("size").alias("source_size")), "mix-sources")
    base = _sharded(base, sources)
    by_shard = table(base.groupBy("src_key", "source", "shard").agg(F.sum("size").alias("shard_size")), "mix-shards")
    by_source = targets(sources.drop("shards"), weights, most)
    by_source = by_source.withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCKS)).cast("long")).withColumn("seats", F.floor(F.col("total") / F.col("block")).cast("long"))
    quotas = sainte_lague(by_source, [], "src_key", "target", "seats", "blocks")
    per_shard = sainte_lague(by_shard.join(quotas.select("src_key", "source_size", "target", "block", "blocks"), "src_key"), ["src_key"], "shard", "shard_size", "blocks", "shard_blocks")
    plan = table(
        per_shard.withColumn("quota", F.least(F.col("shard_blocks") * F.col("block"), F.col("shard_size") * most))
        .withColumn("passes", F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("shard_size"))
        .select("src_key", "shard", "source_size", "target", "passes", "rest"),
        "mix-plan",
    )
    order = Window.partitionBy("src_key", "shard").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = base.withColumn("end", F.sum("size").over(order)).join(plan, ["src_key", "shard"])
    placed = placed.withColumn("first", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("end") - F.col("size")))))
    return placed, sources


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 0) -> DataFrame:
    """One row for each row of df: id, source, size, source_size, target, taken, passes, shard.

    size counts words between ASCII white space, 0 for a null text; a null source is a source of its own,
    the last; ids may be null or repeat (equal ids and sizes are interchangeable). taken is at most
    most * size. An empty table gives no rows. Other columns of df play no part.

    The text is read once. Then one shuffle brings each shard of a source together; a source has a shard for each
    SHARD_ROWS of its rows, so one with a third of them is spread over many.
    """
    d, _ = _placed(_keyed(df, id_col, text_col, source_col, seed), weights, most)
    return d.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("first")).cast("long").alias("taken"), "passes", "shard")


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 0) -> DataFrame:
    """The rows of df as often as the mix takes them, to the nearest whole number; the columns of df.

    Only the row in which a shard's partial pass ends is taken in part: it appears once more if at least half of it is
    taken. So a source misses its target by at most half a document for each SHARD_ROWS of its documents, or half a
    document in all if it has fewer. Rows with the same id and size are taken alike. A shard's partial pass ends at one
    place of its seeded order, so a row needs only that place and the passes of its shard: one small row a shard, and
    texts do not move (unless shards are more than BROADCAST_ROWS).
    """
    keyed = _keyed(df, id_col, text_col, source_col, seed)
    placed, sources = _placed(keyed, weights, most)
    last = F.max(F.when((F.col("first") > 0) & (2 * F.col("first") >= F.col("size")), F.col("h")))
    ends = table(placed.groupBy("src_key", "shard").agg(F.max("passes").alias("passes"), last.alias("last")), "mix-ends")
    named = small(ends).withColumnsRenamed({"src_key": "end_source", "shard": "end_shard"})
    d = _sharded(keyed, sources).join(named, (F.col("src_key") == F.col("end_source")) & (F.col("shard") == F.col("end_shard")))
    times = F.when(F.col("size") > 0, F.col("passes") + F.coalesce((F.col("h") <= F.col("last")).cast("int"), F.lit(0))).otherwise(0).cast("int")
    return unpacked(d.withColumn("times", times).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))))
