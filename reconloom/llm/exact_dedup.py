"""Exact deduplication by counting quotient filters.

Each partition counts the 64-bit fingerprints of its normalised texts in a counting quotient filter,
cut into blocks by the leading quotient bits. Filters of one geometry merge without loss: the
remainders of a quotient are kept sorted, so a merge only interleaves sorted runs and adds counters.
Fingerprints counted more than once are routed to a comparison of the bytes themselves.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.llm.common import leave_one, slices, small, small_batches, table


class CountingQuotientFilter:
    """A multiset of fingerprints of `bits` bits: quotient of `q` bits, remainder of the rest.

    Slots hold the remainders, sorted within the run of their quotient. `occupied` has the quotients that
    have a run (stored as a bit for each quotient, or as a list where that is smaller), `runend` a bit for
    each slot that ends one. A counter is stored only for the slots whose count is above one.
    """

    def __init__(self, bits: int, q: int, fps: np.ndarray, counts: np.ndarray):
        """fps: distinct and sorted, uint64 below 2**bits; counts: of the same length, at least 1."""
        self.bits, self.q = bits, q
        r = bits - q
        quotient = _shift(fps, r)
        self.remainders = fps & np.uint64((1 << r) - 1 if r < 64 else 0xFFFFFFFFFFFFFFFF)
        self.runend = np.ones(len(fps), bool)
        self.runend[:-1] = quotient[1:] != quotient[:-1]
        self.occupied = quotient[self.runend]
        self.more = np.flatnonzero(counts > 1).astype(np.uint32)
        self.counters = counts[self.more].astype(np.int64)

    @classmethod
    def build(cls, bits: int, q: int, fps: np.ndarray) -> CountingQuotientFilter:
        return cls(bits, q, *np.unique(fps, return_counts=True))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints, sorted, and their counts."""
        runs = self.occupied
        which = np.concatenate([[0], np.cumsum(self.runend)[:-1]]).astype(np.int64) if len(self.runend) else np.zeros(0, np.int64)
        r = self.bits - self.q
        high = runs[which] << np.uint64(r) if r < 64 else np.zeros(len(which), np.uint64)
        counts = np.ones(len(self.remainders), np.int64)
        counts[self.more] = self.counters
        return high | self.remainders, counts

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Interleave the sorted remainders and add the counters; nothing is lost."""
        bits, q = filters[0].bits, filters[0].q
        if any((f.bits, f.q) != (bits, q) for f in filters):
            raise ValueError("filters of different geometry")
        parts = [f.items() for f in filters]
        fps, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(fps, kind="stable")  # runs that are sorted already: a merge
        fps, counts = fps[order], counts[order]
        first = np.ones(len(fps), bool)
        first[1:] = fps[1:] != fps[:-1]
        at = np.flatnonzero(first)
        return cls(bits, q, fps[at], np.add.reduceat(counts, at) if len(at) else counts)

    def to_bytes(self) -> bytes:
        width = max(1, (self.bits - self.q + 7) // 8)
        slots = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        return b"".join(
            (
                struct.pack("<BBIII", self.bits, self.q, len(self.remainders), len(self.more), len(self.occupied)),
                np.packbits(np.bincount(self.occupied.astype(np.int64), minlength=1 << self.q).astype(bool)).tobytes() if self._dense(self.q, len(self.occupied)) else self.occupied.astype("<u4").tobytes(),
                np.packbits(self.runend).tobytes(),
                slots,
                self.more.astype("<u4").tobytes(),
                self.counters.astype("<i8").tobytes(),
            )
        )

    @staticmethod
    def _dense(q: int, runs: int) -> bool:
        return (1 << q) <= 32 * runs

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, n, m, runs = struct.unpack_from("<BBIII", data)
        self, at = cls.__new__(cls), struct.calcsize("<BBIII")

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        width = max(1, (bits - q + 7) // 8)
        self.bits, self.q = bits, q
        dense = cls._dense(q, runs)
        self.occupied = (np.flatnonzero(np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q)) if dense else take(4 * runs).view("<u4")).astype(np.uint64)
        self.runend = np.unpackbits(take((n + 7) // 8), count=n).astype(bool)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = take(n * width).reshape(n, width)
        self.remainders = wide.view("<u8").ravel().astype(np.uint64)
        self.more = take(4 * m).view("<u4").astype(np.uint32)
        self.counters = take(8 * m).view("<i8").astype(np.int64)
        return self


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    return x >> np.uint64(by) if by < 64 else np.zeros(len(x), np.uint64)


def geometry(rows: int) -> tuple[int, int]:
    """(block bits, quotient bits in a block) for about one quotient a row; at most 2**14 blocks."""
    total = max(6, int(rows).bit_length())
    block = max(1, min(14, total - 8))
    return block, min(24, max(1, total - block))


def _normal(text: str | None) -> bytes:
    """Bytes of the text with A-Z lower-cased and nothing else changed; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        raw = [_normal(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in raw], np.uint64).view(np.int64))],
            names=["id", "raw_key", "sha", "fp"],
        )


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normalised bytes with their fingerprint, once for each few thousand rows, with how many rows had them."""
    for b in slices(batches, 2048):
        count: dict[bytes, int] = {}
        for t in b.column(0).to_pylist():
            x = _normal(t)
            count[x] = count.get(x, 0) + 1
        keys = list(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in keys], np.uint64).view(np.int64)), pa.array(keys, pa.binary()), pa.array(list(count.values()), pa.int64())], names=["fp", "raw", "rows"]
        )


def fingerprint_counts(fps: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints in column fp that occur more than once, by merged counting quotient filters."""
    block_bits, q = geometry(rows)
    rest = 64 - block_bits

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def out():
            fp = np.sort(np.concatenate(held))
            block = fp >> np.uint64(rest)
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            rows = []
            for part in np.split(fp, cuts[1:]):
                rows.append((int(part[0] >> np.uint64(rest)), CountingQuotientFilter.build(rest, q, part & np.uint64((1 << rest) - 1)).to_bytes()))
            return pd.DataFrame(rows, columns=["block", "filter"])

        for pdf in batches:
            held.append(pdf["fp"].to_numpy(np.int64).view(np.uint64))
            size += len(pdf)
            if size >= 4_000_000:  # 32 MB at a time; a partition may give several filters
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, n = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in pdf["filter"]]).items()
        fp = (fp | np.uint64(int(pdf["block"].iloc[0]) << rest))[n > 1]
        return pd.DataFrame({"fp": fp.view(np.int64), "n": n[n > 1]})

    return fps.select("fp").mapInPandas(build, "block long, filter binary").groupBy("block").applyInPandas(merged, "fp long, n long")


def _decide(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each row of df: id, raw_key (hash of the text as it is), sha, group_size, last (id and row that stay), row."""
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    keyed = src.withColumn("raw_key", F.xxhash64("text"))
    narrow = table(keyed.mapInArrow(_narrow, f"id {id_type}, raw_key long, sha string, fp long").withColumn("row", F.monotonically_increasing_id()), "dedup-narrow")
    twice = table(fingerprint_counts(narrow, narrow.count()), "dedup-twice")
    twice = small(twice)  # only texts of these fingerprints move; above BROADCAST_ROWS of them every text is shuffled once
    same_bytes = src.select("text").mapInArrow(_bytes, "fp long, raw binary, rows long").join(twice, "fp", "left_semi").groupBy("fp", "raw").agg(F.sum("rows").alias("group_size"))
    verified = same_bytes.filter("group_size > 1").select("fp", F.sha2("raw", 256).alias("sha"), "group_size")
    last = narrow.join(twice, "fp", "left_semi").groupBy("fp", "sha").agg(F.max(F.struct("id", "row")).alias("last"))
    groups = table(verified.join(last, ["fp", "sha"]), "dedup-groups")  # a join of two plain inputs can be split where a key is hot
    return narrow.join(groups, ["fp", "sha"], "left")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest id stays (a null id loses to any other; of rows with the same id exactly one stays).
    An empty table gives no rows. Other columns of df play no part, whatever their names.

    The text goes to the Python workers twice: to be fingerprinted, and to be compared. Only the second
    moves it, and there a batch sends equal texts once. Only texts whose fingerprint occurs again move, as long as those
    fingerprints are few enough to broadcast.
    """
    alone = F.col("last").isNull()
    return _decide(df, id_col, text_col).select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("last.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("last.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that exact_duplicates drops, with the columns of df. Of rows with the same id and text one stays, that of the least JSON."""
    found = table(_decide(df, id_col, text_col).select("id", "raw_key", (F.col("last").isNull() | (F.col("row") == F.col("last.row"))).alias("kept")), "dedup-found")
    gone = table(found.filter(~F.col("kept")).select("id", "raw_key").distinct(), "dedup-gone")
    twins = table(gone.intersect(found.filter("kept").select("id", "raw_key")), "dedup-twins")
    return leave_one(df, gone, twins, id_col, text_col)
