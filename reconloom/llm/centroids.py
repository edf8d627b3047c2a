"""Centroid clustering in whole numbers: the same clusters on every machine and for every way of cutting the table.

Vectors become whole numbers, floor(1024 x), and are packed into blocks once. A round sends the few centroids to the
blocks; a block's distances are |x|^2 - 2 x.c + |c|^2 with one matrix product in float64. All of these are whole numbers, so
the product is exact as long as none reaches 2^53, whatever order BLAS adds in. A bound from the largest components says so before
it is used; beyond it a block is computed in 64-bit integers, beyond these in Python's. Sums of a cluster are combined by treeAggregate,
so neither the driver nor one task ever holds more than a few of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.llm.common import slices, table

#: Vectors in a block: 1 MB of 64 components.
BLOCK = 2048
LONG = 2**63 - 1


def kept_vectors(df: DataFrame, size: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors with exactly `size` components, none null or non-finite (also after scaling)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 1024) < float("inf")))
    return rows.filter((F.size("v") == size) & fine)


def starts(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:id` in ascending order, as whole numbers; fewer if there are fewer."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [[int(c) for c in np.floor(np.array(r["v"], np.float64) * 1024)] for r in rows]


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BLOCK):
            if b.num_rows:
                x = np.floor(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * 1024)
                ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])

    return run


def _matrix(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, size)


def _exactly(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[list[int]]]:
    """x and the centroids in the cheapest type in which every term and sum of the expansion is exact."""
    most = int(np.abs(x).max(initial=0)) + max((abs(c) for row in centroids for c in row), default=0)
    bound = x.shape[1] * most * most  # no less than |x|^2 + 2|x||c| + |c|^2 component by component
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    if kind is object:
        whole = np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)
    else:
        whole = x.astype(kind)
    return whole, np.array(centroids, dtype=kind).reshape(len(centroids), x.shape[1])


def assign(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of x: nearest centroid (the first of equals) and squared distance; and x in the type used."""
    w, c = _exactly(x, centroids)
    away = (w * w).sum(1)[:, None] - 2 * (w @ c.T) + (c * c).sum(1)[None, :]
    near = np.argmin(away, 1).astype(np.int64)
    return near, away[np.arange(len(w)), near], w


def _sums(x: np.ndarray, centroids: list[list[int]]) -> tuple[list, list, list]:
    """Of each centroid: sums of its vectors' components, their number, and their distances, as Python integers."""
    near, away, w = assign(x, centroids)
    # A block's sums stay far below 2^63: 2^11 rows of less than 2^24 in float64, of less than 2^32 in 64-bit integers.
    safe = w if w.dtype == object else w.astype(np.int64)
    away = away if away.dtype == object else away.astype(np.int64)
    sums, counts, far = [], [], []
    for j in range(len(centroids)):
        own = near == j
        counts.append(int(own.sum()))
        sums.append([int(s) for s in safe[own].sum(0)] if counts[-1] else [0] * x.shape[1])
        far.append(sum(map(int, away[own])))
    return sums, counts, far


def _add(a, b):
    if a is None or b is None:
        return b if a is None else a
    return [[p + q for p, q in zip(r, s, strict=True)] for r, s in zip(a[0], b[0], strict=True)], [p + q for p, q in zip(a[1], b[1], strict=True)], [p + q for p, q in zip(a[2], b[2], strict=True)]


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector of `size` components, none null or non-finite: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids begin as the k vectors with the smallest sha256 of `seed:id` (a null id counts as no digits; of equal ids the
    vector whose components come first). Each round assigns every vector to the nearest, of equals the first, and
    replaces centroids that have vectors by floor(sum / count). Then vectors are assigned once more. Where there are fewer than k vectors there
    are as many centroids; no vector at all gives no rows. Repeated rows count as often as they occur. Everything is exact; a
    distance or inertia beyond 2^63 - 1 is null. Other columns of df play no part.

    What is held at once: a block of 2,048 vectors in a task, k centroids and k sums on the driver.
    """
    kept = kept_vectors(df, size, id_col, vector_col)
    centroids = starts(kept, k, seed)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    blocks = table(kept.mapInArrow(_pack(size), f"ids array<{kind}>, x binary"), "vector-blocks")

    def total(now: list[list[int]]):
        """Sums, counts and distances of all blocks, combined in two levels of tasks."""
        return blocks.select("x").rdd.treeAggregate(None, lambda acc, row: _add(acc, _sums(_matrix(row[0], size), now)), _add)

    for _ in range(rounds if centroids else 0):
        sums, counts, _far = total(centroids)
        moved = [[s // n for s in row] if n else old for row, n, old in zip(sums, counts, centroids, strict=True)]
        if moved == centroids:
            break  # further rounds would change nothing
        centroids = moved
    far = total(centroids)[2] if centroids else []
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def long(v: int) -> int | None:
        return v if v <= LONG else None

    inertia, own = long(sum(far)), [long(v) for v in far]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            ids = b.column(0).flatten()
            near, away, _ = assign(_matrix(b.column(1)[0].as_py(), size), centroids)
            away = [long(int(v)) for v in away] if away.dtype == object else away.astype(np.int64)
            cols = [ids, pa.array(near.astype(np.int32)), pa.array(away, pa.int64()), pa.array([own[j] for j in near], pa.int64()), pa.array([inertia] * len(near), pa.int64()), pa.array([names[j] for j in near], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(run, schema).withColumnRenamed("id", id_col)
