"""Exact top-k by inner product with a dual-tree search over cover trees.

Vectors are cut into blocks of near ones, queries likewise, and each block is indexed once by a cover tree, stored as
a row. A pair of nodes with centres p, c and covering radii r, s can hold no score above p.c + r|c| + s|p| + rs, so
the pair is dropped when that is below the worst kth score that the queries under the first node have so far.

The same bound holds for whole blocks. Each query block first meets its few most promising data blocks; with the
kth scores found there, it then meets only the data blocks whose bound reaches the worst of them, and starts there from these
scores. Data blocks do not move more often than their tasks ask for; query blocks, a hundredth of the data, go to where they are needed.

Vectors become whole numbers, floor(1024 x), so that scores are exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconloom.llm.common import groups, small, table

LEAF = 64
#: Children of a node that halve its radius; where these leave points over, the points go to the nearest of them.
FANOUT = 32
#: Vectors in a block of queries and of data, and outlines of data blocks that a task holds at a time.
QUERY_BLOCK, DATA_BLOCK, OUTLINES = 1024, 8192, 2048
#: Centres that blocks are gathered around, from a sample by hash of at most so many vectors.
PIVOTS = 4096
#: Data blocks that a query block meets first, and query blocks that meet a data block in one task.
SEEDS, SLICE = 4, 64
#: No score; its negative is a number too.
NONE = np.iinfo(np.int64).min + 1


class Tree:
    """A cover tree of the rows of x, which are put in order, so that a node is a range of them.

    Node i covers rows a[i] to b[i] with a ball of radius[i] around center[i]; children are nodes first[i] to first[i] + count[i] - 1.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(x))
        away = np.sqrt(((x - x[0]) ** 2).sum(1))
        nodes = [(0, len(x), x[0], float(away.max()), 0, 0)]
        todo = [(0, away)]
        while todo:
            at, away = todo.pop()
            a, b, center, radius, _, _ = nodes[at]
            if b - a <= leaf or radius == 0:
                continue
            parts = self._split(x, order[a:b], away, radius / 2)
            if max(len(p) for p, _ in parts) > 0.9 * (b - a) and b - a <= 64 * leaf:
                continue  # one ball holds nearly all: a leaf is no worse
            nodes[at] = (a, b, center, radius, len(nodes), len(parts))
            for p, d in parts:
                order[a : a + len(p)] = p
                todo.append((len(nodes), d))
                nodes.append((a, a + len(p), x[p[np.argmin(d)]], float(d.max()), 0, 0))
                a += len(p)
        self.order = order
        self.a, self.b, self.first, self.count = (np.array([n[k] for n in nodes], np.int64) for k in (0, 1, 4, 5))
        self.center, self.radius = np.array([n[2] for n in nodes], float), np.array([n[3] for n in nodes])
        self.norm = np.sqrt((self.center**2).sum(1))

    @staticmethod
    def _split(x: np.ndarray, rows: np.ndarray, away: np.ndarray, reach: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Balls that cover the rows, each with the distances to its centre: centres are more than `reach` apart, the first the node's own, the next the farthest left."""
        points = x[rows]
        near, owner = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
        at = int(np.argmin(away))
        for k in range(FANOUT):
            d = np.sqrt(((points - points[at]) ** 2).sum(1))
            closer = d < near
            near[closer], owner[closer] = d[closer], k
            at = int(np.argmax(near))
            if near[at] <= reach:
                break
        return [(rows[owner == k], near[owner == k]) for k in np.unique(owner).tolist()]


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers. Exact below 2**63; through floating point where no sum reaches 2**53."""
    if q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2**53:
        return np.rint(q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class TopK:
    """The k best (score, id, row) of each query so far: higher scores, then smaller ids. Scores below a query's floor are of no use."""

    def __init__(self, floors: np.ndarray, k: int):
        n = len(floors)
        self.scores, self.ids, self.rows = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)
        self.low, self.k = floors.copy(), k

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        useful = scores.max(1) >= self.low[at]
        if not useful.any():
            return
        at, scores = at[useful], scores[useful]
        s = np.concatenate([self.scores[at], scores], 1)
        i, r = (np.concatenate([old[at], np.broadcast_to(new, scores.shape)], 1) for old, new in ((self.ids, ids), (self.rows, rows)))
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[at], self.ids[at], self.rows[at] = (np.take_along_axis(v, order, 1) for v in (s, i, r))
        self.low[at] = np.maximum(self.low[at], self.scores[at, -1])


class Index:
    """The vectors of a block in the order of their tree, with their ids and row numbers."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        self.tree = Tree(x)
        self.ids, self.rows, self.x = (v[self.tree.order] for v in (ids, rows, x))

    def to_bytes(self) -> bytes:
        narrow = np.int32 if np.abs(self.x).max(initial=0) < 2**31 else np.float64
        return zstandard.compress(pickle.dumps((self.ids, self.rows, self.x.astype(narrow), self.tree)), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> Index:
        self = cls.__new__(cls)
        self.ids, self.rows, x, self.tree = pickle.loads(zstandard.decompress(data))
        self.x = x.astype(float)
        return self


def _slack(top):
    return top + 1e-9 * np.abs(top) + 1e-6  # radii are rounded


def search(q: Index, x: Index, k: int, floors: np.ndarray | None = None) -> tuple[TopK, int]:
    """The k best rows of x for each row of q (in q's order), none the query's own row; and how many scores were computed."""
    found, work = TopK(np.full(len(q.ids), NONE) if floors is None else floors, k), 0
    qt, xt = q.tree, x.tree
    length = np.sqrt((q.x**2).sum(1))
    top = float(_slack(qt.center[0] @ xt.center[0] + qt.radius[0] * xt.norm[0] + xt.radius[0] * qt.norm[0] + qt.radius[0] * xt.radius[0]))
    todo = [(top, 0, 0)]
    while todo:
        top, a, b = todo.pop()
        i, j = int(qt.a[a]), int(qt.b[a])
        if top < found.low[i:j].min():
            continue
        if not qt.count[a] and not xt.count[b]:
            # Below the query tree each query has its own bound.
            at = np.arange(i, j)
            own = _slack(q.x[i:j] @ xt.center[b] + xt.radius[b] * length[i:j])
            at = at[own >= found.low[i:j]]
            for s in range(int(xt.a[b]), int(xt.b[b]), 1024):
                of = slice(s, min(s + 1024, int(xt.b[b])))
                if len(at):
                    scores = product(q.x[at], x.x[of])
                    scores[q.rows[at][:, None] == x.rows[of][None, :]] = NONE
                    found.add(at, scores, x.ids[of], x.rows[of])
                    work += scores.size
            continue
        if qt.count[a] and (not xt.count[b] or qt.radius[a] >= xt.radius[b]):
            c = np.arange(qt.first[a], qt.first[a] + qt.count[a])
            tops = _slack(qt.center[c] @ xt.center[b] + qt.radius[c] * xt.norm[b] + xt.radius[b] * qt.norm[c] + qt.radius[c] * xt.radius[b])
            pairs = [(t, n, b) for t, n in zip(tops.tolist(), c.tolist(), strict=True)]
        else:
            c = np.arange(xt.first[b], xt.first[b] + xt.count[b])
            tops = _slack(xt.center[c] @ qt.center[a] + xt.radius[c] * qt.norm[a] + qt.radius[a] * xt.norm[c] + xt.radius[c] * qt.radius[a])
            pairs = [(t, a, n) for t, n in zip(tops.tolist(), c.tolist(), strict=True)]
        pairs.sort()  # the stack's top is the most promising pair
        todo.extend(pairs)
    return found, work


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, id, v, dim): components as floor(1024 x). Vectors null, empty, or with null or non-finite components, and null ids drop out."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform(vector_col, lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("double"))
    own = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    return own.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector_col).alias("dim"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _indexed(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """An index of the vectors: a row for each block (block, dim, n, center, radius, index), of about `size` vectors near one pivot."""
    n = vectors.count()
    pivots = max(1, min(PIVOTS, n // max(1, size // 2)))
    picked: dict[int, np.ndarray] = {}
    for r in vectors.orderBy(F.xxhash64("id", "row")).limit(pivots).select("dim", "v").collect():  # bounded
        picked.setdefault(r["dim"], []).append(r["v"])
    picked = {d: np.array(v) for d, v in picked.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cell = b.column("dim").to_numpy(), np.zeros(b.num_rows, np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                p = picked.get(d)
                if d and p is not None:
                    x = _matrix(b.column("v").take(pa.array(at)), d)
                    cell[at] = ((p**2).sum(1)[None, :] - 2 * x @ p.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    placed = table(vectors.mapInArrow(place, "row long, id long, v array<double>, dim int, cell long"), name + "-placed")
    parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).alias("parts")).filter("parts > 1")
    cut = placed.join(small(table(parts, name + "-cells")), ["dim", "cell"], "left")
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))
    cut = cut.select("row", "id", "v", "dim", F.concat_ws(":", "dim", "cell", part).alias("block"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["block"]):
            dim = g.column("dim")[0].as_py()
            index = Index(g.column("id").to_numpy(), g.column("row").to_numpy(), _matrix(g.column("v"), dim))
            row = {"block": g.column("block")[0].as_py(), "dim": dim, "n": g.num_rows, "center": index.tree.center[0].tolist(), "radius": float(index.tree.radius[0]), "index": index.to_bytes()}
            yield pa.RecordBatch.from_pylist([row])

    dealt = cut.repartition("block").sortWithinPartitions("block")
    return table(dealt.mapInArrow(build, "block string, dim long, n long, center array<double>, radius double, index binary"), name)


def _pairs(queries: DataFrame, data: DataFrame, found: DataFrame | None, seeds: DataFrame | None, name: str) -> DataFrame:
    """(qb, db): block pairs to compare. Without `found` the SEEDS most promising of each query block, with it the others whose bound reaches its floor.

    Outlines (centre and radius) of data blocks lie in tiles of OUTLINES or so, query blocks in slices of as many; a task holds
    one tile and one slice, and every slice meets every tile.
    """
    tiles, slices = (max(1, -(-d.count() // OUTLINES)) for d in (data, queries))
    outline = ("block", "dim", "center", "radius")
    nothing, seeding = F.lit(-float("inf")), found is None
    q = queries.select(*outline)
    q = q.withColumn("floor", nothing) if found is None else q.join(found.select(F.col("qb").alias("block"), F.coalesce(F.col("floor").cast("double"), nothing).alias("floor")), "block", "left").na.fill({"floor": -float("inf")})
    own = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = q.select(every(tiles).alias("tile"), own(slices).alias("slice"), F.lit(1).alias("kind"), *outline, "floor")
    right = data.select(own(tiles).alias("tile"), every(slices).alias("slice"), F.lit(0).alias("kind"), *outline, nothing.alias("floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["tile", "slice"]):
            kind, dims = g.column("kind").to_numpy(), g.column("dim").to_numpy()
            names, radius, floors = g.column("block").to_pylist(), g.column("radius").to_numpy(), g.column("floor").to_numpy()
            qb, db, middles = [], [], []
            for dim in np.unique(dims[kind == 1]).tolist():
                at, of = np.flatnonzero((kind == 1) & (dims == dim)), np.flatnonzero((kind == 0) & (dims == dim))
                if not len(of):
                    continue
                p, c = (_matrix(g.column("center").take(pa.array(i)), dim) for i in (at, of))
                long = np.sqrt((c * c).sum(1))
                for i, k in enumerate(at.tolist()):
                    middle = c @ p[i]
                    if seeding:
                        hit = np.argsort(-middle, kind="stable")[:SEEDS]
                    else:
                        hit = np.flatnonzero(_slack(middle + radius[k] * long + radius[of] * float(np.sqrt(np.dot(p[i], p[i]))) + radius[k] * radius[of]) >= floors[k])
                    qb += [names[k]] * len(hit)
                    db += [names[of[h]] for h in hit]
                    middles.append(middle[hit])
            yield pa.RecordBatch.from_arrays([pa.array(qb, pa.string()), pa.array(db, pa.string()), pa.array(np.concatenate(middles) if middles else np.zeros(0))], names=["qb", "db", "middle"])

    dealt = left.unionByName(right).repartition("tile", "slice").sortWithinPartitions("tile", "slice", "kind", "block")
    met = dealt.mapInArrow(run, "qb string, db string, middle double")
    if seeding:
        best = F.row_number().over(Window.partitionBy("qb").orderBy(F.desc("middle"), "db"))  # SEEDS of each tile
        return table(met.withColumn("at", best).filter(F.col("at") <= SEEDS).select("qb", "db"), name)
    return table(met.join(seeds, ["qb", "db"], "left_anti").select("qb", "db"), name)


def _compare(pairs: DataFrame, queries: DataFrame, data: DataFrame, floors: DataFrame | None, k: int, name: str) -> DataFrame:
    """(q_row, query_id, row, vec_id, score, qb, work): what the pairs of blocks find. A task holds one data block and one query block at a time."""
    slices = table(pairs.groupBy("db").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")), name + "-slices")
    null = F.lit(None)
    q = queries.select(F.col("block").alias("qb"), "index")
    q = q.withColumn("floors", null.cast("array<struct<row:long,floor:long>>")) if floors is None else q.join(floors.select("qb", "floors"), "qb", "left")
    left = pairs.join(small(slices), "db").withColumn("slice", F.pmod(F.xxhash64("qb"), F.col("slices")).cast("int")).join(q, "qb")
    right = data.select(F.col("block").alias("db"), "index").join(small(slices), "db").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = left.select("db", "slice", F.lit(1).alias("kind"), "qb", "index", "floors").unionByName(right.select("db", "slice", F.lit(0).alias("kind"), null.cast("string").alias("qb"), "index", null.cast("array<struct<row:long,floor:long>>").alias("floors")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = None
        for b in batches:
            for at in range(b.num_rows):
                index = Index.from_bytes(b.column("index")[at].as_py())
                if b.column("kind")[at].as_py() == 0:
                    x = index
                    continue
                known = {f["row"]: f["floor"] for f in b.column("floors")[at].as_py() or ()}
                found, work = search(index, x, k, np.array([known.get(r, NONE) for r in index.rows.tolist()], np.int64))
                row, col = np.nonzero((found.scores > NONE) & (found.scores >= found.low[:, None]))
                n = len(row)
                works = np.zeros(n + 1, np.int64)
                works[n] = work  # a last row without a score says how many were computed
                nulls = lambda v: pa.array(np.append(v, 0), mask=np.append(np.zeros(n, bool), True))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [nulls(index.rows[row]), nulls(index.ids[row]), nulls(found.rows[row, col]), nulls(found.ids[row, col]), nulls(found.scores[row, col]), pa.array([b.column("qb")[at].as_py()] * (n + 1)), pa.array(works)],
                    names=["q_row", "query_id", "row", "vec_id", "score", "qb", "work"],
                )

    dealt = rows.repartition("db", "slice").sortWithinPartitions("db", "slice", "kind")
    return table(dealt.mapInArrow(run, "q_row long, query_id long, row long, vec_id long, score long, qb string, work long"), name)


def _found(df: DataFrame, k: int, every: int, id_col: str, vector_col: str) -> DataFrame:
    vectors = table(whole_vectors(df, id_col, vector_col).filter("dim > 0"), "topk-vectors")
    data = _indexed(vectors, DATA_BLOCK, "topk-data")
    queries = _indexed(vectors.filter(F.col("id") % every == 0), QUERY_BLOCK, "topk-queries")
    seeds = _pairs(queries, data, None, None, "topk-seeds")
    first = _compare(seeds, queries, data, None, k, "topk-first")
    kth = first.filter("q_row is not null").withColumn("at", F.row_number().over(_best("q_row"))).filter(F.col("at") == k)
    floors = kth.groupBy("qb").agg(F.collect_list(F.struct(F.col("q_row").alias("row"), F.col("score").alias("floor"))).alias("floors"), F.min("score").alias("low"), F.count("*").alias("n"))
    # A query that has fewer than k scores so far has no floor, and its block none.
    floors = floors.join(queries.select(F.col("block").alias("qb"), F.col("n").alias("of")), "qb").withColumn("floor", F.when(F.col("n") == F.col("of"), F.col("low")))
    floors = table(floors.select("qb", "floors", "floor"), "topk-floors")
    return first.unionByName(_compare(_pairs(queries, data, floors, seeds, "topk-pairs"), queries, data, floors, k, "topk-second"))


def _best(query: str) -> Window:
    return Window.partitionBy(query).orderBy(F.desc("score"), "vec_id", "row")


def top_k(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row whose id is divisible by `every`.

    Candidates are all rows but the query's own with as many components; ties go to the smaller id. Rows with one id are
    queries, and candidates, of their own. A query without any candidate, or without components, has no row; an empty
    table gives none. Scores are exact as long as they fit a long. Other columns of df play no part.

    Blocks are of fixed size (8,192 vectors at most on average of a cell's hash), whatever the table's, and a task holds one of each
    side, or 2,048 outlines of blocks of either side; the driver holds none of them. The
    index is built once; pairs of blocks that can hold nothing are never brought together. Where no pair can
    be dropped, every query block meets every data block: that many scores are asked for then.
    """
    found = _found(df, k, every, id_col, vector_col).filter("q_row is not null")
    ranked = found.withColumn("rank", F.row_number().over(_best("q_row"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def share_computed(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Scores that the search computes as a share of all queries times all rows."""
    vectors = whole_vectors(df, id_col, vector_col).filter("dim > 0")
    work = _found(df, k, every, id_col, vector_col).agg(F.sum("work")).collect()[0][0] or 0
    return work / max(1, vectors.count() * vectors.filter(F.col("id") % every == 0).count())
