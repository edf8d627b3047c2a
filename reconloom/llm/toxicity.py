"""Toxicity by a factorization machine over hashed terms.

A document is the set of hashed terms of its words: the word itself and its prefixes of 4, 5 and 6
letters, so that inflected forms share what is learned. The machine learns a weight for each term of the
training rows and, through k factors a term, a weight for each pair, such as an insult with a mention of a
group. It starts from the terms that tell the classes apart by themselves and goes on with all of them:

    z = w0 + sum_i w_i + (1/2) sum_f [(sum_i v_if)^2 - sum_i v_if^2],    score = 1 / (1 + exp(-z))
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.llm.common import held_out, labelled_sample, slices, small_batches, spread, table, tidy

WORD = re.compile(r"\w+")
BITS = 22
#: Labelled rows at most that the machine is fitted on, and terms at most that the descent starts from.
SAMPLE, TERMS = 10_000, 2048
REJECT = 0.3
#: Penalties of terms that are not clear by themselves, of which folds of the training rows choose one, and the batches that a fold's descent takes.
PENALTIES, FOLDS, FOLD_BATCHES = (5e-3, 2e-2, 8e-2), 2, 160


def term_ids(word: str) -> set[int]:
    """Hashes of the word's terms."""
    digest, n = xxhash.xxh32_intdigest, min(len(word), 6)
    out = {digest("w:" + word) >> (32 - BITS)}
    while n >= 4:
        out.add(digest("p:" + word[:n]) >> (32 - BITS))
        n -= 1
    return out


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Machine:
    """A fitted factorization machine: hashes of its terms, their weights and factors."""

    terms: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray
    _cache: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    @cached_property
    def place(self) -> np.ndarray:
        """The place of a term by its hash, -1 for terms that the machine lacks: of fixed size, unlike a dict of Python numbers. Made where texts are read, not in the descent."""
        place = np.full(1 << BITS, -1, np.int32)
        place[self.terms] = np.arange(len(self.terms))
        return place

    def __getstate__(self):
        return (self.terms, self.w0, self.w, self.v)

    def __setstate__(self, s):
        self.terms, self.w0, self.w, self.v = s
        self._cache = {}

    def forget(self) -> None:
        """Drop the remembered words and the places of terms."""
        self._cache.clear()
        self.__dict__.pop("_at", None)
        self.__dict__.pop("place", None)

    @cached_property
    def _at(self) -> memoryview:
        return memoryview(self.place)  # single numbers come out of a view without an array scalar

    def indices(self, text: str | None) -> list[int]:
        """The machine's terms in the whole text."""
        cache, at, found = self._cache, self._at, set()
        if len(cache) > 100_000:
            cache.clear()
        for word in words_of(text):
            hit = cache.get(word)
            if hit is None:
                hit = cache[word] = tuple([i for t in term_ids(word) if (i := at[t]) >= 0])
            if hit:
                found.update(hit)
        return sorted(found)

    def margin(self, i) -> float:
        """w0 and what the terms i add to it, alone and in pairs."""
        z = self.w0
        if len(i):
            v = self.v[i]
            s = v.sum(0)
            z += float(self.w[i].sum() + 0.5 * (s @ s - (v * v).sum()))
        return z

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(self.indices(text)), -40, 40))))


#: Terms of rows that a task holds before it puts equal ones together.
HELD = 1_000_000


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, pos, neg): rows of each class with the term, summed within a partition as far as memory allows: in arrays, as dicts of so many numbers take a worker's memory."""

    def merged():
        terms, place = np.unique(np.concatenate([t for t, _ in kept]), return_inverse=True)
        n = np.concatenate([n for _, n in kept])
        return terms, np.stack([np.bincount(place, n[:, y], len(terms)) for y in (0, 1)], axis=1).astype(np.int32)

    def out(terms, n):
        return pd.DataFrame({"term": terms.astype(np.int64), "pos": n[:, 1].astype(np.int64), "neg": n[:, 0].astype(np.int64)})

    kept: list[tuple[np.ndarray, np.ndarray]] = []
    rows: tuple[list, list] = ([], [])
    held = 0
    seen: dict[str, tuple[int, ...]] = {}
    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"], strict=True):
            own: set[int] = set()
            if len(seen) > 100_000:
                seen.clear()
            for word in words_of(text):
                ids = seen.get(word)
                if ids is None:
                    ids = seen[word] = tuple(term_ids(word))
                own.update(ids)
            rows[int(y)].append(np.fromiter(own, np.int32, len(own)))
            held += len(own)
            if held > HELD:
                kept = [*kept, *_classes(rows)]
                kept, rows = [merged()], ([], [])
                held = len(kept[0][0])
                if held > HELD // 2:
                    yield out(*kept[0])
                    kept, held = [], 0
    kept = [*kept, *_classes(rows)]
    if kept:
        yield out(*merged())


def _classes(rows: tuple[list[np.ndarray], list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, rows of class 0 and 1 with each) of the terms of the rows of either class."""
    out = []
    for y in (0, 1):
        if rows[y]:
            terms, n = np.unique(np.concatenate(rows[y]), return_counts=True)
            both = np.zeros((len(terms), 2), np.int32)
            both[:, y] = n
            out.append((terms, both))
    return out


def fit(train: DataFrame, terms: int = TERMS, factors: int = 8, epochs: int = 15, seed: int = 0) -> Machine:
    """Fit on train (text, y of 0 or 1), which is bounded by the caller and read twice.

    Terms: all of at least 3 rows. The descent starts from `terms` of those whose log odds of the classes are
    2.5 standard errors from 0, the clearest first, and goes on with all terms, as a term may count only in
    a pair. Without rows of both classes the score is the share of class 1, smoothed.
    """
    n = {int(r["y"]): r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    neg, pos = n.get(0, 0), n.get(1, 0)
    base = float(np.log((pos + 0.5) / (neg + 0.5)))
    train = spread(train)
    if not (pos and neg):
        return Machine(np.zeros(0, np.int64), base if pos + neg else 0.0, np.zeros(0), np.zeros((0, factors)))
    p, q = F.col("pos") + 0.5, F.col("neg") + 0.5
    z = (F.log(p / (pos + 1)) - F.log(q / (neg + 1))) / F.sqrt(1 / p + 1 / q)
    counts = train.mapInPandas(tidy(_counts), "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("pos + neg >= 3")
    found = counts.select("term", F.abs(z).alias("z")).toArrow()
    term, clear = (found.column(c).to_numpy() for c in ("term", "z"))
    order = np.lexsort((term, -clear))
    first = min(terms, int((clear >= 2.5).sum()))
    empty = Machine(term[order], base, np.zeros(first), np.zeros((first, factors)))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["h"], "i": [np.array(empty.indices(t), np.int32) for t in pdf["text"]], "y": pdf["y"]})
        empty.forget()

    got = train.select(F.xxhash64("text").alias("h"), "text", "y").mapInPandas(tidy(rows), "h long, i array<int>, y int").toArrow()
    lists, ys, hashes = got.column("i").combine_chunks(), got.column("y").to_numpy(), got.column("h").to_numpy()
    del got
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    order = np.lexsort((ys, hashes))  # the same order each time
    own = [flat[ends[k] : ends[k + 1]] for k in order.tolist()]
    x, y = np.zeros((len(own), first), np.uint8), ys[order].astype(np.float32)
    for row, i in enumerate(own):
        x[row, i[i < first]] = 1
    penalty = _penalty(train.sparkSession, empty, x, own, y, epochs, seed)
    begun = _descend(empty, x, y, epochs, seed)
    del x
    return _go_on(begun, own, y, seed, penalty)


def _penalty(spark, empty: Machine, x: np.ndarray, own: list[np.ndarray], y: np.ndarray, epochs: int, seed: int) -> float:
    """Of PENALTIES the one with the least logistic loss on rows left out, summed over the folds; of equals the larger.

    A task for each fold and penalty. A fold is every FOLDS-th row in the order of the text's hash.
    """
    fold = np.arange(len(y)) % FOLDS
    if any(len(set(y[fold != f].tolist())) < 2 or not (fold == f).any() for f in range(FOLDS)):
        return PENALTIES[1]
    # Bits of x and the terms of the rows, end to end, go along with the tasks; both are bounded by SAMPLE rows.
    bits, width = np.packbits(x, axis=1), x.shape[1]
    # As a broadcast: what a function holds by itself is in a worker twice, as bytes and read.
    sent = spark.sparkContext.broadcast((bits, np.concatenate(own).astype(np.int32), np.array([len(i) for i in own])))
    del bits
    terms, w0, factors = empty.terms, empty.w0, empty.v.shape[1]
    grid = [(f, float(q)) for f in range(FOLDS) for q in PENALTIES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            bits, flat, sizes = sent.value
            for f, penalty in (grid[k] for k in pdf["id"]):
                rows, learn = np.split(flat, np.cumsum(sizes)[:-1]), np.flatnonzero(fold != f)
                m = Machine(terms, w0, np.zeros(width), np.zeros((width, factors)))
                m = _descend(m, np.unpackbits(bits[learn], axis=1, count=width), y[learn], epochs, seed)
                m = _go_on(m, [rows[k] for k in learn], y[learn], seed, penalty, FOLD_BATCHES)
                left = np.flatnonzero(fold == f)
                z = np.array([m.margin(rows[k]) for k in left])
                out.append((penalty, float(np.logaddexp(0, np.where(y[left] > 0, -z, z)).sum())))
            yield pd.DataFrame(out, columns=["penalty", "loss"])

    tasks = spark.range(0, len(grid), 1, len(grid))  # one each
    loss = tasks.mapInPandas(tidy(run), "penalty double, loss double").groupBy("penalty").agg(F.sum("loss").alias("loss")).collect()  # three rows
    sent.destroy()
    return min(loss, key=lambda r: (r["loss"], -r["penalty"]))["penalty"]


def _go_on(m: Machine, rows: list[np.ndarray], y: np.ndarray, seed: int, penalty: float = 2e-2, batches: int = 480, epochs: int = 6) -> Machine:
    """The descent of m over all its terms; rows has the terms of each row. m has weights for its first terms.

    By Adam over batches of 256 rows, for the terms of a batch. The more terms a row has, the shorter the
    steps, which a row's terms take together. Terms that are not clear by themselves have `penalty`, a larger one, as there
    are enough of them to learn the rows by heart. About `batches` are taken, and every row at least a few times.
    """
    rng = np.random.default_rng(seed)
    k, n, start = m.v.shape[1], len(m.terms), len(m.w)
    short = min(1.0, 40 / max(1.0, float(np.mean([len(i) for i in rows]))))
    p = rng.normal(0, 0.02 * short**0.5, (n, 1 + k)).astype(np.float32)
    p[:, 0] = 0
    p[:start, 0], p[:start, 1:] = m.w, m.v
    mean, var, w0, t = np.zeros_like(p), np.zeros_like(p), m.w0, 0
    steps = max(1, -(-len(y) // 256))
    parts = []
    for at in np.array_split(rng.permutation(len(y)), steps):
        at = np.array([a for a in at.tolist() if len(rows[a])], int)
        if len(at):
            size = np.array([len(rows[a]) for a in at])
            u, local = np.unique(np.concatenate([rows[a] for a in at]), return_inverse=True)
            parts.append((y[at], size, np.cumsum(size) - size, u, local.astype(np.int32)))
    del rows
    for _ in range(max(min(epochs, batches // 80), min(120, batches // steps))):
        for j in rng.permutation(len(parts)):
            yb, size, starts, u, local = parts[j]
            b = p[u]
            sums = np.add.reduceat(b[local], starts, axis=0)
            s = sums[:, 1:]
            square = np.add.reduceat((b[:, 1:] ** 2).sum(1)[local], starts)
            e = (1 / (1 + np.exp(-np.clip(w0 + sums[:, 0] + 0.5 * ((s * s).sum(1) - square), -30, 30))) - yb) / len(yb)
            g = np.empty_like(b)
            g[:, 0] = np.bincount(local, np.repeat(e, size), len(u))
            for f in range(k):
                g[:, 1 + f] = np.bincount(local, np.repeat(e * s[:, f], size), len(u)) - b[:, 1 + f] * g[:, 0]
            g += np.where(u < start, 1e-4, penalty)[:, None].astype(np.float32) * b
            t += 1
            mean[u] = ms = 0.9 * mean[u] + 0.1 * g
            var[u] = vs = 0.999 * var[u] + 0.001 * g * g
            p[u] = b - 0.02 * short * (ms / (1 - 0.9**t)) / (np.sqrt(vs / (1 - 0.999**t)) + 1e-4)
            w0 -= 0.02 * short * float(e.sum())
    return Machine(m.terms, w0, p[:, 0].copy(), p[:, 1:].copy())


def _descend(m: Machine, x: np.ndarray, y: np.ndarray, epochs: int, seed: int) -> Machine:
    """Logistic loss with a small square penalty, by Adam over batches of 256 rows."""
    rng = np.random.default_rng(seed)
    p = [np.array([m.w0], np.float32), np.zeros(x.shape[1], np.float32), rng.normal(0, 0.02, (x.shape[1], m.v.shape[1])).astype(np.float32)]
    mean, var, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    steps = max(1, -(-len(y) // 256))
    for _ in range(max(epochs, min(200, 600 // steps))):
        for at in np.array_split(rng.permutation(len(y)), steps):
            a = x[at].astype(np.float32)
            s = a @ p[2]
            z = p[0] + a @ p[1] + 0.5 * ((s * s).sum(1) - a @ (p[2] * p[2]).sum(1))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)
            ae = a.T @ e
            grads = [np.array([e.sum()], np.float32), ae + 1e-4 * p[1], a.T @ (e[:, None] * s) - p[2] * ae[:, None] + 1e-4 * p[2]]
            t += 1
            for i, g in enumerate(grads):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                var[i] = 0.999 * var[i] + 0.001 * g * g
                p[i] -= 0.02 * (mean[i] / (1 - 0.9**t)) / (np.sqrt(var[i] / (1 - 0.999**t)) + 1e-8)
    return Machine(m.terms, float(p[0][0]), p[1].astype(float), p[2].astype(float))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = SAMPLE) -> DataFrame:
    """(text, y) of the labelled rows that are not held out, equal texts once, `bound` rows or so at most."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    own = labelled_sample(own.groupBy("id").agg(F.max("y").alias("y")), "id", bound)
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return table(text.join(F.broadcast(own), "id").groupBy(F.xxhash64("text").alias("_h")).agg(F.min(F.struct("id", "text", "y")).alias("r")).select("r.text", "r.y"), "tox-train")


def toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted (1 from a score of 0.3).

    Reads whole texts; a null or empty text has no terms and gets the base rate's score. An empty table gives no rows.
    """

    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, done=machine.forget):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([machine.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, f"id {id_type}, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, done=machine.forget):
            yield b.filter(pc.less(pa.array([machine.score(t) for t in b.column(at).to_pylist()], pa.float64()), REJECT))

    return docs.mapInArrow(clean, docs.schema)
