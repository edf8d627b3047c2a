"""Similarity join on word shingles by a MinHash LSH forest.

Texts with the same set of shingles form a class. Each class has a signature of minimum hashes, cut into
trees; a tree is the prefix trie of its parts, held as sorted rows. Two classes are candidates in a tree
where they share a prefix. A shared prefix is shortened from MAX_DEPTH levels until pairs of the similarity
asked for meet in some tree with the target recall, which is at `least_depth` levels; what is below is never stored.
Where few classes share a prefix it is shortened further, up to half of MAX_DEPTH: that costs little and adds recall.

Candidates that a sketch of the signature does not contradict are connected. Each connected set is cut into
blocks, whose texts move once. A block is compared in itself and leaves an index, shingle by shingle which members
have it; blocks of one set are then compared by their indexes, every pair of them, so nothing is missed within a set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconloom.llm.common import BROADCAST_ROWS, components, groups, leave_one, slices, small, small_batches, table

WORDS, SIMILARITY = 5, 0.8
TREES, MAX_DEPTH, RECALL = 24, 8, 0.999


def least_depth(similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix at which pairs of the similarity meet in some tree with the target recall."""
    return next((d for d in range(MAX_DEPTH, 1, -1) if 1 - (1 - similarity**d) ** trees >= recall), 1)


#: Levels of a trie: those that can matter at the target recall. The first HALF levels are never shortened.
DEPTH, HALF = least_depth(), MAX_DEPTH // 2
#: A prefix shared by at most so many classes is shortened, to HALF levels at least.
SMALL = 16
#: Bytes of the sketch; candidates whose sketches agree in less than this share are not connected (5 standard errors below 0.8).
SKETCH, SKETCH_SHARE = 32, 0.44
#: Classes in a block: of one trie prefix, and of one connected set.
PREFIX_BLOCK, SET_BLOCK = 4096, 128
#: A class of more copies than this is not joined by a shuffle on its name.
OFTEN = 256

_K = TREES * DEPTH
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 32, _K, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, _K, dtype=np.uint64).astype(np.uint32)
_POS = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
del _rng


class _Hashes(dict):
    """Hash of each word seen; begins anew when large."""

    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_hashes = _Hashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five lower-cased words; of all words, if there are fewer; none without words."""
    words = (text or "").lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(" ".join(words))], np.uint64) if words else np.zeros(0, np.uint64)
    h = np.array(list(map(_hashes.__getitem__, words)), np.uint64)
    n = len(h) - WORDS + 1
    s = h[:n] * _POS[0]
    for k in range(1, WORDS):
        s += h[k : k + n] * _POS[k]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x9E3779B97F4A7C15)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum hashes of a set of shingles, as 16 bits each."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    low = np.full(_K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048, None] * _MUL
        part ^= _XOR
        np.minimum(low, part.min(0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, done=_hashes.clear):
        sets, counts, sigs = [], [], []
        for text in b.column(1).to_pylist():
            s = shingles(text)
            counts.append(len(s))
            sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sets, pa.binary()), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary())], names=["id", "raw_key", "set", "n", "sig"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class a row for each tree: key (tree and first HALF levels of the prefix), rest (the other levels), set, sketch."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    tree = (np.arange(TREES, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            b = whole.slice(at, 2048)
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)
            first, rest = _joined(sig[:, :, :HALF]), _joined(sig[:, :, HALF:])
            key = (first ^ tree) * mix
            key ^= key >> np.uint64(32)
            sketch = (sig.reshape(len(sig), -1)[:, :: _K // SKETCH][:, :SKETCH] & 0xFF).astype(np.uint8)
            rep = np.repeat(np.arange(len(sig)), TREES)
            sets = b.column(0).take(pa.array(rep))
            sketches = pa.array([x.tobytes() for x in sketch], pa.binary()).take(pa.array(rep))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(rest.ravel().view(np.int64)), sets, sketches], names=["key", "rest", "set", "sketch"])


def _joined(levels: np.ndarray) -> np.ndarray:
    """The 16-bit levels on the last axis as one number, the first level highest."""
    out = np.zeros(levels.shape[:-1], np.uint64)
    for k in range(levels.shape[-1]):
        out = (out << np.uint64(16)) | levels[..., k].astype(np.uint64)
    return out


def _nodes(rest: np.ndarray) -> list[tuple[int, int]]:
    """Trie nodes of sorted rests that hold candidates: small ones as short as they come, others at all their levels."""
    out, todo = [], [(0, len(rest), 0)]
    levels = DEPTH - HALF
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2:
            continue
        if b - a <= SMALL or depth >= levels:
            out.append((a, b))
            continue
        level = rest[a:b] >> np.uint64(16 * (levels - depth - 1))
        cuts = (np.flatnonzero(level[1:] != level[:-1]) + 1 + a).tolist()
        todo += [(x, y, depth + 1) for x, y in zip([a, *cuts], [*cuts, b], strict=True)]
    return out


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) that connect the classes of a trie node whose sketches agree; at most one fewer than classes."""
    for g in groups(batches, ["key", "i", "j"]):
        if g.num_rows < 2:
            continue
        rest = g.column("rest").to_numpy().view(np.uint64)
        sets = g.column("set").to_pylist()
        sketch = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        u, v = [], []
        for a, b in _nodes(rest):
            left = np.array(sorted(range(a, b), key=sets.__getitem__))
            while len(left):
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    x = queue.pop()
                    near = (sketch[left] == sketch[x]).sum(1) >= SKETCH_SHARE * SKETCH
                    for y in left[near].tolist():
                        u.append(sets[x])
                        v.append(sets[y])
                    queue += left[near].tolist()
                    left = left[~near]
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])


class Block:
    """An index of the sets of a block: its distinct shingles, sorted, and for each the members that have it, a bit each."""

    def __init__(self, shingles_: np.ndarray, bits: np.ndarray, sizes: np.ndarray):
        self.shingles, self.bits, self.sizes = shingles_, bits, sizes

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Block:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        distinct, row = np.unique(flat, return_inverse=True)
        bits = np.zeros((len(distinct), (len(sets) + 7) // 8), np.uint8)
        np.add.at(bits, (row, owner >> 3), (128 >> (owner & 7)).astype(np.uint8))  # a member has a shingle once
        return cls(distinct, bits, np.array([len(s) for s in sets], np.int64))

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), len(self.shingles)], np.int64)
        return zstandard.compress(b"".join(x.tobytes() for x in (head, self.sizes, self.shingles, np.ascontiguousarray(self.bits.T))), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> Block:
        raw = zstandard.decompress(data)
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        sizes, found = np.frombuffer(raw, np.int64, n, 16), np.frombuffer(raw, np.uint64, m, 16 + 8 * n)
        bits = np.frombuffer(raw, np.uint8, offset=16 + 8 * (n + m)).reshape((n + 7) // 8, m)
        return cls(found, np.ascontiguousarray(bits.T), sizes)

    def linked(self, other: Block) -> np.ndarray:
        """Matrix of the pairs (member of self, member of other) with a Jaccard similarity of at least 0.8: 9 |a & b| >= 4 (|a| + |b|)."""
        if self is other:
            mine = theirs = np.arange(len(self.shingles))
        else:
            _, mine, theirs = np.intersect1d(self.shingles, other.shingles, assume_unique=True, return_indices=True)
        common = np.zeros((len(self.sizes), len(other.sizes)), np.int64)
        for at in range(0, len(mine), 4096):
            x, y = (np.unpackbits(b.bits[k[at : at + 4096]], axis=1, count=len(b.sizes)).astype(np.float32) for b, k in ((self, mine), (other, theirs)))
            common += (x.T @ y).astype(np.int64)
        return 9 * common >= 4 * (self.sizes[:, None] + other.sizes[None, :])


def _findings(linked: np.ndarray, names: list[bytes], copies: np.ndarray) -> tuple[list, list, list]:
    """(u, v, links) of a symmetric matrix of links: of each linked class how many documents it is linked to (v null), and a spanning forest of the links (links 0)."""
    links = linked @ copies
    hit = np.flatnonzero(links)
    u, v = [], []
    seen = np.zeros(len(names), bool)
    for start in hit.tolist():
        if seen[start]:
            continue
        seen[start], queue = True, [start]
        while queue:
            new = np.flatnonzero(linked[queue.pop()] & ~seen).tolist()
            seen[new] = True
            u += [names[y] for y in new]
            v += [names[start]] * len(new)
            queue += new
    return u + [names[k] for k in hit], v + [None] * len(hit), [0] * len(u) + links[hit].tolist()


_FOUND = "u binary, v binary, links long"
_BLOCK = _FOUND + ", comp binary, block int, blocks int, names binary, copies binary, index binary"
_BLOCK_TYPES = (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each set in a partition: of a row repeated whole not all come together in one task."""
    seen: set[bytes] = set()
    for b in batches:
        new = []
        for k, s in enumerate(b.column("set").to_pylist()):
            if s not in seen:
                seen.add(s)
                new.append(k)
        yield b.take(pa.array(new, pa.int64()))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block what is found in it, and, where its connected set has other blocks, a row with its index."""
    for g in groups(batches, ["comp", "block"]):
        names, copies = g.column("set").to_pylist(), g.column("copies").to_numpy()
        once = list({s: k for k, s in enumerate(names)}.values())
        names, copies = [names[k] for k in once], copies[once]
        blocks = g.column("blocks")[0].as_py()
        if len(once) < 2 and blocks == 1:
            continue
        index = Block.of([shingles(g.column("text")[k].as_py()) for k in once])
        linked = index.linked(index)
        np.fill_diagonal(linked, False)
        u, v, links = _findings(linked, names, copies)
        n = len(u)
        rows = [u, v, links, *([None] * n for _ in range(6))]
        if blocks > 1:
            own = (None, None, None, g.column("comp")[0].as_py(), g.column("block")[0].as_py(), blocks, b"".join(names), copies.astype(np.int64).tobytes(), index.to_bytes())
            rows = [[*r, x] for r, x in zip(rows, own, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, _BLOCK_TYPES, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is found between the two blocks of each pair."""
    for g in groups(batches, ["comp", "i", "j"]):
        if g.num_rows < 2:
            continue
        a, b = (Block.from_bytes(x) for x in g.column("index").to_pylist()[:2])
        joined = b"".join(g.column("names").to_pylist()[:2])
        names = [joined[at : at + 16] for at in range(0, len(joined), 16)]
        copies = np.frombuffer(b"".join(g.column("copies").to_pylist()[:2]), np.int64)
        n = len(a.sizes)
        linked = np.zeros((len(names), len(names)), bool)
        linked[:n, n:] = a.linked(b)
        linked[n:, :n] = linked[:n, n:].T
        u, v, links = _findings(linked, names, copies)
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(links, pa.int64())], names=["u", "v", "links"])


def _classes(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(narrow, classes): narrow has id, raw_key, set, n of each row; classes has set, rep, copies, n_links, group of each set."""
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("raw_key", F.xxhash64("text"))
    id_type = src.schema["id"].dataType.simpleString()
    narrow = table(src.mapInArrow(_narrow, f"id {id_type}, raw_key long, set binary, n long, sig binary"), "join-narrow")
    reps = table(narrow.filter("n > 0").groupBy("set").agg(F.min(F.struct("id", "raw_key")).alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "join-sets")

    forest = reps.select("set", "sig").mapInArrow(_forest, "key long, rest long, set binary, sketch binary")
    crowded = forest.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > PREFIX_BLOCK)
    crowded = table(crowded.select("key", F.ceil(F.col("n") / PREFIX_BLOCK).cast("int").alias("blocks")), "join-crowded")
    tiled = _tiles(forest.join(small(crowded), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))))
    edges = tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rest").select("key", "i", "j", "rest", "set", "sketch").mapInArrow(_connect, "u binary, v binary")
    sets = table(components(edges, "join-candidates").select(F.col("v").alias("set"), F.col("root").alias("comp")), "join-connected")
    large = table(sets.groupBy("comp").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("blocks")).filter("blocks > 1"), "join-large")
    members = sets.join(small(large), "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = table(members.join(reps.select("set", "rep", "copies"), "set"), "join-members")

    named = members.select("set", "comp", "blocks", "copies", F.col("rep.id").alias("rep_id"), F.col("rep.raw_key").alias("rep_key"))
    match = F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("raw_key") == F.col("rep_key"))
    if members.count() <= BROADCAST_ROWS:  # the two keys of each member; then only members' texts move
        src = src.join(F.broadcast(named.select("rep_id", "rep_key")), match, "left_semi")
    text = src.join(named, match).select("comp", _block().alias("block"), "blocks", "set", "copies", "text")
    text = text.mapInArrow(_once, text.schema).repartition("comp", "block").sortWithinPartitions("comp", "block")
    blocks = table(text.mapInArrow(_blocks, _BLOCK), "join-blocks")
    other = F.explode(F.expr("filter(sequence(0, blocks - 1), j -> j <> block)"))
    pairs = blocks.filter("index is not null").withColumn("other", other).select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "names", "copies", "index")
    pairs = pairs.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_pairs, _FOUND)
    found = table(blocks.filter("u is not null").select("u", "v", "links").unionByName(pairs), "join-found")
    links = found.filter("v is null").groupBy(F.col("u").alias("set")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("v is not null").select("u", "v"), "join-classes").select(F.col("v").alias("set"), "root")
    linked = roots.join(links, "set").join(members.select("set", "rep"), "set")
    group = linked.groupBy("root").agg(F.min("rep").alias("group"))
    linked = table(linked.join(group, "root").select("set", "links", "group"), "join-linked")
    classes = reps.select("set", "rep", "copies").join(linked, "set", "left")
    classes = classes.select("set", "rep", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("group", "rep").alias("group"))
    return narrow.select("id", "raw_key", "set", "n"), table(classes, "join-all")


def _block() -> Column:
    return F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")


def _tiles(df: DataFrame) -> DataFrame:
    """A row for each pair of blocks (i <= j) that the row's block, of `blocks` by hash of the set, is in."""
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(_block(), j).alias("i"), F.greatest(_block(), j).alias("j")))
    return df.withColumn("_t", F.explode(pair)).withColumns({"i": F.col("_t.i"), "j": F.col("_t.j")}).drop("_t")


def _with_classes(narrow: DataFrame, classes: DataFrame) -> DataFrame:
    """narrow with n_links and group of its class, null without one. Classes of very many copies are broadcast: there are at most BROADCAST_ROWS of them."""
    c = classes.select("set", "copies", "n_links", "group")
    often = F.col("copies") > F.greatest(F.lit(OFTEN), F.lit(narrow.count() / BROADCAST_ROWS))
    hot = F.broadcast(c.filter(often).drop("copies"))
    rest = narrow.join(hot.select("set"), "set", "left_anti").join(c.filter(~often).drop("copies"), "set", "left")
    return narrow.join(hot, "set").unionByName(rest)


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, class_id, n_links, n_shingles.

    Rows are linked when the Jaccard similarity of their shingles is at least 0.8; equal sets are linked.
    n_links counts the other rows that a row is linked to, class_id is the least id that links lead to.
    Null, empty and white texts have no shingles: class_id is their own id, n_links 0. Rows repeated whole
    are copies. An empty table gives no rows. Other columns of df play no part.
    """
    narrow, classes = _classes(df, id_col, text_col)
    return _with_classes(narrow, classes).select(
        F.col("id").alias(id_col), F.when(F.col("group").isNull(), F.col("id")).otherwise(F.col("group.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("n_shingles")
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each class of linked rows, that of the least id; rows without words all stay. The columns of df."""
    narrow, classes = _classes(df, id_col, text_col)
    found = _with_classes(narrow.filter("n > 0"), classes)
    stays = F.col("id").eqNullSafe(F.col("group.id")) & (F.col("raw_key") == F.col("group.raw_key"))
    keys = found.groupBy("id", "raw_key").agg(F.bool_or(stays).alias("stays"), F.count("*").alias("rows"))
    keys = table(keys.filter(~F.col("stays") | (F.col("rows") > 1)), "join-keys")  # of a row repeated whole one stays
    return leave_one(df, keys.select("id", "raw_key"), keys.filter("stays").select("id", "raw_key"), id_col, text_col)
