"""Each operator against brute force on small tables, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reconloom.llm import chat, common, cover_tree, exact_dedup, mixing, ngram_join, pieces, pii, quality, sharding, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "."]) for _ in range(n))


def corpus(seed=0):
    """Texts of all kinds: null, empty, white, very long, copies, near copies, one group that is a third of all."""
    r = random.Random(seed)
    texts = [None, "", " \n\t ", "x", prose(r, 9000)]
    hot = prose(r, 60)
    texts += [hot] * 20 + [hot.upper()] * 3
    base = prose(r, 120).split()
    for i in range(12):
        w = list(base)
        w[(7 * i) % 120] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [prose(r, r.randrange(1, 150)) for _ in range(20)]
    texts += ["naïve ÄÖÜ 東京 🎉 " + prose(r, 5)] * 2
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 0) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id", None, None, None), (None, "no id", None, None, None)]
    return rows


#: Names that the operators use themselves.
CLASHES = ("id", "row", "fp", "set", "h", "size", "block", "rank", "v", "shard", "raw_key", "_raw_key", "_key", "_key_id", "_size", "_src_key", "_h", "_shard", "_of", "_times", "_time", "_last", "_passes", "comp", "kept", "src_key", "key", "key_id")


def clashes_unchanged(df):
    """The columns of CLASHES hold in every row what the fixture put there."""
    got = df.select(*CLASHES).distinct().collect()
    return [tuple(r) for r in got] == [tuple(range(len(CLASHES)))]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = {c: F.lit(k) for k, c in enumerate(CLASHES)}
    return spark.createDataFrame(rows, DOC).withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# Exact deduplication


def test_exact_dedup(docs, rows):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_text = defaultdict(list)
    for i, t, *_ in rows:
        by_text[ascii_lower(t)].append(i)
    want = Counter()
    for t, ids in by_text.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(by_text)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_exact_duplicates(docs, rows, nothing):
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and clashes_unchanged(left)
    texts = [ascii_lower(r.text) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({ascii_lower(t) for _, t, *_ in rows})
    assert exact_dedup.exact_duplicates(nothing).isEmpty() and exact_dedup.drop_exact_duplicates(nothing).isEmpty()


@pytest.mark.parametrize("bits", [10, 50, 64])
def test_quotient_filter_merges_losslessly(bits):
    r = np.random.default_rng(bits)
    parts = [r.integers(0, 1 << min(bits, 9), 300, dtype=np.uint64) << np.uint64(bits - min(bits, 9)) for _ in range(4)]
    q = exact_dedup.CountingQuotientFilter
    merged = q.merge([q.from_bytes(q.build(bits, 6, p).to_bytes()) for p in parts])
    fps, counts = q.from_bytes(merged.to_bytes()).items()
    assert dict(zip(fps.tolist(), counts.tolist(), strict=True)) == Counter(np.concatenate(parts).tolist())
    with pytest.raises(ValueError, match="geometry"):
        q.merge([q.build(bits, 5, parts[0]), q.build(bits, 6, parts[1])])


# Similarity join


def brute_join(rows):
    sets = [(i, frozenset(ngram_join.shingles(t).tolist())) for i, t, *_ in rows]
    n = len(sets)
    links, parent = [0] * n, list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(n):
        for b in range(a + 1, n):
            x, y = sets[a][1], sets[b][1]
            if x and y and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(lambda: (True, 0))
    for a, (i, s) in enumerate(sets):
        if s:
            key = find(a)
            least[key] = min(least[key], (i is None, i or 0))
    out = []
    for a, (i, s) in enumerate(sets):
        c = least[find(a)] if s else (i is None, i or 0)
        out.append((i, None if c[0] else c[1], links[a]))
    return out


def test_jaccard_join_is_brute_force(docs, rows):
    got = Counter((r.doc_id, r.n_links) for r in ngram_join.jaccard_join(docs).collect())
    assert got == Counter((i, n) for i, _, n in brute_join(rows))


def test_jaccard_classes(docs, rows):
    got = {r.doc_id: r.class_id for r in ngram_join.jaccard_join(docs).collect() if r.doc_id is not None}
    assert got == {i: c for i, c, _ in brute_join(rows) if i is not None}


def test_jaccard_join_in_many_blocks(spark, monkeypatch):
    r = random.Random(4)
    base = prose(r, 200).split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in r.sample(range(200), r.randrange(0, 6)):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w), "en", "s", 0))
    monkeypatch.setattr(ngram_join, "SET_BLOCK", 8)
    monkeypatch.setattr(ngram_join, "PREFIX_BLOCK", 8)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, DOC)).collect())
    assert got == sorted(brute_join(rows))


def test_drop_near_duplicates(docs, rows, nothing):
    out = ngram_join.drop_near_duplicates(docs)
    assert out.columns == docs.columns and clashes_unchanged(out)
    left = [r.doc_id for r in out.collect()]
    lead = {c for i, c, _ in brute_join([x for x in rows if ngram_join.shingles(x[1]).size])}
    bare = [i for i, t, *_ in rows if not ngram_join.shingles(t).size]
    assert Counter(left) == Counter([*lead, *bare])
    assert ngram_join.jaccard_join(nothing).isEmpty() and ngram_join.drop_near_duplicates(nothing).isEmpty()


def test_of_rows_that_differ_elsewhere_the_least_json_stays(spark):
    rows = [(1, "same words here for all of them", z) for z in "cab"] + [(2, "SAME words here for all of them", "x"), (2, "SAME words here for all of them", "d")]
    for op in (exact_dedup.drop_exact_duplicates, ngram_join.drop_near_duplicates):
        left = op(spark.createDataFrame(rows, "doc_id long, text string, z string").repartition(4)).collect()
        assert [(r.doc_id, r.z) for r in left] == [(2, "d") if op is exact_dedup.drop_exact_duplicates else (1, "a")]


def test_forest_depth():
    assert ngram_join.DEPTH == ngram_join.least_depth() == 6
    assert 1 - (1 - 0.8**6) ** ngram_join.TREES >= ngram_join.RECALL > 1 - (1 - 0.8**7) ** ngram_join.TREES


def test_nodes_are_shortened_while_small():
    level = lambda *x: sum(v << 16 * (1 - k) for k, v in enumerate(x))
    few = np.array([level(1, 1), level(2, 2), level(3, 3)], np.uint64)
    assert ngram_join._nodes(few) == [(0, 3)]
    many = np.array([level(1, k // 10) for k in range(20)] + [level(2, 7)] * 17 + [level(3, k) for k in range(3)], np.uint64)
    assert sorted(ngram_join._nodes(many)) == [(0, 10), (10, 20), (20, 37), (37, 40)]


def test_candidates_of_pairs_at_the_threshold():
    """Recall of the forest and the sketch over pairs of sets whose similarity is 0.8."""
    r, hit = np.random.default_rng(12), 0
    for _ in range(600):
        x = r.integers(0, 1 << 63, 100, dtype=np.uint64)  # 80 of 100 shared
        sig = [ngram_join.signature(np.unique(s)).tobytes() for s in (x[:90], x[10:])]
        b = pa.RecordBatch.from_arrays([pa.array([b"a" * 16, b"b" * 16]), pa.array(sig)], names=["set", "sig"])
        t = pa.Table.from_batches(ngram_join._forest([b])).sort_by([("key", "ascending"), ("rest", "ascending")])
        t = t.append_column("i", pa.array([0] * t.num_rows)).append_column("j", pa.array([0] * t.num_rows))
        hit += bool(list(ngram_join._connect(t.combine_chunks().to_batches())))
    assert hit / 600 >= 0.99


@pytest.mark.parametrize("n", [1, 2, 7, 9, 40])
def test_blocks_compare_all_pairs(n):
    r = np.random.default_rng(n)
    base = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, int(k)), r.integers(0, 1 << 63, int(m), dtype=np.uint64)])) for k, m in zip(r.integers(100, 2000, 2 * n), r.integers(0, 60, 2 * n), strict=True)]
    want = np.array([[9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)) for b in sets] for a in sets])
    one, two = (ngram_join.Block.from_bytes(ngram_join.Block.of(x).to_bytes()) for x in (sets[:n], sets[n:]))
    assert (one.linked(one) == want[:n, :n]).all() and (one.linked(two) == want[:n, n:]).all()


def test_signature_estimates_similarity():
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
    a, b = ngram_join.signature(np.unique(x[:1800])), ngram_join.signature(np.unique(x[200:]))
    assert abs((a == b).mean() - 0.8) < 0.12


def test_components_of_a_chain(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = {r.v: r.root for r in common.components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# Mixing


def brute_targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, ws = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] > most * sizes[s] * ws]
        if not over:
            return fixed | {s: rest * w[s] / ws for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, *_ in rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
    want, taken = brute_targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 for s in sizes)
    assert sorted(mixing.mix(docs.repartition(5)).collect(), key=str) == sorted(got, key=str)


def nearest(mixed):
    """How often the mix takes each document, to the nearest whole number (halves up)."""
    return {r.doc_id: n for r in mixed.collect() if r["size"] and (n := (2 * r.taken + r["size"]) // (2 * r["size"]))}


def test_mixed_documents_follow_the_targets(spark):
    """Sources of few documents, and long ones among short: each misses its target by half a document for 512 of them at most."""
    r = random.Random(11)
    rows = [(i, " ".join(["w"] * (4000 if r.random() < 0.02 else r.randrange(1, 60))), "en", f"s{min(int(r.expovariate(0.05)), 200):03d}", 0) for i in range(3000)]
    d = spark.createDataFrame(rows, DOC)
    target, longest, got, count = {}, Counter(), Counter(), Counter(x[3] for x in rows)
    for x in mixing.mix(d).collect():
        target[x.source] = x.target
        longest[x.source] = max(longest[x.source], x["size"])
    for x in mixing.mixed_documents(d).collect():
        got[x.source] += x.text.count("w")
    assert len(target) > 60
    assert all(abs(got[s] - t) <= longest[s] / 2 * max(1, count[s] // 512) + 2 for s, t in target.items())


def test_mixed_documents(docs, rows, nothing):
    ids = [i for i, *_ in rows if i is not None]
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = nearest(mixing.mix(unique))
    out = mixing.mixed_documents(unique)
    assert out.columns == docs.columns and clashes_unchanged(out) and set(want) <= set(ids)
    assert Counter(r.doc_id for r in out.collect()) == want
    assert mixing.mix(nothing).isEmpty() and mixing.mixed_documents(nothing).isEmpty()


def test_sainte_lague_is_brute_force(spark):
    votes = [(0, 5300.0), (1, 2400.0), (2, 2400.0), (3, 0.0), (4, 11.0), (5, 999.5)]
    for seats in (0, 1, 7, 100, 1003):
        d = spark.createDataFrame([(p, v, seats) for p, v in votes], "p int, v double, s long")
        got = {r.p: r.won for r in mixing.sainte_lague(d, [], "p", "v", "s", "won").collect()}
        want = Counter({p: 0 for p, _ in votes})
        for _ in range(seats):
            want[max((v / (2 * want[p] + 1), -p) for p, v in votes)[1] * -1] += 1
        assert got == dict(want)


def test_mix_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Sharding


def test_shard(docs, rows, nothing):
    got = sharding.shard(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    places = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard(nothing).isEmpty()


def test_rebalance_evens_out_and_moves_little():
    r = random.Random(0)
    load = [r.randrange(1, 5000) for _ in range(4096)]
    old = sharding.initial_map(16)
    new = sharding.rebalance(old, load, 16)
    total = Counter()
    for s, b in zip(new, load, strict=True):
        total[s] += b
    assert max(total.values()) - min(total.values()) <= 8
    assert sum(a != b for a, b in zip(old, new, strict=True)) < 400
    grown = sharding.rebalance(new, load, 17)
    assert len(set(grown)) == 17 and sum(a != b for a, b in zip(new, grown, strict=True)) < 4096 // 8


def test_map_versions(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    sharding.store_map(spark, path, 0, sharding.initial_map(16))
    first = sharding.shard(docs, map_path=path).collect()
    version, stored = sharding.load_map(spark, path)
    assert version == 1 and all(r.map_version == 1 and stored[r.virtual_slot] == r.shard for r in first)
    assert sharding.load_map(spark, path, 0)[1] == sharding.initial_map(16)


# Search


def brute_top(rows, k=10):
    v = [(i, [int(np.floor(1024 * float(x))) for x in e]) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for a, (i, q) in enumerate(v):
        if i % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, e, strict=True)), j) for b, (j, e) in enumerate(v) if b != a and len(e) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_top_k_is_brute_force(spark, spread, monkeypatch):
    r = np.random.default_rng(1)
    centers = r.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + spread * r.normal(size=8)).astype(np.float32).tolist()) for i in range(500)]
    rows += [(600, [0.5] * 8), (601, [0.5] * 8), (602, [0.5] * 8), (700, None), (701, [None] * 8), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (None, [1.0] * 8), (800, [1.0, 2.0]), (801, [1.0, -2.0]), (900, [])]
    rows += [(100, rows[100][1])] * 3 + [(200, rows[5][1]), (1000, [3e7] * 8), (1001, [3e7, -3e7] * 4)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
    for name, value in (("DATA_BLOCK", 60), ("QUERY_BLOCK", 4), ("SEEDS", 2), ("SLICE", 2)):
        monkeypatch.setattr(cover_tree, name, value)
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in cover_tree.top_k(d).collect())
    assert got == brute_top(rows)
    assert cover_tree.top_k(d.limit(0)).isEmpty()


def test_tree_covers_and_halves():
    r = np.random.default_rng(4)
    for x in (r.normal(size=(900, 5)), r.normal(size=(700, 40)), np.zeros((300, 3)), r.normal(size=(30, 4))[r.integers(0, 30, 800)]):
        t = cover_tree.Tree(x, leaf=8)
        assert sorted(t.order.tolist()) == list(range(len(x)))
        y = x[t.order]
        for i in range(len(t.a)):
            assert np.sqrt(((y[t.a[i] : t.b[i]] - t.center[i]) ** 2).sum(1)).max() <= t.radius[i] + 1e-9
            kids = range(t.first[i], t.first[i] + t.count[i])
            if kids:
                assert t.a[kids[0]] == t.a[i] and t.b[kids[-1]] == t.b[i] and all(t.b[k] == t.a[k + 1] for k in kids[:-1])
                assert len(kids) == cover_tree.FANOUT or all(t.radius[k] <= t.radius[i] / 2 for k in kids)


def test_dual_tree_prunes(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = np.floor(r.normal(0, 1000, (50, 16))[r.integers(0, 50, 4000)] + r.normal(0, 5, (4000, 16)))
    ids = np.arange(4000)
    q = cover_tree.Index(ids[::100], ids[::100], x[::100])
    found, work = cover_tree.search(q, cover_tree.Index(ids, ids, x), 10)
    s = q.x @ x.T
    s[np.arange(40), q.ids] = -np.inf
    assert (found.scores == -np.sort(-s, 1)[:, :10]).all() and work < 0.3 * s.size
    monkeypatch.setattr(cover_tree, "DATA_BLOCK", 200)
    d = spark.createDataFrame([(i, (v / 1024).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert cover_tree.share_computed(d) < 0.3


# Pieces


@pytest.fixture(scope="module")
def model():
    pytest.importorskip("sentencepiece")
    try:
        return pieces.load()
    except FileNotFoundError:
        pytest.skip("no vocabulary files here")


def test_pieces_equal_the_library(model, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    r = random.Random(5)
    texts = [t or "" for _, t, *_ in rows] + ["  two  spaces ", "\ttab\nline", "a" * 500, "▁mark", "def f(x):\n    return x", *["".join(r.choice("abcdeinorst  .é▁") for _ in range(80)) for _ in range(50)]]
    assert [np.frombuffer(x, "<i4").tolist() for x in model.encode(texts)] == sp.encode(texts)
    assert [model.decode(np.array(x)) for x in sp.encode(texts)] == [sp.decode(x) for x in sp.encode(texts)]


def test_encode_documents(docs, rows, model, nothing):
    out = pieces.encode_documents(docs, model)
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    assert all(r.roundtrip and r.n_tokens == len(r.ids) for r in got)
    back = Counter((r.doc_id, r.text) for r in pieces.decode_documents(out, model).collect())
    assert back == Counter((i, t or "") for i, t, *_ in rows)
    assert pieces.encode_documents(nothing, model).isEmpty()


def _message(fields):
    out = b""
    for n, v in fields:
        if isinstance(v, int):
            out += bytes([n << 3, v])
        elif isinstance(v, float):
            out += bytes([n << 3 | 5]) + np.float32(v).tobytes()
        else:
            out += bytes([n << 3 | 2]) + bytes([len(v)]) + v
    return out


def test_unigram_viterbi_is_brute_force():
    vocab = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.9, "▁a": -4.2, "ba": -4.0, "bab": -5.0}
    data = _message([(1, _message([(1, b"<unk>"), (2, 0.0), (3, 2)])), *[(1, _message([(1, p.encode()), (2, s)])) for p, s in vocab.items()], (2, _message([(3, 1)])), (3, _message([(4, 0)]))])
    m = pieces.PieceModel(data)

    def best(w):
        if not w:
            return 0.0, []
        return max((best(w[:-n])[0] + vocab[w[-n:]], [*best(w[:-n])[1], w[-n:]]) for n in range(1, len(w) + 1) if w[-n:] in vocab)

    for text in ("abab", "ba bab", "aab", "bbb a"):
        want = [p for w in ("▁" + text.replace(" ", " ▁")).split(" ") for p in best(w)[1]]
        assert [m.pieces[i] for i in np.frombuffer(m.encode([text])[0], "<i4")] == want
    assert [m.pieces[i] for i in np.frombuffer(m.encode(["z"])[0], "<i4")] == ["▁", "<unk>"]


# Personal data


@pytest.fixture(scope="module")
def field():
    return pii.train()


def brute_base(t):
    """The patterns as they are written, with the checks after."""
    t, out = t or "", []
    out += [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_are_the_patterns():
    r = random.Random(6)
    odd = ["a@b.c@d.e", "@x.y", "a@b", "x.34@mail.example.com.", "1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.1", "00255.1.1.1", "4532015112830366", "4532-0151 1283-0366 12", "+1 (017) 555-7713, +", "+12", "+1 2", "a" * 3000, "1" * 3000, "é@é.com x@é.com", ""]
    for t in odd + ["".join(r.choice("ab@.+-() 0123456789%é") for _ in range(120)) for _ in range(600)]:
        assert sorted(pii.base_spans(t)) == brute_base(t), t


def test_field_on_lines_it_has_not_seen(field):
    hit = wrong = missed = 0
    for text, spans in pii._examples(200, 4242):
        base, added = pii.find(text, field)
        got, want = {(s, e) for _, s, e in base + added}, {(s, e) for _, s, e in spans}
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want - {(s, e) for _, s, e in base}), missed + len(want - got)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.93


@pytest.mark.parametrize("t", ["nothing here", "Section 9.9. and 12,345.67", "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", "2024-01-31 12:30:05", "meet at noon", "7536784127813051"])
def test_field_leaves_clean_text_alone(field, t):
    assert pii.find(t, field)[1] == []


def test_field_adds_what_patterns_miss(field):
    t = "write to jane dot doe at mail dot org or call (017) 555-7713"
    assert [t[s:e] for _, s, e in pii.find(t, field)[1]] == ["jane dot doe at mail dot org", "(017) 555-7713"]
    assert pii.redact(t, pii.find(t, field)[1]) == "write to <email> or call <phone>"


WRITTEN = [
    ("write to " + "a" * 60 + " at mail dot org now", "a" * 60 + " at mail dot org"),
    ("write to jane [dot] doe [at] mail [dot] example [dot] com", "jane [dot] doe [at] mail [dot] example [dot] com"),
    ("word " * 300 + "jane dot doe at mail dot org" + " more" * 300, "jane dot doe at mail dot org"),
    ('the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
    ("call (017) 555-7713 today", "(017) 555-7713"),
]


@pytest.mark.parametrize(("t", "span"), WRITTEN)
def test_field_finds_whole_spans(field, t, span):
    assert [t[s:e] for _, s, e in pii.find(t, field)[1]] == [span]


def test_a_long_spelled_address_is_one_span_or_none(field):
    t = "write to jane dot doe dot the dot second dot of dot the dot house dot of at mail dot org"
    assert [t[s:e] for _, s, e in pii.find(t, field)[1]] in ([t[9:]], [])


def test_decode_is_enumeration(field):
    """Of all ways to cut a short line into candidates and outside tokens the best is found."""
    def best(text, tokens):
        cand = {}
        for i, j, y in set(pii._candidates(text, tokens)):
            cand.setdefault(i, []).append((j, y, field.segment_score(text, tokens, i, j, y)))

        def go(at, before):
            if at == len(tokens):
                return 0.0, ()
            ways = [(field.follow[before, pii.OUT] + go(at + 1, pii.OUT)[0], go(at + 1, pii.OUT)[1])]
            for j, y, s in cand.get(at, ()):
                z, rest = go(j, y)
                ways.append((field.follow[before, y] + s + z, ((y, tokens[at][0], tokens[j - 1][1]), *rest)))
            return max(ways)

        return list(go(0, pii.OUT)[1])

    lines = ["a 555-123-4567 b", "x at mail dot org", "DE44 5001 0517 5407 3249 31", "1.2.3.4", "+1 (017) 555 77", "k@l m 123456789", "key: a1b2c3d4e5f6a7b8c9d0e1"]
    lines += [t[:45] for t, _ in pii._examples(25, 77)]
    for t in lines:
        tokens = pii.tokens_of(t)[:14]
        assert field.decode(t, tokens) == best(t, tokens), t


def test_regions_lose_nothing(field):
    """What is found around anchors is what a decoding of each whole line finds."""
    for t, _ in pii._examples(60, 99):
        for line in (t, "so it was " * 40 + t + " and so on" * 40):
            if not pii.base_spans(line):
                assert pii.find(line, field)[1] == field.decode(line, pii.tokens_of(line)), line


def test_pii_digest(spark, docs, rows, field, nothing):
    found = pii.personal_data(docs, field)
    got = {r.doc_id: r for r in pii.digest(found).collect() if r.doc_id is not None}
    for i, t, *_ in rows:
        if i is not None:
            spans = brute_base(t)
            assert got[i].base_sha256 == hashlib.sha256(pii.written(spans).encode()).hexdigest() and got[i].n_email == sum(k == 0 for k, *_ in spans)
    one = spark.createDataFrame([(1, "a@b.co 1.1.1.1 +1 (017) 555-7713 4532015112830366 b@c.de", None, None, 0)], DOC)
    r = pii.digest(pii.personal_data(one, field)).collect()[0]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added, r.n_spans) == (2, 1, 0, 0, 2, 5)  # the patterns run phone and card together
    assert r.spans.startswith("email:0:6,email:")
    assert pii.digest(pii.personal_data(nothing, field)).isEmpty()


# Toxicity


@pytest.fixture(scope="module")
def toxic(spark):
    """Half of the rows with two of ten stems, inflected, are toxic; noise words elsewhere."""
    r = random.Random(7)
    stems = ["gruft", "blarg", "zonkle", "mofert"]
    rows, labels = [], []
    for i in range(900):
        bad = r.random() < 0.3
        w = [r.choice(WORDS) + r.choice(WORDS) for _ in range(40)]
        if bad:
            for _ in range(3):
                w[r.randrange(40)] = r.choice(stems) + r.choice(["", "s", "ed", "ische", "ario"])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None, None, None, None), (5001, "", None, None, None)]
    labels += [(0, 1, labels[0][2]), (5002, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(toxic):
    docs, labels = toxic
    m = toxicity.fit(toxicity.training_rows(docs, labels))
    got = toxicity.toxicity(docs, m).join(labels.dropDuplicates(["doc_id"]), "doc_id").filter("held_out").collect()
    assert len(got) > 150
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    left = {r.doc_id for r in toxicity.drop_toxic(docs, m).collect()}
    assert left == {r.doc_id for r in toxicity.toxicity(docs, m).filter("predicted = 0").collect()} and {5000, 5001} <= left


def test_training_never_sees_held_out_rows(toxic):
    docs, labels = toxic
    flipped = labels.withColumn("toxic", F.when(common.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(toxicity.training_rows(docs, x)) for x in (labels, flipped))
    assert (a.terms == b.terms).all() and a.w0 == b.w0 and (a.w == b.w).all()


def test_pair_weights_are_learned():
    x = np.array([[1, 0], [0, 1], [1, 1], [0, 0]] * 100, np.uint8)
    y = (x.sum(1) == 2).astype(np.float32)
    m = toxicity._descend(toxicity.Machine(np.zeros(0, np.int64), 0.0, np.zeros(2), np.zeros((2, 8))), x, y, 200, 0)
    assert (m.v[0] * m.v[1]).sum() > 0.5


def test_pairs_without_a_clear_term_are_learned(spark):
    """Toxic only by which group stands with which word: each term is as frequent in both classes."""
    r, rows = random.Random(3), []
    for i in range(1200):
        g, w = i % 2, i // 2 % 2
        words = [r.choice(WORDS) for _ in range(12)] + [("alphans", "betwins")[g], ("gruftig", "mofertal")[w]]
        r.shuffle(words)
        rows.append((" ".join([*words, f"n{i}"]), int(g == w)))
    m = toxicity.fit(spark.createDataFrame(rows[:900], "text string, y int"))
    assert sum((m.score(t) >= 0.5) == bool(y) for t, y in rows[900:]) > 285


def test_terms_beyond_the_first_are_learned(spark):
    """The machine has every term of three rows, however few the descent starts from."""
    rows = [(f"{WORDS[i % 7]} {('gruftig', 'mofertal', 'zonklera', 'blargend')[i % 4]} n{i}", int(i % 4 < 2)) for i in range(800)]
    m = toxicity.fit(spark.createDataFrame(rows, "text string, y int"), terms=1)
    assert all((m.score(t) >= 0.5) == bool(y) for t, y in rows)


def test_score_is_the_double_sum(toxic, docs, rows):
    """A score against the weights and all pairs of factors, one by one; on clashing columns and very long texts too."""
    own, labels = toxic
    m = toxicity.fit(toxicity.training_rows(own, labels))

    place = {x: k for k, x in enumerate(m.terms.tolist())}

    def brute(t):
        terms = sorted({place[x] for w in set(re.findall(r"\w+", (t or "").lower())) for x in toxicity.term_ids(w) if x in place})
        z = m.w0 + sum(float(m.w[i]) for i in terms) + sum(float(m.v[i] @ m.v[j]) for a, i in enumerate(terms) for j in terms[a + 1 :])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    texts = {i: t for i, t, *_ in rows if i is not None}
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, m).collect() if r.doc_id is not None}
    assert set(got) == set(texts) and all(got[i] == pytest.approx(brute(t), abs=1e-4) for i, t in texts.items())
    left = toxicity.drop_toxic(docs, m)
    assert left.columns == docs.columns and clashes_unchanged(left)


def test_pairs_are_learned_from_the_tables(spark):
    """Labels that depend on a pair of words alone, through training_rows, fit and toxicity, on held-out rows."""
    r, rows, labels = random.Random(13), [], []
    for i in range(4000):
        g, w = i % 2, i // 2 % 2
        words = [r.choice(WORDS) for _ in range(12)] + [("alphans", "betwins")[g], ("gruftig", "mofertal")[w]]
        r.shuffle(words)
        rows.append((i, " ".join([*words, f"n{i}"]), "en", "s", 0))
        labels.append((i, 1, int(g == w)))
    docs, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, toxicity.fit(toxicity.training_rows(docs, lab))).filter("held_out").collect()
    assert len(got) > 800 and sum((x.score >= 0.5) == bool(labels[x.doc_id][2]) for x in got) / len(got) > 0.9


def test_toxicity_without_labels(toxic, nothing):
    docs, labels = toxic
    m = toxicity.fit(toxicity.training_rows(docs, labels.limit(0)))
    assert toxicity.toxicity(docs.limit(3), m).count() == 3 and toxicity.toxicity(nothing, m).isEmpty()


# Quality


def test_quality(spark, nothing):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        host, bad = f"h{i % 6}", r.random() < (0.9 if i % 6 == 0 else 0.05)
        t = prose(r, 60)
        rows.append((i, " | ".join(t.upper().split()) if bad else t, "ab"[i % 2], host, 0))
        labels.append((i, int(not bad), 0))
    rows += [(9000, None, None, None, None), (9001, "", "a", "h0", 0)]
    docs, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    c = quality.train(docs, lab)
    out = quality.quality(docs, c)
    got = {x.doc_id: x for x in out.collect()}
    assert len(got) == len(rows)
    held = [(got[i].keep, bool(q)) for i, q, _ in labels if got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert got[6].host_posterior < got[1].host_posterior
    assert quality.quality(nothing, c).isEmpty()


def test_quality_is_brute_force(docs, rows):
    """Posteriors and scores against sums over the other rows of each site, one by one."""
    r = np.random.default_rng(5)
    c = quality.fit_classifier(r.random((60, len(quality.FIGURES))), (r.random(60) < 0.5).astype(float))
    got = quality.quality(docs, c).collect()
    p = c.probability(np.array([quality.figures(t) for _, t, *_ in rows]))
    site = [(s, lang) for _, _, lang, s, _ in rows]
    m = p.mean()

    def strength(keys, priors):
        spread = noise = whole = n = 0.0
        for k, prior in priors.items():
            q = np.array([x for x, o in zip(p, keys, strict=True) if o == k])
            if len(q) > 1:
                spread += len(q) * (q.mean() - prior) ** 2
                noise += max(0.0, (q * q).mean() - q.mean() ** 2)
                whole += len(q) * prior * (1 - prior)
                n += len(q)
        return float(np.clip(whole / n / max((spread - noise) / n, 1e-9) - 1, 1, 1e6))

    hosts = [h for h, _ in site]
    k1 = strength(hosts, {h: m for h in hosts})
    mean = lambda x, k, prior: (sum(x) + k * prior) / (len(x) + k)
    host = {h: mean([x for x, o in zip(p, hosts, strict=True) if o == h], k1, m) for h in hosts}
    k2 = strength(site, {s: host[s[0]] for s in site})
    want = []
    for a, (i, *_) in enumerate(rows):
        h = mean([x for b, x in enumerate(p) if b != a and hosts[b] == hosts[a]], k1, m)
        v = mean([x for b, x in enumerate(p) if b != a and site[b] == site[a]], k2, h)
        z = np.log(p[a] / (1 - p[a])) + np.log(v / (1 - v)) - np.log(m / (1 - m))
        want.append((i, p[a], h, v, 1 / (1 + np.exp(-z))))
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    have = sorted(((x.doc_id, x.evidence, x.host_posterior, x.path_posterior, x.score) for x in got), key=key)
    for x, y in zip(have, sorted(want, key=key), strict=True):
        assert x[0] == y[0] and x[1:] == pytest.approx(y[1:], rel=1e-6)


def test_sparse_sites_shrink_to_the_prior(spark):
    rows = [(i, prose(random.Random(i), 20), "p", "big" if i < 200 else f"tiny{i}", 0) for i in range(203)]
    c = quality.fit_classifier(np.zeros((0, len(quality.FIGURES))), np.zeros(0))
    got = quality.quality(spark.createDataFrame(rows, DOC), c).collect()
    assert len({round(x.path_posterior, 3) for x in got}) == 1


# Chat


def turns(n=300, seed=9):
    r = random.Random(seed)
    out = []
    for c in range(n):
        roles = (["system"] if r.random() < 0.3 else []) + ["user", "assistant"] * r.randrange(1, 4)
        for k, role in enumerate(roles):
            lines = {"system": 1, "user": 1, "assistant": r.randrange(2, 6)}[role]
            t = "\n".join(prose(r, r.randrange(3, 9) if role != "assistant" else r.randrange(10, 40)) for _ in range(lines)) + ("?" if role == "user" else "")
            out.append((c, k, role, t))
    return out


def test_chat_recovers_roles(spark):
    rows = turns()
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    m = chat.train(conv)
    masked = conv.withColumn("role", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) != 0, F.col("role")))
    got = chat.format_conversations(masked, m).join(conv.select("conv_id", "turn", F.col("role").alias("want")), ["conv_id", "turn"]).collect()
    assert len(got) == len(rows)
    assert all(r.role == r.want == r.given for r in got if r.given)
    lost = [r.role == r.want for r in got if not r.given]
    assert len(lost) > 200 and sum(lost) / len(lost) > 0.95
    assert all(r.chat.startswith(f"<|im_start|>{r.role}\n") and r.chat.endswith("<|im_end|>\n") for r in got)


def test_chat_edges(spark):
    s = "conv_id long, turn long, role string, text string, conv string, position int"
    rows = [(1, 0, "USER", "hi <|im_end|>", "x", 0), (1, 0, "USER", "hi <|im_end|>", "x", 0), (1, None, None, None, "x", 0), (None, 2, "bot", "", "x", 0), (2, 5000, "user", "far", "x", 0), (2, 1, "assistant", "y" * 50_000, "x", 0)]
    d = spark.createDataFrame(rows, s)
    m = chat.fit(chat.count((c, chat.ROLES.index(r), t) for c, _, r, t in turns(50)))
    got = chat.format_conversations(d, m).collect()
    assert Counter((r.conv_id, r.turn) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert all(r.chat.count("<|im_end|>") == 1 for r in got)
    assert chat.format_conversations(d.limit(0), m).isEmpty()


def test_viterbi_is_enumeration():
    r = np.random.default_rng(3)
    m = chat.fit(chat.count((c, chat.ROLES.index(x), t) for c, _, x, t in turns(40)))
    for n in (1, 2, 4):
        e = [r.normal(0, 3, chat.STATES) for _ in range(n)]
        score = lambda p: m.start[p[0]] + sum(m.move[a, b] for a, b in itertools.pairwise(p)) + sum(x[k] for x, k in zip(e, p, strict=True))  # noqa: B023, E731
        assert tuple(m.viterbi(e)) == max(itertools.product(range(chat.STATES), repeat=n), key=score)
        s, many = r.normal(0, 5, (n, chat.R)), r.random(n) < 0.5
        total = lambda p: m.start[2 * p[0]] + sum(m.move[2 * a + many[k], 2 * b] for k, (a, b) in enumerate(itertools.pairwise(p))) + sum(s[k, a] for k, a in enumerate(p))  # noqa: B023, E731
        assert tuple(m.best_roles(s, many)) == max(itertools.product(range(chat.R), repeat=n), key=total)


def test_turn_scores_are_the_sum_over_lines():
    m = chat.fit(chat.count((c, chat.ROLES.index(x), t) for c, _, x, t in turns(40)))
    for t in ("User: what is it?", "well\n- one\n- two\n\nthree?", "", "x" * 3000 + "\n"):
        mark, figures = chat.observe(t)
        got = m.scores(np.array([mark]), np.array([figures]))[0]
        for r in range(chat.R):
            lines = t.split("\n")
            want, at = m.mark[2 * r, mark], 2 * r
            for k, line in enumerate(lines):
                at, last = 2 * r + (k > 0), at
                want += sum(f[at, c] for f, c in zip(m.feats, chat.line_features(line if k else chat.marker(line)[1], not k), strict=True))
                want += (m.move[last, at] + m.mark[at, -1]) if k else 0
            want += sum(f[r, c] for f, c in zip(m.shapes, figures[-3:-1], strict=True))
            assert got[r] == pytest.approx(want)


def test_a_long_conversation_is_decoded_as_one(spark):
    """5,000 turns over many tasks, roles mostly unknown: as if decoded in one piece, wherever the turn numbers lie."""
    r, rows = random.Random(5), []
    for k in range(5000):
        rows.append((7, k, ("user", "assistant")[k % 2] if r.random() < 0.02 else None, prose(r, r.randrange(1, 12))))
    rows += [(8, None, None, "User: b"), (8, 3, None, "a"), (9, 1, "system", "s"), (8, None, "user", "User: b")]
    m = chat.fit(chat.count((c, chat.ROLES.index(x), t) for c, _, x, t in turns(40)))
    seen = [chat.observe(t) for _, _, _, t in rows[:5000]]
    marks = np.array([mark if x is None else chat.ROLES.index(x) for (mark, _), (_, _, x, _) in zip(seen, rows, strict=False)])
    figures = np.array([f for _, f in seen])
    scores, many = m.scores(marks, figures), figures[:, -1] > 1
    total = lambda p: m.start[2 * p[0]] + sum(m.move[2 * a + many[k], 2 * b] for k, (a, b) in enumerate(itertools.pairwise(p))) + sum(scores[k, a] for k, a in enumerate(p))
    want = total(m.best_roles(scores, many))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for scale in (1, 2000):
            d = spark.createDataFrame([(c, t if t is None else t * scale, x, s) for c, t, x, s in rows], "conv_id long, turn long, role string, text string").repartition(5)
            got = {(x.conv_id, x.position): x for x in chat.format_conversations(d, m).collect()}
            assert len(got) == len(rows) and total([chat.ROLES.index(got[7, k].role) for k in range(5000)]) == pytest.approx(want, abs=1e-6)
            assert [got[7, k].turn for k in range(5000)] == [k * scale for k in range(5000)]
            assert got[8, 0].turn == 3 * scale and got[8, 1].turn is got[8, 2].turn is None
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_counts_over_parts_are_the_counts(spark):
    rows = turns(60)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    want = chat.count((c, chat.ROLES.index(x), t) for c, _, x, t in rows if zlib.crc32(str(c).encode()) % 4 != 2)
    assert (chat.Observed(d, "conv_id", "turn", "role", "text").count().flat == want.flat).all()


def test_query_recovers_roles_it_does_not_see(spark, sf_dir):
    from reconloom.llm import registry

    got = registry.QUERIES["op10_chat_format"](spark, sf_dir).collect()
    own = common.read(spark, sf_dir, "conversations")
    assert len(got) == own.count()
    right = [r.role == r.given for r in got if zlib.crc32(str(r.conv_id).encode()) % 4 == 2 and r.given]
    assert sum(right) / len(right) > 0.93


def test_transcripts(spark):
    m = chat.fit(chat.count((c, chat.ROLES.index(r), t) for c, _, r, t in turns(200)))
    raw = "System: be good\nUser: what is it?\n### Assistant: it is\n- one\n- two\n\nHuman: thanks"
    assert chat.parse(raw, m) == [("system", "be good"), ("user", "what is it?"), ("assistant", "it is\n- one\n- two"), ("user", "thanks")]
    d = spark.createDataFrame([(1, raw), (2, None), (3, "")], "id long, raw string")
    assert chat.parse_transcripts(d, m, "id", "raw").count() == 4


# The pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = common.read(spark, sf_dir, "documents")
    names = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for name, stage in p.STAGES:
        out = common.table(stage(spark, docs, sf_dir), "test-" + name.replace(" ", "-"))
        if name != p.STAGES[-1][0]:
            assert out.columns == names
        kept.append(out)
        docs = out
    clean, once, near, mixed, coded = kept
    labels = {r.doc_id: r.toxic for r in common.read(spark, sf_dir, "labels").collect()}
    left = {r.doc_id for r in clean.collect()}
    good = [i for i, t in labels.items() if t == 0]
    assert sum(i in left for i in good) >= 0.97 * len(good)
    groups = defaultdict(list)
    for i in left:
        groups[ascii_lower(before[i])].append(i)
    assert {r.doc_id for r in once.collect()} == {max(g) for g in groups.values()}
    rows = [tuple(r) for r in once.collect()]
    lead = {c for _, c, _ in brute_join([x for x in rows if ngram_join.shingles(x[1]).size])} | {i for i, t, *_ in rows if not ngram_join.shingles(t).size}
    assert {r.doc_id for r in near.collect()} == lead
    want = nearest(mixing.mix(near))
    assert Counter(r.doc_id for r in mixed.collect()) == want
    assert Counter(r.doc_id for r in coded.collect()) == want and coded.filter("not roundtrip").isEmpty()


def test_registered_queries():
    import __spark_entry__ as e

    found = e.queries()
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 11)] == [1] * 10 and "pipeline" in found


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op4_top_k", "op5_mixing"])
def test_query_equals_sql(name, spark, sf_dir, duck):
    from reconloom.llm import registry
    from tests.helpers import duck_rows, spark_rows

    assert spark_rows(registry.QUERIES[name](spark, sf_dir)) == duck_rows(duck, registry.ORACLES[name])
