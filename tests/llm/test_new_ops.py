"""Centroids, token counts and fill-in-middle against brute force, the library and SQL."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconloom.llm import centroids, fill_middle, oracles, registry, token_counts
from tests.helpers import duck_rows, spark_rows
from tests.llm.test_ops import CLASHES, DOC, corpus

VEC = "vec_id long, embedding array<double>, label int"


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit(k) for k, c in enumerate(CLASHES)}
    more = [(900, "ends in <P> a mark", "en", "s", 0), (901, "\t\n ", "en", "s", 0), (902, "a b\x1cc É É", "en", "s", 0), (903, "<|endoftext|>x<|startoftext|", "en", "s", 0)]
    return spark.createDataFrame(corpus() + more, DOC).withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


# Fill-in-middle


def by_hand(i, t):
    """The contract, with the standard library's patterns and no offsets."""
    t = t or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 50:
        return len(units), "plain", None, None, t
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs):
    rows = docs.select("doc_id", "text").collect()
    got = fill_middle.restore(fill_middle.fill_in_middle(docs)).collect()
    key = lambda x: repr(x)
    want = [(r.doc_id, *by_hand(r.doc_id, r.text), r.text or "") for r in rows]
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest() for r in got)


def test_fill_in_middle_rates_and_edges(spark, docs, nothing):
    assert fill_middle.digest(fill_middle.fill_in_middle(nothing)).count() == 0
    every = fill_middle.fill_in_middle(docs, rate=100, spm_rate=0).collect()
    assert {r.form for r in every} == {"plain", "psm"}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert all(r.form == "psm" or not texts[r.doc_id] or "<P>" in texts[r.doc_id] for r in every if r.doc_id is not None)
    back = fill_middle.restore(spark.createDataFrame([(1, None, "plain")], "restored_id int, output string, form string")).collect()[0]
    assert back.restored is None and back.restored_sha256 is None


@pytest.mark.parametrize("text", ["a <", "<<P", "x<S <S", "<", "S>", "a<P", "<M", "M> <"])
def test_marks_cut_in_two_are_restored(text):
    for i in range(200):
        _, form, _, _, out = fill_middle.transform(i, text, 1, 100, 50)
        assert fill_middle.rebuilt(form, out) == text


def test_fill_in_middle_equals_sql(spark, sf_dir, duck):
    assert spark_rows(registry.op13_fill_in_middle(spark, sf_dir)) == duck_rows(duck, oracles.FIM_SQL)


# Centroids


def lloyd(rows, k=8, rounds=10, size=64):
    """(id, cluster, distance, cluster's sum, whole sum, digest) by Python's integers."""
    kept = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept))[:k]
    c = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, z, strict=True)), j) for j, z in enumerate(c))

    for _ in range(rounds if c else 0):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    sums = [sum(d for _, o, d in out if o == j) for j in range(len(c))]
    return [(i, j, d, sums[j], sum(sums), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out]


def vectors(seed, n, scale=1.0):
    r = np.random.default_rng(seed)
    around = r.normal(size=(11, 64))
    out = [(i, [float(x) for x in scale * (around[i % 11] + 0.3 * r.normal(size=64))], 0) for i in range(n)]
    out += [out[0], out[0], (None, out[1][1], 0), (5000, None, 0), (5001, [1.0] * 63, 0), (5002, [1.0] * 63 + [None], 0), (5003, [float("nan")] * 64, 0), (5004, [float("inf")] + [0.0] * 63, 0), (5005, [], 0)]
    return out + [(6000 + i, [0.0] * 64, 0) for i in range(n // 2)]  # ties: a third of all rows at one place


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e8])  # float64, 64-bit integers, Python's integers
def test_clusters_equal_brute_force(spark, scale):
    rows = vectors(3, 90, scale)
    df = spark.createDataFrame(rows, VEC).withColumn("id", F.lit("x")).withColumn("x", F.lit(1)).repartition(3)
    got = [tuple(r) for r in centroids.cluster(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]
    want = [tuple(x if not isinstance(x, int) or x < 2**63 else None for x in r) for r in lloyd(rows)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_kinds_of_arithmetic_are_those_meant():
    x = np.floor(np.array([v for _, v, _ in vectors(3, 20)][:20]) * 1024)
    assert [centroids.assign(x * s, [[0] * 64])[2].dtype.kind for s in (1, 1e4, 1e8)] == ["f", "i", "O"]


def test_few_vectors_and_none(spark):
    rows = vectors(1, 3)[:3]
    got = centroids.cluster(spark.createDataFrame(rows, VEC)).collect()
    assert len({r.cluster for r in got}) == 3 and all(r.distance == 0 and r.inertia == 0 for r in got)
    assert centroids.cluster(spark.createDataFrame([], VEC)).count() == 0


def test_clusters_equal_sql(spark, sf_dir, duck):
    assert spark_rows(registry.op11_centroids(spark, sf_dir)) == duck_rows(duck, oracles.cluster_sql())


# Token counts


@pytest.fixture(scope="module")
def model():
    return token_counts.load()


@pytest.fixture(scope="module")
def tokens():
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(token_counts.VOCABULARY)
    return lambda t: len(lib.encode(t, add_special_tokens=False).ids)


#: What strings of the tests are put together from: letters that compose, change their length, end words, contractions, specials.
PARTS = "a b e the ing ' 're 's 'll 'v R E ! !! 1 22 é É é ́ ̣ Σ İ ß 東京 🎉 <|endoftext|> <|endoftext <|startoftext|> ᄀ ᅡ ᆨ Ɤ internationalization zzzz qx".split() + [" ", "\n", " ", "\x1c", "​"]


def test_counts_of_all_prefixes_equal_the_library(model, tokens):
    r = random.Random(5)
    for k in range(500):
        text = "".join(r.choice(PARTS) for _ in range(r.randrange(0, 14)))
        if k % 20 == 0:
            text = "é" * r.randrange(60, 90) + text + "É" * 80 + text
        want = [tokens(text[:i]) for i in range(len(text) + 1)]
        assert model.prefixes(text).tolist() == want, text
        assert model.count(text) == want[-1], text
        for limit in (0, 1, want[-1] // 2, want[-1]):
            assert model.longest_within(text, limit) == max(i for i, n in enumerate(want) if n <= limit), (text, limit)


def test_every_byte_and_character_class(model, tokens):
    for i in [*range(1, 0x3100), *range(0xAC00, 0xAC40), *range(0x1F600, 0x1F610)]:
        text = f"a{chr(i)}b 1{chr(i)}2"
        assert model.count(text) == tokens(text), hex(i)


def test_token_counts(docs, nothing, model, tokens):
    rows = docs.select("doc_id", "text").collect()
    got = token_counts.token_counts(docs, model, limit=20).collect()
    want = [(r.doc_id, len((r.text or "").encode()), tokens(r.text or ""), tokens(r.text or "") > 20) for r in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=repr) == sorted(want, key=repr)
    texts = {r.doc_id: r.text for r in rows}
    for r in got:
        t = texts[r.doc_id] or ""
        assert tokens(t[: r.cut]) <= 20 and (r.cut == len(t) or tokens(t[: r.cut + 1]) > 20)
    assert token_counts.token_counts(nothing, model).count() == 0


def test_stored_counts_answer_without_texts(spark, docs, nothing, model, tokens, monkeypatch):
    rows = [r for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    texts = {r.doc_id: r.text or "" for r in rows}
    stored = token_counts.prefix_counts(docs.filter("doc_id is not null"), model).cache()
    assert stored.selectExpr("max(size(counts))").collect()[0][0] == token_counts.PIECE  # the long text has several pieces
    for limit in (0, 7, 3000):
        for r in token_counts.longest_prefixes(stored, limit).collect():
            t = texts[r.doc_id]
            assert tokens(t[: r.chars]) <= limit and (r.chars == len(t) or tokens(t[: r.chars + 1]) > limit)
    asked = [(i, n) for i, t in texts.items() for n in {0, 1, len(t) // 2, len(t), len(t) + 1}]
    got = token_counts.tokens_at(stored, spark.createDataFrame(asked, "doc_id long, chars long").withColumn("first", F.lit(1))).collect()
    assert len(got) == len(asked)
    assert all(r.n_tokens == (tokens(texts[r.doc_id][: r.chars]) if r.chars <= len(texts[r.doc_id]) else None) for r in got)
    assert token_counts.prefix_counts(nothing, model).count() == 0
    assert isinstance(stored.schema["counts"].dataType, T.ArrayType)


def test_tokens_of_whole_tables(spark, sf_dir, tokens):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = registry.op12_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts) and all(r.n_tokens == tokens(texts[r.doc_id]) for r in got)


# Faults of earlier operators


def test_rows_repeated_whole_are_spread(spark):
    """Half of all rows are one row: shards stay even in bytes, slots without gaps."""
    from reconloom.llm import sharding

    rows = [(7, "the same text", "en", "s", 0)] * 6000 + [(i, "t" * (i % 13), "en", "s", 0) for i in range(100, 3100)] + [(None, "no id", "en", "s", 0)] * 3000
    got = sharding.shard(spark.createDataFrame(rows, DOC).repartition(5)).collect()
    assert len(got) == len(rows)
    sizes, places = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 0.01 * max(sizes.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(sum(1 for r in got if r.virtual_slot == s) for s in {r.virtual_slot for r in got}) < 30


def test_ties_of_turns_do_not_tell_roles(spark):
    """With all turn numbers equal, places and recovered roles are the same whether the table names roles or not."""
    from reconloom.llm import chat

    r = random.Random(2)
    rows = [(c, 1, ["user", "assistant"][k % 2], f"{r.choice(['what is', 'here is', 'yes', 'no'])} {r.randrange(40)}?" if k % 2 == 0 else "a\n" * r.randrange(1, 4)) for c in range(40) for k in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.train(df)
    both = [d.select("conv_id", "position", "role", "chat").collect() for d in (chat.format_conversations(x, model, trust=False) for x in (df, df.withColumn("role", F.lit(None).cast("string"))))]
    assert sorted(both[0]) == sorted(both[1])


def test_penalty_comes_from_training_rows_alone(spark, monkeypatch):
    """Labels of held-out rows change nothing: not the penalty, not the machine."""
    import zlib

    from reconloom.llm import toxicity

    r = random.Random(4)
    words = ["apple", "bread", "cloud", "delta", "engine", "forest", "grass", "house", "iron", "juice", "mud", "idiot", "fool"]
    docs = [(i, " ".join(r.choice(words) for _ in range(12)), "en", "s", 0) for i in range(400)]
    label = lambda flip: [(i, 0, int("idiot" in t and "fool" in t) ^ (flip and zlib.crc32(str(i).encode()) % 4 == 2)) for i, t, *_ in docs]
    d = spark.createDataFrame(docs, DOC)
    chosen = []
    real = toxicity._go_on
    monkeypatch.setattr(toxicity, "_go_on", lambda m, rows, y, seed, penalty=2e-2, *a, **k: chosen.append(penalty) or real(m, rows, y, seed, penalty, *a, **k))
    scores = [sorted((x.doc_id, x.score) for x in toxicity.toxicity(d, toxicity.fit(toxicity.training_rows(d, spark.createDataFrame(label(f), "doc_id long, quality int, toxic int")))).collect()) for f in (False, True)]
    assert scores[0] == scores[1] and len(set(chosen)) == 1 and chosen[0] in toxicity.PENALTIES


def test_outlines_are_met_in_tiles(spark, monkeypatch):
    """Many tiles of outlines give what one gives, and brute force."""
    from reconloom.llm import cover_tree

    g = np.random.default_rng(8)
    x = g.normal(size=(900, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(cover_tree, "DATA_BLOCK", 20)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 2)
    monkeypatch.setattr(cover_tree, "OUTLINES", 7)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in cover_tree.top_k(df, k=5).collect()}
    w = np.floor(1024 * x)
    for q in range(0, 900, 100):
        s = w @ w[q]
        order = sorted((-int(s[i]), i) for i in range(900) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -v) for v, i in order]


def test_entry_without_a_library(monkeypatch):
    """A library that the subpackage needs is missing: the other queries are there."""
    import builtins
    import sys

    import __spark_entry__ as e

    real = builtins.__import__

    def broken(name, *a, **k):
        if name == "xxhash":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m.startswith("reconloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", broken)
    found = e.queries()
    assert "score_overall" in found and "pipeline" not in found


def test_spread_keeps_rows(spark):
    from reconloom.llm.common import spread

    one = spark.range(100).coalesce(1).withColumn("text", F.lit("a"))
    dealt = spread(one)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, one.collect()))
    many = spark.range(0, 100, 1, 50)
    assert spread(many) is many and spread(one.limit(0)).isEmpty()
