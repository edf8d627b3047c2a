"""What Python workers hold while they work and when a partition is over."""

from __future__ import annotations

import pickle
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa

from reconloom.llm import common, pieces, toxicity


def test_pairs_of_pieces_are_packed_between_partitions():
    m = pieces.load()
    rng = random.Random(0)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40)) for _ in range(200)]
    worker = pickle.loads(pickle.dumps(m))  # shares its state with the worker's model
    first = worker.encode(texts)
    known = dict(worker._fits)
    assert len(known) > 1000
    worker.forget()
    for held in (worker, pickle.loads(pickle.dumps(m))):
        assert not held._fits and not held._words
    worker.forget()
    assert worker.encode(texts[:1]) == first[:1] and worker._fits == known  # nothing is merged anew
    assert worker.encode(texts) == first


def test_terms_are_counted_in_little_memory(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(f"{rng.randrange(1 << 40):010x}" for _ in range(120)) for _ in range(600)]
    y = [i % 3 == 0 for i in range(len(texts))]
    pdf = pd.DataFrame({"text": texts, "y": np.array(y, int)})
    want = {True: Counter(), False: Counter()}
    for t, k in zip(texts, y, strict=True):
        want[k].update(set().union(*map(toxicity.term_ids, toxicity.words_of(t))))
    monkeypatch.setattr(toxicity, "HELD", 20_000, raising=False)
    monkeypatch.setattr(toxicity, "term_ids", lambda w, f=toxicity.term_ids: f(w))
    tracemalloc.start()
    got: dict = {}
    for out in toxicity._counts(iter([pdf.iloc[:300], pdf.iloc[300:]])):
        for t, pos, neg in out.itertuples(index=False):
            a = got.setdefault(t, [0, 0])
            a[0] += pos
            a[1] += neg
    tracemalloc.stop()
    assert got == {t: [want[True][t], want[False][t]] for t in want[True] | want[False]}
    # The table of places of all hashes is made where texts are read, and goes with the remembered words.
    m = pickle.loads(pickle.dumps(toxicity.Machine(np.arange(5), 0.0, np.zeros(5), np.zeros((5, 2)))))
    assert "place" not in m.__dict__
    before = m.score("any words")
    m.forget()
    assert "place" not in m.__dict__ and m.score("any words") == before


def test_counting_stays_small():
    rng = random.Random(2)
    texts = [" ".join(f"{rng.randrange(1 << 40):010x}" for _ in range(400)) for _ in range(250)]
    pdf = pd.DataFrame({"text": texts * 4, "y": 0})
    tracemalloc.start()
    n = sum(len(out) for out in toxicity._counts(iter([pdf])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 100_000 and peak < 75e6  # 87 MB with dicts of counts and sets of terms


def test_memory_is_given_back_when_a_partition_is_over(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "_trim", lambda: calls.append(1))
    assert list(common.tidy(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4] and calls == [1]
    batch = pa.record_batch({"x": [1, 2, 3]})
    assert sum(b.num_rows for b in common.slices(iter([batch]), 2)) == 3 and calls == [1, 1]
