import random
from collections import Counter

import numpy as np
import pytest

from ridgeline.llm import collocations, oracles
from ridgeline.llm import words as W
from tests.llm.fixtures import documents, empty, frame, nulls
from tests.oracle import connect, same


def texts(seed=0, n=1500):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["été", "中文", "x" * 200, "a-b", " "]
    fixed = [["New", "York", "city"], ["in", "spite", "of", "the"], ["a", "a", "a", "a", "a", "a"], ["one", "two", "three", "four", "five", "six"]]
    out = []
    for i in range(n):
        w = []
        while len(w) < r.randint(3, 80):
            w += r.choice(fixed) if r.random() < 0.5 else [r.choice(vocab[: r.choice((3, 35))])]
        out.append(("".join(x + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "?! "]) for x in w), r.choice(["en", "en", "fr", None, "und"])))
    return out + [(None, "en"), ("", None), (" .. \n", "de"), ("one", "de")]


def rows_of(df):
    return [tuple(r) for r in df.orderBy("lang", "rank").collect()]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, small, monkeypatch):
    if small:  # many slices, shards that give away early, many ranges; the workers read these from the closure's module
        monkeypatch.setattr(collocations, "RANGE", 500)
    data = texts()
    df = frame(spark, [(i, t, lang, "s", 0, 1, 1, 1, 1, 1, 1, "x") for i, (t, lang) in enumerate(data)])
    want = sorted(collocations.brute(data, least=20, most=50))
    assert len(want) > 80 and {w[0] for w in want} == {"en", "fr", "und"} and max(len(w[2].split(" ")) for w in want) == 5
    assert rows_of(collocations.collocations(df, least=20, most=50)) == want


def test_awkward_documents_nulls_and_empty(spark):
    data = documents()
    want = sorted(collocations.brute([(r[1], r[2]) for r in data], least=10))
    assert want
    assert rows_of(collocations.collocations(frame(spark, data), least=10)) == want
    assert collocations.collocations(nulls(spark)).collect() == []
    assert collocations.collocations(empty(spark)).collect() == []


def test_slices_of_long_texts_hold_every_phrase(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 300)
    import pyarrow as pa

    data = texts(2, 40) + [("alpha beta. " * 300, "en"), ("no end here " * 200, "en")]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for t, _ in data], pa.string()), "lang": pa.array([x for _, x in data], pa.string())})
    got: Counter = Counter()
    for s in (collocations.Stream(*x) for x in collocations.stretches([batch])):
        w = s.strings(np.arange(len(s.word))).to_pylist()
        got.update((s.names[s.lang[i]], w[i], w[i + 1]) for i in range(len(w) - 1) if s.piece[i] == s.piece[i + 1])
    want: Counter = Counter()
    import re

    for t, lang in data:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")):
            w = re.findall(r"[^ \t]+", piece)
            want.update(("und" if lang is None else lang, a, b) for a, b in zip(w, w[1:]))
    assert got == want


def test_runs_come_back():
    r = np.random.default_rng(1)
    parent, word, n = collocations.tally(r.integers(0, 50, 5000).astype(W.U) << W.U(50), r.integers(0, 2**63, 5000).astype(W.U) // W.U(2**57), np.ones(5000, np.int64))
    assert n.sum() == 5000 and len(n) < 5000
    for got, want in zip(collocations.parse(collocations.serialise(parent, word, n)), (parent, word, n)):
        assert (got == want).all()


def test_filter_never_closes_an_open_node(spark):
    keys = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20_000)
    f = collocations.filter_of(spark.createDataFrame([(int(k),) for k in keys[:10_000]], "key long"))
    assert f(keys[:10_000].view(W.U)).all() and f(keys[10_000:].view(W.U)).mean() < 0.05


def test_sql(spark, tiny):
    same(collocations.query(spark, tiny), connect(tiny), oracles.SQL["op11_collocations"])
