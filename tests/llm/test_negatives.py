import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import negatives, oracles
from ridgeline.llm.negatives import Bounds, Chunk, Tree, augmented, distances
from tests.oracle import connect, same

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(seed=0, n=400, dims=12):
    """Clusters, a third of copies of one vector, norms from small to large, and every row that takes no part."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    x = centres[r.integers(0, 6, n)] * r.uniform(0.2, 2.0, (n, 1)) + 0.2 * r.normal(size=(n, dims))
    x[r.random(n) < 0.33] = centres[0]
    out = [(i, [float(np.float32(v)) for v in row], int(r.integers(0, 4))) for i, row in enumerate(x)]
    bad = [None, [], [None, 1.0], [float("nan")] * dims, [float("inf")] * dims]
    out += [(n + 10 * k, v, 1) for k, v in enumerate(bad)] + [(n + 60, [1.0] * dims, None), (None, [1.0] * dims, 1), (n + 70, [1.0, 2.0], 1), (n + 80, [1.0, 1.0], 2), (n + 90, [2.0, 1.0], 1), (n + 100, [0.0] * dims, 1)]
    return out


def got(spark, data, **kw):
    df = spark.createDataFrame(data, SCHEMA).repartition(3).withColumns({"q": F.lit(1), "chunk": F.lit("x"), "leaf": F.lit(None).cast("int"), "v": F.lit(2)})
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **kw).collect())


@pytest.mark.parametrize("chunk,sample", [(8192, 20_000), (32, 50)])
def test_equals_brute_force(spark, chunk, sample):
    data = rows()
    want = sorted(negatives.brute(data, every=10))
    assert len(want) > 200 and max(r[2] for r in want) == 5
    assert got(spark, data, every=10, chunk=chunk, sample=sample) == want


def test_all_copies_of_one_vector(spark):
    """Ties go by vec_id, across chunks too."""
    data = [(i, [1.0, 0.5], i % 2) for i in range(120)]
    out = got(spark, data, chunk=16)
    assert out == sorted(negatives.brute(data))
    assert [r[1:4:2] for r in out if r[0] == 0 and r[2] == 1] == [(p, min(i for i in range(120) if ((i % 2 + 1) % 10 if i % 7 == 0 else i % 2) != 1)) for p in [r[1] for r in out if r[0] == 0 and r[2] == 1]]


def test_repeated_rows_and_no_partners(spark):
    data = [(100, [1.0], 3), (100, [1.0], 3), (101, [0.5], 3), (102, [0.45], 4), (102, [0.45], 4)]
    assert got(spark, data) == [(100, 101, 1, 102, 128 * 256, 115 * 256), (100, 101, 2, 102, 128 * 256, 115 * 256)]
    assert got(spark, [(100, [1.0], 3)]) == [] and got(spark, []) == []
    assert got(spark, [(100, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2)]) == []  # a window below zero holds nothing


def test_large_components_are_exact(spark):
    big = float(2**22)
    data = [(100, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big, 1.0], 2), (3, [big, 1.5], 2), (4, [big, 2.5], 2)]
    assert got(spark, data) == sorted(negatives.brute(data))


def test_search_of_a_chunk_is_pruned_and_exact():
    r = np.random.default_rng(3)
    x = np.round(60 * r.normal(size=(40, 8))).repeat(60, axis=0) + np.round(3 * r.normal(size=(2400, 8)))
    top = float((x * x).sum(axis=1).max())
    tree = Tree(augmented(x, top), 64)
    assert sum(map(len, tree.buckets)) == len(x) and max(map(len, tree.buckets)) <= 64
    dealt = tree.deal(augmented(x, top))
    assert all((dealt[b] == i).all() for i, b in enumerate(tree.buckets))
    q = np.concatenate([x[:50], np.zeros((50, 1))], axis=1)
    for spans in (tree.spans, tree.radii()):
        near, far = Bounds(tree, spans)(q, 1e-6)
        for b, members in enumerate(tree.buckets):
            d = distances(q, augmented(x[members], top))
            assert (near[:, b] <= d.min(axis=1) + 1e-3).all() and (far[:, b] >= d.max(axis=1) - 1e-3).all()
    near, _ = Bounds(tree, tree.spans)(q, 1e-6)
    assert (near > 100).mean() > 0.2  # far buckets are known to be far
    chunk = Chunk(np.arange(len(x)), np.zeros(len(x), np.int64), x, top)
    assert math.isclose(chunk.top, top)


def test_sql(spark, tiny):
    same(negatives.query(spark, tiny), connect(tiny), oracles.SQL["op12_hard_negatives"])
