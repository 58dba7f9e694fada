"""The stream: what it tells in batches adds up to the batch's structure, late rows are rows, and state survives a restart."""

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import kernel
from ridgeline.streaming import steps
from ridgeline.streaming.steps import Shelf, Warm
from tests.test_fold import walk

SCHEMA = "code string, period string, ts string, high double, low double, close double"


def bars(code, period, n, seed, start=0):
    return [(code, period, f"{i:05}", h, l, c) for i, (h, l, c) in enumerate(zip(*walk(n, seed)))][start:]


class Feed:
    """A folder that a stream reads; every call is a start of the query from its checkpoint."""

    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, f"file://{root}", 0

    def __call__(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{self.root}/in/{self.n}")
        self.n += 1
        q = steps.stream_structure(self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.root}/in"), mode="loose")
        q.writeStream.format("parquet").option("checkpointLocation", f"{self.root}/state").option("path", f"{self.root}/out").trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(f"{self.root}/out")


def shown(out, code, period):
    rows = steps.current(out).where((F.col("code") == code) & (F.col("period") == period)).collect()
    return {(r["layer"], r["kind"], r["src_start"], r["src_end"]): (r["status"], r["confirmed_at"]) for r in rows}


def wanted(rows):
    s = kernel.analyse(*([r[k] for r in rows] for k in (3, 4, 5)), "day", "loose")
    out = {("stroke", None, k.start.src, k.end.src): k.status for k in s.strokes}
    out |= {("segment", None, g.src_start, g.src_end): g.status for g in s.segments} | {("pivot", None, p.src_start, p.src_end): p.status for p in s.levels[0][1]}
    return out | {("signal", g.kind, g.src_start, g.src_end): g.status for g in s.signals}


def test_batches_add_up_by_code_and_period(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    a, b = bars("a", "day", 500, 1), bars("a", "week", 500, 2)
    for cut in ((0, 120), (120, 121), (121, 350), (350, 500)):
        out = feed(a[slice(*cut)] + b[slice(*cut)])
    for period, rows in (("day", a), ("week", b)):
        got, want = shown(out, "a", period), wanted(rows)
        assert set(got) == set(want) and len(want) > 10
        assert all(got[k][0] == kernel.CONFIRMED for k, v in want.items() if v == kernel.CONFIRMED)
        assert all((status == kernel.CONFIRMED) == (at is not None) for status, at in got.values())
    assert {(r["as_of"], r["version"]) for r in steps.heads(out).collect()} == {("00499", 4)}
    told = out.where("layer not in ('snapshot', 'error')").count()
    assert told < 3 * sum(len(wanted(r)) for r in (a, b))  # changes only, not a snapshot a batch


def test_late_rows_are_rows_and_others_go_on(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    a, b = bars("a", "day", 300, 1), bars("b", "day", 300, 2)
    feed(a[:200] + b[:100])
    out = feed(a[50:60] + b[100:])  # a's batch ends before a does
    late = out.where("layer = 'error'").orderBy("text").collect()
    assert [(r["code"], r["kind"], r["text"], r["version"]) for r in late] == [("a", "late", f"{r[2]} comes after 00199", 1) for r in a[50:60]]
    assert set(shown(out, "a", "day")) == set(wanted(a[:200])) and set(shown(out, "b", "day")) == set(wanted(b))


def test_a_bar_that_comes_again_replaces_the_old_one(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    a = bars("a", "day", 260, 3)
    wrong = [(*r[:3], r[3] + 5, r[4] - 5, r[5]) if i in (100, 199) else r for i, r in enumerate(a)]
    feed(wrong[:200])
    out = feed([a[100], *a[199:]])
    assert set(shown(out, "a", "day")) == set(wanted(a))
    assert steps.heads(out).first()["as_of"] == "00259"


def test_a_kept_fold_is_dropped_when_it_is_not_the_states():
    shelf = Shelf(most=10)
    for i in range(4):
        w = Warm("day", "strict")
        for t in range(4):
            w.push(f"{t}", (2.0 + t, 1.0 + t, 1.5 + t))
        shelf.put(i, w)
    assert shelf.take(0) is None and shelf.take(3) is not None and shelf.size <= 10


def test_bad_mode(spark):
    with pytest.raises(ValueError):
        steps.stream_structure(spark.createDataFrame([], SCHEMA), mode="wild")
