"""Tables that keep the latest row of each key, and what is kept from run to run."""

import json

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import persist, structure
from ridgeline.sources.keyed import Conflict, KeyedTable
from tests.test_fold import walk

SCHEMA = "code string, period string, v int"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["code", "period"], 8)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(t, version=None):
    return sorted((tuple(r) for r in t.read(version).collect()), key=str)


def test_latest_row_of_each_key(spark, table):
    assert held(table) == [] and table.manifest() is None
    assert table.upsert(frame(spark, [("a", "day", 1), ("b", "day", 1), ("c", None, 1)])) == 1
    assert table.upsert(frame(spark, [("a", "day", 2), ("d", "5", 1), ("c", None, 2)])) == 2
    assert held(table) == [("a", "day", 2), ("b", "day", 1), ("c", None, 2), ("d", "5", 1)]
    assert held(table, 1) == [("a", "day", 1), ("b", "day", 1), ("c", None, 1)]  # an old reader's version stays whole
    assert [tuple(r) for r in table.get(code="a", period="day").collect()] == [("a", "day", 2)] and table.get(code="x", period="day").count() == 0
    assert table.delete(frame(spark, [("b", "day", 0), ("x", "day", 0)])) == 3
    assert held(table) == [("a", "day", 2), ("c", None, 2), ("d", "5", 1)]
    assert table.upsert(frame(spark, [])) == 3


def test_only_touched_buckets_are_rewritten(spark, table):
    table.upsert(frame(spark, [(f"k{i}", "day", i) for i in range(40)]))
    before = table.manifest()["holds"]
    table.upsert(frame(spark, [("k7", "day", 700)]))
    after = table.manifest()["holds"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert table.vacuum(keep=2) == 0 and table.vacuum(keep=1) == 0  # the first write still holds seven buckets
    assert len(held(table)) == 40 and ("k7", "day", 700) in held(table)


def test_a_writer_that_dies_changes_nothing(spark, table, monkeypatch):
    table.upsert(frame(spark, [("a", "day", 1)]))

    def dies(self, state):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", dies)
        with pytest.raises(RuntimeError):
            table.upsert(frame(spark, [("a", "day", 2), ("b", "day", 2)]))
    assert held(table) == [("a", "day", 1)]
    table.upsert(frame(spark, [("a", "day", 2), ("b", "day", 2)]))  # the run again
    assert held(table) == [("a", "day", 2), ("b", "day", 2)]
    assert table.vacuum(keep=1) > 0 and held(table) == [("a", "day", 2), ("b", "day", 2)]


def test_two_writers(spark, table, monkeypatch):
    """The second finds its version taken and merges with what the first one made."""
    real, other = KeyedTable._publish, []

    def meanwhile(self, state):
        if not other:
            other.append(1)
            KeyedTable(spark, self.root, SCHEMA, self.keys).upsert(frame(spark, [("b", "day", 9)]))
        return real(self, state)

    monkeypatch.setattr(KeyedTable, "_publish", meanwhile)
    assert table.upsert(frame(spark, [("a", "day", 1)])) == 2
    assert held(table) == [("a", "day", 1), ("b", "day", 9)]
    monkeypatch.setattr(KeyedTable, "_publish", lambda self, state: False)
    with pytest.raises(Conflict):
        table.upsert(frame(spark, [("a", "day", 3)]), tries=2)
    assert held(table) == [("a", "day", 1), ("b", "day", 9)]


def market(spark, upto=1500):
    data = [(c, "day", f"{2000 + i // 300}-{i // 25 % 12 + 1:02}-{i % 25 + 1:02}", h, low, x) for c, seed in (("a", 1), ("b", 2), ("c", 4)) for i, (h, low, x) in enumerate(zip(*walk(1500, seed))) if i < (upto if c != "c" else 40)]
    return spark.createDataFrame(data, "code string, period string, ts string, high double, low double, close double")


def sync_of(bars):
    return bars.groupBy("code", "period").agg(F.min("ts").alias("sync_start"), F.max("ts").alias("sync_end"))


def test_tracking_tells_what_changed_since_the_last_run(spark, tmp_path):
    root = f"file://{tmp_path}"
    first = market(spark, 400)
    rows = persist.run_track(spark, root, first, sync_of(first)).collect()
    assert {(r["code"], r["status"], r["change"], r["reason"]) for r in rows} == {("a", "ok", "FIRST_SNAPSHOT", None), ("b", "ok", "FIRST_SNAPSHOT", None), ("c", "insufficient", None, "too few bars")}
    again = persist.run_track(spark, root, first, sync_of(first)).where("status = 'ok'").collect()
    assert {(r["change"], r["prev_as_of"] == r["as_of"]) for r in again} == {("NO_CHANGE", True)}
    later = market(spark)
    seen = persist.run_track(spark, root, later, sync_of(later), keep=False).where("status = 'ok'").collect()
    assert {r["change"] for r in seen} & {"NEW_PIVOT", "SIGNAL", "DIVERGENCE", "PIVOT_BREAKOUT"} and all(r["prev_as_of"] < r["as_of"] for r in seen)
    assert {tuple(r) for r in persist.run_track(spark, root, later, sync_of(later)).where("status = 'ok'").collect()} == {tuple(r) for r in seen}  # what was not kept is told again
    assert {r["change"] for r in persist.run_track(spark, root, later, sync_of(later)).where("status = 'ok'").collect()} == {"NO_CHANGE"}


def test_a_failing_series_keeps_its_fingerprint(spark, tmp_path):
    bars = market(spark, 400)
    root = f"file://{tmp_path}"
    persist.run_track(spark, root, bars, sync_of(bars))
    broken = bars.withColumn("high", F.when((F.col("code") == "a") & (F.col("ts") > "2001"), None).otherwise(F.col("high")))
    rows = persist.run_track(spark, root, broken, sync_of(bars)).collect()
    assert {r["code"] for r in rows if r["status"] == "ok"} >= {"b"}
    assert persist.opened(spark, root, "fingerprint").read().count() == 2


def test_snapshots_trails_and_hits_are_kept(spark, tmp_path):
    bars, root = market(spark, 400), f"file://{tmp_path}"
    table = structure.structure(bars, mode="loose")
    as_of = bars.groupBy("code", "period").agg(F.max("ts").alias("as_of"))
    persist.save_snapshots(spark, root, table, as_of)
    persist.save_snapshots(spark, root, table.where("code = 'a'"), as_of)
    got = {r["code"]: r for r in persist.opened(spark, root, "structure_snapshot").read().collect()}
    assert {c: r["version"] for c, r in got.items()} == {"a": 2, "b": 1, "c": 1} and {"area_now", "level"} <= set().union(*json.loads(got["a"]["payload"]))
    seen = structure.checkpoints(bars, 50, mode="loose")
    marks = seen.select("code", "period", "checkpoint").distinct()
    trail = structure.trail(seen, marks)
    persist.save_trails(spark, root, trail, 50, "qfq")
    persist.save_trails(spark, root, trail, 50, "qfq")
    kept = persist.opened(spark, root, "signal_trail").read().collect()
    assert sum(len(json.loads(r["payload"])) for r in kept) == trail.count() > 0 and {r["step"] for r in kept} == {50}
    hits = structure.layer(table, "signal").select("code", F.lit("day").alias("period"), "kind", "ts", "level", "price", "status", F.lit(1.5).alias("strength"))
    for day in ("2026-01-01", "2026-01-02", "2026-01-02"):
        persist.save_hits(spark, root, hits, day)
    n = hits.select("code", "kind", "ts").distinct().count()
    assert persist.saved_hits(spark, root, "2026-01-02").count() == n > 0 and persist.saved_hits(spark, root, limit=1).count() == 1 and persist.saved_hits(spark, root).count() == 2 * n
