"""Structure as bars arrive: keyed state by (code, period), of which only changed entries are written.

The state of a series is a map of its bars by time, a map of what is known of each
object (when it was confirmed), and a head (version, number of bars, last time).
It is kept in RocksDB by Spark (``transformWithState``), so a lost executor or a
restart costs a replay of the series' bars and nothing else: a worker keeps the
fold of the series that it has seen (``Warm``) only to save that replay, and throws
it away when the head says that it is not the state's.

Rows that come too late (a batch that ends before its series does) change nothing:
they come out as error rows, and all other series go on.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ridgeline.operators import kernel
from ridgeline.operators.fold import Fold

OUT = "code string, period string, as_of string, version int, layer string, kind string, src_start int, src_end int, status string, confirmed_at string, text string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def objects(s: Fold) -> dict[str, list]:
    """The objects whose fate is told, by layer."""
    s.settle()
    return {"stroke": list(s.strokes), "segment": s.segments, "pivot": s.levels[0][1], "signal": s.latest[1]}


def name(layer: str, o) -> str:
    """What an object is called from one batch to the next."""
    span = (o.start.src, o.end.src) if layer == "stroke" else (o.src_start, o.src_end)
    return "|".join(map(str, (layer, o.kind if layer == "signal" else "", *span)))


class Warm:
    """A series' fold, its bars' times and what was told of it last."""

    def __init__(self, level: str, mode: str):
        self.fold, self.ts, self.bars = Fold(level, mode), [], []
        self.told: dict[str, list] = {k: [] for k in ("stroke", "segment", "pivot", "signal")}
        self.known: dict[str, str] = {}

    def push(self, ts: str, bar) -> None:
        self.ts.append(ts)
        self.bars.append(bar)
        self.fold.push(*bar)

    def step(self) -> list[tuple[str, str, str | None]]:
        """(name, status, time) of every object whose fate changed; an object that was confirmed once stays so."""
        as_of, out = self.ts[-1], []
        for layer, new in objects(self.fold).items():
            old = self.told[layer]
            same = next((i for i, (a, b) in enumerate(zip(old, new)) if a is not b and a != b), min(len(old), len(new)))
            now = {name(layer, o): o for o in new[same:]}
            for key in [k for k in dict.fromkeys(name(layer, o) for o in old[same:]) if k in self.known and k not in now]:
                out.append((key, kernel.INVALIDATED, self.known.pop(key) or None))
            for key, o in now.items():
                sure = o.status == kernel.CONFIRMED
                at = self.known.get(key) or ((self.ts[o.confirmed] if o.confirmed is not None else as_of) if sure else "")
                if self.known.get(key) != at:
                    self.known[key] = at
                    out.append((key, kernel.CONFIRMED if at else kernel.TENTATIVE, at or None))
            self.told[layer] = new
        return out


class Shelf:
    """The folds that a worker keeps, the latest used ones, up to so many bars in all."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.size, self.held = most, 0, OrderedDict()

    def take(self, key):
        w = self.held.pop(key, None)
        self.size -= len(w.ts) if w else 0
        return w

    def put(self, key, w: Warm) -> None:
        self.held[key] = w
        self.size += len(w.ts)
        while self.size > self.most and len(self.held) > 1:
            _, old = self.held.popitem(last=False)
            self.size -= len(old.ts)


SHELF = Shelf()


class Structures(StatefulProcessor):
    """One series' bars in, what became of its objects out."""

    def __init__(self, level: str, mode: str):
        self.level, self.mode, self.query = level, mode, uuid.uuid4().hex  # no two queries share a shelf's folds

    def init(self, handle) -> None:
        self.bars = handle.getMapState("bars", "ts string", "high double, low double, close double")
        self.known = handle.getMapState("known", "object string", "at string")
        self.head = handle.getValueState("head", "version int, n int, as_of string")

    def warm(self, key, head) -> Warm:
        """The series' fold: kept by this worker if it is at the state's head, else replayed from the state."""
        w = SHELF.take((self.query, key))
        if w is None or (len(w.ts), w.ts[-1] if w.ts else None) != (head[1], head[2]):
            w = Warm(self.level, self.mode)
            for (ts,), bar in sorted((tuple(k), tuple(v)) for k, v in self.bars.iterator()):
                w.push(ts, bar)
            w.known = {k[0]: v[0] for k, v in self.known.iterator()}
            if w.ts:
                w.told = objects(w.fold)
        return w

    def handleInputRows(self, key, rows, timerValues):
        new: dict[str, tuple] = {}
        for pdf in rows:
            for ts, *bar in pdf[["ts", "high", "low", "close"]].itertuples(index=False):
                new[ts] = tuple(map(float, bar))
        head = tuple(self.head.get()) if self.head.exists() else (0, 0, None)
        version, n, as_of = head[0] + 1, head[1], head[2]
        base = dict(zip(("code", "period"), key))
        if as_of is not None and max(new) < as_of:
            yield self.frame([base | {"as_of": as_of, "version": head[0], "layer": "error", "kind": "late", "text": f"{ts} comes after {as_of}"} for ts in sorted(new)])
            return
        w = self.warm(key, head)
        if as_of is not None and min(new) <= as_of:  # a bar that is known is written again: what follows it is replayed
            known, told, old = w.known, w.told, dict(zip(w.ts, w.bars)) | new
            w = Warm(self.level, self.mode)
            w.known, w.told = known, told
            for ts in sorted(old):
                w.push(ts, old[ts])
        else:
            for ts in sorted(new):
                w.push(ts, new[ts])
        for ts, bar in new.items():
            self.bars.updateValue((ts,), bar)
        changed = w.step()
        for k, status, at in changed:
            if status == kernel.INVALIDATED:
                self.known.removeKey((k,))
            else:
                self.known.updateValue((k,), (at or "",))
        self.head.update((version, len(w.ts), w.ts[-1]))
        SHELF.put((self.query, key), w)
        base |= {"as_of": w.ts[-1], "version": version}
        out = [base | {"layer": "snapshot", "text": f"{len(w.ts)} bars"}]
        for k, status, at in changed:
            layer, kind, a, z = k.split("|")
            out.append(base | {"layer": layer, "kind": kind or None, "src_start": int(a), "src_end": int(z), "status": status, "confirmed_at": at})
        yield self.frame(out)

    @staticmethod
    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=COLUMNS).astype({"version": "int32", "src_start": "Int32", "src_end": "Int32"} | {c: object for c in COLUMNS if c not in ("version", "src_start", "src_end")})

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    """``transformWithState`` keeps its state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def stream_structure(bars: DataFrame, level: str = "day", mode: str = "strict") -> DataFrame:
    """What changes in each series of a streaming table of bars (code, [period,] ts, high, low, close), batch by batch.

    One ``snapshot`` row for each series and batch, a row for each object that is
    new, is confirmed, or is gone, and an ``error`` row for each row that is too late.
    """
    from ridgeline.operators.structure import series

    if mode not in ("strict", "loose"):
        raise ValueError(f"mode is strict or loose, not {mode!r}")
    with_state_store(bars.sparkSession)
    return series(bars, "high", "low", "close").groupBy("code", "period").transformWithStateInPandas(Structures(level, mode), OUT, "append", "none")


def current(changes: DataFrame) -> DataFrame:
    """The objects that are there, from all changes so far: the last word on each, unless that is that it is gone."""
    objects = changes.where(~F.col("layer").isin("snapshot", "error")).groupBy("code", "period", "layer", "kind", "src_start", "src_end")
    last = objects.agg(F.max_by(F.struct("status", "confirmed_at", "version"), "version").alias("last")).select("*", "last.*").drop("last")
    return last.where(F.col("status") != kernel.INVALIDATED)


def heads(changes: DataFrame) -> DataFrame:
    """code, period, as_of, version: how far each series is."""
    return changes.where("layer = 'snapshot'").groupBy("code", "period").agg(F.max("as_of").alias("as_of"), F.max("version").alias("version"))
