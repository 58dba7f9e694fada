"""Structure of many series at once: the kernel in each (code, period) group, and one long table of what it finds.

A group is one series, which must be whole (segments are chosen over all of
it), and even a long minute series is a few megabytes; series spread over the
cluster by hash. A failing series becomes an error row and stops nothing else.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import kernel
from ridgeline.operators.fold import Fold
from ridgeline.sources.bars import same_series, series_keys

LAYERS = ("merged", "fractal", "stroke", "segment", "pivot", "trend", "divergence", "signal", "error")
SCHEMA = (
    "code string, period string, layer string, depth int, idx int, kind string, direction int, ts string, end_ts string, price double, high double, low double, zg double, zd double, "
    "start_idx int, end_idx int, src_start int, src_end int, status string, confirmed_at string, area_now double, area_prev double, flag boolean, level string, text string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def series(bars: DataFrame, *columns: str) -> DataFrame:
    """code, period (null without one), ts and ``columns`` as doubles: what is shuffled."""
    period = F.col("period").cast("string") if "period" in bars.columns else F.lit(None).cast("string")
    return bars.select("code", period.alias("period"), "ts", *(F.col(c).cast("double").alias(c) for c in columns))


def rows_of(code: str, ts: list[str], s: kernel.Structure, level: str) -> list[dict]:
    """The long table's rows of one series."""
    at = lambda i: None if i is None else ts[i]
    out: list[dict] = []

    def add(layer, idx, **v):
        out.append({"code": code, "layer": layer, "depth": 0, "idx": idx, "level": level} | v)

    for i, m in enumerate(s.merged):
        add("merged", i, direction=m.direction, ts=at(m.src_end), end_ts=at(m.src_start), high=m.high, low=m.low, src_start=m.src_start, src_end=m.src_end)
    for i, f in enumerate(s.fractals):
        add("fractal", i, kind="top" if f.top else "bottom", ts=at(f.src), price=f.price, high=f.high, low=f.low, start_idx=f.midx, src_start=f.src, src_end=f.src, confirmed_at=at(f.confirmed))
    for i, k in enumerate(s.strokes):
        add("stroke", i, direction=k.direction, ts=at(k.start.src), end_ts=at(k.end.src), high=k.high, low=k.low, start_idx=k.start.midx, end_idx=k.end.midx, src_start=k.start.src, src_end=k.end.src, status=k.status, confirmed_at=at(k.confirmed))
    for i, g in enumerate(s.segments):
        add("segment", i, direction=g.direction, ts=at(g.src_start), end_ts=at(g.src_end), high=g.high, low=g.low, start_idx=g.first, end_idx=g.last, src_start=g.src_start, src_end=g.src_end, status=g.status, confirmed_at=at(g.confirmed), area_now=kernel.hist_area(s.macd[2], g.src_start, g.src_end, g.direction))
    for depth, (name, pivots, trends) in enumerate(s.levels):
        for p in pivots:
            add("pivot", p.idx, depth=depth, level=name, ts=at(p.src_start), end_ts=at(p.src_end), high=p.gg, low=p.dd, zg=p.zg, zd=p.zd, start_idx=p.start, end_idx=p.end, src_start=p.src_start, src_end=p.src_end, status=p.status, confirmed_at=at(p.confirmed), flag=p.capped)
        for i, t in enumerate(trends):
            add("trend", i, depth=depth, level=name, kind=t.kind, direction=t.direction, ts=at(t.src_start), end_ts=at(t.src_end), high=t.high, low=t.low, start_idx=t.start, end_idx=t.end, src_start=t.src_start, src_end=t.src_end, status=t.status, confirmed_at=at(t.confirmed))
    for i, d in enumerate(s.divergences):
        add("divergence", i, kind=d.kind, direction=d.direction, ts=at(d.src), price=d.price, start_idx=d.ref, end_idx=d.seg, src_start=d.src_start, src_end=d.src_end, status=d.status, confirmed_at=at(d.confirmed), area_now=d.area_now, area_prev=d.area_prev, flag=d.new_extreme)
    for i, g in enumerate(s.signals):
        add("signal", i, kind=g.kind, ts=at(g.src), price=g.price, start_idx=g.pivot, src_start=g.src_start, src_end=g.src_end, status=g.status, confirmed_at=at(g.confirmed), flag=g.quantao)
    return out


def frame(rows: list[dict]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=COLUMNS)
    for c, kind in (x.split() for x in SCHEMA.split(", ")):
        df[c] = df[c].astype({"int": "Int32", "double": "float64", "boolean": "boolean"}.get(kind, object))
    return df


def runner(level: str | None, mode: str, policy, layers, **functions):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        code, ts = pdf["code"].iloc[0], pdf["ts"].tolist()
        own = level or pdf["period"].iloc[0] or "day"
        try:
            rows = rows_of(code, ts, kernel.analyse(pdf["high"].tolist(), pdf["low"].tolist(), pdf["close"].tolist(), own, mode, policy, **functions), own)
        except Exception as e:  # one bad series must not stop a market
            rows = [{"code": code, "layer": "error", "depth": 0, "idx": 0, "text": f"{type(e).__name__}: {e}"}]
        out = frame([r for r in rows if layers is None or r["layer"] in layers or r["layer"] == "error"])
        out["period"] = pdf["period"].iloc[0]
        return out

    return run


def structure(bars: DataFrame, level: str | None = "day", mode: str = "strict", policy=kernel.choose_breaks, layers: tuple[str, ...] | None = None, signal_fn=None, divergence_fn=None) -> DataFrame:
    """The long table of every series of ``bars``. Only the columns that the kernel needs are shuffled. Own functions of a ``kernel.View`` may give the signals and divergences. Without a level, a series is on that of its period."""
    if mode not in ("strict", "loose"):
        raise ValueError(f"mode is strict or loose, not {mode!r}")
    return series(bars, "high", "low", "close").groupBy("code", "period").applyInPandas(runner(level, mode, policy, layers, signal_fn=signal_fn, divergence_fn=divergence_fn), SCHEMA)


def layer(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col("layer") == name)


def as_of(bars: DataFrame, ts: str) -> DataFrame:
    """What was there at a time: the only way to see the past; it must come before the kernel."""
    return bars.where(F.col("ts") <= ts)


def clip(table: DataFrame, start: str, end: str) -> DataFrame:
    """The long table of a window: spans that meet it, points inside it; levels above the first are kept whole."""
    point = F.col("layer").isin("fractal", "signal", "divergence")
    meets = (F.coalesce("end_ts", "ts") >= start) & (F.col("ts") <= end)
    merged = (F.col("ts") >= start) & (F.col("end_ts") <= end)
    inside = F.col("ts").between(start, end)
    return table.where((F.col("depth") > 0) | F.when(point, inside).when(F.col("layer") == "merged", merged).otherwise(meets))


def signal_key(kind: str, ts: str, price: float) -> tuple[str, str, float]:
    """Which signal it is, whatever its number in the list of its time; code and period are the series' own."""
    return kind, ts, round(price, 4)


def folded(pdf: pd.DataFrame, level: str, mode: str):
    """(bars so far, the state, whether the last bar changed a stroke) at each bar of a series, and its times."""
    pdf = pdf.sort_values("ts", kind="stable")
    state = Fold(level, mode)
    for n, bar in enumerate(zip(pdf["high"].tolist(), pdf["low"].tolist(), pdf["close"].tolist()), 1):
        yield n, state, state.push(*bar)


def checkpoints(bars: DataFrame, step: int, level: str = "day", mode: str = "strict") -> DataFrame:
    """Signals at every ``step`` bars and at the end: (code, period, checkpoint, kind, src_start, src_end, ts, price, status)."""
    if step < 1:
        raise ValueError("step is 1 at least")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = sorted(pdf["ts"])
        out = []
        for n, state, _ in folded(pdf, level, mode):
            if n % step == 0 or n == len(ts):
                out += [(pdf["code"].iloc[0], pdf["period"].iloc[0], ts[n - 1], g.kind, g.src_start, g.src_end, ts[g.src], g.price, g.status) for g in state.signals]
        return pd.DataFrame(out, columns=["code", "period", "checkpoint", "kind", "src_start", "src_end", "ts", "price", "status"])

    return series(bars, "high", "low", "close").groupBy("code", "period").applyInPandas(run, "code string, period string, checkpoint string, kind string, src_start int, src_end int, ts string, price double, status string")


def showings(bars: DataFrame, level: str = "day", mode: str = "strict") -> DataFrame:
    """Signals, whatever their status, at the bar that first shows them: (code, period, kind, ts, price, checkpoint).

    Each bar sees only the bars up to it. A bar that leaves the strokes as they
    were shows what the one before does, so signals are sought only when they change.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = sorted(pdf["ts"])
        seen: dict = {}
        for n, state, changed in folded(pdf, level, mode):
            for g in state.signals if changed else ():
                seen.setdefault(signal_key(g.kind, ts[g.src], g.price), ts[n - 1])
        return pd.DataFrame([(pdf["code"].iloc[0], pdf["period"].iloc[0], *k, t) for k, t in seen.items()], columns=["code", "period", "kind", "ts", "price", "checkpoint"])

    return series(bars, "high", "low", "close").groupBy("code", "period").applyInPandas(run, "code string, period string, kind string, ts string, price double, checkpoint string")


def trail(seen: DataFrame, marks: DataFrame) -> DataFrame:
    """The life of each signal: first and last checkpoint that shows it, and the one that no longer does.

    seen: ``checkpoints``; marks: (code, [period,] checkpoint) of all checkpoints.
    """
    from pyspark.sql import Window

    keys = series_keys(seen, marks)
    w = Window.partitionBy(*keys).orderBy("checkpoint")
    order = marks.select(*(F.col(k).alias(f"m_{k}") for k in keys), F.col("checkpoint").alias("m_at"), F.lead("checkpoint").over(w).alias("after"))
    life = seen.groupBy(*keys, "kind", "src_start", "src_end").agg(F.min("checkpoint").alias("first_seen"), F.max("checkpoint").alias("last_seen"), F.count("*").alias("times"))
    return life.join(order, same_series(life, order, "m_") & (F.col("last_seen") == F.col("m_at"))).select(*keys, "kind", "src_start", "src_end", "first_seen", "last_seen", "times", F.col("after").isNull().alias("alive"), F.col("after").alias("falsified_at"))
