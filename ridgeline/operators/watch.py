"""Watching series: what a series looked like at points in time, pressed into items that can be compared."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ridgeline.operators import kernel
from ridgeline.operators.structure import series


def last_divergence(segments: list[kernel.Segment], hist: list[float]) -> kernel.Segment | None:
    """The last segment, if it goes further than the one before that runs its way, with a smaller area."""
    if not segments:
        return None
    last = max(segments, key=lambda s: (s.src_end, s.src_start))
    same = [s for s in segments if s.direction == last.direction and s.src_end < last.src_end]
    if not same:
        return None
    before = max(same, key=lambda s: s.src_end)
    area, prev = (kernel.hist_area(hist, s.src_start, s.src_end, s.direction) for s in (last, before))
    edges = (before.high, last.high) if last.direction == 1 else (before.low, last.low)
    return last if area is not None and prev is not None and kernel.diverges(*edges, prev, area, last.direction) else None


def fingerprint(ts: list[str], close: list[float], s: kernel.Structure) -> list[tuple[str, str]]:
    """(part, item): zones, signals, where the last close stands against the latest zone, and a divergence of the last segment."""
    pivots = s.levels[0][1] if s.levels else []
    out = [("pivot", f"{p.src_start}:{p.src_end}:{round(p.zd, 2)}:{round(p.zg, 2)}") for p in pivots]
    out += [("signal", f"{ts[g.src]}:{g.kind}") for g in s.signals]
    zone = max(pivots, key=lambda p: (p.src_end, p.src_start), default=None)
    state = "none" if zone is None else "up" if close[-1] > round(zone.zg, 2) else "down" if close[-1] < round(zone.zd, 2) else "inside"
    out.append(("breakout", state))
    d = last_divergence(s.segments, s.macd[2])
    return out + ([("divergence", f"{ts[d.src_end]}:{d.direction}")] if d else [])


def fingerprints(bars: DataFrame, cuts: list[str], level: str = "day", mode: str = "strict") -> DataFrame:
    """code, period, is_new, part, item: the fingerprints of each series at two times, by one pass over its bars.

    A series without bars at a time has no fingerprint there.
    """
    before, now = cuts

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        out = []
        for is_new, cut in ((False, before), (True, now)):
            seen = pdf[pdf["ts"] <= cut]
            if len(seen):
                high, low, close = (seen[c].tolist() for c in ("high", "low", "close"))
                out += [(pdf["code"].iloc[0], pdf["period"].iloc[0], is_new, *x) for x in fingerprint(seen["ts"].tolist(), close, kernel.analyse(high, low, close, level, mode))]
        return pd.DataFrame(out, columns=["code", "period", "is_new", "part", "item"])

    return series(bars, "high", "low", "close").groupBy("code", "period").applyInPandas(run, "code string, period string, is_new boolean, part string, item string")


def looked(bars: DataFrame, mode: str = "strict") -> DataFrame:
    """code, period, as_of, items, error: the fingerprint of each series as it is; a series that fails is a row with its error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        code, period, ts = pdf["code"].iloc[0], pdf["period"].iloc[0], pdf["ts"].tolist()
        items, error = None, None
        try:
            high, low, close = (pdf[c].tolist() for c in ("high", "low", "close"))
            items = [{"part": p, "item": i} for p, i in fingerprint(ts, close, kernel.analyse(high, low, close, period or "day", mode))]
        except Exception as e:  # one bad series must not stop a market
            error = f"{type(e).__name__}: {e}"
        return pd.DataFrame({"code": [code], "period": [period], "as_of": [ts[-1]], "items": [items], "error": [error]})

    return series(bars, "high", "low", "close").groupBy("code", "period").applyInPandas(run, "code string, period string, as_of string, items array<struct<part: string, item: string>>, error string")
