"""Functions that tests plug in through SQL."""

from ridgeline.functions.tables import series_function
from ridgeline.operators import backtest, kernel


@series_function("ts string, kind string, price double")
def stroke_ends(bars, s):
    """A signal of one's own: every confirmed stroke's end."""
    return [(bars[k.end.src]["ts"], "up" if k.direction == 1 else "down", k.end.price) for k in s.strokes if k.status == kernel.CONFIRMED]


@series_function("ts string, area_now double, area_prev double")
def weaker_strokes(bars, s):
    """A divergence of one's own: a stroke with a smaller area than the last one its way."""
    for a, b in zip(s.strokes, s.strokes[2:]):
        x, y = (kernel.hist_area(s.macd[2], k.start.src, k.end.src, k.direction) for k in (a, b))
        if y < x:
            yield bars[b.end.src]["ts"], y, x


@series_function("ts string, side string, qty long, cash double")
def stroke_strategy(bars, s):
    """A strategy of one's own: an account for the series, in at a bottom and out at a top."""
    ledger, causes = backtest.Ledger(1e6), {}
    for f in s.fractals:
        causes.setdefault(f.confirmed, []).append("top" if f.top else "bottom")
    act = backtest.fractal_strategy()
    for i, b in enumerate(bars):
        ledger.open(b["code"], b["ts"], b["open"], bars[i - 1]["close"] if i else None, i)
        act(ledger, b["code"], causes.get(i, []))
    return [(f["ts"], f["side"], f["qty"], f["cash_after"]) for f in ledger.fills]


def no_columns(bars, s):
    return []
