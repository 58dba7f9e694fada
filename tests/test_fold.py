"""The fold over arriving bars equals the analysis of every prefix."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.operators import kernel
from ridgeline.operators.fold import Breaks, Fold


def walk(n, seed, tick=1.0):
    """A random walk on a grid, so that equal prices are common."""
    r = np.random.default_rng(seed)
    close = 100 + tick * np.cumsum(np.round(r.normal(size=n) * 2))
    open_ = np.concatenate([[100], close[:-1]])
    wick = lambda: tick * np.round(np.abs(r.normal(size=n)))
    return (np.maximum(open_, close) + wick()).tolist(), (np.minimum(open_, close) - wick()).tolist(), close.tolist()


def check(fold, high, low, close, n, mode):
    want, got = kernel.analyse(high[:n], low[:n], close[:n], "day", mode), fold.structure()
    for a, b, name in zip(want, got, kernel.Structure._fields):
        assert a == b, (n, name)


@pytest.mark.parametrize("seed,tick,mode", [(1, 1.0, "strict"), (2, 0.01, "loose"), (3, 0.5, "loose"), (4, 5.0, "strict")])
def test_equals_the_analysis_of_every_prefix(seed, tick, mode):
    high, low, close = walk(500, seed, tick)
    fold = Fold("day", mode)
    for n in range(1, 501):
        fold.push(high[n - 1], low[n - 1], close[n - 1])
        if n < 60 or n % 3 == 0:
            check(fold, high, low, close, n, mode)
    assert len(fold.segments) > 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 3)), min_size=1, max_size=120))
def test_any_bars(pairs):
    high, low = [float(a + b) for a, b in pairs], [float(a) for a, _ in pairs]
    fold = Fold("day", "loose")
    for n, (h, l) in enumerate(zip(high, low), 1):
        fold.push(h, l, (h + l) / 2)
    check(fold, high, low, [(h + l) / 2 for h, l in zip(high, low)], len(high), "loose")


def test_a_bar_without_a_change_changes_nothing():
    high, low, close = walk(300, 9)
    fold, before = Fold("day", "loose"), ([], [])
    quiet = 0
    for bar in zip(high, low, close):
        changed = fold.push(*bar)
        now = list(fold.strokes), list(fold.signals)
        if not changed:
            quiet += 1
            assert now == before
        before = now
    assert quiet > 100


def test_strokes_are_taken_back():
    """Breaks over strokes whose tail is replaced again and again are those of a fresh look."""
    high, low, _ = walk(900, 5)
    strokes = kernel.build_strokes(kernel.find_fractals(kernel.merge_bars(high, low), high, low))
    breaks, r = Breaks(), np.random.default_rng(0)
    for n in range(4, len(strokes)):
        for _ in range(2):
            tail = [s._replace(high=s.high + float(r.integers(0, 4)), low=s.low - float(r.integers(0, 4))) for s in strokes[n - 2 : n]]
            seen = strokes[: n - 2] + tail
            assert breaks.choose(seen, n - 2) == kernel.choose_breaks(seen)
    assert breaks.first is not None


def test_own_policy():
    high, low, close = walk(300, 6)
    policy = lambda strokes: [kernel.Break(0, 4, 5)] if len(strokes) > 8 else []
    fold = Fold("day", "strict", policy)
    for bar in zip(high, low, close):
        fold.push(*bar)
    assert fold.structure() == kernel.analyse(high, low, close, "day", "strict", policy)


def test_bad_mode_and_no_bars():
    with pytest.raises(ValueError):
        Fold("day", "wild")
    with pytest.raises(ValueError):
        Fold().structure()


def test_twenty_thousand_bars_in_time():
    """Every bar's signals of a long minute series: ten seconds on a free machine, with room here for a busy one."""
    bars = list(zip(*walk(20_000, 7)))
    fold, start = Fold("1", "loose"), time.process_time()
    n = sum(len(fold.signals) for bar in bars if fold.push(*bar))
    assert n and time.process_time() - start < 20
