"""The structure of one series as its bars arrive: the kernel's rules over a state that takes a bar at a time.

What a bar can still change is small: the last merged bar, the fractal before it,
the last turning point, and with it the last strokes. All else is kept. For each
place at which a segment may begin, the pull-backs since then are a stack that
takes a stroke in constant time on average; strokes that may still change are taken
back before the next ones come. Zones, trends and levels are built again only when
a segment that is not the last one changes; divergences and signals of the last
segment are sought alone.

``Fold`` gives at every bar exactly what ``kernel.analyse`` gives of the bars so far.
"""

from __future__ import annotations

from typing import Sequence

from ridgeline.operators import kernel
from ridgeline.operators.kernel import MIN_STROKES, Break, Stroke, inside

LOW = float("-inf")


class Pullback:
    """One pull-back of a move: its range, where the move ended before it, and whether a segment could end there."""

    __slots__ = ("top", "bottom", "place", "fits", "record")

    def __init__(self, top: float, bottom: float, place: int, fits: bool):
        self.top, self.bottom, self.place, self.fits, self.record = top, bottom, place, fits, LOW


class Move:
    """Everything that may be a segment from ``start`` on, whatever its end."""

    def __init__(self, start: int, least: int):
        self.start, self.least, self.n = start, least, start
        self.sign = 0
        self.stack: list[Pullback] = []
        #: (pull-back, place, its confirming stroke or None where a peak must come) of the pull-backs where a segment may end.
        self.ends: list[tuple[int, int, int | None]] = []
        self.highest, self.lowest = (LOW, start), (-LOW, start)
        self.log: list[tuple] = []

    def take(self, s: Stroke, keep: bool) -> None:
        """Stroke n; ``keep`` lets it be taken back."""
        i = self.n
        if i == self.start:
            self.sign = s.direction
        top, bottom = (s.high, s.low) if self.sign == 1 else (-s.low, -s.high)
        popped: list[Pullback] = []
        ends: list = []
        pulled = (i - self.start) % 2 == 1
        if pulled:
            stack = self.stack
            new = Pullback(top, bottom, i, i - self.start >= self.least and self.lowest[1] <= self.highest[1])
            while stack and inside(stack[-1].top, stack[-1].bottom, new.top, new.bottom):
                old = stack.pop()
                popped.append(old)
                if old.top > new.top:
                    new.place, new.fits = old.place, old.fits
                new.top, new.bottom = max(new.top, old.top), max(new.bottom, old.bottom)
            if stack:
                new.record = max(stack[-1].record, stack[-1].top)
            stack.append(new)
            at = len(stack) - 2
            while self.ends and self.ends[-1][0] >= at:
                ends.append(self.ends.pop())
            if at >= 0 and (e := self.end_at(at)):
                self.ends.append(e)
        if keep:
            self.log.append((pulled, popped, ends, self.highest, self.lowest))
        if top > self.highest[0]:
            self.highest = (top, i)
        if bottom < self.lowest[0]:
            self.lowest = (bottom, i)
        self.n = i + 1

    def take_back(self) -> None:
        """Undoes every stroke that was taken to be kept."""
        while self.log:
            pulled, popped, ends, self.highest, self.lowest = self.log.pop()
            self.n -= 1
            if pulled:
                self.stack.pop()
                at = len(self.stack) - 1
                self.stack += popped[::-1]
                while self.ends and self.ends[-1][0] >= at:
                    self.ends.pop()
                self.ends += ends[::-1]

    def end_at(self, k: int) -> tuple[int, int, int | None] | None:
        """Whether the move turns at pull-back k."""
        own, after = self.stack[k], self.stack[k + 1]
        if not own.fits or own.top <= after.top:
            return None
        if not k:
            return k, own.place, after.place
        before = self.stack[k - 1]
        if own.top <= own.record or own.top <= before.top or own.bottom <= max(before.bottom, after.bottom):
            return None
        apart = own.top < before.bottom or own.bottom > before.top
        return k, own.place, None if apart else after.place


class FirstPeak:
    """The stroke that completes the first peak of the pull-backs of a move, once there is one."""

    def __init__(self, start: int):
        self.start, self.n, self.found = start, start, None
        self.stack: list[tuple[float, float, int]] = []

    @staticmethod
    def step(stack, strokes: Sequence[Stroke], start: int, i: int) -> int | None:
        if (i - start) % 2 == 0:
            return None
        s = strokes[i]
        top, bottom = (s.high, s.low) if strokes[start].direction == 1 else (-s.low, -s.high)
        kernel.join_pullback(stack, top, bottom, i)
        return stack[-1][2] if len(stack) > 2 and kernel.peaks(stack, len(stack) - 2) else None

    def by(self, strokes: Sequence[Stroke], fixed: int, stop: int) -> int | None:
        """What is known from the strokes before ``stop``, of which those before ``fixed`` stay."""
        while self.found is None and self.n < min(fixed, stop):
            self.found = self.step(self.stack, strokes, self.start, self.n)
            self.n += 1
        if self.found is not None:
            return self.found
        stack = list(self.stack)
        for i in range(self.n, stop):
            found = self.step(stack, strokes, self.start, i)
            if found is not None:
                return found
        return None


class Breaks:
    """``kernel.choose_breaks`` over strokes of which only the last few change."""

    def __init__(self, least: int = MIN_STROKES):
        self.least = least
        self.moves: dict[int, Move] = {}
        self.peaks: dict[int, FirstPeak] = {}
        self.first: int | None = None
        self.looked = 0  # of so many strokes no start has a break
        self.strokes: Sequence[Stroke] = []
        self.fixed = 0
        self.touched: list[Move] = []
        self.overlaps: dict[int, bool] = {}

    def move(self, s: int, stop: int) -> Move:
        """The move from s, with all strokes before ``stop``."""
        m = self.moves.get(s)
        if m is None:
            m = self.moves[s] = Move(s, self.least)
        for i in range(m.n, stop):
            keep = i >= self.fixed
            if keep and not m.log:
                self.touched.append(m)
            m.take(self.strokes[i], keep)
        return m

    def overlapping(self, strokes: Sequence[Stroke], s: int) -> bool:
        """Remembered where its strokes stay."""
        if s + 3 > self.fixed:
            return kernel.overlapping(strokes, s)
        if s not in self.overlaps:
            self.overlaps[s] = kernel.overlapping(strokes, s)
        return self.overlaps[s]

    def ends(self, s: int, stop: int) -> list[tuple[int, int, int]]:
        """(pull-back, start of the next segment, confirming stroke) of the breaks of the move from s."""
        if stop - s < 6 or not self.overlapping(self.strokes, s):
            return []
        m = self.moves.get(s)
        if m is None or m.n < stop:
            m = self.move(s, stop)
        for e in m.ends:
            if e[2] is None:
                break
        else:
            return m.ends
        out = []
        for k, place, known in m.ends:
            if known is None:
                peak = self.peaks.get(place)
                if peak is None:
                    peak = self.peaks[place] = FirstPeak(place)
                known = peak.by(self.strokes, self.fixed, stop)
            if known is not None:
                out.append((k, place, known))
        return out

    def begin(self) -> int | None:
        """The first start with a break: the one that needs the fewest strokes."""
        if self.first is not None:
            return self.first
        for t in range(self.looked + 1, len(self.strokes) + 1):
            found = next((s for s in range(t) if self.ends(s, t)), None) if t >= self.least else None
            if t <= self.fixed:
                self.looked, self.first = t, found
            if found is not None:
                return found
        return None

    def choose(self, strokes: Sequence[Stroke], fixed: int) -> list[Break]:
        for m in self.touched:
            m.take_back()
        self.touched = []
        self.strokes, self.fixed = strokes, fixed
        first, n = self.begin(), len(strokes)
        if first is None:
            return []
        ends: dict[int, list[tuple[int, int, int]]] = {}
        todo = [first]
        while todo:
            s = todo.pop()
            if s not in ends:
                ends[s] = self.ends(s, n) if s + self.least <= n else []
                todo += [e[1] for e in ends[s] if e[1] not in ends]
        count: dict[int, int] = {}
        pick: dict[int, tuple[int, int, int] | None] = {}
        for s in sorted(ends, reverse=True):
            most, choice = 0, None
            for e in ends[s]:
                if count[e[1]] >= most:
                    most, choice = count[e[1]] + 1, e
            count[s], pick[s] = most, choice
        out, at = [], first
        while pick[at]:
            _, place, known = pick[at]
            out.append(Break(at, place - 1, known))
            at = place
        return out


class Fold:
    """The state of one series."""

    def __init__(self, level: str = "day", mode: str = "strict", policy=kernel.choose_breaks):
        if mode not in ("strict", "loose"):
            raise ValueError(f"mode is strict or loose, not {mode!r}")
        self.level, self.mode, self.policy = level, mode, policy
        self.high: list[float] = []
        self.low: list[float] = []
        self.merged: list[kernel.Merged] = []
        self.settled: list[kernel.Fractal] = []  # fractals that stay
        self.points: list[kernel.Fractal] = []  # their turns; all but the last stay
        self.strokes: list[Stroke] = []
        self.breaks = Breaks()
        self.known: dict = {}
        self.extents: dict[tuple[int, int], tuple[float, float]] = {}
        self.lines: tuple[list[float], list[float], list[float]] = ([], [], [])
        self.ema: tuple[float, float] | None = None
        self.segments: list[kernel.Segment] = []
        self.view: kernel.View | None = None
        self.levels: list = kernel.build_levels([], level)
        self.kept: tuple[list, list] = ([], [])
        self.stale = True
        self.latest: tuple[list, list] = ([], [])

    def __len__(self) -> int:
        return len(self.high)

    def push(self, high: float, low: float, close: float) -> bool:
        """Takes the next bar; True if it changes a stroke."""
        i = len(self.high)
        self.high.append(float(high))
        self.low.append(float(low))
        self.average(float(close))
        before = len(self.merged)
        kernel.merge_into(self.merged, self.high[-1], self.low[-1], i)
        if len(self.merged) > before and (f := kernel.fractal_at(self.merged, before - 2, self.high, self.low)):
            self.settled.append(f)
            kernel.turn(self.points, f)
        points = self.points[-4:]
        skipped = len(self.points) - len(points)
        if f := self.open_fractal():
            kernel.turn(points, f)
        # a stroke stays whole once the turn after its end has stayed
        whole = max(0, len(self.points) - 3 - skipped)
        first = skipped + whole
        tail = kernel.strokes_of(points, whole)
        if tail == self.strokes[first:] and len(self.strokes) == first + len(tail):
            return False
        self.strokes[first:] = tail
        self.stale = True
        return True

    def open_fractal(self) -> kernel.Fractal | None:
        return kernel.fractal_at(self.merged, len(self.merged) - 2, self.high, self.low)

    def average(self, close: float) -> None:
        """MACD with its usual periods, one close further."""
        a, b, c = (2.0 / (n + 1) for n in (12, 26, 9))
        self.ema = (close, close) if self.ema is None else (a * close + (1 - a) * self.ema[0], b * close + (1 - b) * self.ema[1])
        dif, dea, hist = self.lines
        dif.append(self.ema[0] - self.ema[1])
        dea.append(c * dif[-1] + (1 - c) * dea[-1] if dea else dif[-1])
        hist.append(2 * (dif[-1] - dea[-1]))

    def extent(self, strokes, a: int, z: int) -> tuple[float, float]:
        if z >= self.fixed:
            return kernel.extent(strokes, a, z)
        if (a, z) not in self.extents:
            self.extents[a, z] = kernel.extent(strokes, a, z)
        return self.extents[a, z]

    @property
    def fixed(self) -> int:
        """Strokes whose ends stay."""
        return max(0, len(self.points) - 2)

    def settle(self) -> None:
        """Brings everything above the strokes up to date."""
        if not self.stale:
            return
        self.stale = False
        breaks = self.breaks.choose(self.strokes, self.fixed) if self.policy is kernel.choose_breaks else self.policy(self.strokes) if self.strokes else []
        old, new = self.segments, kernel.segments_between(self.strokes, breaks, extent=self.extent, overlapping=self.breaks.overlapping)
        last = len(new) - 1
        same = self.view is not None and len(old) == len(new) and old[:-1] == new[:-1] and (not new or kernel.CONFIRMED not in (old[-1].status, new[-1].status))
        self.segments = new
        if not same:
            self.levels = kernel.build_levels(new, self.level, self.high, self.low)
        view = kernel.View(new, self.levels[0][1], self.level, self.high, self.low, self.lines[2], self.known)
        if same:
            for name in ("weaker", "higher", "higher_divergences"):
                if name in self.view.__dict__:
                    view.__dict__[name] = self.view.__dict__[name]
        else:
            self.kept = view.divergences(0, max(0, last)), view.signals(self.mode, 0, max(0, last))
        self.view = view
        last = max(0, last)
        self.latest = sorted(self.kept[0] + view.divergences(last), key=lambda d: (d.src, d.kind)), sorted(self.kept[1] + view.signals(self.mode, last), key=lambda s: (s.src, s.kind))

    @property
    def signals(self) -> list[kernel.Signal]:
        self.settle()
        return self.latest[1]

    def structure(self) -> kernel.Structure:
        """What ``kernel.analyse`` gives of the bars so far."""
        if not self.high:
            raise ValueError("a series without bars has no structure")
        self.settle()
        f = self.open_fractal()
        return kernel.Structure(list(self.merged), self.settled + ([f] if f else []), list(self.strokes), self.segments, self.levels, *self.latest, self.lines)
