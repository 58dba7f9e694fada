"""An adaptive context-mixing range coder for token ids, many blocks in step.

A block is a run of ids coded on its own: its model starts afresh and a CRC-32
guards its ids. Its header lists the distinct ids; the coder works on their
ranks ("symbols"). Three predictions are mixed for each symbol:

* order 2 and order 1 name one symbol each, the one that followed the last two
  (the last) symbols before, with a confidence that grows with every hit; how
  far a confidence is trusted is itself learned from hits and misses;
* order 0 gives the rest of the probability to all symbols by their counts.

Counts and trust are learned all the time and take effect at doubling
intervals, then every ``REFRESH`` symbols. A symbol's interval is that of the
first prediction that names it, so a decoder looks at the two named symbols
first and finds all others by one look into a table of order 0's slots.

The mix drives a range coder of 64-bit state and 32-bit output words, whose
carries are added to the words when a block is done. Blocks are independent, so numpy codes one symbol of every block at a
time. A decoder runs ``Models`` symbol by symbol. An encoder has all symbols
before it, so it finds what a context named at every step by sorting the steps
by context, and computes all intervals between two refreshes at once with the
same ``Models``; only the coder's two numbers a block go from symbol to symbol.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES = 4096, 1024
JOINT = 4096  # lanes of several files that are decoded in step
TOGETHER = 64  # blocks whose intervals an encoder computes at once: what a processor's cache holds
#: Bits of a mixed probability, of a trust, and the bits of order 0's slots.
TOTAL, TRUST, SLOTS_LEAST, SLOTS_MOST = 16, 12, 10, 14
REFRESH = 1024
FLAGS = 1 << 17  # ids below it are ranked by a table instead of a sort
SLOTS2 = 1 << 12
TOP = np.uint64(1 << 32)
LOW32 = np.uint64((1 << 32) - 1)
WORD = np.uint64(32)
MAGIC = b"RLTK\x03"
HEAD = "<QIIII"


class Models:
    """The predictions of k blocks; every array has a row for each block, and shorter blocks come last."""

    def __init__(self, sizes: np.ndarray, decoding: bool):
        k, self.m = len(sizes), int(sizes.max())
        self.sizes, self.decoding = sizes.astype(np.int64), decoding
        lane = np.arange(k, dtype=np.int64)
        # what is computed with is 64 bits wide, since numpy converts mixed widths slowly; what is only looked up is narrow
        self.bits = np.clip(np.ceil(np.log2(4.0 * sizes)), SLOTS_LEAST, SLOTS_MOST).astype(np.int64)
        self.slots = 1 << int(self.bits.max())
        self.counts = (np.arange(self.m) < sizes[:, None]).astype(np.int32)
        self.at1, self.at2, self.at_s, self.at_m, self.at_c = lane * (self.m + 1), k * (self.m + 1) + lane * SLOTS2, lane * self.slots, lane * self.m, lane * 8
        # hits and tries of a confidence, for each order and block
        self.tries = np.zeros((2, k, 8))
        self.hits = np.zeros((2, k, 8))
        self.parts = np.zeros((k, self.m), np.uint32)
        self.slot = np.zeros((k, self.slots), np.uint16) if decoding else None
        self.step, self.next = 0, 64
        self.seen: list[tuple] = []  # what was named with which confidence, and what came; rows are steps
        self.renew()

    def renew(self) -> None:
        """Order-0 intervals and weights from what was counted so far."""
        k = len(self.sizes)
        if self.seen:
            named, came = (np.concatenate(x, axis=-2) for x in zip(*self.seen))
            self.seen.clear()
            for at in range(0, k, TOGETHER):
                near = slice(at, at + TOGETHER)
                e, sym = named[..., near], came[:, near].astype(np.int64)
                w = sym.shape[1]
                rows = np.arange(w) * 8
                for order in (0, 1):
                    q, hit = (e[order] & 7) + rows, e[order] >> 3 == sym
                    self.tries[order, near] += np.bincount(q.reshape(-1), minlength=8 * w).reshape(w, 8)
                    self.hits[order, near] += np.bincount(q[hit], minlength=8 * w).reshape(w, 8)
                self.counts[near] += 24 * np.bincount((sym + np.arange(w) * self.m).reshape(-1), minlength=w * self.m).reshape(w, self.m).astype(np.int32)
        guess = np.linspace(0.1, 0.9, 8)
        # from 1/256 to 63/64, so that no interval is empty
        trust = np.maximum((self.hits + 2 * guess) / (self.tries + 2) * ((1 << TRUST) - 64), 16).astype(np.int64)
        named = ((1 << TOTAL) - (1 << self.bits))[:, None]  # order 0 keeps a part for every slot
        weight2 = (named * trust[1]) >> TRUST
        # the weights of order 2 and of both orders, by confidences
        self.weight2 = weight2.reshape(-1)
        self.weights = (weight2[:, :, None] + (((named - weight2)[:, :, None] * trust[0][:, None, :]) >> TRUST)).reshape(-1)
        # the parts of each symbol, one slot at least, as start << 16 | size
        for at in range(0, k, TOGETHER):
            near = slice(at, at + TOGETHER)
            sizes, bits = self.sizes[near], self.bits[near]
            sums = np.cumsum(self.counts[near], axis=1, dtype=np.int64)
            room = (1 << bits) - sizes
            cum = np.zeros((len(sizes), self.m + 1), np.int64)
            cum[:, 1:] = (sums * (room / sums[:, -1])[:, None] + 1e-6).astype(np.int64)
            cum[:, 1:] += np.minimum(np.arange(1, self.m + 1), sizes[:, None])
            size = cum[:, 1:] - cum[:, :-1]
            self.parts[near] = cum[:, :-1] << 16 | size
            if self.decoding:
                own = np.arange(self.slots) < (1 << bits)[:, None]
                self.slot[near][own] = np.repeat(np.tile(np.arange(self.m, dtype=np.uint16), len(sizes)), size.reshape(-1))

    def weigh(self, e: np.ndarray, k: int) -> None:
        """What order 1 and 2 name, and the weights: up to ``a`` for order 2's, to ``ab`` for order 1's, ``rest`` for order 0; the last axis is the blocks."""
        self.s, c = e >> 3, e & 7
        at = self.at_c[:k] + c[1]
        self.ab = self.weights.take((at << 3) + c[0])
        self.a = np.where(self.s[0] == self.s[1], self.ab, self.weight2.take(at))
        self.rest = (1 << TOTAL) - self.ab

    def interval(self, k: int, sym: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = self.parts.reshape(-1).take(self.at_m[:k] + sym).astype(np.int64)
        first, bits = part >> 16, self.bits[:k]
        low = (first * self.rest) >> bits
        high = ((first + (part & 0xFFFF)) * self.rest) >> bits
        hit1, hit2 = hit
        start = np.where(hit2, 0, np.where(hit1, self.a, self.ab + low))
        size = np.where(hit2, self.a, np.where(hit1, self.ab - self.a, high - low))
        return start.view(np.uint64), size.view(np.uint64)

    def stepped(self, n: int, came: np.ndarray, named: np.ndarray) -> None:
        """Counts what was named and came in the last steps; a row a step."""
        self.seen.append((named, came))
        self.step += len(came)
        if self.step == self.next and self.step < n:
            self.next += min(self.step, REFRESH)
            self.renew()

    def intervals(self, symbols: np.ndarray, out: tuple[np.ndarray, np.ndarray]) -> None:
        """The intervals of all symbols (a row a step, a column a block) into ``out``, as a decoder finds them one by one."""
        n, k = symbols.shape
        named = np.empty((2, n, k), np.uint16)
        before = np.empty((2, n, k), np.int64)
        before[:] = self.sizes
        before[0, 1:], before[1, 2:] = symbols[:-1], symbols[:-2]
        follow(before[0], symbols, named[0])
        follow(hashed(*before), symbols, named[1])
        while self.step < n:
            at = slice(self.step, min(n, self.next))
            sym = symbols[at]
            self.weigh(named[:, at].astype(np.int64), k)
            for whole, part in zip(out, self.interval(k, sym, self.s == sym)):
                whole[at] = part
            self.stepped(n, sym, named[:, at])


def hashed(prev1: np.ndarray, prev2: np.ndarray) -> np.ndarray:
    return (prev1 * 40503 + prev2 * 10007) & (SLOTS2 - 1)


def follow(context: np.ndarray, symbols: np.ndarray, out: np.ndarray) -> None:
    """What each step's context named, as in ``Models.table``: the symbol that followed it last, and how often in a row by then."""
    n, k = symbols.shape
    context = np.ascontiguousarray(context.T.astype(np.uint16))
    place = np.argsort(context, axis=1, kind="stable")
    place += np.arange(0, n * k, n)[:, None]
    place = place.reshape(-1)
    keys, sym = context.reshape(-1).take(place), symbols.T.astype(np.uint16).reshape(-1).take(place)
    begins = np.ones(n * k, bool)
    np.not_equal(keys[1:], keys[:-1], out=begins[1:])
    begins[::n] = True
    last = np.zeros(n * k, np.uint16)
    last[1:] = sym[:-1]
    last[begins] = 0  # a context names symbol 0 before it is met
    # confidence: the steps since the one that missed, or since the first
    anew = begins
    anew[1:] |= (sym != last)[:-1]
    at = np.arange(n * k, dtype=np.int32)
    sure = at - np.maximum.accumulate(at * anew)
    named = np.empty(n * k, np.uint16)
    named[place] = last << 3 | np.minimum(sure, 7).astype(np.uint16)
    out[:] = named.reshape(k, n).T


def encode_lanes(symbols: list[np.ndarray], sizes: np.ndarray) -> list[bytes]:
    """The coded words of each block; the blocks come longest first."""
    k = len(symbols)
    lens = np.array([len(s) for s in symbols])
    n = int(lens[0])
    starts, parts = np.empty((n, k), np.uint64), np.empty((n, k), np.uint64)
    for at in range(0, k, TOGETHER):
        near = slice(at, at + TOGETHER)
        grid = np.zeros((len(symbols[near]), n), np.int64)
        for row, s in zip(grid, symbols[near]):
            row[: len(s)] = s
        Models(sizes[near], decoding=False).intervals(np.ascontiguousarray(grid.T), (starts[:, near], parts[:, near]))
    low, span = np.zeros(k, np.uint64), np.full(k, 2**64 - 1, np.uint64)
    made = np.zeros(k, np.int64)  # words of each block
    lanes: list[np.ndarray] = []
    words: list[np.ndarray] = []
    carries: list[tuple] = []  # block, and how many words it had
    active = np.searchsorted(-lens, -np.arange(n), "left").tolist()
    for t, w in enumerate(active):
        r = span[:w] >> np.uint64(TOTAL)
        more = r * starts[t, :w]
        low[:w] += more
        np.multiply(r, parts[t, :w], out=span[:w])
        over = (low[:w] < more).nonzero()[0]
        if len(over):
            carries.append((over, made[over]))
        at = (span[:w] < TOP).nonzero()[0]
        if len(at):
            lo = low[at]
            lanes.append(at)
            words.append(lo >> WORD)
            low[at] = lo << WORD
            span[at] <<= WORD
            made[at] += 1
    for _ in range(2):
        lanes.append(np.arange(k))
        words.append(low >> WORD)
        low <<= WORD
    lane = np.concatenate(lanes)
    order = np.argsort(lane.astype(np.uint16) if k <= 1 << 16 else lane, kind="stable")
    value = np.concatenate(words)[order]
    cuts = np.append(0, np.cumsum(made + 2))
    if carries:
        block, count = (np.concatenate(x) for x in zip(*carries))
        value += np.bincount(cuts[block] + count - 1, minlength=len(value)).astype(np.uint64)
        while len(over := np.flatnonzero(value >= TOP)):
            value[over] -= TOP
            value[over - 1] += np.uint64(1)
    return [x.tobytes() for x in np.split(value.astype("<u4"), cuts[1:-1])]


def decode_lanes(data: list[bytes], lens: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The symbols of each block; the blocks come longest first."""
    k = len(data)
    words = np.concatenate([np.frombuffer(d + bytes(16), "<u4") for d in data]).astype(np.uint64)
    at_word = np.concatenate([[0], np.cumsum([len(d) // 4 + 4 for d in data])])[:-1].astype(np.int64)
    model = Models(sizes, decoding=True)
    # order 1's and order 2's named symbols, as symbol << 3 | confidence; a pair of rows is order 1 and order 2
    table = np.zeros(k * (model.m + 1) + k * SLOTS2, np.uint16)
    span, code = np.full(k, 2**64 - 1, np.uint64), (words[at_word] << WORD) | words[at_word + 1]
    at_word += 2
    prev1 = prev2 = model.sizes
    n = int(lens[0])
    grid = np.zeros((n, k), np.uint16)
    names = np.zeros((2, min(n, max(REFRESH, 64)), k), np.uint16)
    width, kept = k, 0
    active = np.searchsorted(-lens, -np.arange(n), "left").tolist()
    at, slot = np.zeros((2, k), np.int64), model.slot.reshape(-1)
    at1, at2, at_s, bits = model.at1, model.at2, model.at_s, model.bits
    for t, w in enumerate(active):
        if w != width:
            width, at, span, code, prev1, prev2 = w, at[:, :w].copy(), span[:w], code[:w], prev1[:w], prev2[:w]
            at1, at2, at_s, bits = at1[:w], at2[:w], at_s[:w], bits[:w]
        np.add(at1, prev1, out=at[0])
        np.add(at2, hashed(prev1, prev2), out=at[1])
        raw = table.take(at)
        e = raw.astype(np.int64)
        model.weigh(e, w)
        r = span >> np.uint64(TOTAL)
        target = (code // r).view(np.int64)
        past = np.maximum(target, model.ab) - model.ab
        other = slot.take(at_s + (((past + 1) << bits) - 1) // model.rest).astype(np.int64)
        sym = np.where(target < model.a, model.s[1], np.where(target < model.ab, model.s[0], other))
        hit = model.s == sym
        start, size = model.interval(w, sym, hit)
        code -= r * start
        span = r * size
        small = (span < TOP).nonzero()[0]
        if len(small):
            place = at_word[small]
            span[small] <<= WORD
            code[small] = (code[small] << WORD) | words.take(place)
            at_word[small] = place + 1
        table[at] = np.where(hit, np.minimum(e + 1, e | 7), sym << 3).astype(np.uint16)
        prev1, prev2 = sym, prev1
        grid[t, :w] = sym
        names[:, kept, :w] = raw
        kept += 1
        if t + 1 == model.next or kept == names.shape[1]:
            model.stepped(n, grid[t + 1 - kept : t + 1], names[:, :kept].copy())
            kept = 0
    return [grid[: lens[i], i] for i in range(k)]


def pack_alphabet(ids: np.ndarray) -> bytes:
    """Sorted distinct ids as gaps: a byte each, 255 and four bytes where a byte is too small."""
    gaps = np.diff(ids, prepend=-1) - 1
    out = gaps.clip(max=255).astype(np.uint8)
    wide = np.flatnonzero(gaps >= 255)
    return struct.pack("<II", len(ids), len(wide)) + out.tobytes() + gaps[wide].astype("<u4").tobytes()


def unpack_alphabet(data: bytes) -> np.ndarray:
    n, wide = struct.unpack_from("<II", data)
    gaps = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(data, "<u4", wide, 8 + n)
    return np.cumsum(gaps + 1) - 1


def ranked(block: np.ndarray, seen: np.ndarray | None, ranks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a block, ascending, and the rank of each of its ids; ``seen``, all false, and ``ranks`` have a place for every id unless ids are large."""
    if seen is None:
        return np.unique(block, return_inverse=True)
    seen[block] = True
    alphabet = np.flatnonzero(seen)
    seen[alphabet] = False
    ranks[alphabet] = np.arange(len(alphabet))
    return alphabet, ranks.take(block)


def encode(ids: np.ndarray, note: bytes = b"", block: int = BLOCK, lanes: int = LANES) -> bytes:
    """Ids (below 2**31) as bytes: a head, a checked note, a directory of blocks, and the blocks.

    Few ids make shorter blocks rather than fewer of them, so that a file is coded in step.
    """
    if block > 1 << (SLOTS_MOST - 1):
        raise ValueError("a block holds at most half as many ids as order 0 has slots")
    ids = np.ascontiguousarray(ids, "<u4")
    block = max(min(block, 1024), min(block, -(-len(ids) // lanes)))
    blocks = [ids[a : a + block] for a in range(0, len(ids), block)]
    made = []
    most = int(ids.max()) + 1 if len(ids) else 0
    seen, ranks = (np.zeros(most, bool), np.zeros(most, np.uint16)) if most <= FLAGS else (None, None)
    for at in range(0, len(blocks), lanes):
        group = sorted(enumerate(blocks[at : at + lanes]), key=lambda x: -len(x[1]))
        alphabets, symbols = zip(*(ranked(b, seen, ranks) for _, b in group))
        coded = encode_lanes(list(symbols), np.array([len(a) for a in alphabets]))
        done = {i: (len(b), zlib.crc32(b), pack_alphabet(a.astype(np.int64)), c) for (i, b), a, c in zip(group, alphabets, coded)}
        made += [done[i] for i in range(len(group))]
    head = [MAGIC, struct.pack(HEAD, len(ids), len(made), len(note), zlib.crc32(note), lanes), note]
    head += [struct.pack("<IIII", n, crc, len(a), len(c)) for n, crc, a, c in made]
    return b"".join([*head, *(x for _, _, a, c in made for x in (a, c))])


class Coded:
    """A file's parts: the note, and of each block how many ids, their checksum, the distinct ids and the coded words."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file of this format")
        self.total, n, note_size, note_crc, _ = struct.unpack_from(HEAD, data, len(MAGIC))
        at = len(MAGIC) + struct.calcsize(HEAD)
        self.note = data[at : at + note_size]
        if zlib.crc32(self.note) != note_crc:
            raise ValueError("the note is damaged")
        at += note_size
        directory = [struct.unpack_from("<IIII", data, at + 16 * i) for i in range(n)]
        at += 16 * n
        self.blocks = []
        for size, crc, a, c in directory:
            self.blocks.append((size, crc, data[at : at + a], data[at + a : at + a + c]))
            at += a + c


def decode_blocks(blocks: list[tuple]) -> list[np.ndarray]:
    """The ids of blocks, of whatever files, all in step."""
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    out: list = [None] * len(blocks)
    try:
        alphabets = [unpack_alphabet(blocks[i][2]) for i in order]
        symbols = decode_lanes([blocks[i][3] for i in order], np.array([blocks[i][0] for i in order]), np.array([len(a) for a in alphabets]))
        for i, a, s in zip(order, alphabets, symbols):
            out[i] = a[s].astype("<u4")
    except (IndexError, struct.error) as e:
        raise ValueError("a block is damaged") from e
    for i, got in enumerate(out):
        if zlib.crc32(got) != blocks[i][1]:
            raise ValueError(f"block {i} is damaged")
    return out


def decode_all(files: list[bytes]) -> list[tuple[np.ndarray, bytes]]:
    """The ids and the notes that ``encode`` was given; raises if a checksum differs. Files are decoded side by side."""
    coded = [Coded(data) for data in files]
    blocks = [b for c in coded for b in c.blocks]
    got = [ids for at in range(0, len(blocks), JOINT) for ids in decode_blocks(blocks[at : at + JOINT])]
    out, at = [], 0
    for c in coded:
        ids = np.concatenate([np.zeros(0, "<u4"), *got[at : at + len(c.blocks)]])
        at += len(c.blocks)
        if len(ids) != c.total:
            raise ValueError("the file is cut short")
        out.append((ids, c.note))
    return out


def decode(data: bytes) -> tuple[np.ndarray, bytes]:
    return decode_all([data])[0]
