"""Operator 13: personal data by rules and a character tagger.

The base rules are the contract's patterns; each is written so that a text is
walked once. The tagger (bidirectional LSTM with CRF transitions, in numpy) is
trained from labelled spans: windows around base matches, and windows around
digits that are none, ``PER_KIND`` of each by hash (a bounded, documented sample),
with the spans rewritten in the ways in which people write them differently
(no plus, other separators, "at" for the sign, two spans side by side) and digits
changed. It then reads every place near a digit, a sign or a written-out "at":
such stretches are cut into overlapping windows, each is decoded, a span that
touches the edge of a window is left to the next one, and all windows' spans of
a text are reconciled at once: the set without overlaps that has the most
probability. An exact check follows (checksum, parts, lengths). The tagger adds
spans beside base ones and never takes one away.

Defined results. Null or empty text: no spans. Repeated rows: a result each. No
labelled span in the table: base spans only. Empty table: empty result. Texts that
have no digit, sign or written-out "at" are not given to the tagger.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, table
from .tagger import KINDS, OTHER, PAD, Tagger, symbols

#: The contract's patterns. Each begins where a run of its symbols does, which finds the same leftmost matches.
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What the tagger looks at: digits, the sign, and "at" where it is written out as a sign.
TRIGGER = re.compile(r"[0-9@]+|[\[({<] ?(?:at|AT) ?[\])}>]|\b(?:at|AT) [^\s]{1,40} (?:dot|DOT)\b")
HAS_TRIGGER = r"[0-9@]|[\[({<] ?(?:at|AT) ?[\])}>]|\b(?:at|AT) [^\s]{1,40} (?:dot|DOT)\b"
PER_KIND = 400
WINDOW, STRIDE, MARGIN = 96, 48, 24
SURE = 0.6


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LEFT:
            start -= 1
        m = EMAIL_RIGHT.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end, True
        else:
            end = max(end, at)
        at = text.find("@", max(end, at + 1))


def base_others(text: str):
    """(kind, start, end, good) of the patterns of digits; a match that fails its check is told, not kept."""
    for m in IP.finditer(text):
        yield "ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
    for m in CARD.finditer(text):
        d = digits_of(m.group()) if len(m.group()) <= 40 else ""
        yield "card", m.start(), m.end(), 14 <= len(d) <= 19 and luhn(d)
    for m in PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 10 <= sum(c in "0123456789" for c in m.group()) <= 15


def base(text: str) -> tuple[list[tuple], list[tuple]]:
    """(kind, start, end) that the rules keep, and those that fail their check."""
    found = [("email", a, z, ok) for a, z, ok in base_emails(text)] + list(base_others(text))
    return [f[:3] for f in found if f[3]], [f[:3] for f in found if not f[3]]


def in_order(spans) -> list[tuple]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in in_order(spans))


# --- what the tagger learns from


#: What may be personal though the rules keep nothing there: nine digits or more close together, a written-out "at".
DOUBT = re.compile(r"[0-9](?:[^A-Za-z0-9\n]{0,3}[0-9]){8,}|[\[({<] ?(?:at|AT) ?[\])}>]|\b(?:at|AT) [^\s]{1,40} (?:dot|DOT)\b")


def snippets(text: str, around: int = 40):
    """(kind or none, snippet, its spans): windows around base matches, and around triggers that are part of no match.

    A window that shows something doubtful has no sure labels and is left out.
    """
    good, _ = base(text)
    doubtful = [m.span() for m in DOUBT.finditer(text)]
    doubtful = [(a, z) for a, z in doubtful if not any(s <= a and z <= e for _, s, e in good)]
    sure = lambda lo, hi: not any(a < hi and lo < z for a, z in doubtful)
    for kind, a, z in good:
        lo, hi = max(0, a - around), min(len(text), z + around)
        if z - a <= WINDOW // 2 and sure(lo, hi):
            yield kind, text[lo:hi], [(k, s - lo, e - lo) for k, s, e in good if lo <= s and e <= hi]
    last = -1
    for m in TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - around), min(len(text), m.start() + around)
        if lo >= last and sure(lo, hi) and not any(s < hi and lo < e for _, s, e in good):
            last = hi
            yield "none", text[lo:hi], []


def sampler(batches):
    for batch in pieces(batches):
        rows = []
        for text in texts_with(batch):
            rows += [(kind, snippet, written(spans)) for kind, snippet, spans in snippets(text)]
        if rows:
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(("kind", "snippet", "spans"))})


def texts_with(batch) -> list[str]:
    col = batch.column("text").fill_null("")
    return col.filter(pc.match_substring_regex(col, HAS_TRIGGER)).to_pylist()


def rewritten(r: random.Random, kind: str, s: str) -> str:
    """A span as other people write it, with other digits."""
    fresh = "".join(r.choice("0123456789") if c.isdigit() and kind != "ip" and r.random() < 0.8 else c for c in s)
    if kind == "email":
        left, right = fresh.split("@", 1)
        if r.random() < 0.5:
            return fresh
        at = r.choice([" at ", " [at] ", "[at]", " (at) ", "(at)", " AT ", " @ ", "{at}", "<at>"])
        dot = r.choice([".", " dot ", "[dot]", " [dot] ", "(dot)", " (dot) ", "."])
        return left + at + right.replace(".", dot)
    if kind == "ip":
        return r.choice([".", ".", ".", "[.]", "(.)", " . ", "[.]"]).join(str(r.randrange(256)) for _ in range(4))
    if kind == "card":
        d = digits_of(fresh)
        cut = r.choice([[4, 4, 4, len(d) - 12], [4, 4, 4, len(d) - 12], [len(d)], [len(d)], [4, 6, len(d) - 10]])
        parts, at = [], 0
        for c in cut:
            parts.append(d[at : at + c])
            at += c
        return r.choice([" ", "-", ".", "  ", "/", "_", " - "]).join(parts)
    d = digits_of(fresh)[-10:].rjust(10, "5")
    a, b, c = d[:3], d[3:6], d[6:]
    lead = r.choice(["+1 ", "+44 ", "", "", "", "1 ", "1-", "001 ", "00 1 ", "tel:"])
    body = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}){b}-{c}", f"{a}/{b}-{c}"])
    return lead.replace("tel:", "") + body


def harmless(r: random.Random) -> str:
    """Digits that are nothing of the kind."""
    return r.choice([
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 32, 40)))), lambda: str(r.randrange(10 ** r.choice((1, 2, 4, 5, 6, 8)))),
        lambda: f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02} {r.randrange(24):02}:{r.randrange(60):02}", lambda: f"{r.randrange(30)}.{r.randrange(30)}.{r.randrange(30)}",
        lambda: f"{r.randrange(1000)},{r.randrange(1000):03},{r.randrange(1000):03}", lambda: f"{r.random() * 100:.{r.randrange(1, 8)}f}", lambda: f"{r.randrange(2000)}/{r.randrange(99)}", lambda: str(r.randrange(10**20, 10**24)),
    ])()


def example(r: random.Random, pool: dict[str, list]) -> tuple[str, list[tuple]]:
    """A snippet with its spans rewritten, a second span or something harmless put beside it now and then."""
    kind = r.choice(sorted(pool))
    snippet, spans = r.choice(pool[kind])
    out, made, at = "", [], 0

    def put(k, s):
        nonlocal out
        made.append((k, len(out), len(out) + len(s)))
        out += s

    for k, a, z in in_order(spans):
        if a < at:
            continue
        out += snippet[at:a]
        s = snippet[a:z]
        put(k, rewritten(r, k, s) if r.random() < 0.7 else s)
        at = z
        if r.random() < 0.35:
            k2 = r.choice([k for k in sorted(pool) if k != "none"])
            text2, spans2 = r.choice(pool[k2])
            k2, a2, z2 = r.choice(spans2)
            out += r.choice([" ", " ", ", ", " / ", "\n"])
            put(k2, rewritten(r, k2, text2[a2:z2]) if r.random() < 0.5 else text2[a2:z2])
    out += snippet[at:]
    if not made and r.random() < 0.5:
        at = r.randrange(len(out) + 1)
        out = out[:at] + r.choice([" ", " \"", "="]) + harmless(r) + r.choice([" ", ", ", "\"", ". "]) + out[at:]
    return out, made


def window_of(r: random.Random, text: str, spans: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """A cut of WINDOW symbols with its tags."""
    x = np.full(WINDOW, PAD, np.int64)
    y = np.zeros(WINDOW, np.int64)
    tags = np.zeros(len(text), np.int64)
    for k, a, z in spans:
        tags[a:z] = 2 * KINDS.index(k) + 2
        tags[a] -= 1
    at = r.randrange(max(1, len(text) - WINDOW + 1))
    part = symbols(text)[at : at + WINDOW]
    x[: len(part)], y[: len(part)] = part, tags[at : at + WINDOW]
    return x, y


def learn(pool: dict[str, list], steps: int = 320, batch: int = 48, seed: int = 11) -> Tagger | None:
    """A tagger from (snippet, spans) by kind; None without a labelled span."""
    if not any(pool.get(k) for k in KINDS):
        return None
    pool = {k: v for k, v in pool.items() if v}
    r = random.Random(seed)
    tagger = Tagger()

    def batches():
        for _ in range(steps):
            pairs = [window_of(r, *example(r, pool)) for _ in range(batch)]
            yield np.stack([x for x, _ in pairs]), np.stack([y for _, y in pairs])

    tagger.train(batches())
    return tagger


def pool_of(documents: DataFrame, per_kind: int) -> dict[str, list]:
    """The labelled windows that are learned from: ``per_kind`` of each kind by hash."""
    from pyspark.sql import Window

    got = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(sampler, "kind string, snippet string, spans string")
    order = Window.partitionBy("kind").orderBy(F.xxhash64("snippet", "spans"), "snippet", "spans")
    picked = got.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_kind).orderBy("kind", "n").collect()
    out: dict[str, list] = {}
    for p in picked:
        spans = [(k, int(a), int(z)) for k, a, z in (s.split(":") for s in p["spans"].split(",") if s)]
        out.setdefault(p["kind"], []).append((p["snippet"], spans))
    return out


# --- what it finds


def stretches(text: str) -> list[tuple[int, int]]:
    """What lies near a trigger."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        a, z = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def windows(text: str) -> list[tuple[int, int, int, int]]:
    """(from, to, stretch from, stretch to) of overlapping windows over all stretches."""
    return [(at, min(z, at + WINDOW), a, z) for a, z in stretches(text) for at in range(a, max(a + 1, z - STRIDE), STRIDE)]


def spans_of(tags: np.ndarray, sure: np.ndarray, size: int) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, least probability) of a decoded window."""
    out, i = [], 0
    while i < size:
        if tags[i] == 0:
            i += 1
            continue
        k, j = (tags[i] - 1) // 2, i + 1
        while j < size and tags[j] == 2 * k + 2:
            j += 1
        out.append((KINDS[k], i, j, float(sure[i:j].min())))
        i = j
    return out


def reconcile(found: list[tuple]) -> list[tuple]:
    """The spans without overlaps that have the most probability together (kind, start, end, weight), of a whole text."""
    found = sorted(set(found), key=lambda s: (s[2], s[1], s[0], s[3]))
    ends = [s[2] for s in found]
    best: list[tuple[float, bool]] = [(0.0, False)]
    before = np.searchsorted(ends, [s[1] for s in found], "right") if found else []
    for i, s in enumerate(found):
        take = best[before[i]][0] + s[3]
        best.append((take, True) if take > best[i][0] else (best[i][0], False))
    out, i = [], len(found)
    while i:
        if best[i][1]:
            out.append(found[i - 1][:3])
            i = before[i - 1]
        else:
            i -= 1
    return out[::-1]


AT, DOT = re.compile(r" ?[\[({<]? ?(?:@|\bat\b) ?[\])}>]? ?", re.I), re.compile(r" ?[\[({<]? ?(?:\.|\bdot\b) ?[\])}>]? ?", re.I)
WHOLE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
SEPARATED = re.compile(r"[^0-9]+")


def holds(kind: str, text: str, a: int, z: int) -> bool:
    """The exact check of a span that the tagger proposes."""
    s = text[a:z]
    if (a and text[a - 1].isalnum() and s[0].isalnum()) or (z < len(text) and text[z].isalnum()):
        return False
    if kind == "email":
        return bool(WHOLE_EMAIL.fullmatch(DOT.sub(".", AT.sub("@", s, count=1))))
    if any(c.isalpha() for c in s) or "\n" in s or not s.isascii():
        return False
    parts = re.findall("[0-9]+", s)
    gaps = [g for g in SEPARATED.split(s) if g]
    if kind == "ip":
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and len(set(SEPARATED.findall(s))) == 1
    d = "".join(parts)
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d) and len(set(d)) > 2
    return 10 <= len(d) <= 15 and len(gaps) >= 3 and max(map(len, parts)) <= 7 and not re.fullmatch(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}.*", s)


def trimmed(kind: str, text: str, a: int, z: int) -> tuple[int, int]:
    """Without blanks and marks at the ends."""
    begins = "+(" if kind == "phone" else ""
    while a < z and not (text[a].isalnum() or text[a] in begins):
        a += 1
    while z > a and not text[z - 1].isalnum():
        z -= 1
    return a, z


def propose(tagger: Tagger, texts: list[str], step: int = 512) -> list[list[tuple]]:
    """(kind, start, end) that the tagger finds in each text, after the exact check."""
    jobs = [(i, *w) for i, t in enumerate(texts) for w in windows(t)]
    found: list[list[tuple]] = [[] for _ in texts]
    coded: dict[int, np.ndarray] = {}
    for at in range(0, len(jobs), step):
        part = jobs[at : at + step]
        x = np.full((len(part), WINDOW), PAD, np.int64)
        for row, (i, a, z, _, _) in zip(x, part):
            if i not in coded:
                coded = {i: symbols(texts[i])}
            row[: z - a] = coded[i][a:z]
        tags, sure = tagger.decode(x)
        for (i, a, z, first, last), t, p in zip(part, tags, sure):
            for kind, s, e, weight in spans_of(t, p, z - a):
                if (s == 0 and a > first) or (e == z - a and z < last):
                    continue  # the next window sees it whole
                s, e = trimmed(kind, texts[i], a + s, a + e)
                if weight >= SURE and s < e and holds(kind, texts[i], s, e):
                    found[i].append((kind, s, e, round(weight * (e - s), 6)))
    return [reconcile(f) for f in found]


def finder(tagger: Tagger | None):
    """doc_id and the results of every row."""

    def run(batches):
        for batch in pieces(batches):
            col = batch.column("text").fill_null("")
            hit = np.flatnonzero(np.asarray(pc.match_substring_regex(col, HAS_TRIGGER)))
            texts = [col[int(i)].as_py() for i in hit]
            own = [base(t)[0] for t in texts]
            more = propose(tagger, texts) if tagger else [[] for _ in texts]
            n = {k: np.zeros(len(col), np.int64) for k in KINDS}
            digest = [hashlib.sha256(b"").hexdigest()] * len(col)
            spans = [""] * len(col)
            for i, good, extra in zip(hit, own, more):
                for k, _, _ in good:
                    n[k][i] += 1
                digest[i] = hashlib.sha256(written(good).encode()).hexdigest()
                spans[i] = written(good + [e for e in extra if not any(a < e[2] and e[1] < z for _, a, z in good)])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {f"n_{k}": pa.array(n[k]) for k in KINDS} | {"base_sha256": pa.array(digest, pa.string()), "spans": pa.array(spans, pa.string())})

    return run


def personal_data(documents: DataFrame, per_kind: int = PER_KIND) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of ``documents``."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tagger = learn(pool_of(docs, per_kind))
    return docs.mapInArrow(finder(tagger), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def brute(text: str | None) -> list[tuple]:
    """The base spans by the contract's patterns as they stand, for tests."""
    text, out = text or "", []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            d = digits_of(m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return in_order(out)
