"""Operator 3: language ID by interpolated Kneser-Ney character models.

One model a language, order 4 over the letters themselves, as UTF-16 units
(a letter beyond the first 65,536 is two of them), and one space for whatever
is not a letter. So a 4-gram is exactly one 64-bit key, of any script. Counts
are gathered from every training row, summed where the rows are and then in
Spark; the model has an entry for each n-gram that the corpus has, so it grows
as a language's n-grams do, and passes through the driver. Each order is a
sorted array of keys: the n-grams that any language has, and a matrix of final
log probabilities with a column for each language, so a lookup scores all
languages at once.

The language with the lowest length-normalised cross-entropy wins. Rejection
is calibrated: a document is rejected if its cross-entropy exceeds the
``tail`` quantile of the training documents given the same language by more
than ``slack`` nats (more for short texts).

Defined results. Null text or no letter: ``und``, score 0, rejected. No
training rows: every text is ``und``. Repeated rows: a result each. Null
languages are not learned. A null doc_id is not held out and not learned
from. Empty table: empty result.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, pieces, release, small_batches, table

ORDER, BITS = 4, 16
U = np.uint64


def low_units(k: int) -> np.uint64:
    """The mask of the last k symbols of a key."""
    return U((1 << (BITS * k)) - 1)


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_letters = None


def symbols(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, bounds, letters): the units of the texts one after another, 0 for other characters, runs of 0 cut to one; each starts with a 0."""
    global _letters
    if _letters is None:
        _letters = letter_table()
    col = pc.utf8_lower(col.fill_null(""))
    points = np.frombuffer("".join(col.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = pc.utf8_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.where(_letters[points], points, 0)
    wide = points > 0xFFFF
    codes = points.astype(np.uint16)
    if wide.any():  # two units each
        doc = np.repeat(np.arange(len(lens)), lens)
        lens = lens + np.bincount(doc[wide], minlength=len(lens))
        codes = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-16-le", "surrogatepass"), np.uint16)
    ends = np.concatenate([[0], np.cumsum(lens)])
    s = np.zeros(len(codes) + len(lens), np.uint16)
    doc = np.repeat(np.arange(len(lens)), lens)
    s[np.arange(len(codes)) + doc + 1] = codes
    starts = ends[:-1] + np.arange(len(lens))
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    keep[starts] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    bounds = np.concatenate([total[starts], total[-1:]])
    letters = np.concatenate([[0], np.cumsum(s != 0)])
    own = letters[np.append(starts[1:], len(s))] - letters[starts]
    return s[keep], bounds, own


def grams(s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams that end at each symbol after a text's first (padded with 0), and their bounds."""
    w = s.astype(U)
    at = np.arange(len(s)) - np.repeat(bounds[:-1], np.diff(bounds))
    g = w.copy()
    for k in range(1, ORDER):
        prev = np.zeros_like(w)
        prev[k:] = w[:-k]
        g |= np.where(at >= k, prev, U(0)) << U(BITS * k)
    return g[at > 0], bounds - np.arange(len(bounds))


def count_grams(batches):
    """(lang, gram, n) of all texts of a task; sums are merged as they grow."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def merge(lang, keys, n):
        if lang in held:
            keys, n = np.concatenate([held[lang][0], keys]), np.concatenate([held[lang][1], n])
            keys, back = np.unique(keys, return_inverse=True)
            n = np.bincount(back, n).astype(np.int64)
        held[lang] = keys, n

    for batch in pieces(batches, most=2 << 20):
        g, bounds = grams(*symbols(batch.column("text"))[:2])
        langs = batch.column("lang").to_pylist()
        for lang in set(langs):
            parts = [g[bounds[i] : bounds[i + 1]] for i, x in enumerate(langs) if x == lang]
            merge(lang, *np.unique(np.concatenate(parts), return_counts=True))
    for lang, (keys, n) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def discount(n: np.ndarray) -> float:
    one, two = (n == 1).sum(), (n == 2).sum()
    return float(one / (one + 2 * two)) if one and two else 0.5


class Kneser:
    """Interpolated Kneser-Ney of one language: probabilities of all n-grams of an order."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, symbols: int):
        self.tables = []  # from the lowest order
        self.symbols = symbols
        order = np.argsort(keys)
        counts = (keys[order], n[order].astype(np.int64))
        orders = [counts]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
            low, c = np.unique(orders[-1][0] & low_units(k), return_counts=True)
            orders.append((low, c))
        for keys, n in reversed(orders):
            d = discount(n)
            ctx, back, types = np.unique(keys >> U(BITS), return_inverse=True, return_counts=True)
            total = np.bincount(back, n)
            self.tables.append({"keys": keys, "p": np.maximum(n - d, 0) / total[back], "ctx": ctx, "bow": d * types / total})

    def prob(self, order: int, grams: np.ndarray) -> np.ndarray:
        """P(last symbol | the others) for n-grams of ``order`` symbols."""
        if order == 0:
            return np.full(len(grams), 1 / self.symbols)
        t = self.tables[order - 1]
        low = self.prob(order - 1, grams & low_units(order - 1))
        return find(t["keys"], t["p"], grams, 0.0) + find(t["ctx"], t["bow"], grams >> U(BITS), 1.0) * low


def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


class Model:
    """Sorted hash arrays of all languages; unseen n-grams go to the next lower order."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        keys = counts["gram"].to_numpy().astype(np.int64).view(U)
        self.symbols = len(np.unique(keys & low_units(1))) + 1  # one for all that were never seen
        lang, n = counts["lang"].to_numpy(), counts["n"].to_numpy()
        models = [Kneser(keys[lang == x], n[lang == x], self.symbols) for x in self.langs]
        self.orders = []
        for k in range(ORDER, 0, -1):
            keys = np.unique(np.concatenate([m.tables[k - 1]["keys"] for m in models])) if models else np.zeros(0, U)
            logp = np.log(np.stack([m.prob(k, keys) for m in models], axis=1)).astype(np.float32) if models else None
            ctx = np.unique(np.concatenate([m.tables[k - 1]["ctx"] for m in models])) if models else keys
            bow = np.log(np.stack([find(m.tables[k - 1]["ctx"], m.tables[k - 1]["bow"], ctx, 1.0) for m in models], axis=1)).astype(np.float32) if models else None
            self.orders.append((keys, logp, ctx, bow))

    def scores(self, g: np.ndarray) -> np.ndarray:
        """Log probability of each 4-gram in each language."""
        distinct, back = np.unique(g, return_inverse=True)  # sorted, so that lookups run along the array
        keys, logp = self.orders[0][:2]
        at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
        out = logp[at]
        miss = np.flatnonzero(keys[at] != distinct)
        if len(miss):
            out[miss] = self.backed(distinct[miss])
        return out[back]

    def backed(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((len(g), len(self.langs)), np.float32)
        open_ = np.arange(len(g))
        for k in range(ORDER - 1, -1, -1):
            ctx, bow = self.orders[ORDER - 1 - k][2:]
            h = g[open_] >> U(BITS)
            at = np.minimum(np.searchsorted(ctx, h), len(ctx) - 1)
            out[open_] += np.where((ctx[at] == h)[:, None], bow[at], 0)
            g = g & low_units(k)
            if k == 0:
                out[open_] += -np.log(self.symbols)
                break
            keys, logp = self.orders[ORDER - k][:2]
            at = np.minimum(np.searchsorted(keys, g[open_]), len(keys) - 1)
            seen = keys[at] == g[open_]
            out[open_[seen]] += logp[at[seen]]
            open_ = open_[~seen]
            if not len(open_):
                break
        return out


def scorer(model: Model, names: list[str]):
    """``names`` columns, then lang_pred, score, entropy, n_letters of each text."""
    langs = np.array([*model.langs, "und"], dtype=object)

    def run(batches):
        for batch in pieces(batches, most=1 << 20):
            s, bounds, letters = symbols(batch.column("text"))
            g, at = grams(s, bounds)
            n = len(letters)
            ok = (letters > 0) & (len(model.langs) > 0)
            best, score, entropy = np.full(n, len(model.langs)), np.zeros(n), np.zeros(n)
            if ok.any():
                lp = model.scores(g)
                lens = np.diff(at)
                full = np.flatnonzero(lens > 0)
                ce = np.zeros((n, len(model.langs)))
                ce[full] = -np.add.reduceat(lp, at[:-1][full], axis=0, dtype=np.float64) / lens[full, None]
                b = ce.argmin(axis=1)
                low = ce.min(axis=1)
                sure = 1 / np.exp(-(ce - low[:, None]) * np.minimum(lens, 60)[:, None]).sum(axis=1)
                best[ok], score[ok], entropy[ok] = b[ok], sure[ok], low[ok]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(langs[best].tolist(), pa.string()), pa.array(score), pa.array(entropy), pa.array(letters)], [*names, "lang_pred", "score", "entropy", "n_letters"])

    return run


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_id(documents: DataFrame, tail: float = 0.999, slack: float = 1.2, short: float = 20.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected for every row of ``documents`` (doc_id, text, lang)."""
    small_batches(documents.sparkSession)
    learned = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = learned.select("text", "lang").mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = Model(counts.toPandas())  # a row for each n-gram and language
    release(documents.sparkSession)
    docs = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = "doc_id {}, held_out boolean, lang_pred string, score double, entropy double, n_letters long".format(dict(documents.dtypes)["doc_id"])
    scored = Saved(docs.mapInArrow(scorer(model, ["doc_id", "held_out"]), out), "langid").df
    usual = scored.where("not held_out and n_letters > 0").groupBy("lang_pred").agg(F.percentile_approx("entropy", F.lit(tail), F.lit(10_000)).alias("usual"))
    limits = [x for r in usual.collect() for x in (F.lit(r["lang_pred"]), F.lit(r["usual"]))]  # a row a language, as the model has
    limit = F.create_map(*limits)[F.col("lang_pred")] if limits else F.lit(None).cast("double")
    far = F.col("entropy") > limit + slack * (1 + short / F.greatest("n_letters", F.lit(1)))
    rejected = (F.col("lang_pred") == "und") | F.coalesce(far, F.lit(False))
    return scored.select("doc_id", "held_out", "lang_pred", "score", "entropy", rejected.alias("rejected"))


def query(spark, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def brute_prob(counts: dict, history: tuple, symbol: int, symbols: int) -> float:
    """Interpolated Kneser-Ney by the formula over {4-gram tuple: n}, for tests."""
    levels = [dict(counts)]
    for _ in range(ORDER - 1):
        low: dict = {}
        for g in levels[-1]:
            low[g[1:]] = low.get(g[1:], 0) + 1
        levels.append(low)

    def p(k, h):
        if k == 0:
            return 1 / symbols
        level = levels[ORDER - k]
        n = np.array(list(level.values()))
        d = discount(n)
        h = h[len(h) - k + 1 :]
        follow = {g[-1]: c for g, c in level.items() if g[:-1] == h}
        if not follow:
            return p(k - 1, h)
        total = sum(follow.values())
        return max(follow.get(symbol, 0) - d, 0) / total + d * len(follow) / total * p(k - 1, h)

    return p(ORDER, history)


