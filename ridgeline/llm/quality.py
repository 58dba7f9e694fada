"""Operator 4: quality rules with adaptive thresholds from mergeable quantile sketches.

Base counts of each whole text come from numpy over its bytes. The verdict
replaces fixed cutoffs: for each (language, source) group a sketch of every
ratio is built where the rows are, small sketches are merged, and a document
fails a ratio that lies beyond its group's fence, ``reach`` times the spread
between two quantiles above the upper one (and below the lower one where both
directions count). A sketch counts values by the power of ``GROWTH`` above them, so
its quantiles are right to half a percent; merging adds counts, so it is the same
whatever the order and the partitions, and so is every verdict. A group's own
sketch counts only from ``least`` documents on; smaller groups use the sketch of
their language, merged from its sources, and small languages that of the corpus.
Sketches are merged, never documents: a source with a third of all rows costs one
sketch a task, of at most ``(HIGHEST - LOWEST) / log GROWTH`` counts.

Defined results. Null or empty text, or no word: all counts 0, base_failed and
not kept. Null language or source: a group of its own. Repeated rows: a result
each. Empty table: empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import Saved, pieces, raw_text, small_batches, table

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The contract's symbols.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: The ratios that are judged: (name, also a lower fence, least spread). The least spread keeps a group of
#: near-equal values from calling a harmless difference an outlier.
RATIOS = [("chars_per_word", True, 0.8), ("symbols_per_word", False, 0.05), ("dup_lines_per_word", False, 0.01), ("repeat_share", False, 0.08)]
IS_BREAK = np.arange(256) == 10
#: A sketch's cells: powers of GROWTH between e^LOWEST and e^HIGHEST; anything smaller is 0.
GROWTH, LOWEST, HIGHEST = 1.01, -14, 14


def same_hash_twice(keys: np.ndarray) -> np.ndarray:
    """True where a value occurs twice or more."""
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[back] > 1


def count(col: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of every text of a column."""
    data, ends = raw_text(col)
    n = len(col)
    z = np.zeros(n, np.int64)
    if not len(data):
        return {c: z for c in COUNTS}
    starts, stops, doc = W.spans(data, ends)
    out = {"n_words": np.bincount(doc, minlength=n)}
    run = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    # code points: bytes that do not continue one
    points = run((data & 0xC0) != 0x80)
    out["word_chars"] = np.bincount(doc, points[stops] - points[starts], minlength=n).astype(np.int64)
    marks = run(SYMBOLS[data])
    out["n_symbols"] = marks[ends[1:]] - marks[ends[:-1]]
    # 3-word windows: all words of a window that occurs twice in the text count
    hashes = W.span_hashes(data, starts, stops)
    repeat = z.copy()
    first = np.concatenate([[0], np.cumsum(out["n_words"])])
    tri = W.mix((hashes[:-2] * W.STEP[1] + hashes[1:-1]) * W.STEP[2] + hashes[2:]) if len(hashes) > 2 else hashes[:0]
    for i in np.flatnonzero(out["n_words"] >= 3):
        twice = same_hash_twice(tri[first[i] : first[i + 1] - 2])
        if twice.any():
            words = np.zeros(len(twice) + 2, bool)
            for k in range(3):
                words[k : k + len(twice)] |= twice
            repeat[i] = words.sum()
    out["n_repeat_words"] = repeat
    # lines with a word, equal to an earlier one
    ls, le, ldoc = W.spans(data, ends, IS_BREAK)
    worded = run(~W.IS_SPACE[data])
    full = worded[le] > worded[ls]
    ls, le, ldoc = ls[full], le[full], ldoc[full]
    keys = W.mix(W.span_hashes(data, ls, le) + ldoc.astype(W.U) * W.STEP[3])
    _, at = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[at] = False
    out["n_dup_lines"] = np.bincount(ldoc[later], minlength=n)
    return out


def counter(batches):
    for batch in pieces(batches):
        got = count(batch.column("text"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], [*(c for c in batch.schema.names if c != "text"), *COUNTS])


def base_counts(documents: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the base counts of every row; the text is read, not returned."""
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} long" for c in COUNTS)])
    return documents.select(*keep, "text").mapInArrow(counter, schema)


def cell(ratio: str):
    """The cell of a ratio; null for 0."""
    log = F.greatest(F.least(F.log(F.col(ratio)), F.lit(float(HIGHEST))), F.lit(float(LOWEST)))
    return F.when(F.col(ratio) > math.exp(LOWEST), F.ceil(log / math.log(GROWTH)).cast("int"))


def quantiles(cells: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """keys, r, n and the values at two quantiles of merged sketches (keys, r, cell, n)."""
    merged = cells.groupBy(*keys, "r", "cell").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "r")
    so_far = F.sum("n").over(own.orderBy(F.asc_nulls_first("cell")).rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("cell").isNull(), 0.0).otherwise(F.pow(F.lit(GROWTH), F.col("cell")) * (2 / (1 + GROWTH)))
    at = merged.select(*keys, "r", so_far.alias("so_far"), F.sum("n").over(own).alias("n"), value.alias("value"))
    return at.groupBy(*keys, "r").agg(F.max("n").alias("n"), *(F.min(F.when(F.col("so_far") >= q * F.col("n"), F.col("value"))).alias(name) for q, name in ((low, "a"), (high, "b"))))


def fences(rows: DataFrame, low: float, high: float, reach: float, least: int) -> DataFrame:
    """lang, source and an array of (lower, upper) for each ratio.

    One sketch a ratio and group is aggregated where the rows are; those of a
    language and of the corpus are merged from them.
    """
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("r"), cell(r).alias("cell")) for i, (r, _, _) in enumerate(RATIOS)))).alias("x")
    cells = Saved(rows.select("lang", "source", each).groupBy("lang", "source", "x.r", "x.cell").agg(F.count("*").alias("n")), "sketches").df

    def bounds(keys: list[str], least: int, tag: str) -> DataFrame:
        q = quantiles(cells, keys, low, high)
        cols = []
        for i, (r, both, spread) in enumerate(RATIOS):
            a, b = (F.max(F.when(F.col("r") == i, F.col(c))) for c in ("a", "b"))
            room = reach * F.greatest(b - a, F.lit(spread))
            cols.append(F.struct((a - room if both else F.lit(float("-inf"))).alias("low"), (b + room).alias("high")).alias(r))
        return q.groupBy(*keys).agg(F.when(F.max("n") >= least, F.struct(*cols)).alias(tag))

    of_lang = bounds(["lang"], least, "by_lang").withColumnRenamed("lang", "l")
    of_all = bounds([], 1, "by_all").withColumn("one", F.lit(1))
    own = bounds(["lang", "source"], least, "own").join(of_lang, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("one", F.lit(1)).join(of_all, "one", "left")
    return own.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.coalesce("own", "by_lang", "by_all").alias("fence"))


def quality_rules(documents: DataFrame, low: float = 0.1, high: float = 0.9, reach: float = 3.0, least: int = 100) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the ratios for every row of ``documents``."""
    small_batches(documents.sparkSession)
    counted = Saved(base_counts(documents, ["doc_id", "lang", "source"]), "counts").df
    n = F.greatest("n_words", F.lit(1))
    rows = counted.select(
        "*", (F.col("word_chars") / n).alias("chars_per_word"), (F.col("n_symbols") / n).alias("symbols_per_word"), (F.col("n_dup_lines") / n).alias("dup_lines_per_word"), (F.col("n_repeat_words") / n).alias("repeat_share"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )
    fence = fences(rows.where(~F.col("base_failed")), low, high, reach, least)
    rows = rows.join(fence, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    inside = F.lit(True)
    for r, _, _ in RATIOS:
        inside &= F.col(r).between(F.col(f"fence.{r}.low"), F.col(f"fence.{r}.high"))
    return rows.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), *(r for r, _, _ in RATIOS))


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def brute_verdicts(rows: list[tuple], low: float = 0.1, high: float = 0.9, reach: float = 3.0, least: int = 100) -> list[bool]:
    """The verdicts of (text, lang, source) in plain Python, for tests."""
    counts = [brute(t) for t, _, _ in rows]
    ratios = [(c / max(w, 1), s / max(w, 1), d / max(w, 1), r / max(w, 1)) for w, c, s, d, r in counts]
    sound = [w >= 50 and 100 * r <= 50 * w for w, _, _, _, r in counts]

    def fence(pick, r):
        values = sorted(math.ceil(math.log(ratios[i][r]) / math.log(GROWTH)) if ratios[i][r] > math.exp(LOWEST) else -(10**9) for i in pick)
        a, b = (0.0 if k == -(10**9) else GROWTH**k * 2 / (1 + GROWTH) for k in (values[max(0, math.ceil(q * len(values)) - 1)] for q in (low, high)))
        room = reach * max(b - a, RATIOS[r][2])
        return a - room if RATIOS[r][1] else -math.inf, b + room

    out = []
    for i, (_, lang, source) in enumerate(rows):
        groups = [[j for j, row in enumerate(rows) if sound[j] and same(row)] for same in (lambda row: row[1:] == (lang, source), lambda row: row[1] == lang)]
        pick = next((g for g in groups if len(g) >= least), [j for j in range(len(rows)) if sound[j]])
        out.append(sound[i] and all(lo <= ratios[i][r] <= hi for r in range(len(RATIOS)) for lo, hi in [fence(pick, r)]))
    return out


def brute(text: str | None) -> tuple:
    """The base counts of one text in plain Python, for tests."""
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = {t: tri.count(t) for t in set(tri)} if len(tri) < 3000 else __import__("collections").Counter(tri)
    hit = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)
