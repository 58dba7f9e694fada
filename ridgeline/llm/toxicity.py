"""Operator 10: toxicity by class-conditional Kneser-Ney models.

Two models, toxic and ordinary, give every word of a text a probability; the
difference of their log-likelihoods over every occurrence of every word, by
the length in words, is the evidence, and nothing else decides. Both are
interpolated models of the chain word -> stem (the first ``STEM`` bytes) ->
shared counts: a class's discounted count of the word; with the mass that the
discount frees, its discounted count of the stem, shared among the stem's
words by the corpus; with what that frees, the corpus itself, whose
continuation counts (in how many documents does a word occur?) are of *all*
documents, labelled or not.

The discount is absolute, but not one constant: it is what the shared counts
already explain of a class's count, ``SPREAD`` standard deviations of that,
and ``LEAST``. A constant discount lets every rare word speak that chance put
into one class: on the given tables plain Kneser-Ney models of words, and of
pairs of words, find 8 to 33 % of the toxic held-out texts at 2 % false alarms;
these models find 95 to 99 % at 1 %. So rare expressions are smoothed through
the shared backoff counts, whole.

All counts are of documents, a continuation count in Kneser-Ney's sense: a word
that one document repeats counts once. Their keys are whole 64-bit hashes of
words and of stems, in a table that grows with the corpus. Evidence comes only
from what exceeds its discount in a class, so the model holds just those words
and stems, as sorted arrays (32 bytes an entry).
They come in two folds: a learning row is scored by models that
did not count its fold, so the calibration (a logistic curve over the evidence,
fitted to at most ``SAMPLE`` rows) sees evidence like that of new documents.

Defined results. Null or empty text, or no word: no evidence, and the score of
that. Without labels of both classes the score is 0. Repeated labels of a
document: the largest. Repeated documents: a result each. A null doc_id has no
label and is not held out. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Saved, pieces, raw_text, release, table

STEM = 6
#: The logistic curve is fitted to at most so many labelled rows, in the order of a hash.
SAMPLE = 200_000
#: Slots of document ids in the broadcast that keeps unlabelled texts back.
ID_SLOTS = 1 << 20
#: The discount beyond what the shared counts explain: in standard deviations of a count, and in counts.
SPREAD, LEAST = 3.0, 1.0
#: Words are runs of ASCII letters and of bytes above 127.
GAP = np.ones(256, bool)
GAP[65:91] = GAP[97:123] = GAP[128:] = False
COLUMNS = ["df", "t0", "t1", "o0", "o1"]
#: The columns of the toxic and of the ordinary class in the models without fold 0, without fold 1, and of all.
KINDS = [(["t1"], ["o1"]), (["t0"], ["o0"]), (["t0", "t1"], ["o0", "o1"])]


def hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, stem hash, document) of every word."""
    data, ends = raw_text(pc.utf8_lower(col.fill_null("")))
    starts, stops, doc = W.spans(data, ends, GAP)
    word = W.span_hashes(data, starts, stops).view(np.int64)
    stem = W.span_hashes(data, starts, np.minimum(stops, starts + STEM)).view(np.int64)
    return word, stem, doc


def count_words(batches):
    """(level, key, df, t0, t1, o0, o1) of all texts of a task; level 0 words, 1 stems. ``part``: 0 and 1 toxic, 2 and 3 ordinary, by fold; null unlabelled."""
    held: tuple[list, list] = ([], [])

    def merged(level):
        keys, back = np.unique(np.concatenate([k for k, _ in held[level]]), return_inverse=True)
        rows = np.concatenate([v for _, v in held[level]])
        return keys, np.stack([np.bincount(back, rows[:, j], len(keys)) for j in range(5)], axis=1).astype(np.int32)

    def out(level):
        keys, rows = merged(level)
        held[level].clear()
        for at in range(0, len(keys), 100_000):
            k, v = keys[at : at + 100_000], rows[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), level, np.int8)), pa.array(k), *(pa.array(v[:, j].astype(np.int64)) for j in range(5))], ["level", "key", *COLUMNS])

    size = [0, 0]
    for batch in pieces(batches, most=2 << 20):
        *found, doc = hashes(batch.column("text"))
        if not len(doc):
            continue
        part = batch.column("part").fill_null(-1).to_numpy(zero_copy_only=False)
        for level, each in enumerate(found):
            keys, at = np.unique(each, return_inverse=True)
            pair = np.unique(doc * len(keys) + at)
            at, of = pair % len(keys), part[pair // len(keys)]
            held[level].append((keys, np.stack([np.bincount(at, minlength=len(keys)), *(np.bincount(at, of == j, len(keys)) for j in range(4))], axis=1).astype(np.int32)))
            size[level] += len(keys)
            if size[level] > 1_000_000:
                held[level][:] = [merged(level)]
                if len(held[level][0][0]) > 500_000:  # a task's memory is bounded; Spark adds up
                    yield from out(level)
                size[level] = 0
    for level in (0, 1):
        if held[level]:
            yield from out(level)


def discounted(n: np.ndarray, shared: np.ndarray, total: float) -> tuple[np.ndarray, float]:
    """A class's counts less their discounts as shares of ``total``, all its counts, and the mass that this leaves to the lower level."""
    total = max(total, 1)
    explained = shared * total
    x = np.maximum(n - explained - SPREAD * np.sqrt(explained) - LEAST, 0) / total
    return x, float(1 - x.sum())


def ratios(df: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, totals: tuple[float, float], total: float, distinct: int):
    """For each class: what each word (or stem) of the labelled vocabulary adds to P(word | class) over P(word | corpus), and the mass below.

    With x the discounted shares of a word w and of its stem s, and a and b the
    masses that they leave, P(w | class) = x(w) + a (x(s) P(w | s) + b P(w)),
    where P(w | s) and P(w) are the corpus's; so over P(w) it is
    x(w)/P(w) + a (x(s)/P(s) + b). x is 0 outside the labelled vocabulary;
    ``total`` and ``distinct`` are of the whole corpus.
    """
    shared = (df + 1e-3) / (total + 1e-3 * distinct)
    own = [discounted(c, shared, n) for c, n in zip((toxic, ordinary), totals)]
    return [x / shared for x, _ in own], [mass for _, mass in own]


class Model:
    """Evidence by (word, stem) for each fold left out, and for all: sorted keys of a level, and two columns a kind beside them."""

    def __init__(self, counts: pa.Table, totals: dict[int, dict[str, int]]):
        level = counts["level"].to_numpy()
        self.keys, self.arrays, self.mass = [], [], []
        for j in (0, 1):
            own = counts.filter(pa.array(level == j))
            key = own["key"].to_numpy()
            order = np.argsort(key)
            self.keys.append(key[order])
            df, t0, t1, o0, o1 = (own[c].to_numpy()[order] for c in COLUMNS)
            array, mass = np.zeros((len(key) + 1, 3, 2), np.float32), []  # the last row is what no class has seen
            all_ = totals.get(j, dict.fromkeys((*COLUMNS, "n"), 0))
            for kind, (t, o) in enumerate(((t1, o1), (t0, o0), (t0 + t1, o0 + o1))):
                own_totals = [sum(all_[c] for c in group) for group in (KINDS[kind][0], KINDS[kind][1])]
                (array[:-1, kind, 0], array[:-1, kind, 1]), masses = ratios(df, t, o, own_totals, all_["df"], all_["n"])
                mass.append(masses)
            self.arrays.append(array)
            self.mass.append(np.maximum(np.array(mass), 1e-6))  # a column a class

    def find(self, level: int, wanted: np.ndarray) -> np.ndarray:
        """Two columns a kind for each key."""
        keys = self.keys[level]
        at = np.searchsorted(keys, wanted)
        there = at < len(keys)
        there[there] = keys[at[there]] == wanted[there]
        return self.arrays[level][np.where(there, at, len(keys))]

    def evidence(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """Three columns: by the models without fold 0, without fold 1, and of all."""
        x = self.find(0, word) + self.mass[0] * (self.find(1, stem) + self.mass[1])
        return np.log(x[..., 0] / x[..., 1])


def scorer(model: Model):
    """evidence of each text, by the models without fold 0, without fold 1, and of all."""

    def run(batches):
        for batch in pieces(batches, most=2 << 20):
            word, stem, doc = hashes(batch.column("text"))
            n = batch.num_rows
            keys, first, at = np.unique(word, return_index=True, return_inverse=True)
            each = model.evidence(keys, stem[first])
            words = np.maximum(np.bincount(doc, minlength=n), 1)
            out = np.stack([np.bincount(doc, each[at, kind], n) / words for kind in range(3)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * n + 1, 3, dtype=np.int32)), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), lists], ["doc_id", "held_out", "evidence"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic curve (the last is the constant), by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def speaks(totals: dict[int, dict[str, int]]) -> F.Column:
    """Does a row of counts exceed its discount in any model? All others add nothing to a class and stay in Spark."""
    out = F.lit(False)
    for level, all_ in totals.items():
        shared = (F.col("df") + 1e-3) / (all_["df"] + 1e-3 * all_["n"])
        for group in (g for kind in KINDS for g in kind):
            explained = shared * max(1, sum(all_[c] for c in group))
            out |= (F.col("level") == level) & (sum(F.col(c) for c in group) > explained + SPREAD * F.sqrt(explained) + LEAST * (1 - 1e-9))
    return out


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row of ``documents`` (doc_id, text)."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("l_id")))
    fold = F.when(F.col("toxic").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(2))).cast("int")
    # Document counts need no label, so no text moves for them. Labelled texts meet their labels by one shuffle, in
    # front of which a broadcast of id slots (of a fixed number, whatever the corpus) keeps most other texts back.
    schema = "level byte, key long, " + ", ".join(f"{c} long" for c in COLUMNS)
    counted = documents.select("text", F.lit(None).cast("int").alias("part")).mapInArrow(count_words, schema)
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(ID_SLOTS)).cast("int")
    wanted = known.select(slot("l_id").alias("id_slot")).distinct()
    near = documents.select("doc_id", "text", slot("doc_id").alias("id_slot")).join(F.broadcast(wanted), "id_slot", "left_semi")
    labelled = near.join(known.hint("merge"), F.col("doc_id") == F.col("l_id"))
    part = fold + F.when(F.col("toxic") > 0, 0).otherwise(2)
    labelled = labelled.select("text", part.cast("int").alias("part")).mapInArrow(count_words, schema).withColumn("df", F.lit(0).cast("long"))
    sums = Saved(counted.union(labelled).groupBy("level", "key").agg(*(F.sum(c).alias(c) for c in COLUMNS)), "word-counts")
    totals = {r["level"]: r.asDict() for r in sums.df.groupBy("level").agg(*(F.sum(c).alias(c) for c in COLUMNS), F.count("*").alias("n")).collect()}
    model = Model(sums.df.where(speaks(totals)).select("level", "key", *(F.col(c).cast("int") for c in COLUMNS)).toArrow(), totals)
    sums.drop()
    release(documents.sparkSession)
    # the texts meet the labels once, to be counted; scores meet them without texts
    scored = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(scorer(model), "doc_id {}, held_out boolean, evidence array<double>".format(dict(documents.dtypes)["doc_id"]))
    scored = scored.join(known, F.col("doc_id") == F.col("l_id"), "left")
    kind = F.coalesce(fold, F.lit(2)) + 1
    rows = Saved(scored.select("doc_id", "held_out", "toxic", F.element_at("evidence", kind).alias("evidence")), "toxic").df
    fit = rows.where("toxic is not null").orderBy(F.xxhash64("doc_id", F.lit(1))).limit(SAMPLE).select("evidence", "toxic").toPandas()
    y = (fit["toxic"].to_numpy() > 0).astype(float)
    if 0 < y.sum() < len(y):
        a, b = (float(v) for v in logistic(np.cbrt(fit["evidence"]), y))  # evidence is small and its tails are long: roots of it
        score = 1 / (1 + F.exp(-(a * F.cbrt("evidence") + b)))
    else:
        score = F.lit(0.0)
    out = rows.select("doc_id", "held_out", score.alias("score"), "evidence")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def brute(texts: list[str], toxic: list[str], ordinary: list[str]):
    """The evidence of a text by the formula, with models of ``toxic`` and ``ordinary`` texts among all ``texts``, for tests."""
    import re
    from collections import Counter

    words = lambda t: re.findall(r"[a-z\x80-\U0010ffff]+", t.lower())
    stem = lambda w: w.encode()[:STEM]

    def level(key):
        count = lambda group: Counter(k for t in group for k in {key(w) for w in words(t)})
        df = count(texts)
        total, distinct = sum(df.values()), len(df)
        shared = lambda k: (df[k] + 1e-3) / (total + 1e-3 * distinct)
        out = []
        for group in (toxic, ordinary):
            n = count(group)
            size = max(1, sum(n.values()))
            x = {k: max(0.0, c - (e := shared(k) * size) - SPREAD * e**0.5 - LEAST) / size for k, c in n.items()}
            out.append((x, 1 - sum(x.values())))
        return shared, out

    (pw, w_models), (ps, s_models) = level(lambda w: w), level(stem)

    def evidence(text):
        got = 0.0
        for w in words(text):
            r = []
            for (xw, a), (xs, b) in zip(w_models, s_models):
                r.append(xw.get(w, 0.0) / pw(w) + max(a, 1e-6) * (xs.get(stem(w), 0.0) / ps(stem(w)) + max(b, 1e-6)))
            got += float(np.log(r[0] / r[1]))
        return got / max(1, len(words(text)))

    return evidence
