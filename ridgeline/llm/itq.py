"""Operator 8: near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation is learned (ITQ: alternate binary codes and the orthogonal
Procrustes rotation) on a bounded sample, so that the signs of the rotated
vectors are balanced codes. The code bits are cut into chunks; each chunk is a
Hamming table, and vectors that agree on a chunk are compared with their
original values. Further rotations (other random starts) give further chunks
until a pair at the threshold is missed with a probability of ``miss`` at most;
chunks grow with the logarithm of the rows, so buckets keep their size.

Equal vectors are one class from the start and count their copies. Every pair
is counted in the first table where it meets and nowhere else, so tables need
no pair list: a bucket returns link counts and the links of a spanning forest,
never all pairs. A bucket of over ``block`` rows is cut into blocks, and each
pair of blocks is a task's group of its own, of bounded memory.

Defined results. A vector that is null, empty, zero, or holds null or
non-finite components links with nothing. Vectors of different lengths do not
link. Repeated rows get a result each, and link with one another (cosine 1).
A null vec_id has component_id null and is kept. Empty table: empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, components, table

#: A bounded, documented sample fits the rotations; every row is indexed.
SAMPLE = 20_000
ROUNDS = 30


def fit(sample: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): ITQ over unit vectors; the projection keeps every dimension."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, basis = np.linalg.eigh(x.T @ x + 1e-9 * np.eye(x.shape[1]))
    v = x @ basis
    rot, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1], x.shape[1])))
    for _ in range(ROUNDS):
        codes = np.where(v @ rot >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ v)
        rot = (left @ right).T
    return mean, basis @ rot


def plan(rows: int, dims: int, cosine: float, bucket: int, miss: float) -> tuple[int, int, int]:
    """(bits of a chunk, chunks of a code, rotations) for so many rows."""
    bits = int(np.clip(math.ceil(math.log2(max(2.0, rows / bucket))), 4, min(dims, 30)))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    tables = math.ceil(math.log(miss) / math.log(1 - agree))
    per = max(1, dims // bits)
    return bits, per, max(1, math.ceil(tables / per))


def centred(cosine: float, sample: np.ndarray) -> float:
    """The cosine that unit vectors at ``cosine`` have left on average once the sample's mean is taken off, which is what codes are of.

    A common direction of over nine tenths of the vectors' length leaves too little to plan with: 0.5 at least.
    """
    mean = sample.mean(axis=0)
    return max(0.5, 1 - (1 - cosine) / max(1e-9, 1 - float(mean @ mean)))


def codes_of(x: np.ndarray, fits, bits: int, per: int) -> np.ndarray:
    """The chunk values of unit vectors: one column for each table."""
    weight = 1 << np.arange(bits, dtype=np.int64)
    out = []
    for mean, turn in fits:
        signs = ((x - mean) @ turn >= 0).astype(np.int64)
        out += [signs[:, c * bits : (c + 1) * bits] @ weight for c in range(per)]
    return np.stack(out, axis=1)


def unit(v) -> np.ndarray:
    x = np.stack([np.asarray(a, dtype=np.float64) for a in v])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(xa, xb, cosine):
    return xa @ xb.T >= cosine


def matcher(cosine: float, step: int = 512):
    """For one pair of blocks of one bucket: counts and spanning links."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, i, j = (int(pdf[c].iloc[0]) for c in ("t", "i", "j"))
        first = pdf[pdf["side"] == 0].sort_values("cls")
        second = first if i == j else pdf[pdf["side"] == 1].sort_values("cls")
        if not len(first) or not len(second):
            return pd.DataFrame({"cls": [], "n": [], "to": []}).astype("int64")
        a, b = first["cls"].to_numpy(), second["cls"].to_numpy()
        xa, ca = unit(first["v"]), np.stack(first["codes"].to_numpy())[:, :t]
        xb, cb = (xa, ca) if i == j else (unit(second["v"]), np.stack(second["codes"].to_numpy())[:, :t])
        wa, wb = first["copies"].to_numpy(), second["copies"].to_numpy()
        na, nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        top = {}

        def root(k):
            while top.setdefault(k, k) != k:
                top[k] = top[top[k]]
                k = top[k]
            return k

        edges = []
        for at in range(0, len(a), step):
            hit = linked(xa[at : at + step], xb, cosine)
            if i == j:
                hit &= np.arange(at, at + len(hit))[:, None] < np.arange(len(b))
            r, c = np.nonzero(hit)
            new = ~(ca[at + r] == cb[c]).any(axis=1) if t else np.ones(len(r), bool)
            r, c = at + r[new], c[new]
            np.add.at(na, r, wb[c])
            np.add.at(nb, c, wa[r])
            for p, q in zip(a[r], b[c]):
                x, y = root(p), root(q)
                if x != y:
                    top[max(x, y)] = min(x, y)
                    edges.append((p, q))
        out = [pd.DataFrame({"cls": k[n > 0], "n": n[n > 0], "to": -1}) for k, n in ((a, na), (b, nb))]
        out.append(pd.DataFrame({"cls": [p for p, _ in edges], "n": 0, "to": [q for _, q in edges]}))
        return pd.concat(out).astype("int64")

    return run


def embedding_dedup(vectors: DataFrame, cosine: float = 0.95, bucket: int = 128, miss: float = 0.002, block: int = 2048, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    good = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    v = v.withColumn("good", F.coalesce(good, F.lit(False)))
    same = F.when(F.col("good"), F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    rows = Saved(v.select("vec_id", "good", same.alias("v")), "vectors").df
    # a class is every row with equal components, named by its smallest id
    classes = Saved(rows.where("good and vec_id is not null").groupBy("v").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies")), "classes").df
    facts = classes.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).collect()  # a row for each vector length
    found = None
    for dims, n in sorted((r["dims"], r["n"]) for r in facts):
        one = search(classes.where(F.size("v") == dims), dims, n, cosine, bucket, miss, block, sample)
        found = one if found is None else found.union(one)
    if found is None:
        empty = F.lit(0).cast("long")
        return rows.select("vec_id", empty.alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = Saved(found, "matches").df
    links = found.where("n > 0").groupBy("cls").agg(F.sum("n").alias("n"))
    label = components(found.where("to >= 0").select(F.col("cls").alias("a"), F.col("to").alias("b")))
    info = classes.join(links, "cls", "left").join(label.toDF("cls", "component"), "cls", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    out = rows.where("good").join(info, "v", "left").select("vec_id", "n_links", "component_id").union(rows.where("not good").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def search(classes: DataFrame, dims: int, n: int, cosine: float, bucket: int, miss: float, block: int, sample: int) -> DataFrame:
    """(cls, n, to): link counts, and links of spanning forests, of one vector length."""
    picked = classes.orderBy(F.xxhash64("cls")).limit(sample).select("v").toPandas()["v"]
    x = unit(picked)
    bits, per, turns = plan(n, dims, centred(cosine, x), bucket, miss)
    fits = [fit(x, seed) for seed in range(turns)]

    def encode(batches):
        for pdf in batches:
            if len(pdf):
                pdf["codes"] = list(codes_of(unit(pdf["v"]), fits, bits, per))
                yield pdf[["cls", "copies", "v", "codes"]]

    coded = Saved(classes.select("cls", "copies", "v").mapInPandas(encode, "cls long, copies long, v array<double>, codes array<long>"), "codes").df
    at = coded.select("cls", "copies", "v", "codes", F.posexplode("codes").alias("t", "code"))
    sizes = at.groupBy("t", "code").agg(F.count("*").alias("size")).where("size > 1")
    at = at.join(sizes, ["t", "code"]).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    at = at.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # a row goes to each pair of blocks that holds its own: (own, j >= own) first, (i < own, own) second
    meet = at.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select("t", "code", "cls", "copies", "v", "codes", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side"))
    return meet.groupBy("t", "code", "i", "j").applyInPandas(matcher(cosine), "cls long, n long, to long")


def query(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def brute(rows: list[tuple], cosine: float = 0.95) -> dict:
    """The same over all pairs of (vec_id, list), for tests."""
    ok = [(i, np.asarray(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    top = {i: i for i, _ in rows}
    n = dict.fromkeys(top, 0)

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for p, (i, x) in enumerate(ok):
        for j, y in ok[p + 1 :]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                n[i] += 1
                n[j] += 1
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: (n[i], root(i), root(i) == i) for i in top}
