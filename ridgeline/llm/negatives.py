"""Operator 12: hard negatives by vantage-point trees over norm-augmented vectors.

A row x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, and
an anchor q gets a zero there: the squared distance of the two is then
|q|^2 + M^2 - 2 q.x, so a larger inner product is a smaller distance, and a window
of scores is an annulus around the anchor. One tree, learned from a bounded sample
(``SAMPLE`` rows, the only thing it is used for is balance), deals every row to
its leaf; a large leaf is cut into chunks by the row's id, so copies of one
vector spread. In each chunk a tree over all its rows keeps, for each bucket, the
span of distances to the vantage points above it. A search walks the buckets
nearest first from the inner edge of its annulus, and ends when the next bucket
lies beyond the k-th row found or the outer edge.

Positives are a search with the same label and no annulus, negatives one with
other labels in the annulus of 80 to 100 % of the positive's score. Each search
goes to its nearest chunk first; what it finds there bounds the annulus before
it goes to the other chunks that the annulus still meets. Nothing is dropped:
bounds come from distances with slack, scores are exact integers.

Defined results. Rows with a null vec_id, label or vector, and those with a null
or non-finite component, take no part. Rows of one vec_id are never partners of
each other; an anchor row that is repeated counts once, other repeated rows count
each. Vectors of other lengths than the anchor's do not meet it. Equal scores go
by vec_id, then label. Scores beyond 64 bits are held at the largest (smallest) long.
No positive, or none with a score above zero that the window can hold: no rows.
Empty table: empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, table

#: A bounded, documented sample shapes the tree that deals rows to chunks; every row is dealt and searched.
SAMPLE = 20_000
CHUNK = 8192
BUCKET = 96
FAR = np.int64(2**63 - 2)
QUERY = "q long, rank int, anchor_id long, label long, same boolean, low long, high long, v array<double>"


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that brings them all to the squared norm ``top``."""
    return np.concatenate([x, np.sqrt(np.maximum(0.0, top - np.einsum("ij,ij->i", x, x)))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


class Tree:
    """A vantage-point tree: buckets of at most ``most`` points (more where points are equal)."""

    def __init__(self, x: np.ndarray, most: int):
        self.points: list[np.ndarray] = []
        self.buckets: list[np.ndarray] = []
        self.spans: list[list[tuple[int, float, float]]] = []  # for each bucket: vantage point, nearest, farthest
        self.splits: list[tuple[int, float, int, int]] = []  # vantage point, radius, inner and outer child (buckets are ~n)
        self.root = self.grow(x, most)

    def grow(self, x, most) -> int:
        """Splits by the median distance to the point that lies farthest from the centre, until parts are small."""
        answers: list[int] = []
        todo: list[tuple] = [("part", np.arange(len(x)), [])]
        while todo:
            task, *rest = todo.pop()
            if task == "join":
                at = rest[0]
                outer, inner = answers.pop(), answers.pop()
                self.splits[at] = (*self.splits[at][:2], inner, outer)
                answers.append(at)
                continue
            part, path = rest
            if len(part) > most:
                sub = x[part]
                point = sub[int(np.argmax(distances(sub, sub.mean(axis=0)[None])[:, 0]))]
                d = distances(sub, point[None])[:, 0]
                radius = float(np.median(d))
                near = d <= radius
                if near.all():
                    near = d < radius
                if 0 < near.sum() < len(d):
                    number = len(self.points)
                    self.points.append(point)
                    self.splits.append((number, radius if (d <= radius)[~near].sum() == 0 else float(d[near].max()), 0, 0))
                    todo.append(("join", len(self.splits) - 1))
                    for side in (~near, near):
                        todo.append(("part", part[side], [*path, number]))
                    continue
            answers.append(~len(self.buckets))
            self.buckets.append(part)
            self.spans.append([(v, float(d.min()), float(d.max())) for v in path for d in [distances(x[part], self.points[v][None])[:, 0]]] if len(part) else [])
        return answers.pop()

    def deal(self, x: np.ndarray) -> np.ndarray:
        """The bucket that each point falls into."""
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out[rows] = ~node
                continue
            point, radius, inner, outer = self.splits[node]
            near = distances(x[rows], self.points[point][None])[:, 0] <= radius
            todo += [(inner, rows[near]), (outer, rows[~near])]
        return out

    def radii(self) -> list[list[tuple[int, float, float]]]:
        """For each bucket what the splits alone say of its distances: true of every point that is dealt to it."""
        out: list[list] = [[] for _ in self.buckets]
        todo: list[tuple] = [(self.root, [])]
        while todo:
            node, path = todo.pop()
            if node < 0:
                out[~node] = path
                continue
            point, radius, inner, outer = self.splits[node]
            todo += [(inner, [*path, (point, 0.0, radius)]), (outer, [*path, (point, radius, math.inf)])]
        return out


class Bounds:
    """The nearest and farthest that anything in a bucket can be from an anchor."""

    def __init__(self, tree: Tree, spans):
        self.points = np.stack(tree.points) if tree.points else None
        deep = max(map(len, spans), default=0)
        self.at = np.zeros((len(spans), deep), np.int64)
        self.low, self.high = np.zeros((len(spans), deep)), np.full((len(spans), deep), math.inf)
        for b, path in enumerate(spans):
            for j, (v, lo, hi) in enumerate(path):
                self.at[b, j], self.low[b, j], self.high[b, j] = v, lo, hi

    def __call__(self, anchors: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        near, far = np.zeros((len(anchors), len(self.at))), np.full((len(anchors), len(self.at)), math.inf)
        if self.points is not None:
            d = distances(anchors, self.points)
            for j in range(self.at.shape[1]):
                step = d[:, self.at[:, j]]
                np.maximum(near, np.maximum(step - self.high[:, j], self.low[:, j] - step), out=near)
                np.minimum(far, step + self.high[:, j], out=far)
        return np.maximum(near - slack, 0.0), far + slack


def annulus(q2: np.ndarray, top: float, low: np.ndarray, high: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances between which the scores low..high lie; the extreme longs stand for no limit."""
    inner = np.where(high >= FAR, 0.0, np.sqrt(np.maximum(0.0, q2 + top - 2.0 * high)))
    outer = np.where(low <= -FAR, math.inf, np.sqrt(np.maximum(0.0, q2 + top - 2.0 * low)))
    return np.maximum(inner - slack, 0.0), outer + slack


def scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; doubles hold them where norms say so, else Python's integers do."""
    if exact:
        return np.rint(a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape)
    return np.array([[min(max(int(v), -int(FAR)), int(FAR)) for v in r] for r in whole(a) @ whole(b).T], np.int64).reshape(len(a), len(b))


class Chunk:
    """Rows of one chunk and the tree over them."""

    def __init__(self, ids, labels, x, top: float):
        order = np.lexsort((labels, ids))
        self.ids, self.labels, self.x, self.top = ids[order], labels[order], x[order], top
        self.exact = top < 2.0**52
        self.slack = 1e-6 * math.sqrt(max(top, 1.0)) + 1e-9
        self.tree = Tree(augmented(self.x, top), BUCKET)
        self.bounds = Bounds(self.tree, self.tree.spans)

    def search(self, q: pd.DataFrame, k: int) -> pd.DataFrame:
        """The first k rows of each search, by score, vec_id, label."""
        x = np.stack(q["v"].to_numpy())
        own, label, same = q["anchor_id"].to_numpy(), q["label"].to_numpy(), q["same"].to_numpy()
        low, high = q["low"].to_numpy(), q["high"].to_numpy()
        q2 = np.einsum("ij,ij->i", x, x)
        near, far = self.bounds(np.concatenate([x, np.zeros((len(x), 1))], axis=1), self.slack)
        inner, outer = annulus(q2, self.top, low, high, self.slack)
        start = np.maximum(near, inner[:, None])
        start[far < inner[:, None]] = math.inf  # wholly inside the hole
        order = np.argsort(start, axis=1, kind="stable")
        best = np.full((len(x), k), -FAR - 1)
        who = np.full((len(x), k), -1)
        alive = np.arange(len(x))
        for step in range(order.shape[1]):
            bucket = order[alive, step]
            reach = start[alive, bucket]
            go = (reach <= outer[alive]) & (reach < math.inf)
            alive, bucket = alive[go], bucket[go]
            if not len(alive):
                break
            by = np.argsort(bucket, kind="stable")
            for rows in np.split(alive[by], np.flatnonzero(np.diff(bucket[by])) + 1):
                members = self.tree.buckets[order[rows[0], step]]
                s = scores(x[rows], self.x[members], self.exact)
                ok = (s >= np.maximum(low[rows], best[rows, -1])[:, None]) & (s <= high[rows, None]) & (self.ids[members] != own[rows, None]) & ((self.labels[members] == label[rows, None]) == same[rows, None])
                hit = ok.any(axis=1)
                for r, sr, okr in zip(rows[hit], s[hit], ok[hit]):
                    cand_s, cand_i = np.concatenate([best[r], sr[okr]]), np.concatenate([who[r], members[okr]])
                    top = np.lexsort((cand_i, -cand_s))[:k]  # rows are numbered by vec_id, then label
                    best[r], who[r] = cand_s[top], cand_i[top]
                full = rows[who[rows, -1] >= 0]
                if len(full):
                    outer[full] = np.minimum(outer[full], annulus(q2[full], self.top, best[full, -1], high[full], self.slack)[1])
        r, j = np.nonzero(who >= 0)
        return pd.DataFrame({"q": q["q"].to_numpy()[r], "rank": q["rank"].to_numpy()[r], "id": self.ids[who[r, j]], "lab": self.labels[who[r, j]], "score": best[r, j]})


FOUND = "q long, rank int, id long, lab long, score long"


def searcher(k: int, top: float, batch: int = 2048):
    """Reads rows sorted by chunk, a chunk's rows before its searches: one chunk and one batch of searches are held."""

    def run(batches):
        key, rows, chunk, waiting = None, [], None, []

        def flush():
            nonlocal chunk, rows, waiting
            if waiting and (rows or chunk):
                if chunk is None:
                    pdf = pd.concat(rows)
                    chunk, rows = Chunk(pdf["anchor_id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()), top), []
                q = pd.concat(waiting)
                for at in range(0, len(q), batch):
                    yield chunk.search(q.iloc[at : at + batch], k)
            waiting = []

        for pdf in batches:
            for value, part in pdf.groupby("chunk", sort=False):
                if value != key:
                    yield from flush()
                    key, rows, chunk, waiting = value, [], None, []
                data, asks = part[part["side"] == 0], part[part["side"] == 1]
                if len(data):
                    rows.append(data[["anchor_id", "label", "v"]])
                if len(asks):
                    waiting.append(asks)
                    if sum(map(len, waiting)) >= batch:
                        yield from flush()
        yield from flush()

    return run


def find(rows: DataFrame, asks: DataFrame, k: int, top: float) -> DataFrame:
    """``asks`` (QUERY and chunk) against the rows of their chunks."""
    none = F.lit(0).cast("long")  # not null: pandas would make doubles of the searches' longs
    data = rows.select("chunk", F.lit(0).alias("side"), none.alias("q"), F.lit(0).alias("rank"), F.col("vec_id").alias("anchor_id"), "label", F.lit(False).alias("same"), none.alias("low"), none.alias("high"), "v")
    both = data.join(asks.select("chunk").distinct(), "chunk", "left_semi").union(asks.select("chunk", F.lit(1), *(c.split()[0] for c in QUERY.split(", "))))
    return both.repartition("chunk").sortWithinPartitions("chunk", "side").mapInPandas(searcher(k, top), FOUND)


def first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each search, whichever chunks they came from, with their place from 1."""
    from pyspark.sql import Window

    w = Window.partitionBy("q", "rank").orderBy(F.desc("score"), "id", "lab")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


class Router:
    """Sends searches to the chunks that their annulus meets."""

    def __init__(self, tree: Tree, top: float, chunks: dict[int, int]):
        self.bounds, self.top = Bounds(tree, tree.radii()), top
        self.first = np.zeros(len(tree.buckets), np.int64)
        counts = np.array([chunks.get(b, 0) for b in range(len(tree.buckets))])
        self.first[1:] = np.cumsum(counts)[:-1]
        self.counts, self.slack = counts, 1e-6 * math.sqrt(max(top, 1.0)) + 1e-9

    def meets(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack(pdf["v"].to_numpy())
        near, far = self.bounds(np.concatenate([x, np.zeros((len(x), 1))], axis=1), self.slack)
        inner, outer = annulus(np.einsum("ij,ij->i", x, x), self.top, pdf["low"].to_numpy(), pdf["high"].to_numpy(), self.slack)
        ok = (near <= outer[:, None]) & (far >= inner[:, None]) & (self.counts > 0)
        return ok, np.where(ok, np.maximum(near, inner[:, None]), math.inf)

    def home(self, pdf: pd.DataFrame) -> np.ndarray:
        """The first chunk of the nearest leaf; -1 where none can hold a row."""
        ok, start = self.meets(pdf)
        leaf = np.argmin(start, axis=1)
        return np.where(ok.any(axis=1), self.first[leaf], -1)

    def others(self, pdf: pd.DataFrame) -> list[np.ndarray]:
        ok, _ = self.meets(pdf)
        out = []
        for row, home in zip(ok, pdf["home"].to_numpy()):
            leaves = np.flatnonzero(row)
            each = np.repeat(self.first[leaves], self.counts[leaves]) + np.concatenate([np.arange(n) for n in self.counts[leaves]] or [np.zeros(0, np.int64)])
            out.append(each[each != home].astype(np.int64))
        return out


def search(rows: DataFrame, asks: DataFrame, k: int, top: float, router: Router, tag: str) -> DataFrame:
    """The first k rows of every search: its home chunk, then the chunks that its narrowed annulus still meets."""

    def go_home(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(chunk=router.home(pdf))

    def go_on(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(chunks=router.others(pdf)).drop(columns="home")

    started = Saved(asks.mapInPandas(go_home, QUERY + ", chunk long").where("chunk >= 0"), f"{tag}-asks").df
    near = Saved(first(find(rows, started, k, top), k).drop("place"), f"{tag}-near").df
    bound = near.groupBy("q", "rank").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    names = [c.split()[0] for c in QUERY.split(", ")]
    narrowed = started.join(bound, ["q", "rank"], "left").withColumn("low", F.greatest("low", F.coalesce("least", "low"))).select(*names, F.col("chunk").alias("home"))
    spread = narrowed.mapInPandas(go_on, QUERY + ", chunks array<long>").withColumn("chunk", F.explode("chunks")).drop("chunks")
    return first(near.union(find(rows, Saved(spread, f"{tag}-spread").df, k, top)), k)


def whole_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v: the rows that take part, with their final labels and integer components (as doubles)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # a double of 2^52 and more is whole already, and 256 times it may pass what a long holds
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**44, F.floor(256 * x).cast("double")).otherwise(256 * x) + F.lit(0.0))
    return v.where(F.coalesce(good, F.lit(False))).select("vec_id", label.alias("label"), whole.alias("v"))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor of ``vectors`` (vec_id, label, embedding)."""
    rows = Saved(whole_rows(vectors), "whole").df
    facts = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).collect()  # a row for each vector length
    out = None
    for f in sorted(facts):
        one = of_length(rows.where(F.size("v") == f["dims"]), f["n"], f["top"], every, positives, negatives, low, high, chunk, sample)
        out = one if out is None else out.union(one)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def of_length(rows: DataFrame, n: int, top: float, every, positives, negatives, low, high, chunk, sample) -> DataFrame:
    picked = rows.orderBy(F.xxhash64("vec_id", "v")).limit(sample).select("v").toPandas()["v"]
    leaves = max(1, min(1024, math.ceil(n / chunk)))
    x = augmented(np.stack(picked.to_numpy()), top)
    tree = Tree(x, max(1, math.ceil(len(x) / leaves)))
    tree.buckets = [b[:0] for b in tree.buckets]  # the sample itself is not needed any more
    tree.spans = []

    def dealer(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(leaf=tree.deal(augmented(np.stack(pdf["v"].to_numpy()), top)))

    dealt = Saved(rows.mapInPandas(dealer, "vec_id long, label long, v array<double>, leaf int"), "dealt").df
    sizes = {r["leaf"]: r["n"] for r in dealt.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # 2048 leaves at most
    router = Router(tree, top, {leaf: math.ceil(size / chunk) for leaf, size in sizes.items()})
    where = F.create_map(*(F.lit(v) for leaf in sizes for v in (leaf, int(router.first[leaf]))))
    cuts = F.create_map(*(F.lit(v) for leaf in sizes for v in (leaf, int(router.counts[leaf]))))
    placed = dealt.withColumn("chunk", where[F.col("leaf")] + F.pmod(F.xxhash64("vec_id", "label", "v"), cuts[F.col("leaf")]))

    anchors = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "v"])
    names = [c.split()[0] for c in QUERY.split(", ")]
    limit = F.lit(int(FAR))
    asks = anchors.select(F.xxhash64("vec_id", "label", "v").alias("q"), F.lit(0).alias("rank"), F.col("vec_id").alias("anchor_id"), "label", F.lit(True).alias("same"), (-limit).alias("low"), limit.alias("high"), "v")
    asks = Saved(asks, "anchors").df
    near = Saved(search(placed, asks, positives, top, router, "positive"), "positives").df
    pairs = near.select("q", F.col("place").alias("rank"), F.col("id").alias("positive_id"), F.col("score").alias("high"))
    least = F.expr(f"CAST(({low} * CAST(high AS DECIMAL(20, 0)) + {high - 1}) DIV {high} AS LONG)")
    wanted = asks.drop("rank", "same", "low", "high").join(pairs, "q").where("high >= 0").withColumn("low", least).withColumn("same", F.lit(False))
    found = search(placed, wanted.select(*names), negatives, top, router, "negative")
    named = found.join(wanted.select("q", "rank", "anchor_id", "positive_id", F.col("high").alias("positive_score")), ["q", "rank"])
    return named.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def brute(rows: list[tuple], every: int = 100, positives: int = 5, negatives: int = 5) -> list[tuple]:
    """The same over all pairs of (vec_id, embedding, label) in plain Python, for tests."""
    ok = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        ok.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * c) for c in v)))
    out = []
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    for i, label, v in sorted({r for r in ok if r[0] % every == 0}):
        all_ = sorted(((-dot(v, w), j, m) for j, m, w in ok if j != i and len(w) == len(v)))
        for s, j, _ in [t for t in all_ if t[2] == label][:positives]:
            fit = [t for t in all_ if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s][:negatives]
            out += [(i, j, n, t[1], -s, -t[0]) for n, t in enumerate(fit, 1)]
    return out
