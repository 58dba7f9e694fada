"""Operator 1: near-duplicates by MinHash with tensored banding, verified on full sets.

``collections`` small collections of ``width`` minimum hashes are computed for
each distinct shingle set; a table key joins the values of two collections, so
n collections give n(n-1)/2 tables from only n*width hashes, about the square
root of what independent tables would need. Two sets are compared if they
agree on any key, and linked only if their full sets meet the threshold.

Work is bounded as follows. Equal sets are one class from the start, so copies
never meet. In each round a bucket emits one pair per member, with a member
chosen by the round (the first round uses a few tables, which join most of a
large group); pairs that components already join are not compared. What is
then left between different components of a bucket is compared in full, so no
link is lost to the rounds. Pairs whose sizes or minimum hashes rule the
threshold out are never emitted; full sets are read again only for documents
with a candidate.

Missed links: a pair at the threshold agrees in one collection with
probability t**width; with 14 of 2 it shares no key with a probability of
2e-4 at 0.75 and 1e-5 at 0.8, and agrees on fewer than 12 of 28 minimum hashes
with 2e-4 and 3e-6.

Defined results. Null or empty text, or no word: an empty set, n_shingles 0,
linked with nothing, kept. Repeated rows get a result each; rows that share a
doc_id count as one document, which links by each of its texts; n_shingles is
each row's own. A null doc_id has component_id null
and is kept if nothing smaller has its set. Empty table: empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Saved, components, pieces, raw_text, release, saved, small_batches, table, tidy

#: The lowest bits of a key hold its table's number; the first step uses so many tables, the least that must agree
#: of all minimum hashes is this share of them.
TABLE_MASK, FIRST, AGREE = 127, 8, 0.43
SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, mins array<int>, tags array<long>"
#: Bytes of a tag: the lowest byte of so many minimum hashes.
TAG = 7


def shingle_sets(col: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text."""
    data, ends = raw_text(col)
    hashes, doc = W.word_hashes(data, ends)
    all_, bounds = W.shingles(hashes, doc, len(col), k)
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield np.unique(all_[a:b])


def factors(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=W.U) * W.U(2) + W.U(1), rng.integers(0, 2**64, n, dtype=W.U)


def signer(k: int, n: int):
    mul, add = factors(n)

    def run(batches):
        for batch in pieces(batches, most=1 << 20):
            count, h1, h2, mins = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                count.append(len(s))
                h1.append(digest(s))
                h2.append(int(W.mix(s * W.STEP[4]).sum(dtype=W.U).astype(np.int64)))
                low = np.full(n, 2**64 - 1, W.U)
                for at in range(0, len(s), 4096):
                    low = np.minimum(low, (s[at : at + 4096, None] * mul + add).min(axis=0))
                mins.append((low >> W.U(32)).astype(np.uint32).view(np.int32))
            flat = pa.array(np.concatenate(mins))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(mins) + 1, n, dtype=np.int32)), flat)
            low = np.zeros((len(mins), -(-n // TAG) * TAG), np.int64)
            low[:, :n] = np.stack(mins) & 255
            tags = low.reshape(len(mins), -1, TAG) @ (1 << np.arange(0, 8 * TAG, 8))
            tags = pa.ListArray.from_arrays(pa.array(np.arange(0, tags.size + 1, tags.shape[1], dtype=np.int32)), pa.array(tags.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists, tags], ["doc_id", "n_shingles", "h1", "h2", "mins", "tags"])

    return run


def digest(s: np.ndarray) -> int:
    """The first of a set's two hashes."""
    return int(W.mix(s + W.STEP[3]).sum(dtype=W.U).astype(np.int64))


def set_maker(k: int):
    """(rep, shingles) of the rows whose set is that of the class that was asked for."""

    def run(batches):
        for batch in pieces(batches):
            sets = list(shingle_sets(batch.column("text"), k))
            mine = pa.array([digest(s) == h for s, h in zip(sets, batch.column("h1").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "shingles"]).filter(mine)

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Do two sorted sets meet the threshold?"""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def checker(percent: int):
    """Keeps the pairs whose full sets meet the threshold."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("sa"), batch.column("sb")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                keep[i] = similar(np.frombuffer(a[i].as_buffer(), W.U), np.frombuffer(b[i].as_buffer(), W.U), percent)
            yield batch.filter(pa.array(keep)).select(["a", "b"])
        tidy()

    return run


def equal_bytes(a, b):
    """How many of the TAG bytes of two longs are equal."""
    x, seven = a.bitwiseXOR(b), F.lit(int("7f" * TAG, 16))
    return TAG - F.bit_count((x.bitwiseAND(seven) + seven).bitwiseOR(x).bitwiseAND(F.lit(int("80" * TAG, 16))))


def minhash_dedup(documents: DataFrame, k: int = 5, percent: int = 75, collections: int = 14, width: int = 2, rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents`` (doc_id, text)."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = Saved(docs.mapInArrow(signer(k, collections * width), SIGNATURE), "minhash").df
    own = ["n_shingles", "h1", "h2"]
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy(*own).agg(F.min("doc_id").alias("of"), F.first("mins").alias("mins"), F.first("tags").alias("tags"))
    # documents with several different sets (rows that share a doc_id): their sets get numbers of their own, above all ids, and a link to the document
    mixed = Saved(sig.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("m")).agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("m"), "mixed").df
    several = not mixed.isEmpty()
    rep = F.col("of")
    if several:
        classes = classes.join(mixed, F.col("of") == F.col("m"), "left")
        rep = F.when(F.col("m").isNotNull(), F.lit(1 << 62) + F.pmod(F.xxhash64(*own), F.lit(1 << 62))).otherwise(rep)
    reps = Saved(classes.select(*own, rep.alias("rep"), "of", "mins", "tags"), "classes").df
    ties = None
    if several:
        ties = Saved(sig.join(mixed, F.col("doc_id") == F.col("m"), "left_semi").join(reps.select(*own, "rep"), own).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "ties").df

    n = collections * width
    part = lambda c: F.slice("mins", c * width + 1, width)
    tables = list(combinations(range(collections), 2))
    # a key's lowest bits say which table it is of
    keys = [F.xxhash64(F.lit(t), part(i), part(j)).bitwiseAND(F.lit(~TABLE_MASK)).bitwiseOR(F.lit(t)) for t, (i, j) in enumerate(tables)]
    # each document makes len(tables) rows: spread the documents first
    rows = reps.select("rep", "mins").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select("rep", F.explode(F.array(*keys)).alias("key"))
    # most keys have one member: they go before anything is joined
    full = rows.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key")
    buckets = Saved(rows.join(full, "key", "left_semi"), "buckets").df
    release(spark)

    # each step: the tables that take part, and who is compared
    steps = [(min(FIRST, len(tables)), "hub"), *((len(tables), "hub") for _ in range(rounds)), (len(tables), "all")]
    links, tried = ties, None
    label = components(ties) if several else None
    for r, (most, kind) in enumerate(steps):
        members = buckets.where(F.col("key").bitwiseAND(F.lit(TABLE_MASK)) < most) if most < len(tables) else buckets
        if label is not None:
            members = members.join(label, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
            split = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
            members = members.join(split, "key", "left_semi")
        else:
            members = members.withColumn("component", F.col("rep"))
        if kind == "all":
            found = Saved(compare_in_blocks(docs, members.select("key", "rep", "component"), reps, k, percent, int(AGREE * n)), "links").df
            links = found if links is None else links.union(found)
            label = components(links)
            break
        tags = [F.col("tags")[i].alias(f"tag{i}") for i in range(-(-n // TAG))]
        members = members.join(reps.select("rep", "n_shingles", *tags), "rep")
        facts = ["rep", "n_shingles", "component", *(f"tag{i}" for i in range(len(tags)))]
        x, y = F.struct(*facts).alias("x"), F.struct(*facts).alias("y")
        # one chosen member a bucket: first the smallest id, which copies are often copies of
        hub = members.select("key", y).groupBy("key").agg(F.min_by("y", F.col("y.rep") if r == 0 else F.xxhash64("y.rep", F.lit(r))).alias("y"))
        met = members.select("key", x).join(hub, "key")
        # sizes and minimum hashes settle most pairs before a full set is read
        alike = sum((equal_bytes(F.col(f"x.tag{i}"), F.col(f"y.tag{i}")) for i in range(len(tags))), F.lit(n - TAG * len(tags)))
        sizes = 100 * F.least("x.n_shingles", "y.n_shingles") >= percent * F.greatest("x.n_shingles", "y.n_shingles")
        met = met.where((F.col("x.component") != F.col("y.component")) & sizes & (alike >= int(AGREE * n)))
        pairs = met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = Saved(pairs, "pairs").df
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.union(pairs)
        found = Saved(verify(docs, pairs, reps, k, percent), "links").df
        links = found if links is None else links.union(found)
        label = components(links)
    if label is None:
        label = spark.createDataFrame([], "node long, component long")
    whole = reps.join(label, F.col("rep") == F.col("node"), "left").select(*own, F.coalesce("component", "rep").alias("component_id"))
    out = sig.join(whole, own, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: Candidates are first sought by the slot of their id: a table of at most so many rows, which may be broadcast.
SLOTS = 1 << 20


def sets_of(docs: DataFrame, ids: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """rep, shingles of the classes of ``ids`` (rep); texts of other documents are not shuffled, or few of them."""
    wanted = reps.select("rep", F.col("of").alias("doc_id"), "h1").join(ids, "rep", "left_semi")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int")
    slots = wanted.select(slot.alias("slot")).distinct()
    near = docs.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").select("doc_id", "text", F.xxhash64("text").alias("th"))
    rows = near.join(wanted.hint("merge"), "doc_id").dropDuplicates(["doc_id", "rep", "th"]).select("rep", "h1", "text")
    return saved(rows.mapInArrow(set_maker(k), "rep long, shingles binary"), "sets").dropDuplicates(["rep"])


def verify(docs: DataFrame, pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets are similar enough."""
    sets = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), reps, k)
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(checker(percent), "a long, b long")


def compare_in_blocks(docs: DataFrame, members: DataFrame, reps: DataFrame, k: int, percent: int, agree: int, size: int = 512) -> DataFrame:
    """Links (a, b) between the different components of each bucket of ``members`` (key, rep, component).

    Buckets that share members form a group; its documents fall into blocks,
    and a task's group is a pair of blocks that gets each document once and
    returns a spanning forest of the links, so no pair is ever a row.
    """
    members = Saved(members, "open").df
    hub = members.groupBy("key").agg(F.min("rep").alias("hub"))
    group = components(members.join(hub, "key").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "groups").toDF("rep", "grp")
    own = members.select("rep", "component").distinct().join(group, "rep").join(reps.select("rep", "n_shingles", "mins"), "rep")
    sets = sets_of(docs, members.select("rep").distinct(), reps, k)
    own = own.join(sets.toDF("rep", "shingles"), "rep")
    blocks = group.groupBy("grp").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    own = own.join(blocks, "grp").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    meet = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select("grp", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "rep", "component", "n_shingles", "mins", "shingles")

    def run(pdf):
        pdf = pdf.sort_values("rep")
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        rep, comp, count = (pdf[c].to_numpy() for c in ("rep", "component", "n_shingles"))
        mins = np.stack(pdf["mins"].to_numpy())
        held = [np.frombuffer(x, W.U) for x in pdf["shingles"]]
        first = np.flatnonzero(pdf["own"].to_numpy() == i)
        second = np.flatnonzero(pdf["own"].to_numpy() == j)
        top: dict[int, int] = {}

        def root(x):
            while top.setdefault(x, x) != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        out = []
        for x in first:
            y = second[second > x] if i == j else second
            y = y[(comp[y] != comp[x]) & (100 * np.minimum(count[y], count[x]) >= percent * np.maximum(count[y], count[x]))]
            y = y[(mins[y] == mins[x]).sum(axis=1) >= agree]
            for z in y:
                p, q = root(comp[x]), root(comp[z])
                if p != q and similar(held[x], held[z], percent):
                    top[max(p, q)] = min(p, q)
                    out.append((min(rep[x], rep[z]), max(rep[x], rep[z])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return meet.groupBy("grp", "i", "j").applyInPandas(run, "a long, b long")


def query(spark, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"))


def brute(rows: list[tuple], k: int = 5, percent: int = 75) -> dict:
    """The same over all pairs of (doc_id, text) in plain Python, for tests."""
    import re

    sets: list[tuple] = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    top = {i: i for i, _ in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for (a, x), (b, y) in combinations(sets, 2):
        n = len(x & y)
        if n and 100 * n >= percent * (len(x) + len(y) - n):
            p, q = sorted((root(a), root(b)))
            top[q] = p
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}
