"""Operator 11: phrases whose words occur together more often than their parts explain.

Phrases are the paths of a count trie of depth 5. A node is named by its parent
and its last word (two 64-bit hashes, of language and words; 128 bits tell any two
nodes apart), so a child's name holds its left part. The trie grows a level in each
pass over the texts: a shard (a task's texts) grows children only where both the
phrase without its last word and the one without its first word reached the
threshold, since no longer phrase can be more frequent. The shard's level is
counted, sorted and serialised by parent, cut into ranges of node names, and all
shards' runs of a range are merged; only there counts are compared with the
threshold. A bit filter of at most 32 MB tells shards which nodes are open; what it
lets through wrongly is counted like the rest and then dropped, so it saves work
and decides nothing. Ranges are of mixed names: a very common first word spreads.

What is left of the trie is joined level by level: the parents' counts are the left
parts, and suffix links (the node without its first word, found below the parent's
suffix link) give the right parts.

Defined results. Null text: no words. Null language: ``und``. Repeated rows count
each. No phrase that often, or an empty table: empty result. Words are whatever
stands between blanks; a text of one piece is counted like any other.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Saved, pieces, raw_text, table, tidy

U = np.uint64
#: The contract's separators of pieces and of words.
IS_END = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
IS_GAP = IS_END | np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))
DEPTH = 5
#: Nodes that a shard holds before it gives them away, and nodes of a range.
HELD, RANGE = 2_000_000, 1_000_000
#: Bits of the filter: 16 a node up to this many.
MOST_BITS = 1 << 28
SLICE = 4 << 20


def child(parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The name of the node below ``parent`` by ``word``."""
    return W.mix(parent * W.STEP[0] + word)


def stretches(batches):
    """(lower-cased bytes, ends, language of each text) for slices of some megabytes; a longer text is cut between pieces."""
    for batch in pieces(batches, most=SLICE):
        data, ends = raw_text(batch.column("text"))
        langs = batch.column("lang").fill_null("und")
        data = W.LOWER[data]
        if len(data) <= 2 * SLICE:
            yield data, ends, langs
            continue
        for i in range(len(langs)):
            text, at = data[ends[i] : ends[i + 1]], 0
            while at < len(text):
                stop = at + SLICE
                found = np.flatnonzero(IS_END[text[at:stop]])
                if stop < len(text) and not len(found):
                    found = np.flatnonzero(IS_END[text[at:]])
                stop = len(text) if stop >= len(text) or not len(found) else at + int(found[-1 if at + found[-1] < stop else 0]) + 1
                part = text[at:stop]
                yield part, np.array([0, len(part)]), langs.slice(i, 1)
                at = stop


class Stream:
    """The words of a slice: hash (of language and word), piece, and where they are."""

    def __init__(self, data, ends, langs):
        self.data = data
        self.starts, self.stops, self.doc = W.spans(data, ends, IS_GAP)
        self.langs = langs.dictionary_encode()
        names = self.langs.dictionary.to_pylist()
        seed = np.array([xxhash.xxh3_64_intdigest(s.encode()) for s in names], U)
        self.lang = np.asarray(self.langs.indices)[self.doc]
        self.names = names
        self.word = W.mix(W.span_hashes(data, self.starts, self.stops) * W.STEP[1] + seed[self.lang]) if len(self.doc) else np.zeros(0, U)
        self.piece = np.concatenate([[0], np.cumsum(IS_END[data])])[self.starts] + self.doc

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at these places."""
        size = self.stops[at] - self.starts[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        body = self.data[np.arange(ends[-1]) + np.repeat(self.starts[at] - ends[:-1], size)]
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body)])


def vocabulary(batches):
    """lang, word, key, n: counts of the words of a shard; a null word stands for all words of a language."""
    held: list[tuple] = []
    total: Counter = Counter()

    def counted():
        key, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        lang, word = pa.concat_arrays([h[2] for h in held]), pa.concat_arrays([h[3] for h in held])
        _, at, back = np.unique(key, return_index=True, return_inverse=True)
        held[:] = [(key[at], np.bincount(back, n).astype(np.int64), lang.take(pa.array(at)), word.take(pa.array(at)))]
        return held[0]

    def batch(key, n, lang, word):
        return pa.RecordBatch.from_arrays([lang, word, pa.array(key.view(np.int64)), pa.array(n)], ["lang", "word", "key", "n"])

    for data, ends, langs in stretches(batches):
        s = Stream(data, ends, langs)
        if not len(s.word):
            continue
        for i, n in enumerate(np.bincount(s.lang, minlength=len(s.names))):
            total[s.names[i]] += int(n)
        key, at, n = np.unique(s.word, return_index=True, return_counts=True)
        held.append((key, n.astype(np.int64), pa.array(s.names, pa.string()).take(pa.array(s.lang[at])), s.strings(at)))
        if sum(len(h[0]) for h in held) > HELD // 2 and len(counted()[0]) > HELD // 4:
            yield batch(*held.pop())
    if held:
        yield batch(*counted())
    if total:
        names, n = zip(*total.items())
        yield batch(np.zeros(len(n), np.int64), np.array(n, np.int64), pa.array(names, pa.string()), pa.nulls(len(n), pa.string()))
    tidy()


class Filter:
    """Which nodes may be open: two bits for each; never wrong about one that is."""

    def __init__(self, bits: int, words: np.ndarray):
        self.mask, self.words = U(bits - 1), words

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for shift in (0, 29):
            bit = (keys >> U(shift)) & self.mask
            out &= ((self.words[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1)).astype(bool)
        return out


def filter_of(nodes: DataFrame) -> Filter:
    """Set in Spark; the driver gets its words only, 4 million at most."""
    n = nodes.count()
    bits = 1 << 16
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    places = nodes.select(F.explode(F.array(*(F.shiftrightunsigned("key", s).bitwiseAND(bits - 1) for s in (0, 29)))).alias("bit"))
    got = places.groupBy(F.shiftrightunsigned("bit", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("word")).toArrow()
    words = np.zeros(bits // 64, U)
    words[got["slot"].to_numpy()] = got["word"].to_numpy().view(U)
    return Filter(bits, words)


def tally(parent: np.ndarray, word: np.ndarray, n: np.ndarray):
    """Sorted by parent and word, each pair once."""
    order = np.lexsort((word, parent))
    parent, word = parent[order], word[order]
    new = np.ones(len(order), bool)
    new[1:] = (parent[1:] != parent[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(new)
    return parent[at], word[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def planes(a: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, all first bytes first: alike bytes side by side."""
    return a.astype("<u8").view(np.uint8).reshape(len(a), 8).T.tobytes()


def serialise(parent, word, n) -> bytes:
    """A sorted run: each parent once with its number of children, then words and counts."""
    first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
    heads = parent[first]
    body = planes(np.diff(heads, prepend=U(0))) + planes(np.diff(np.append(first, len(word)))) + word.astype("<u8").tobytes() + planes(n)
    return np.array([len(heads), len(word)], "<u8").tobytes() + pa.compress(body, "zstd", asbytes=True)


def parse(blob: bytes):
    heads, size = (int(v) for v in np.frombuffer(blob, "<u8", 2))
    body = np.frombuffer(pa.decompress(blob[16:], 16 * heads + 16 * size, "zstd", asbytes=True), np.uint8)
    plane = lambda at, k: np.ascontiguousarray(body[at : at + 8 * k].reshape(8, k).T).view("<u8").ravel()
    parent = np.repeat(np.cumsum(plane(0, heads), dtype=U), plane(8 * heads, heads).astype(np.int64))
    return parent, body[16 * heads : 16 * heads + 8 * size].view("<u8"), plane(16 * heads + 8 * size, size).astype(np.int64)


def grower(depth: int, is_open: Filter, ranges: int):
    """Level ``depth`` of a shard's trie, as sorted runs of ranges."""

    def run(batches):
        held: list[tuple] = []

        def merged():
            held[:] = [tally(*(np.concatenate([h[i] for h in held]) for i in range(3)))]
            return held[0]

        def give():
            parent, word, n = held.pop()
            place = ((child(parent, word) >> U(32)) * U(ranges) >> U(32)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.diff(place[order])) + 1
            for part in np.split(order, cuts):
                if len(part):
                    yield pa.RecordBatch.from_pydict({"range": pa.array(place[part[:1]]), "run": pa.array([serialise(parent[part], word[part], n[part])], pa.binary())})

        for data, ends, langs in stretches(batches):
            s = Stream(data, ends, langs)
            if len(s.word) < depth:
                continue
            name = s.word
            for k in range(1, depth - 1):
                name = child(name[:-1], s.word[k:])
            good = is_open(name)
            at = np.flatnonzero(good[:-1] & good[1:] & (s.piece[: 1 - depth] == s.piece[depth - 1 :]))
            if not len(at):
                continue
            held.append(tally(name[at], s.word[at + depth - 1], np.ones(len(at), np.int64)))
            if sum(len(h[0]) for h in held) > HELD and len(merged()[0]) > HELD // 2:
                yield from give()
        if held:
            merged()
            yield from give()
        tidy()

    return run


def merger(least: int):
    """The runs of one range, merged; what reaches the threshold."""

    def run(runs: pa.Table) -> pa.Table:
        parts = [parse(b.as_buffer()) for b in runs.column("run").combine_chunks()]
        parent, word, n = tally(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        keep = n >= least
        parent, word, n = parent[keep], word[keep], n[keep]
        return pa.table({"parent": parent.view(np.int64), "last": word.view(np.int64), "key": child(parent, word).view(np.int64), "f": n})

    return run


def grow(docs: DataFrame, nodes: DataFrame, depth: int, least: int, ranges: int) -> DataFrame:
    """parent, last, key, f of the phrases of ``depth`` words that occur ``least`` times."""
    runs = docs.mapInArrow(grower(depth, filter_of(nodes), ranges), "range int, run binary")
    return Saved(runs.groupBy("range").applyInArrow(merger(least), "parent long, last long, key long, f long"), f"trie-{depth}").df


def joined(level: DataFrame, shorter: DataFrame, depth: int) -> DataFrame:
    """A level with its words, the counts of its left and right parts, and its suffix links."""
    above = shorter.select(F.col("key").alias("parent"), F.col("link").alias("up"), "lang", "words", F.col("f").alias("pf"), F.col("left").alias("pl"))
    behind = shorter.select(F.col("key").alias("link"), F.col("parent").alias("up"), "last", F.element_at("words", -1).alias("word"), F.col("f").alias("sf"), F.col("right").alias("sr"))
    out = level.join(above, "parent")
    out = out.drop("up").join(behind.drop("up", "last").withColumn("last", F.col("link")), "last") if depth == 2 else out.join(behind, ["up", "last"])
    return out.select(
        "key", "parent", "last", "link", "lang", F.concat("words", F.array("word")).alias("words"), "f",
        F.concat("pl", F.array("pf")).alias("left"), F.concat(F.array("sf"), "sr").alias("right"),
    )


def collocations(documents: DataFrame, least: int = 100, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``most`` phrases of each language, a row each."""
    docs = documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = docs.mapInArrow(vocabulary, "lang string, word string, key long, n long").groupBy("lang", "word").agg(F.first("key").alias("key"), F.sum("n").alias("f"))
    vocab = Saved(counts.where((F.col("f") >= least) | F.col("word").isNull()), "vocabulary").df
    totals = vocab.where("word is null").select("lang", F.col("f").alias("n"))
    ranges = max(1, -(-int(totals.agg(F.sum("n")).first()[0] or 0) // RANGE))
    none, zero = F.array().cast("array<bigint>"), F.lit(None).cast("long")
    nodes = Saved(vocab.where("word is not null").select("key", zero.alias("parent"), F.col("key").alias("last"), zero.alias("link"), "lang", F.array("word").alias("words"), "f", none.alias("left"), none.alias("right")), "trie-1").df
    levels = []
    for depth in range(2, DEPTH + 1):
        nodes = Saved(joined(grow(docs, nodes, depth, least, ranges), nodes, depth), f"phrases-{depth}").df
        levels.append(nodes.withColumn("size", F.lit(depth)))
    found = reduce(DataFrame.unionByName, levels)
    # a part is inside a longer phrase that is as frequent; what lies deeper is inside a part that is
    inside = found.where("size > 2").select((F.col("size") - 1).alias("size"), F.explode(F.expr("filter(array(IF(element_at(left, -1) = f, parent, NULL), IF(right[0] = f, link, NULL)), x -> x IS NOT NULL)")).alias("key")).distinct()
    kept = found.join(inside, ["size", "key"], "left_anti").join(totals, "lang")
    cut = "array_min(transform(sequence(1, size(left)), j -> struct((1000 * CAST(f AS DECIMAL(20, 0)) * n) DIV (CAST(left[j - 1] AS DECIMAL(20, 0)) * right[j - 1]) AS score, j AS k, left[j - 1] AS l, right[j - 1] AS r)))"
    scored = kept.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "n", F.expr(cut).alias("cut"))
    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def brute(rows: list[tuple], least: int = 100, most: int = 2000) -> list[tuple]:
    """The same from (text, lang) in plain Python, for tests."""
    f: dict[str, Counter] = {}
    n: Counter = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, DEPTH + 1):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        inside = {p[i : i + k] for p, a in cands.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * own[p[i : i + k]]}
        rank = []
        for p, a in cands.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                rank.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rank)[:most], 1)]
    return out
