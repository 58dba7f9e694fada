"""Operator 7: BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that its encoding ends
with. An automaton over the vocabulary gives the tokens that end at a
position; the one whose predecessor (the last token of the prefix before it)
is compatible with it is stored, and the back-pointers from the whole word
give the ids. No merge is ever carried out.

Compatibility of a pair of tokens: undo the right edge of the first and the
left edge of the second. Each piece x on the first's right edge lives until
the merge that swallowed it, likewise y on the second's left edge. The pair is
incompatible if some x and y can merge, and that merge has its turn while both
live; of equal merges the one further left comes first.

Words repeat, so a worker keeps the result of each piece of text between white
space (no token crosses white space) in a cache of bounded size.

Defined results. Null or empty text: no tokens, hashes of the empty string.
Repeated rows: a result each. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import pieces, table

END = "Ā"  # stands behind the last byte of a word, which are all below it
#: Longer pieces of text (of languages without spaces, of data) are not cached.
LONG = 64
_loaded: dict = {}


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_chars() -> dict[int, str]:
    """The printable character of each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for n, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + n)
    return out


class Vocabulary:
    """A BPE vocabulary with word ends, read from its file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_str(json.dumps(spec))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        self.text = {i: t for t, i in self.ids.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte = {c: chr(b) for b, c in byte_chars().items()}
        spelled: dict[str, str] = {}  # token -> its bytes, and END
        for c, b in byte.items():
            for t, s in ((c, b), (c + self.suffix, b + END)):
                if t in self.ids:
                    spelled[t] = s
        self.merge: dict[tuple[int, int], int] = {}  # (left, right) -> rank
        born: dict[int, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in model["merges"]):
            new = self.ids[a + b]
            spelled.setdefault(a + b, spelled[a] + spelled[b])
            self.merge[self.ids[a], self.ids[b]] = rank
            if new not in born:
                born[new], parts[new] = rank, (self.ids[a], self.ids[b])
        never = len(model["merges"]) + 1
        self.right: dict[int, list[tuple[int, int]]] = {}  # id -> [(piece on its right edge, when it is swallowed)]
        self.left: dict[int, list[tuple[int, int]]] = {}
        for edges, side in ((self.right, 1), (self.left, 0)):
            for t in spelled:
                at, dies, chain = self.ids[t], never, []
                while True:
                    chain.append((at, dies))
                    if at not in parts:
                        break
                    dies, at = born[at], parts[at][side]
                edges[self.ids[t]] = chain
        self.automaton = ahocorasick.Automaton()
        for t, s in spelled.items():
            self.automaton.add_word(s, (self.ids[t], len(s)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.byte_char = byte_chars()

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            got = True
            for x, dies_x in self.right[a]:
                for y, dies_y in self.left[b]:
                    r = self.merge.get((x, y))
                    if r is not None and r < dies_x and r <= dies_y:
                        got = False
                        break
                if not got:
                    break
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = got
        return got

    def last_tokens(self, s: str) -> tuple[list[int], list[int]]:
        """The last token of the encoding of each prefix of ``s``, and its length; -1 where there is none."""
        last, size = [-1] * (len(s) + 1), [0] * (len(s) + 1)
        for end, (token, length) in self.automaton.iter(s):
            p = end + 1
            if last[p] < 0:
                q = p - length
                if q == 0 or (last[q] >= 0 and self.compatible(last[q], token)):
                    last[p], size[p] = token, length
        return last, size

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as characters below 256 for its bytes."""
        s = word + END
        last, size = self.last_tokens(s)
        out, p = [], len(s)
        while p > 0:
            out.append(last[p])
            p -= size[p]
        return out[::-1]


# Text of printable ASCII and the letters of Latin-1 has one form (NFC) and one lower case everywhere: its words are
# found here. All other text goes through the library's normaliser and pre-tokeniser.
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*\Z")


class Encoder:
    """Ids and decoded text of pieces of text between white space, with a cache of each."""

    def __init__(self, path: str, most: int = 600_000):
        self.v = Vocabulary(path)
        self.most = most  # pieces of at most LONG bytes: what a cache holds is bounded in bytes
        self.chunks: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.words: dict[str, tuple[int, bytes, bytes]] = {}

    def word(self, w: str) -> tuple[int, bytes, bytes]:
        got = self.words.get(w)
        if got is None:
            ids = self.v.encode_word(w)
            got = len(ids), np.array(ids, "<u4").tobytes(), " ".join(self.v.text[i] for i in ids).encode()
            if len(w) <= LONG:
                if len(self.words) >= self.most:
                    self.words.clear()
                self.words[w] = got
        return got

    def split(self, text: str):
        """The words of a piece of text, as characters for bytes."""
        if PLAIN.match(text):
            words = LATIN_WORDS.findall(text.lower())
            return words if text.isascii() else [w.encode().decode("latin-1") for w in words]
        back = {c: chr(b) for b, c in self.v.byte_char.items()}
        lib = self.v.library
        return ["".join(back[c] for c in w) for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))]

    def chunk(self, c: bytes) -> tuple[int, bytes, bytes]:
        text = c.decode("utf-8", "replace")
        parts = []
        for x in self.v.special_re.split(text) if self.v.special_re else [text]:
            if x in self.v.special:
                parts.append((1, np.array([self.v.special[x]], "<u4").tobytes(), x.encode()))
            elif x:
                parts += [self.word(w) for w in self.split(x)]
        got = sum(p[0] for p in parts), b"".join(p[1] for p in parts), b" ".join(p[2] for p in parts)
        if len(c) <= LONG:
            if len(self.chunks) >= self.most:
                self.chunks.clear()
            self.chunks[c] = got
        return got

    def document(self, text: bytes) -> tuple[int, bytes, bytes]:
        """(number of ids, little-endian 32-bit ids, decoded UTF-8) of a whole text."""
        get, make = self.chunks.get, self.chunk
        got = [get(c) or make(c) for c in text.split()]
        return sum(g[0] for g in got), b"".join([g[1] for g in got]), b" ".join([g[2] for g in got if g[0]])


# The same words found by array operations over many texts at once, in text whose bytes are ASCII without control
# characters, or letters and signs from C3 80 to C3 BF: nothing there composes, and lower case has as many bytes.
FLAT_BYTES = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), 0xC3])
SPACE, LETTER, DIGIT, SIGN = range(4)
CLASSES = bytes(SPACE if b in range(9, 14) or b == 32 else LETTER if b >= 128 or chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN for b in range(256))
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def flat(text: bytes) -> bool:
    if b"<|" in text or text.translate(None, FLAT_BYTES):
        return False
    if not text.isascii():
        try:
            text.decode()
        except UnicodeDecodeError:
            return False
    return True


def word_spans(joined: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Flat text in lower case, and where each of its words begins and ends."""
    low = joined.lower()
    kinds = np.frombuffer(low.translate(CLASSES), np.uint8)
    if not low.isascii():
        buf, kinds = np.frombuffer(low, np.uint8).copy(), kinds.copy()
        second = np.flatnonzero(buf == 0xC3) + 1
        v = buf[second]
        signs = second[(v == 0x97) | (v == 0xB7)]
        kinds[signs] = kinds[signs - 1] = SIGN
        buf[second[(v <= 0x9E) & (v != 0x97)]] += 0x20
        low = buf.tobytes()
    edge = np.ones(len(kinds) + 1, bool)
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:-1])
    edge[:-1] |= kinds == DIGIT
    if b"'" in low:
        buf = np.frombuffer(low + b"  ", np.uint8)
        at = np.flatnonzero(buf == 39)
        at = at[edge[at]]  # a sign before it takes it along
        x, y = buf[at + 1], buf[at + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = (np.isin(x, np.frombuffer(b"rv", np.uint8)) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        for found, n in ((at[one], 2), (at[two], 3)):
            edge[found + 1] = False
            edge[found + n] = True
    at = np.flatnonzero(edge)
    there = kinds[at[:-1]] != SPACE
    return low, at[:-1][there], at[1:][there]


def distinct_words(low: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """One place of each distinct word, and which of them each word is; words beyond 16 bytes stand for themselves. None if hashes collide."""
    padded = np.frombuffer(low + bytes(16), np.uint8)
    words = np.ndarray((len(low) + 8,), "<u8", padded, strides=(1,))
    size = end - begin
    w0 = words[begin] & MASKS.take(np.minimum(size, 8))
    w1 = words[begin + 8 * (size > 8)] & MASKS.take(np.clip(size - 8, 0, 8))
    h = w1 * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = (w0 ^ (h * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(size > 16)
    h[long] = np.arange(len(long), dtype=np.uint64)
    order = np.argsort(h)
    ranked = h[order]
    first = np.ones(len(h), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=first[1:])
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(first) - 1
    place = order[first]
    same = place.take(which)
    if (w0 != w0.take(same)).any() or (w1 != w1.take(same)).any() or (size != size.take(same)).any():
        return None
    return place, which


class Recent(dict):
    """A cache of at most ``most`` entries: when half of them are new the others go, but for those used since."""

    def __init__(self, most: int):
        super().__init__()
        self.half, self.old = max(1, most // 2), {}

    def turn(self) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key):
        got = self.old.pop(key, None)
        if got is not None:
            self[key] = got
        return got


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, which sees each word of a batch, or each piece between white space, once."""

    def __init__(self, path: str, most: int = 1_400_000):
        with open(path, encoding="utf-8") as f:
            self.lib = Tokenizer.from_str(f.read())
        self.lib.no_truncation()
        self.lib.no_padding()
        self.words, self.pieces = Recent(most), Recent(most // 8)
        self.chars = {b: c for b, c in byte_chars().items() if b > 126}

    def flat_documents(self, texts: list[bytes]) -> list[bytes]:
        """Words of flat text need no normaliser any more: the library's model takes them as they are."""
        low, begin, end = word_spans(b"\n".join(texts))
        found = distinct_words(low, begin, end)
        if found is None:
            return self.other_documents(texts)
        place, which = found
        self.words.turn()
        words, model, ids = self.words, self.lib.model, []
        for a, b in zip(begin[place].tolist(), end[place].tolist()):
            w = low[a:b]
            got = words[w]
            if got is None:
                got = array("I", [t.id for t in model.tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(self.chars))]).tobytes()
                if b - a <= LONG:
                    words[w] = got
            ids.append(got)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(sizes) - sizes
        n = sizes.take(which)
        ends = np.cumsum(n)
        all_ids = np.frombuffer(b"".join(ids), "<u4")
        out = all_ids.take(np.repeat(first.take(which) - (ends - n), n) + np.arange(n.sum())).tobytes()
        bounds = np.cumsum([len(t) + 1 for t in texts])
        at = np.append(0, ends)[np.searchsorted(begin, bounds)].tolist()
        return [out[4 * a : 4 * b] for a, b in zip([0, *at], at)]

    def other_documents(self, texts: list[bytes]) -> list[bytes]:
        """Any text: the library's normaliser and pre-tokeniser see each piece between white space once."""
        split = [t.split() for t in texts]
        self.pieces.turn()
        known = {c: self.pieces[c] for c in set().union(*split)}
        new = [c for c, got in known.items() if got is None]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for c, e in zip(part, self.lib.encode_batch_fast([x.decode("utf-8", "replace") for x in part], add_special_tokens=False)):
                known[c] = array("I", e.ids).tobytes()
                if len(c) <= LONG:
                    self.pieces[c] = known[c]
        return [b"".join([known[c] for c in s]) for s in split]

    def documents(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = list(texts)
        plain = [flat(t) for t in texts]
        for kind, run in ((True, self.flat_documents), (False, self.other_documents)):
            at = [i for i, p in enumerate(plain) if p is kind]
            for i, got in zip(at, run([texts[i] for i in at]) if at else []):
                out[i] = got
        return out


def encoder(path: str, kind=Encoder):
    """One encoder a worker process."""
    if (path, kind) not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path, kind] = kind(path)
    return _loaded[path, kind]


def texts(col: pa.Array) -> list[bytes]:
    return [t or b"" for t in col.cast(pa.binary()).to_pylist()]


def bpe(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids, decoded for every row of ``documents`` (doc_id, text)."""

    def run(batches):
        e = encoder(vocabulary or word_bpe())
        for batch in pieces(batches):
            got = [e.document(t) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([np.frombuffer(g[1], "<i4") for g in got], pa.list_(pa.int32())), pa.array([g[2].decode() for g in got])], ["doc_id", "ids", "decoded"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, ids array<int>, decoded string")


def bpe_digests(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what ``bpe`` returns."""

    def run(batches):
        e = encoder(vocabulary or word_bpe())
        for batch in pieces(batches):
            got = [e.document(t) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), *(pa.array([hashlib.sha256(g[j]).hexdigest() for g in got], pa.string()) for j in (1, 2))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


