import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ridgeline.llm import bpe, bwt, langid, minhash, oracles, packing, quality, rangecoder, suffix, tokenfile, toxicity
from ridgeline.llm import words as W
from tests.llm.fixtures import documents, empty, frame, nulls, words
from tests.oracle import connect, same

ROWS = documents()
TEXT = {r[0]: r[1] for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.word_bpe())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def check_empty(spark, op):
    assert op(empty(spark)).collect() == []


# --- 1


def test_minhash_equals_brute_force(spark, docs):
    want = minhash.brute(list(TEXT.items()))
    got = minhash.minhash_dedup(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]
    assert sum(not r["kept"] for r in got) > 10


def test_minhash_nulls_and_empty(spark):
    got = minhash.minhash_dedup(nulls(spark)).collect()
    assert len(got) == 2 and all(r["component_id"] is None and r["kept"] for r in got)
    check_empty(spark, minhash.minhash_dedup)


def test_minhash_large_group(spark):
    """A chain of near copies is one group, though its ends are no longer alike."""
    r = random.Random(5)
    w = words(r, 120)
    rows = []
    for i in range(60):
        w[i % len(w)] = f"new{i}"
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in minhash.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = minhash.brute(rows)
    assert got == {i: v[1] for i, v in want.items()} and set(got.values()) == {0}


def thue_morse(n, a="a", b="b"):
    out = a
    while len(out) < n:
        out += out.translate(str.maketrans(a + b, b + a))
    return out[:n]


def test_words_that_break_polynomial_hashes():
    x, y = thue_morse(1024), thue_morse(1024, "b", "a")
    long = [x * 50, y * 50]
    assert quality.count(pa.array([x + "\n" + y, x + "\n" + x, "\n".join(long)]))["n_dup_lines"].tolist() == [0, 1, 0]
    for n in (1, 7, 8, 9, 64, 127, 128, 129, 1000):
        words = [thue_morse(n), thue_morse(n, "b", "a"), "a" * n, "a" * (n + 1)]
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, stops, _ = W.spans(data, np.array([0, len(data)]))
        h = W.span_hashes(data, starts, stops)
        assert len(set(h)) == len(set(words))
        again = np.frombuffer(("  x " + " ".join(words)).encode(), np.uint8)
        starts, stops, _ = W.spans(again, np.array([0, len(again)]))
        assert (W.span_hashes(again, starts, stops)[1:] == h).all()  # where a word stands does not matter


def test_minhash_of_rows_that_share_an_id(spark):
    r = random.Random(4)
    a, b = (" ".join(words(r, 80)) for _ in range(2))
    near = lambda t: t + " end"
    rows_ = [(5, a), (5, b), (7, near(b)), (9, near(a)), (3, b), (11, " ".join(words(r, 60)))]
    for order in (rows_, rows_[::-1]):
        got = minhash.minhash_dedup(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()
        assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, v[1]) for i, v in minhash.brute(order).items()} == {(5, 3), (7, 3), (9, 3), (3, 3), (11, 11)}


def test_equal_bytes(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = []
    for _ in range(200):
        a = [r.choice([0, 1, 127, 128, 255]) for _ in range(7)]
        b = [r.choice([x, 0, 255]) for x in a]
        rows.append((int.from_bytes(bytes(a), "little"), int.from_bytes(bytes(b), "little"), sum(x == y for x, y in zip(a, b))))
    df = spark.createDataFrame(rows, "a long, b long, n int")
    assert df.where(minhash.equal_bytes(F.col("a"), F.col("b")) != F.col("n")).count() == 0


# --- 2


def test_packing_places_every_piece(spark, docs, library):
    got = packing.pack(docs).collect()
    want = Counter()
    for i, t, *_ in ROWS:
        ids = np.array([*ids_of(library, t), 0], "<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[i, p, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    check_sequences(got, 2048)


def check_sequences(got, size):
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def best(lengths, size):
    """The least number of bins, by search."""
    lengths, low = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= low[0]:
            return
        if i == len(lengths):
            low[0] = len(rooms)
            return
        for room in sorted({x for x in rooms if x >= lengths[i]}):
            k = rooms.index(room)
            go(i + 1, rooms[:k] + [room - lengths[i]] + rooms[k + 1 :])
        go(i + 1, rooms + [size - lengths[i]])

    go(0, [])
    return low[0]


@pytest.mark.parametrize("seed", range(30))
def test_plan_and_dominance(seed):
    r = random.Random(seed)
    size, n = 20, r.randint(1, 9)
    lengths = [r.randint(1, size) for _ in range(n)]
    hist = Counter(lengths)
    bins = {}
    for length, low, high, seq, offset in packing.plan(dict(hist), size):
        for k in range(high - low + 1):
            bins.setdefault(seq + k, []).append((offset, length))
    assert Counter(x for b in bins.values() for _, x in b) == hist
    exact = best(lengths, size)
    assert exact <= len(bins) <= exact + 1
    # what is fixed belongs to some best packing
    fixed, rest = packing.reduce_dominated(packing.Lengths(dict(hist)), size)
    left = [x for x, k in rest.items() for _ in range(k)]
    assert sum(k for _, k in fixed) + best(left, size) == exact


def test_packing_nulls_and_empty(spark):
    assert packing.pack(nulls(spark)).count() == 2
    check_empty(spark, packing.pack)


# --- 3


def test_language_model_is_kneser_ney():
    import pandas as pd

    r = np.random.default_rng(0)
    counts = Counter(tuple(int(x) for x in g) for g in r.integers(0, 5, (400, 4)))
    pack = lambda g: sum(x << (16 * (3 - i)) for i, x in enumerate(g))
    model = langid.Model(pd.DataFrame([("x", pack(g), n) for g, n in counts.items()], columns=["lang", "gram", "n"]))
    tests = [tuple(int(x) for x in g) for g in r.integers(0, 7, (80, 4))]
    got = model.scores(np.array([pack(g) for g in tests], np.uint64))[:, 0]
    assert model.symbols == 6
    assert np.allclose(got, np.log([langid.brute_prob(counts, g[:3], g[3], 6) for g in tests]), atol=1e-5)


def test_language_symbols_are_letters_of_any_script():
    s, bounds, letters = langid.symbols(pa.array(["Ab1é", None, "中 𠀀!", "😀", "..ÉΩ"]))
    assert letters.tolist() == [3, 0, 3, 0, 2]
    assert s.tolist() == [0, 97, 98, 0, 0xE9, 0, 0, 0x4E2D, 0, 0xD840, 0xDC00, 0, 0, 0, 0xE9, 0x3C9]
    assert bounds.tolist() == [0, 5, 6, 12, 13, 16]


def test_language_id_equals_brute_force(spark):
    """The choice and its entropy by the formula, over texts of four alphabets."""
    r = random.Random(6)
    alphabets = {"a": "abcd", "g": "αβγδ", "c": "абвг", "h": "中文字典"}
    rows = [(i, " ".join("".join(r.choices(alphabets[k], k=r.randint(1, 6))) for _ in range(r.randint(2, 9))), k) for i, k in enumerate(r.choices(list(alphabets), k=80))]
    rows += [(200, "ab αβ α", "a"), (201, "zzz", None)]
    got = {x["doc_id"]: x for x in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    counts = {k: Counter() for k in alphabets}
    grams_of = lambda t: [tuple(([0] * 4 + [0, *(ord(c) if c.isalpha() else 0 for c in t)])[n + 2 : n + 6]) for n in range(len(t))]
    for i, t, k in rows:
        if k and zlib.crc32(str(i).encode()) % 3 != 1:
            counts[k].update(grams_of(t))
    symbols = len({g[-1] for c in counts.values() for g in c}) + 1
    for i, t, _ in rows[::7] + rows[-2:]:
        ce = {k: -np.mean([np.log(langid.brute_prob(counts[k], g[:3], g[3], symbols)) for g in grams_of(t)]) for k in counts}
        assert got[i]["entropy"] == pytest.approx(min(ce.values()), abs=1e-4) and ce[got[i]["lang_pred"]] == pytest.approx(min(ce.values()))


def test_language_id(spark, docs):
    got = {r["doc_id"]: r for r in langid.language_id(docs).collect()}
    for i in (100, 101, 102, 111, 112):
        assert got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    longer = [r for r in ROWS if r[0] % 6 > 2 and r[0] < 60 and len(r[1]) > 60]
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in longer]) > 0.9
    assert {r["lang_pred"] for r in langid.language_id(nulls(spark)).collect()} == {"und"}
    check_empty(spark, langid.language_id)


def test_language_id_on_held_out(spark, tiny):
    d = spark.read.parquet(f"{tiny}/documents.parquet")
    got = langid.language_id(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


# --- 4


def test_quality_counts(spark, docs):
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        n_words, *rest = quality.brute(TEXT[r["doc_id"]])
        assert [r[c] for c in quality.COUNTS] == [n_words, *rest]
        assert r["base_failed"] == (n_words < 50 or 100 * rest[-1] > 50 * n_words)
        assert not (r["base_failed"] and r["kept"])
    check_empty(spark, quality.quality_rules)
    assert all(r["base_failed"] for r in quality.quality_rules(nulls(spark)).collect())


def graded(n=700, seed=3):
    """(text, lang, source): a large group, small ones that borrow their language's or the corpus' fences, and outliers in each."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang, source = r.choice([("en", "big")] * 6 + [("en", "small"), ("de", "a"), ("de", "b"), ("de", "c"), ("fr", "rare"), (None, None)])
        w = words(r, r.randint(40, 120), "en" if lang == "fr" else lang or "en")
        for kind, extra in ((0.06, "### $$$ &&&"), (0.04, "x" * 300), (0.05, "of the of the of the of the of the")):
            if r.random() < kind:
                w[3:3] = extra.split()
        out.append((" ".join(w) + ("\nsame line\nsame line" * 6 if r.random() < 0.04 else ""), lang, source))
    return out


def verdicts(df, **options):
    return [r["kept"] for r in quality.quality_rules(df, **options).orderBy("doc_id").collect()]


def test_quality_verdicts_equal_brute_force_whatever_the_partitions(spark):
    rows = graded()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    want = quality.brute_verdicts(rows)
    sound = [w >= 50 and 100 * rep <= 50 * w for w, *_, rep in (quality.brute(t) for t, _, _ in rows)]
    assert 20 < sum(s and not k for s, k in zip(sound, want)) < 200
    for parts in (1, 7, 32):
        assert verdicts(df.repartition(parts)) == want
    assert verdicts(df.repartition(5), least=10) == quality.brute_verdicts(rows, least=10) != want


def test_quality_sql(spark, tiny):
    same(quality.query(spark, tiny), connect(tiny), oracles.SQL["op4_quality_rules"])


def test_quality_keeps_clean_documents(spark, tiny):
    d, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_rules(d).join(labels, "doc_id")
    assert got.where("quality = 1 AND NOT kept AND NOT base_failed").count() <= 0.02 * got.count()


# --- 5


@pytest.mark.parametrize("n,block,vocabulary", [(0, 8, 5), (1, 8, 5), (9, 8, 1), (1000, 64, 3), (3000, 700, 49_408), (2000, 16, 2), (9000, 8192, 2), (9000, 8192, 49_408)])
def test_range_coder_round_trip(n, block, vocabulary):
    x = np.random.default_rng(n).integers(0, vocabulary, n)
    for lanes in (8, 3):
        ids, note = rangecoder.decode(rangecoder.encode(x, b"a note", block, lanes))
        assert (ids == x).all() and note == b"a note"


def test_range_coder_on_long_runs():
    """Predictions that are always right, then always wrong: no interval is ever empty."""
    r = np.random.default_rng(3)
    x = np.concatenate([np.zeros(5000, int), np.arange(5000), np.tile([1, 2], 3000), r.permutation(5000)])
    assert (rangecoder.decode(rangecoder.encode(x))[0] == x).all()


@pytest.mark.parametrize("most", [3, 49_408, rangecoder.FLAGS + 1, 1 << 31])
def test_range_coder_ranks_as_by_sorting(most):
    """Small ids are ranked by a table, which is left as it was for the next block; large ones by a sort."""
    x = np.random.default_rng(most).integers(0, most, (2, 900)).astype("<u4")
    n = int(x.max()) + 1
    seen, ranks = (np.zeros(n, bool), np.zeros(n, np.uint16)) if n <= rangecoder.FLAGS else (None, None)
    for block in x:
        for got, want in zip(rangecoder.ranked(block, seen, ranks), np.unique(block, return_inverse=True)):
            assert (got == want).all()
    assert seen is None or not seen.any()
    assert (rangecoder.decode(rangecoder.encode(x.reshape(-1)))[0] == x.reshape(-1)).all()


def test_range_coder_learns_and_detects():
    x = np.tile(np.arange(50), 400)
    data = rangecoder.encode(x, b"note")
    assert len(data) < len(x) // 4
    for at in (len(data) // 2, data.index(b"note")):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rangecoder.decode(bytes(bad))
    with pytest.raises(ValueError):
        rangecoder.decode(b"other" + data)


def test_range_coder_follows_contexts_as_step_by_step():
    """What all steps' contexts named, found by sorting, is what a table kept from step to step says."""
    r = np.random.default_rng(2)
    context, symbols = r.integers(0, 6, (500, 3)), r.integers(0, 3, (500, 3))
    symbols[100:300] = 1
    got = np.empty((500, 3), np.uint16)
    rangecoder.follow(context, symbols, got)
    table = np.zeros((3, 6), int)
    for t in range(500):
        for lane in range(3):
            c, sym, e = context[t, lane], symbols[t, lane], table[lane, context[t, lane]]
            assert got[t, lane] == e
            table[lane, c] = min(e + 1, e | 7) if e >> 3 == sym else sym << 3


def test_range_coder_decodes_files_side_by_side(monkeypatch):
    """Files of unlike lengths and alphabets share a decoder's steps, in groups of lanes that cross files."""
    monkeypatch.setattr(rangecoder, "JOINT", 5)
    r = np.random.default_rng(6)
    ids = [r.integers(0, v, n) for v, n in ((3, 4000), (49_408, 9000), (1 << 31, 2500), (2, 0), (1, 1))]
    files = [rangecoder.encode(x, bytes([i]), 700, 4) for i, x in enumerate(ids)]
    for i, (got, note) in enumerate(rangecoder.decode_all(files)):
        assert (got == ids[i]).all() and note == bytes([i])
    with pytest.raises(ValueError):
        rangecoder.decode_all([files[0], files[1][:-400] + bytes(400)])


def test_words_of_many_texts_are_the_library_s(library):
    """Words found by array operations: contractions, signs, digits, Latin letters, words beyond 16 bytes, bytes that are no UTF-8."""
    e, r = bpe.LibraryEncoder(bpe.word_bpe(), most=40), random.Random(4)
    texts = ["it's 'sword ''s we'll're 's's 1's .'s 're've'", "x" * 16 + " " + "x" * 17 + " " + "x" * 100, "", " ", "a×b÷c ÀÉßÿ", "'"]
    texts += ["".join(r.choice("aAsStTlLdDmMrReEvV''''  \n\t.,!\"09#ÀéßÉ×÷ÿÖ<|>") for _ in range(r.choice([1, 3, 40, 200]))) for _ in range(300)]
    raw = [t.encode() for t in texts] + [b"a\xc3", b"\xc3\xc3\x80 b", b"\x80a"]
    for t, got in zip(raw, e.documents(raw)):
        assert got == np.array(ids_of(library, t.decode("utf-8", "replace")), "<u4").tobytes()
    low, begin, end = bpe.word_spans(b"One two, ONE\nit's")
    place, which = bpe.distinct_words(low, begin, end)
    assert sorted(low[begin[p] : end[p]] for p in place) == [b"'s", b",", b"it", b"one", b"two"] and len(which) == 6


def test_token_files(spark, docs, library):
    files = tokenfile.write_tokens(docs, segment=500)
    assert files.df.count() > 3
    got = sorted(map(tuple, tokenfile.read_tokens(files.df).collect()), key=lambda r: r[1])
    at = 0
    for row, (i, t) in zip(got, sorted(((r[0], r[1]) for r in ROWS), key=lambda r: r[0])):
        ids = np.array([*ids_of(library, t), 2], "<u4")
        assert row == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(ROWS)
    files.drop()
    assert tokenfile.read_tokens(tokenfile.write_tokens(empty(spark)).df).collect() == []
    assert {r["n_tokens"] for r in tokenfile.read_tokens(tokenfile.write_tokens(nulls(spark)).df).collect()} == {1, 9}


# --- 6


def brute6(rows):
    return suffix.brute([(i, t) for i, t in dict((r[0], r[1]) for r in rows).items()])


def test_passages_equal_brute_force(spark, docs):
    want = brute6(ROWS)
    got = suffix.cut_repeats(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert tuple(r)[1:5] == want[r["doc_id"]]
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    assert sum(r["n_removed"] for r in got) > 1000


@pytest.mark.parametrize("hot,batch,shard", [(20_000, 40_000, 1 << 14), (3, 50, 7), (10, 20, 3)])
def test_passages_in_a_small_alphabet(spark, monkeypatch, hot, batch, shard):
    for name, v in (("HOT", hot), ("BATCH", batch), ("SHARD", shard)):
        monkeypatch.setattr(suffix, name, v)
    r = random.Random(3)
    base = ["".join(r.choice("ab ") for _ in range(300)) for _ in range(3)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(r.randint(0, 6)):
            b, x = r.choice(base), r.randint(0, 200)
            parts.append(b[x : x + r.randint(1, 250)])
        rows.append((i, "".join(parts)))
    rows += [(200, "x" * 500), (201, "xy" * 300), (202, None), (203, ""), (204, "x" * 99), (205, "\0" * 300), (206, "é" * 120)]
    got = {x["doc_id"]: tuple(x)[1:5] for x in suffix.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == suffix.brute(rows)


def test_passages_of_many_copies_of_a_row(spark):
    r = random.Random(5)
    text = " ".join(words(r, 600))
    many = spark.createDataFrame([(1, text)] * 500 + [(2, text)], "doc_id long, text string").repartition(3)
    got = suffix.cut_repeats(many).groupBy("doc_id", "n_removed").count().collect()
    assert {tuple(x) for x in got} == {(1, 0, 500), (2, len(text.encode()), 1)}


def test_passages_nulls_and_empty(spark):
    got = suffix.cut_repeats(nulls(spark), keep=("rep", "th"), as_text=True)
    assert got.columns[:3] == ["doc_id", "rep", "th"] and [r["n_removed"] for r in got.collect()] == [0, 0]
    check_empty(spark, suffix.cut_repeats)


def test_merged_transforms_sort_strings():
    rng = np.random.default_rng(5)
    for _ in range(80):
        n, w = int(rng.integers(2, 60)), int(rng.integers(1, 6))
        base = rng.integers(0, 2, (4, w))
        x = base[rng.integers(0, 4, n)].copy()
        x[rng.random((n, w)) < 0.1] = 3
        x = x.astype(np.uint64) * np.uint64(0x0100000100000001)
        order, shared = bwt.sorted_strings(x, int(rng.integers(1, 40)))
        rows = [tuple(int(v) for v in x[i]) for i in order]
        assert rows == sorted(rows) and sorted(order) == list(range(n))
        common = bwt.common_bytes(x, order, shared)
        data = [x[i].astype(">u8").tobytes() for i in order]
        for i in range(1, n):
            assert common[i] == next((k for k in range(8 * w) if data[i][k] != data[i - 1][k]), 8 * w)


# --- 7


def test_bpe_is_the_library(spark, docs, library):
    for r in bpe.bpe_digests(docs).collect():
        ids = ids_of(library, TEXT[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    check_empty(spark, bpe.bpe)
    assert {len(r["ids"]) for r in bpe.bpe(nulls(spark)).collect()} == {0, 8}


ODD = ["it's we'll I'D 'S don'T 'reX", "12 3½ ²³ ①", "ﬁ Å İstanbul ΣΑΣ ẛ̣ ſ", "x y\x1cz\x85w​v", "</w> a</w></w>", "日本語 한국어 हिन्दी العربية", "😀👨‍👩‍👧", "<|startoftext|>a<|endoftext|><|", "ÀÉß×÷ÿªµº", "\0\x01", "e\u0301 \u0301x"]


def test_bpe_odd_texts(library):
    e, lib = bpe.Encoder(bpe.word_bpe()), bpe.LibraryEncoder(bpe.word_bpe())
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("".join(ODD)) for _ in range(40)) for _ in range(200)]
    for t, by_lib in zip(texts, lib.documents([t.encode() for t in texts])):
        ids = np.array(ids_of(library, t), "<u4")
        n, got, decoded = e.document(t.encode())
        assert got == ids.tobytes() == by_lib and n == len(ids)
        assert decoded.decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_one_last_token_for_each_prefix(library):
    """The compatible token is unique, and a prefix's encoding is what the table says."""
    v = bpe.Vocabulary(bpe.word_bpe())
    for w in ("unbelievable", "aaaaaaa", "thththth", "xqzj", "internationalization"):
        s = w + bpe.END
        fits = [t for e, (t, n) in v.automaton.iter(s) if e == len(s) - 1 and (n == len(s) or v.compatible(v.last_tokens(s)[0][len(s) - n], t))]
        assert len(fits) == 1 and v.encode_word(w)[-1] == fits[0]


# --- 10


def test_toxicity(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        w = words(r, r.randint(30, 80))
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["zorgly", "blarfing", "zorglish"])
        rows.append((i, " ".join(w)))
        if i % 4:
            labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (None, "words")]
    labels += [(None, 1), (3, None), (5, 1), (5, 1)]
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(d, l).collect()
    assert len(got) == len(rows)
    for x in got:
        i = x["doc_id"]
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3)
        assert x["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
    new = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 400 and x["held_out"]]
    assert sum(x["predicted"] == int(x["doc_id"] % 5 == 0) for x in new) >= 0.95 * len(new)
    none = toxicity.toxicity(d, l.limit(0)).collect()
    assert {x["score"] for x in none} == {0.0}
    assert toxicity.toxicity(d.limit(0), l).collect() == []


def test_labels_outside_the_learning_rows_change_nothing(spark, tiny):
    d, l = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    a = {r["doc_id"]: r["score"] for r in toxicity.toxicity(d, l).collect()}
    flip = l.withColumn("toxic", __import__("pyspark.sql.functions", fromlist=["when"]).when(toxicity.held_out(l["doc_id"]), 1 - l["toxic"]).otherwise(l["toxic"]))
    assert a == {r["doc_id"]: r["score"] for r in toxicity.toxicity(d.withColumn("lang", d["source"]), flip).collect()}


def test_toxicity_keeps_words_apart(spark):
    """A word that no label has seen brings no evidence, though the first 19 bits of its hash are those of a toxic word."""
    r, seen = random.Random(4), {}
    while True:
        w = "".join(r.choice("bcdfghjklm") for _ in range(12))
        data = np.frombuffer(w.encode(), np.uint8)
        slot = int(toxicity.W.span_hashes(data, np.array([0]), np.array([12]))[0] >> np.uint64(45))
        if seen.setdefault(slot, w) != w:
            break
    toxic, unseen = seen[slot], w
    rows = [(i, f"one two three {'four' if i % 5 else toxic} five") for i in range(300)] + [(1000, unseen), (1001, toxic), (1002, "quite other")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["evidence"] for x in toxicity.toxicity(d, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")).collect()}
    assert got[1000] == pytest.approx(got[1002]) and got[1001] > got[1000] + 1


def test_toxicity_counts_every_occurrence(spark):
    """200 of 1,000 words carry a fifth of what the word carries alone; the others bring nothing."""
    rows = [(i, f"one two three {'four' if i % 5 else 'zorgly'} five") for i in range(300)]
    rest = ["".join(chr(98 + int(c)) for c in f"{i:03d}") + "q" for i in range(800)]
    rows += [(1000, " ".join(["zorgly"] * 200 + rest)), (1001, "zorgly"), (1002, " ".join(rest))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["evidence"] for x in toxicity.toxicity(d, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")).collect()}
    assert got[1001] > 1 and got[1000] == pytest.approx(got[1001] / 5 + got[1002] * 4 / 5)


def test_toxicity_equals_brute_force(spark):
    r = random.Random(12)
    vocabulary = words(r, 300)
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 60)) + (["zorgly", "zorgling"] if i % 6 == 0 else []))) for i in range(240)] + [(500, None), (501, "Zorgly ÉTÉ zorgly"), (502, "")]
    labels = [(i, int(i % 6 == 0)) for i in range(0, 240) if i % 3 < 2]
    got = {x["doc_id"]: x["evidence"] for x in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    text = {i: t or "" for i, t in rows}
    learned = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    evidence = toxicity.brute(list(text.values()), [text[i] for i, y in learned.items() if y], [text[i] for i, y in learned.items() if not y])
    new = [i for i in text if i not in learned]
    assert len(new) > 80 and all(got[i] == pytest.approx(evidence(text[i]), abs=1e-4) for i in new)
