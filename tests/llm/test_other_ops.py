import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import common, itq, registry, url_filter
from tests.llm.fixtures import documents, empty, frame


# --- 8


def vectors(seed=0, n=300, dims=32):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for i in range(60, 160):
        x[i] = x[i % 10] + 0.12 * rng.normal(size=dims)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, [2 * v for v in rows[0][1]]), (n + 3, None), (n + 4, []), (n + 5, [0.0] * dims), (n + 6, [None] + [1.0] * (dims - 1)), (n + 7, [float("nan")] + [1.0] * (dims - 1)), (n + 8, [float("inf")] + [1.0] * (dims - 1)), (n + 9, [1.0, 2.0]), (n + 10, [1.0, 2.1])]
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings_equal_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cls": F.lit(1), "v": F.lit("x"), "label": F.lit(None).cast("int")})
    got = {r["vec_id"]: tuple(r)[1:] for r in itq.embedding_dedup(df, block=block).collect()}
    want = itq.brute(rows)
    links = sum(v[0] for v in want.values())
    assert links > 200
    assert sum(v[0] for v in got.values()) >= 0.99 * links  # the index's recall
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)
    for i in range(303, 309):
        assert got[i] == (0, i, True)


def test_vectors_with_a_common_direction(spark):
    """Codes are of what is left beside the mean, so more tables are planned."""
    r = np.random.default_rng(5)
    base = r.standard_normal((150, 32)) + 1.5
    x = np.concatenate([base, base + 0.3 * r.standard_normal(base.shape)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert itq.centred(0.95, itq.unit(x)) < 0.9 and itq.centred(0.95, itq.unit(x - x.mean(axis=0))) > 0.94
    got = {q["vec_id"]: q["n_links"] for q in itq.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), bucket=8).collect()}
    want = {i: v[0] for i, v in itq.brute(rows).items()}
    assert sum(got.values()) >= 0.97 * sum(want.values()) > 0 and all(got[i] <= want[i] for i in got)


def test_embeddings_nulls_and_empty(spark):
    s = "vec_id long, embedding array<float>"
    assert [tuple(r) for r in itq.embedding_dedup(spark.createDataFrame([(None, None)], s)).collect()] == [(None, 0, None, True)]
    assert itq.embedding_dedup(spark.createDataFrame([], s)).collect() == []
    assert {tuple(r) for r in itq.embedding_dedup(spark.createDataFrame([(1, [1.0, 0.0])], s)).collect()} == {(1, 0, 1, True)}


def test_plan_keeps_buckets_small_and_misses_rare():
    for n in (10**3, 10**6, 10**9):
        bits, per, turns = itq.plan(n, 64, 0.95, 128, 0.002)
        assert n / 2**bits <= 2 * 128 or bits == 30
        agree = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - agree) ** (per * turns) <= 0.002


# --- 9


def pages(seed=1, n=200):
    r = random.Random(seed)
    hosts = [f"{s}{x}.example.{t}" for s in ("", "www.", "m.") for x in ("a", "b", "bad") for t in ("com", "org", "net")] + ["org", "evilorg", "example.org"]
    out = []
    for i in range(n):
        links = "".join(f'<a href="{r.choice(["http://", "https://", "//"])}{r.choice(hosts)}/x">y</a>' for _ in range(r.randint(0, 3)))
        url = f"{r.choice(['http', 'https'])}://{r.choice(hosts).upper() if i % 9 == 0 else r.choice(hosts)}{r.choice(['', '/', '/fr/1', '/de/2', '/en/1', '/en/12', '/en/2', '/es/x', '?q=/fr/', '#/de/'])}"
        out.append((i, url, links + (" write to me@mail.bad.example.com" if i % 7 == 0 else "")))
    out += [(n, None, None), (n + 1, "no scheme", "<a href='http://a.example.com'>"), (n + 2, "", ""), (n + 3, "http://", None), (n + 4, "a://b://c.org/", "x" * 100_000), (n + 5, "http://user@a.example.org:80/en/1?x", None)]
    return out


def test_url_filter_equals_brute_force(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "n": F.lit(1), "trust": F.lit(0)})
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.url_filter(df).collect()}
    assert got == url_filter.brute(rows)
    assert {v[3] for v in got.values() if v[2] is None} == {"allow", "block"}


def test_url_filter_is_native_and_takes_empties(spark):
    s = "page_id long, url string, html string"
    assert url_filter.url_filter(spark.createDataFrame([], s)).collect() == []
    df = spark.createDataFrame([(None, None, None), (None, None, None)], s)
    assert [tuple(r)[:5] for r in url_filter.url_filter(df).collect()] == [(None, "", "", None, "allow")] * 2
    plan = url_filter.url_filter(spark.createDataFrame(pages(), s))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- shared


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (5, None), (7, 3)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[200] == 200 and len(got) == 72
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_registry(spark):
    q = registry.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in q) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(q)


# --- pipeline


def stages():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline_stages(spark):
    cp = stages()
    assert [f.__name__ for _, f in cp.STAGES] == ["quality_rules", "language_id", "near_duplicates", "repeated_passages", "pack"]
    docs = frame(spark, documents()).select("doc_id", "text", "lang", "source", "n_chars")
    for name, f in cp.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = common.saved(f(spark, docs, ""), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= before
        assert docs.where("n_chars <> length(text)").count() == 0
    assert cp.STAGES[-1][1](spark, docs, "").count() >= docs.count() > 5


def test_pipeline_equals_brute_force(spark):
    """Each stage's decisions against the plain versions of the operators, on its own input."""
    from ridgeline.llm import minhash, quality, suffix

    cp = stages()
    f = dict(cp.STAGES)
    docs = frame(spark, documents(3)).select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id"]).where("doc_id < 100")
    texts = dict(docs.select("doc_id", "text").collect())
    kept = {r["doc_id"] for r in f["quality_rules"](spark, docs, "").collect()}
    failed = {i for i, t in texts.items() if (b := quality.brute(t))[0] < 50 or 100 * b[4] > 50 * b[0]}
    assert not kept & failed
    near = {r["doc_id"] for r in f["near_duplicates"](spark, docs, "").collect()}
    assert near == {i for i, v in minhash.brute(list(texts.items())).items() if v[2]}
    cut = {r["doc_id"]: len(r["text"].encode()) for r in f["repeated_passages"](spark, docs, "").collect()}
    want = suffix.brute(list(texts.items()))
    assert all(n <= want[i][0] - want[i][1] and n >= want[i][0] - want[i][1] - 6 * want[i][2] for i, n in cut.items())


def test_tables_on_the_way_are_dropped(spark):
    import glob

    root = common.checkpoint_dir(spark).removeprefix("file://") + "/ridgeline"
    before = set(glob.glob(f"{root}/*"))

    def make():
        step = common.saved(spark.range(5), "step")
        return step.where("id > 1")

    out = common.alone(make, "result")
    assert set(glob.glob(f"{root}/*")) - before == {out.path.removeprefix("file://")} and out.df.count() == 3
    out.drop()
    assert set(glob.glob(f"{root}/*")) == before


def test_pipeline_with_columns_of_any_name(spark):
    cp = stages()
    names = ["kept", "_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "row", "rest", "id", "th", "spots", "key", "a.b"]
    docs = frame(spark, documents()).select("doc_id", "text", "lang", "source", "n_chars").withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for _, f in cp.STAGES[:-1]:
        out = f(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    good, bad = " ".join(words_of(200)), "x"
    nulls_ = spark.createDataFrame([(None, good, "en", "s", 1), (None, bad, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["text"] for r in dict(cp.STAGES)["quality_rules"](spark, nulls_, "").collect()] == [good]


def words_of(n):
    import random

    from tests.llm.fixtures import words

    return words(random.Random(8), n)


def test_pipeline_takes_empty_and_null(spark):
    cp = stages()
    for docs in (empty(spark), empty(spark).limit(0)):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, f in cp.STAGES:
            assert f(spark, docs, "").count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, tiny, name):
    from tests.oracle import connect, same

    same(registry.queries()[name](spark, tiny), connect(tiny), registry.oracle_sql()[name])
