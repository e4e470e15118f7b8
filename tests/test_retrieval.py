import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.functions import vector as V
from sparkseek.functions.filters import Condition
from sparkseek.operators import documents as D
from sparkseek.operators import evaluate, fulltext, fusion, semantic
from sparkseek.streaming.ingest import HashEncoder, encode_windows, keep_long_vectors, next_merge

RNG = np.random.default_rng(3)


def unit(n, dim=16):
    m = RNG.standard_normal((n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def tokens(spark):
    rows, pos = [], 0
    for doc in range(40):
        for sub in range(3):
            for _ in range(1 + (doc + sub) % 3):
                rows.append((doc, sub, pos, f"h{doc}", unit(1)[0].tolist()))
                pos += 1
    return spark.createDataFrame(rows, "rowid long, sub_idx int, pos int, hash string, embedding array<float>").cache()


def loop(rows, query, missing):
    """Scores in order: a sub-document also has what came before it in its document."""
    out, best = {}, {}
    for r in sorted(rows, key=lambda r: (r["rowid"], r["sub_idx"])):
        sims = query @ np.array(r["embedding"])
        old = best.get(r["rowid"], np.array(missing))
        best[r["rowid"]] = np.maximum(old, sims)
        out[r["rowid"], r["sub_idx"]] = best[r["rowid"]].mean()
    return out


@pytest.mark.parametrize("missing", [[0.0, 0.0, 0.0], [0.1, 0.3, 0.0]])
def test_maxsim_equals_the_loop(tokens, missing):
    query = unit(3)
    expected = loop(tokens.collect(), query, missing)
    for native in (False, True):
        got = {(r["rowid"], r["sub_idx"]): r["score"] for r in semantic.maxsim(semantic.with_similarities(tokens, query, native), 3, missing).collect()}
        assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k], abs=1e-6) for k in got)


def test_probe():
    centers = np.eye(4)
    q = np.array([[0.9, 0.5, 0.2, 0.1]])
    assert semantic.probe(centers, np.array([5, 5, 5, 5]), q, 4, 10) == ([0, 1], [0.0])
    assert semantic.probe(centers, np.array([5, 6, 5, 5]), q, 4, 11) == ([0, 1], [0.0])  # the one that crosses the budget is taken
    assert semantic.probe(centers, np.array([5, 5, 5, 5]), q, 3, 99) == ([0, 1, 2], [0.2])


def test_index_finds_what_exact_search_finds(tokens):
    query = unit(3)
    exact = [(r["rowid"], r["sub_idx"]) for r in semantic.search_exact(tokens, query, 0.0, 20).collect()]
    g = semantic.build_generation(tokens, k=12)
    found = [(r["rowid"], r["sub_idx"]) for r in semantic.search_index([g], None, query, 0.0, 20).collect()]
    assert len(set(exact) & set(found)) >= 16
    half = semantic.build_generation(tokens.filter("rowid < 20"), k=6)
    mixed = semantic.search_index([half], tokens.filter("rowid >= 20"), query, 0.0, 20).collect()
    assert len({(r["rowid"], r["sub_idx"]) for r in mixed} & set(exact)) >= 15
    live = tokens.select("rowid", "hash").distinct().filter("rowid <> 0")
    assert all(r["rowid"] != 0 for r in semantic.search_index([g], None, query, 0.0, 200, documents=live).collect())


def test_kmeans_is_repeatable(tokens):
    a, b = (semantic.kmeans(tokens, 5) for _ in range(2))
    assert np.array_equal(a, b) and np.allclose(np.linalg.norm(a, axis=1), 1)
    assert semantic.centers_wanted(10_000, 10_000) == 1600 and semantic.centers_wanted(10_000, 100) == 25 and semantic.centers_wanted(1, 1) == 1


def test_levels(spark):
    levels = semantic.Levels(4, 2)
    assert [levels.capacity(i) for i in range(3)] == [8, 16, 32]
    assert levels.plan(3, {}) is None and levels.plan(4, {}) == (0, 4) and levels.plan(4, {0: 8}) == (1, 12) and levels.plan(4, {0: 8, 1: 16}) == (2, 28)
    chunks = spark.createDataFrame([(i, 2) for i in range(1, 6)], "chunk long, n int")
    done = spark.createDataFrame([(0, 4, 1, 2)], "level int, num_embeddings int, min_chunk long, max_chunk long")
    assert next_merge(chunks, done, levels) == (1, 10, 1)
    assert next_merge(chunks.filter("chunk <= 3"), done, levels) is None


def test_sentences_and_batches(tokens):
    query = unit(2)
    rows = tokens.collect()
    got = {r["rowid"]: r["score"] for r in semantic.sentence_scores(tokens, query, "rowid").collect()}
    for doc in got:
        assert got[doc] == pytest.approx(np.mean(np.max([query @ np.array(r["embedding"]) for r in rows if r["rowid"] == doc], axis=0)), abs=1e-6)
    many = fusion.batched_maxsim(tokens, {7: query, 9: query[:1]}, top_k=10, block=1)
    assert {(r["qid"], r["rank"]) for r in many.collect()} == {(q, k) for q in (7, 9) for k in range(10)}
    alone = [(r["rowid"], r["sub_idx"]) for r in semantic.search_exact(tokens, query, 0.0, 10).collect()]
    assert [(r["rowid"], r["sub_idx"]) for r in many.filter("qid = 7").orderBy("rank").collect()] == alone


def test_codes():
    expected = [-0.25, -0.118843, -0.056226, -0.026331, -0.012059, -0.005245, -0.001992, -0.000438]
    assert np.allclose(V.code_values(), expected + [-x for x in reversed(expected)], atol=1e-6)
    values = [-0.3, -0.25, -0.1, -0.01, 0, 0.001, 0.01, 0.1, 0.25]
    packed = V.encode_residuals(np.array([values]))[0]
    assert [c for b in packed for c in (b >> 4, b & 15)][:9] == [0, 0, 1, 4, 8, 8, 11, 14, 15]
    rows = unit(7, 15) / 10
    again = V.decode_residuals(V.encode_residuals(rows), 15)
    assert np.array_equal(V.decode_residuals(V.encode_residuals(again), 15), again)


DOCS = ["A group of flamingos is called a flamboyance", "Flamingo one", "The café is open", "cats and dogs", "dogs and cats and cats", "Straße", ""]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, f"u{i}", f"2024-01-{i + 1:02}", '{"n":%d}' % i, d) for i, d in enumerate(DOCS)]
    return D.prepare(spark.createDataFrame(rows, "rowid long, uuid string, date string, metadata string, body string")).cache()


def test_fulltext(documents):
    index = fulltext.build(documents)
    find = lambda q, **k: [r["rowid"] for r in fulltext.search(documents, index, q, 10, **k).orderBy("rank").collect()]
    assert find("flam") == [1, 0] and find("flamingo ") == [1] and find("CAFE") == [2] and find("strasse") == [] and find("straße ") == [5]
    assert set(find("cats dogs ")) == {3, 4} and find("nothing here") == []
    assert find("") == [6, 5, 4, 3, 2, 1, 0]
    assert find("flam", f=Condition("uuid", "Equals", "u0")) == [0]
    row = fulltext.search(documents, index, "flamingo one ", 10).first()
    assert row["sub_idx"] == 0 and row["score"] > 0.9


def test_bm25_formula(documents):
    index = fulltext.build(documents)
    lengths = [8, 2, 4, 3, 5, 1, 0]
    mean = sum(lengths) / 7
    got = {r["rowid"]: r["score"] for r in fulltext.bm25(index, [("cats", False)]).collect()}
    idf = math.log((7 - 2 + 0.5) / 2.5)
    for doc, tf in ((3, 1), (4, 2)):
        assert got[doc] == pytest.approx(-idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[doc] / mean)), abs=1e-9)
    assert fulltext.bm25(index, [("cats", False), ("cats", False)]).filter("rowid = 3").first()["score"] == pytest.approx(2 * got[3], abs=1e-8)


def test_entries_are_counted_in_the_row(spark):
    """Counts as by hand, one shuffle by ranges and no other, repeated rows as one document; a built index has no hashes."""
    rows = [(1, "b a b É e c", "x"), (2, "", "y"), (3, None, "z"), (4, "?? !", "v"), (5, "a a", "w"), (5, "a a", "w")]
    df = spark.createDataFrame(rows, "rowid long, body string, hash string")
    found = fulltext.entries(df)
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted([("", 1, "x", 6), ("a", 1, "x", 1), ("b", 1, "x", 2), ("c", 1, "x", 1), ("e", 1, "x", 2), ("", 2, "y", 0), ("", 3, "z", 0), ("", 4, "v", 0), ("", 5, "w", 4), ("a", 5, "w", 4)])
    plan = found._jdf.queryExecution().sparkPlan().toString()  # and what ensures the distributions adds none:
    assert plan.count("Exchange") == 1
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 0 and plan.count("Exchange rangepartitioning") == 1
    index = fulltext.build(df)
    assert index.count == 5 and sorted(map(tuple, index.postings.filter("term = 'a'").collect())) == [("a", 1, 1), ("a", 5, 4)]
    assert fulltext.build(df.limit(0)).count == 0


def test_rrf(spark):
    a = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 2)], "rowid long, sub_idx int, rank int")
    b = spark.createDataFrame([(2, 0, 0), (4, 2, 1), (1, 0, 2)], "rowid long, sub_idx int, rank int")
    got = [(r["rowid"], r["sub_idx"], round(r["rrf"], 9)) for r in fusion.reciprocal_ranks(a, b).orderBy(F.desc("rrf")).collect()]
    assert got == [(2, 0, 0.032291667), (1, 0, 0.032002048), (4, 2, 0.016393443), (3, 1, 0.015384615)]


def test_hybrid(spark, documents):
    encoder = HashEncoder(16)
    rows = [(i, 0, p, v.tolist()) for i, d in enumerate(DOCS) for p, v in enumerate(encoder.encode(d)[0])]
    tokens = spark.createDataFrame(rows, "rowid long, sub_idx int, pos int, embedding array<double>")
    search = lambda q, k, index: fusion.hybrid_search(documents, index, lambda m: semantic.search_exact(tokens, m, 0.2, k), q, lambda t: encoder.encode(t)[0], k).collect()
    got = search("cats and dogs", 3, fulltext.build(documents))
    assert {r["rowid"] for r in got[:2]} == {3, 4} and [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    assert got[0]["bodies"] == [DOCS[got[0]["rowid"]]]
    assert {r["rowid"] for r in search("cats and dogs", 3, None)[:2]} == {3, 4}
    assert {r["rowid"] for r in search("ca", 5, fulltext.build(documents))} == {0, 2, 3, 4}  # two bytes: full text alone


def test_document_hash_and_upsert(spark):
    empty = spark.createDataFrame([], D.DOCUMENT)
    rows = spark.createDataFrame([("a", "x", "{}", "first document body"), ("b", "x", "{}", "two")], "uuid string, date string, metadata string, body string")
    one = D.upsert(empty, rows)
    assert one.filter("uuid = 'a'").first()["hash"] == "b3c22e8f2fa0dcff273c5dd7a816e5d3"
    more = spark.createDataFrame([("b", "y", "{}", "changed"), ("c", "y", "{}", "")], "uuid string, date string, metadata string, body string")
    two = D.upsert(one, more)
    assert {(r["uuid"], r["rowid"], r["body"]) for r in two.collect()} == {("a", 1, "first document body"), ("b", 2, "changed"), ("c", 3, "")}
    chunks = D.add_chunks(spark.createDataFrame([], "hash string"), one.select("hash"))
    assert chunks.count() == 2 and D.orphans(chunks, two).count() == 1 and D.live_chunks(chunks, two).count() == 1
    assert [r["body"] for r in D.backlog(two, chunks).collect()] == ["changed"]  # empty bodies wait for nothing
    assert D.remove(two, "b").count() == 2


def test_ndcg_and_quantiles(spark):
    ranked = spark.createDataFrame([("q", k, i + 1) for i, k in enumerate("abc")], "qid string, key string, rank int")
    rel = spark.createDataFrame([("q", "a", 1), ("q", "c", 2), ("q", "z", 1)], "qid string, key string, rel int")
    ideal = 2 + 1 / math.log2(3) + 1 / 2
    assert evaluate.mean_ndcg(ranked, rel).first()["ndcg"] == pytest.approx((1 + 2 / 2) / ideal)
    values = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert evaluate.clamped_quantile(values, "v", 0.95, 100.0).first()["quantile"] == 10 and evaluate.clamped_quantile(values, "v", 0.95, 8.0).first()["quantile"] == 8


def test_encoder_parts(spark):
    ones = lambda part: np.ones((len(part), 2))
    out = encode_windows(ones, list(range(5000)))
    assert len(out) == 5000 and out[0, 0] == 1 and out[1800, 0] == 2 and out[2100, 0] == 1
    m, ends = keep_long_vectors(np.array([[3.0, 4], [0.1, 0]]), [1, 2])
    assert m.tolist() == [[0.6, 0.8]] and ends == [1]
    with pytest.raises(ValueError):
        keep_long_vectors(np.zeros((1, 2)), [1])
    subs = spark.range(1).select(semantic.token_subs(F.array(*map(F.lit, [2, 5, 6, 11, 20])), F.array(*map(F.lit, [5, 6]))).alias("s")).first()["s"]
    assert subs == [0, 0, 1, 1, 2]


def test_index_recall_with_more_centres_than_probes(spark):
    """Vectors without clusters: recall of the exact top 50 over every 50th vector."""
    from sparkseek.plans import common

    d = "/root/testdata/sf0.1"
    rows = common.tokens(spark, d).cache()
    g = semantic.build_generation(rows)
    assert len(g.centers) > semantic.PROBES
    probes = semantic.probes_wanted(rows, g)
    g.postings = g.postings.cache()
    asked = {r["vec_id"]: np.array([r["embedding"]], dtype=np.float64) for r in rows.filter("vec_id % 50 = 0").collect()}
    exact = {i: set() for i in asked}
    for r in fusion.batched_maxsim(rows, asked, top_k=50).collect():
        exact[r["qid"]].add((r["rowid"], r["sub_idx"]))
    key = lambda found: {(r["rowid"], r["sub_idx"]) for r in found.collect()}
    found = lambda i: key(semantic.search_index([g], None, asked[i], 0.0, 50, probes=probes, budget=1 << 60, exact=rows))
    with ThreadPoolExecutor(8) as pool:
        part = list(pool.map(lambda i: len(exact[i] & found(i)) / 50, sorted(asked)))
    print(f"{len(asked)} queries, {len(g.centers)} centres, {probes} probes: recall {np.mean(part)}, least {min(part)}")
    assert np.mean(part) >= 0.9


def test_nearest_centres_in_blocks(spark):
    """Products with many centres are never held for a whole batch, blocks change nothing, and a task codes in one worker."""
    import tracemalloc

    rng = np.random.default_rng(3)
    rows, centers = rng.normal(size=(3000, 8)), rng.normal(size=(4000, 8))
    centers[7] = centers[5]
    tracemalloc.start()
    at, score = V.nearest_rows(rows, centers, 1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sims = rows @ centers.T
    assert np.array_equal(at, sims.argmax(axis=1)) and np.allclose(score, sims.max(axis=1)) and not (at == 7).any()
    assert peak < 4 << 20  # all products are 96 MB
    assert [len(x) for x in V.nearest_rows(np.zeros((0, 0)), centers)] == [0, 0]
    tokens = spark.createDataFrame([(i, 0, 0, f"h{i}", r.tolist()) for i, r in enumerate(rows[:40])], "rowid long, sub_idx int, pos int, hash string, embedding array<float>")
    g = semantic.build_generation(tokens, centers=centers[:5])
    assert g.postings._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_probes_wanted_against_counting(spark):
    """The number of probes as by hand, from all products."""
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(300, 8))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    rows = rows.astype(np.float32).astype(np.float64)
    tokens = spark.createDataFrame([(i, 0, 0, f"h{i}", r.tolist()) for i, r in enumerate(rows)], "rowid long, sub_idx int, pos int, hash string, embedding array<float>")
    g = semantic.build_generation(tokens, centers=rows[:20])
    bucket = (rows @ rows[:20].T).argmax(axis=1)
    places = []
    for q in rows:
        place = np.argsort(np.argsort(-(rows[:20] @ q), kind="stable"))
        places += place[bucket[np.argsort(-(rows @ q))[:10]]].tolist()
    sums = np.cumsum(np.bincount(places, minlength=20))
    assert semantic.probes_wanted(tokens, g, 0.9, asked=300, top_k=10) == int(np.searchsorted(sums, 0.9 * sums[-1])) + 1


def test_long_texts_come_to_jaro_in_small_batches(spark, data):
    from sparkseek.plans.document_queries import jw_rerank

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert jw_rerank(spark, data).count() == 200
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
