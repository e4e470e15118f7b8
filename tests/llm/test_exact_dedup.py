import hashlib
import re

from pyspark.sql import functions as F

from sparkseek.llm import exact_dedup as E


def slow(rows):
    groups = {}
    for doc, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(key, []).append((doc, text or ""))
    out = []
    for key, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        out += [(doc, keep, len(members), hashlib.sha256(key.encode()).hexdigest()) for doc, _ in members]
    return sorted(out)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n"), (7, "é"), (8, "é"), (9, "x" * 100_000), (10, "x" * 100_000), (11, "a b"), (3, "a  b"), (12, "A b")]


def check(spark, rows, **k):
    df = spark.createDataFrame([(a, b, "clash", 0) for a, b in rows], "doc_id long, text string, digest string, n int")
    got = E.groups(df, **k).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == slow(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    return df


def test_odd_rows(spark):
    df = check(spark, ROWS)
    out = E.exact_dedup(df)
    assert out.columns == df.columns and out.count() == 7


def test_hot_group(spark):
    check(spark, [(i, "same text" + " " * (i % 3)) for i in range(5000)] + [(9000 + i, f"other {i}") for i in range(50)])


def test_empty(spark):
    assert E.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_collisions_are_told_apart(spark, monkeypatch):
    """With a digest of a few values only full bytes tell texts apart."""
    rows = [(i, t) for i, t in enumerate(["a", "b", "a ", "c", "b", "d", "a"])]
    located = E.located
    monkeypatch.setattr(E, "located", lambda *a: located(*a).withColumn("digest", F.lit("0")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in E.groups(df).collect()}
    assert got == {0: (2, 3, False), 2: (2, 3, True), 6: (2, 3, False), 1: (1, 2, True), 4: (1, 2, False), 3: (3, 1, True), 5: (5, 1, True)}


def test_state_outlives_a_run(spark, tmp_path):
    def put(name, rows):
        df = E.as_files(spark.createDataFrame(rows, "doc_id long, text string"))
        E.located(df).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))

    args = (spark, str(tmp_path / "events"), "doc_id long, digest string, points long, file string, place long", str(tmp_path / "state"), str(tmp_path / "cp"))
    put("a", [(5, "x"), (6, "y")])
    E.stream_state(*args)
    put("b", [(1, "x"), (2, "z")])
    E.stream_state(*args)
    held = {r["keep_id"]: r["n"] for r in E.current_state(spark, str(tmp_path / "state")).collect()}
    assert held == {1: 2, 6: 1, 2: 1}
