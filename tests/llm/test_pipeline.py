import corpus_pipeline as C
from sparkseek.llm import exact_dedup
from sparkseek.llm.decontaminate import Matcher, words_of
from sparkseek.llm.toxicity import score


def test_stages_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    bad = {r["doc_id"] for r in score(docs, labels).filter("predicted = 1").collect()}
    left = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in bad]
    groups = {}
    for doc, text in left:
        groups.setdefault("".join(text.translate(dict.fromkeys([32, *range(9, 14)]))), []).append((-len(text), doc, text))
    left = [(d, t) for members in groups.values() for _, d, t in [min(members)]]
    words = {d: t.lower().split() for d, t in left}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    matcher = Matcher(items)
    expected = {d for d, t in left if find(d) == d and not matcher.find(words_of(t))[1]}
    out = C.run(spark, data).collect()
    assert {r["doc_id"] for r in out} == expected and len(out) == len(expected) and all(r["round_trip"] for r in out)


def test_stages_keep_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "sentencepiece"]
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns
    assert exact_dedup.exact_dedup(docs).count() <= docs.count()


def test_stages_on_odd_rows(spark, data):
    """Nulls anywhere, empty and long texts, repeated rows, columns with the names that operators use themselves."""
    rows = [(1, "a fine text", "en", "s", 3), (2, None, None, None, None), (None, "no id", "en", "s", 1), (3, "", "en", "s", 0), (1, "a fine text", "en", "s", 3), (4, "word " * 40_000, "en", "s", 9), (5, "you idiot moron scum", "en", "s", 2)]
    docs = spark.createDataFrame([(*r, "x", 1.0, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, score double, fp string")
    for name, stage in C.STAGES:
        empty = stage(spark, docs.limit(0), data)
        assert empty.count() == 0
        out = stage(spark, docs, data)
        found = {r["doc_id"] for r in out.collect()}
        assert {1, 4} <= found and found <= {1, 2, 3, 4, 5, None}
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "exact dedup":
            assert out.count() == 5 and len(found & {2, 3}) == 1  # null and empty are equal; the repeated row goes
        if name == "toxicity":
            assert 5 not in found
