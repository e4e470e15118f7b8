import random

from pyspark.sql import functions as F

from sparkseek.llm import near as N


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_roots(texts):
    """Components of all pairs of texts that are similar enough, by comparing every pair."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def made(rng):
    words = [f"w{i}" for i in range(2000)]
    texts = ["", None, " \n ", "one two", "one two", "ONE two", "one two three four five", "x" * 30_000, "long " * 30_000]
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(60, 400))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 2, 12])):
            copy = list(base)
            for _ in range(max(1, int(len(copy) * rng.choice([0.005, 0.01, 0.02, 0.06])))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(5)
    texts = made(rng)
    rows = [(i, t, "n", 1, 2.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, w0 int, `a.b` double")
    kept = N.near_dedup(df)
    assert kept.columns == df.columns
    got, root = {r["doc_id"] for r in kept.collect()}, slow_roots(texts)
    wrong = [i for i in range(len(texts)) if i not in got and root[i] == i]
    could = [i for i in range(len(texts)) if root[i] != i]
    assert not wrong and len(could) > 100
    assert sum(i not in got for i in could) >= 0.95 * len(could)
    assert {3, 7, 8} <= got and not {1, 2, 4, 5} & got


def test_odd_rows(spark):
    schema = "doc_id long, text string, other int"
    rows = [(5, "a b c", 1), (None, "a b c", 2), (None, "lonely text", 3), (None, "lonely text", 4), (7, "same id", 5), (7, "other text of it", 6), (9, "twice here", 7), (9, "twice here", 8), (1, None, 9), (2, "", 9)]
    got = N.near_dedup(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(5, "a b c"), (0, "lonely text"), (7, "same id"), (7, "other text of it"), (9, "twice here"), (1, "")])
    assert N.near_dedup(spark.createDataFrame([], schema)).count() == 0


def test_shared_keys_lose_no_pair(spark):
    """Texts of many groups under one fingerprint: the least member of a key is like few of the others."""
    rng = random.Random(6)
    texts = [t for t in made(rng) if t and t.strip()]
    texts = sorted(set(texts))
    nodes = spark.createDataFrame([(i * 7 - 300, 5, -5, 0) for i in range(len(texts))], "node long, w0 long, w1 long, w2 long")
    own = spark.createDataFrame([(i * 7 - 300, t) for i, t in enumerate(texts)], "node long, text string")
    got = {r["node"]: r["root"] for r in N.near_roots(nodes, own).collect()}
    for i, r in enumerate(slow_roots(texts)):
        assert got.get(i * 7 - 300, i * 7 - 300) == r * 7 - 300


def test_wide_fingerprints(spark):
    """Bits by counting; and near texts are near."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(2000)]
    base = rng.choices(words, k=300)
    copy = base[:150] + ["new"] + base[150:]
    apart = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(N.wide_fingerprint(a), N.wide_fingerprint(b)))
    a, b, c = " ".join(base), " ".join(copy), " ".join(rng.choices(words, k=300))
    assert N.wide_fingerprint("") == (0, 0, 0) and N.wide_fingerprint("A b") == N.wide_fingerprint("a  b")
    assert apart(a, b) < 25 < 60 < apart(a, c)
    assert N.similarity(a, b) > 0.9 and N.similarity(a, c) < 0.1 and N.similarity("", " ") == 1.0 and N.similarity("a", "") == 0.0


def test_hot_group(spark):
    """A third of all rows are distinct near copies of one text: the work is about the rows, not their pairs."""
    base = [f"t{i}" for i in range(120)]
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit(" ".join(base)), F.lit(" end"), F.col("id"))).otherwise(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.hash(F.col("id"), i).cast("string")))).alias("text"),
    )
    assert N.near_dedup(df).count() == 2001


def edited(rng, n):
    """A text of 150 words and n - 1 copies, each with up to 20 words replaced: most are similar to no other."""
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=150)
    texts = {" ".join(base): None}
    while len(texts) < n:
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(1, 20)):
            copy[at] = rng.choice(words)
        texts[" ".join(copy)] = None
    texts = list(texts)
    rng.shuffle(texts)
    return texts


def test_crowd_of_unlike_texts(spark, monkeypatch):
    """One fingerprint for all, few of them similar: no link is lost, and texts are compared in proportion to the rows."""
    compared, write = [], N.written

    def counted(df, tag):
        out = write(df, tag)
        if tag == "near":
            compared.append(out.count())
        return out

    monkeypatch.setattr(N, "written", counted)
    texts = edited(random.Random(8), 400)
    nodes = spark.createDataFrame([(i * 3 - 100, 5, -5, 0) for i in range(len(texts))], "node long, w0 long, w1 long, w2 long")
    own = spark.createDataFrame([(i * 3 - 100, t) for i, t in enumerate(texts)], "node long, text string")
    got = {r["node"]: r["root"] for r in N.near_roots(nodes, own).collect()}
    root = slow_roots(texts)
    assert len(set(root)) > 200
    assert all(got.get(i * 3 - 100, i * 3 - 100) == r * 3 - 100 for i, r in enumerate(root))
    assert sum(compared) < 8 * len(texts), compared


def test_like_texts_in_the_second_round(spark, monkeypatch):
    """Near copies that the first round joined: what the second one handles doesn't grow with the keys that they share."""
    made, write = [], N.written

    def counted(df, tag):
        out = write(df, tag)
        made.append((tag, out.count()))
        return out

    monkeypatch.setattr(N, "written", counted)
    rng = random.Random(9)
    base = rng.choices([f"w{i}" for i in range(2000)], k=150)
    texts = [" ".join([*base, f"end{i}"]) for i in range(120)]
    nodes = spark.createDataFrame([(i * 3 - 100, *N.wide_fingerprint(t)) for i, t in enumerate(texts)], "node long, w0 long, w1 long, w2 long")
    own = spark.createDataFrame([(i * 3 - 100, t) for i, t in enumerate(texts)], "node long, text string")
    got = {r["node"]: r["root"] for r in N.near_roots(nodes, own).collect()}
    assert got == {i * 3 - 100: -100 for i in range(len(texts))}
    after = made[[tag for tag, _ in made].index("roots") + 1 : -1]
    assert sum(n for _, n in after) < 4 * len(texts), after
    assert next(n for tag, n in made if tag == "members") > 60 * len(texts) > 20 * len(texts) > dict(made)["stars"]


def test_key_of_a_crowd_and_others(spark):
    """Texts outside of a crowd that share keys with it, and whose other hubs are like none of them, are still paired."""
    rng = random.Random(10)
    crowd, u = edited(rng, 60), rng.choices([f"x{i}" for i in range(900)], k=150)
    others = [" ".join(rng.choices([f"y{i}" for i in range(900)], k=150)), " ".join(u), " ".join([*u, "end"])]
    here, there = (5, -5, 0), (5, 0x0F0F0F0F0F0F0F0F, 0x3C3C3C3C3C3C3C3C)  # w0 in common, over 48 bits apart
    assert sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(here, there)) > N.WIDE_BITS
    texts = [*crowd, *others]
    nodes = spark.createDataFrame([(i, *(here if i < len(crowd) else there)) for i in range(len(texts))], "node long, w0 long, w1 long, w2 long")
    got = {r["node"]: r["root"] for r in N.near_roots(nodes, spark.createDataFrame(list(enumerate(texts)), "node long, text string")).collect()}
    root = slow_roots(texts)
    assert all(got.get(i, i) == r for i, r in enumerate(root))
    assert got[len(crowd) + 2] == len(crowd) + 1
