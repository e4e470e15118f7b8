import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import quality as Q
from sparkseek.llm import toxicity as T
from sparkseek.llm.linear import fit, logits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def misspelled(rng, term, most=3):
    for _ in range(rng.randint(0, most)):
        i = rng.randint(0, len(term))
        term = rng.choice([term[:i] + rng.choice("abcdeiost1") + term[i:], term[:i] + term[i + 1 :], term[:i] + rng.choice("aeiost0") + term[i + 1 :]])
    return term


@pytest.mark.parametrize("prefix", [0, 3])
def test_automaton_against_distances(prefix):
    rng, terms = random.Random(1), {"idiot": 1, "worthless": 2, "worthful": 1, "scum": 0, "moron": 0, "disgusting": 2, "loser": 1, "losers": 2}
    trie = T.LevenshteinTrie(terms, prefix)
    for _ in range(5000):
        w = misspelled(rng, rng.choice(list(terms)))
        near = {t: distance(w[prefix:], t[prefix:]) for t in terms if w[:prefix] == t[:prefix]}
        expected = sorted((e, t) for t, e in near.items() if e <= terms[t])
        assert trie.matches(w) == expected
        assert trie.match(w) == ((expected[0][1], expected[0][0]) if expected else None)


def slow_features(model, text):
    """FEATURES by the distance to every term, quotations by reading characters, and windows by slicing."""
    low, marks, opened, inside = text.lower(), {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’"}, None, set()
    for i, c in enumerate(low):
        if c == "\n":
            opened = None
        elif opened is None:
            opened = i if c in marks else None
        elif c in marks[low[opened]]:
            inside |= set(range(opened, i + 1))
            opened = None
    tokens = [(m.group(), m.start()) for m in T.re.finditer(r"[^\W_]+", low)]
    kinds, mention, addressed_sum, seen = [0.0] * 4, 0.0, 0.0, set()
    for i, (w, at) in enumerate(tokens):
        options = [(distance(w, t), 0, t) for t in T.LEXICON if distance(w, t) <= T.edits_for(t)]
        options += [(distance(w[3:], t[3:]), 1, t) for t, e in model.learned if w[:3] == t[:3] and distance(w[3:], t[3:]) <= e]
        if not options or w in model.harmless:
            continue
        edits, n, term = min(options)
        window = [t for t, _ in tokens[max(0, i - T.WINDOW) : i + T.WINDOW + 1]]
        quoted, said, addressed = at in inside, any(t in T.REPORTING for t in window), any(t in T.ADDRESS for t in window)
        share = {(0, 0): 1.0, (0, 1): 0.8, (1, 0): 0.4, (1, 1): 0.15}[quoted, said]
        share = min(1.0, 1.5 * share) if addressed else share
        kinds[2 * n + (edits > 0)] += share / (1 + edits)
        mention, addressed_sum = mention + 1 - share, addressed_sum + share * addressed
        seen.add(term)
    direct = sum(kinds)
    numbers = [*kinds, mention, addressed_sum, len(seen) if direct >= 0.5 else 0, 100 * direct / len(tokens) if tokens else 0]
    return [float(np.log1p(x)) for x in numbers]


def test_score_against_brute_force(spark):
    rng = random.Random(3)
    model = T.Model([("achlicher", 2), ("achlichein", 1), ("bocoas", 0), ("zuglos", 1)], ["moroon", "achlich"], tuple(rng.uniform(-1, 2) for _ in T.PRIOR))
    words = [*T.LEXICON, *(t for t, _ in model.learned), "schlicher", "lake", "stone", "said", "you", "du", "zitat", "moroon", "achlich"]
    texts = ["", " ", "«idiot» idiot", "“a\nidiot”"]
    for _ in range(300):
        parts = [misspelled(rng, rng.choice(words), 2) for _ in range(rng.randint(1, 40))]
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", ' "', "“", "” ", "„", "« ", "» ", "_", "’ ", "‘"]) for w in parts))
    scanner = T.Scanner(model)
    for t in texts:
        assert np.allclose(scanner.features(t), slow_features(model, t)), t
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", T.score_column(F.col("text"), model).alias("s")).collect()
    for r in got:
        z = sum(a * b for a, b in zip(slow_features(model, texts[r["i"]]), model.weights)) + model.weights[-1]
        assert abs(r["s"] - 1 / (1 + np.exp(-z))) < 2e-6


def test_learned_terms_against_brute_force(spark):
    """Edits by counting, for every candidate, the texts with a word within each distance."""
    rng = random.Random(8)
    rows = []
    for i in range(600):
        bad = i % 6 == 0
        text = rng.choices([f"word{k}" for k in range(80)], k=20) + [misspelled(rng, "zugrotlich", 2) if bad else rng.choice(["zugerotes", "lichtrot", "stone"])]
        rows.append((" ".join(text), int(bad)))
    model = T.learn_terms(spark.createDataFrame(rows, "text string, y int"))
    texts = [(set(t.split()) - set(model.harmless), y) for t, y in rows]
    found = dict(model.learned)
    assert "zugrotlich" in found and found["zugrotlich"] == 2
    for term, edits in found.items():
        near = [y for ws, y in texts if any(w[:3] == term[:3] and distance(w[3:], term[3:]) <= edits for w in ws)]
        assert sum(near) >= T.STRONG * len(near) and sum(near) >= 3


def test_quotation_counts_less():
    s = T.Scanner(T.Model())
    weights = np.array(T.PRIOR)
    value = lambda text: float(logits(np.array([s.features(text)]), weights)[0])
    abuse, quoted, clean = "you are an idiot and a moron", 'the report said "idiot and a moron" was written', "a calm text about lakes"
    assert value(abuse) > value(quoted) > value(clean) == pytest.approx(T.PRIOR[-1])
    assert value("such an idi0t, you m0ron") > value(clean) and s.features("") == (0.0,) * len(T.FEATURES)


def made(spark, n=1000):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text, bad = rng.choices(words, k=60), i % 5 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(60), rng.choice(["idiot", "moron", "idi0t"]) if i % 2 else f"zugrot{rng.choice('abcdefgh')}x{rng.randrange(9)}")
        docs.append((i, " ".join(text), "x", 0.5))
        if i % 4:
            labels.append((i, int(bad)))
    docs += [(9000, "", "x", 0.0), (9001, None, "x", 0.0), (9001, None, "x", 0.0), (None, "idiot", "x", 0.0), (9002, "fine " * 30_000, "x", 0.0)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, docs, labels = made(spark)
    model = T.train(docs, labels)
    assert any(t.startswith("zugrot") and e for t, e in model.learned)
    out = T.score(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] < 9000 and r["held_out"]:
            assert r["predicted"] == int(r["doc_id"] % 5 == 0)
        if r["doc_id"] in (9000, 9001, 9002):
            assert r["predicted"] == 0 and 0 <= r["score"] < 0.2
    kept = T.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and {9000, 9001, 9002} <= {r["doc_id"] for r in kept.collect()}


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i % 70}") for i in range(5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 50, i % 2) for i in range(1000)], "doc_id long, toxic int")
    assert T.training_rows(docs, labels, 20).count() <= 20


def test_toxicity_without_labels(spark):
    _, docs, labels = made(spark, 20)
    assert T.train(docs, labels.limit(0)).weights == T.PRIOR
    assert T.train(docs, labels.withColumn("toxic", F.lit(1))).learned == []
    assert T.score(docs.limit(0), labels).count() == 0


def test_toxicity_held_out_accuracy(spark):
    import __spark_entry__

    d = "/root/testdata/sf0.01"
    out = T.op7_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    clean = [r for r in out if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean) and __spark_entry__.HAS_LLM
    assert np.mean([r["score"] for r in out if r["toxic"]]) > 5 * np.mean([r["score"] for r in clean])


def test_regression():
    x = np.random.default_rng(0).standard_normal((500, 2))
    w = fit(x, (x[:, 0] + 0.5 > 0).astype(float))
    assert w[0] > 3 and abs(w[1]) < 1 and w[2] > 0
    assert fit(np.zeros((0, 2)), np.zeros(0), np.array([1.0, 2, 3])).tolist() == [1, 2, 3]


def test_quality_views(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        good = i % 3 > 0
        text = " ".join(rng.choices(["calm", "lake", "river", "stone", "water"], k=80)) if good else " ".join(rng.choices(["***", "$$$", "BUY!!", "|"], k=80))
        rows.append((i, text, "en", "good" if good and i % 2 else "mixed", len(text), 1.0))
        if i % 2:
            labels.append((i, int(good)))
    rows += [(900, None, None, None, None, 1.0), (901, "", "en", "s", 0, 1.0), (901, "", "en", "s", 0, 1.0), (902, "calm lake " * 20_000, "en", "mixed", 200_000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    out = Q.score(docs, known).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 500]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= 0.98 * len(held)
    assert Q.score(docs.limit(0), known).count() == 0
    assert {r["score"] for r in Q.score(docs, known.limit(0)).collect()} == {0.5}
    bare = docs.select("doc_id", "text")
    assert Q.score(bare, known).count() == len(rows)


def test_packed_numbers():
    rng = random.Random(5)
    for many in (0, 1, 2, 40, 3000):
        numbers = sorted(rng.sample(range(Q.PHRASES), many))
        assert Q.unpacked(Q.packed(numbers)).tolist() == numbers
    assert Q.unpacked(Q.packed([0, 255, 510, 16383])).tolist() == [0, 255, 510, 16383]


def slow_cells(model, row):
    """Cells of the text and of the metadata, number by number."""
    bins = [sum(x >= e for e in edges) for x, edges in zip(row["numbers"], model.edges)]
    text = [k * Q.BINS + b for k, b in enumerate(bins[:-1])] + [Q._SURFACE + f for f in Q.unpacked(row["phrases"])]
    first = Q._TEXT + Q.BINS
    return text, [Q._TEXT + bins[-1], first + row["names"][0], first + Q.HASHED + 1 + row["names"][1]]


def slow_odds(model, row):
    text, meta = slow_cells(model, row)
    n, many = len(Q.TEXT_FEATURES), max(1, len(Q.unpacked(row["phrases"])))
    parts = [model.cells[c] for c in text[:n]] + [sum(model.cells[c] for c in text[n:]) / many**0.5]
    return (
        sum(w * x for w, x in zip(model.text, parts)) + model.text[-1],
        sum(w * model.cells[c] for w, c in zip(model.meta, meta)) + model.meta[-1],
    )


def slow_ratios(sums):
    out = {}
    for view in (0, 1):
        good, bad = sums["rows", view, 1] + 1, sums["rows", view, 0] + 1
        rate = good / (good + bad)
        for c in {c for c, *_ in sums if c != "rows" and (c >= Q._TEXT) == bool(view)}:
            out[c] = np.log((sums[c, view, 1] + Q.SMOOTHING * rate) / (sums[c, view, 0] + Q.SMOOTHING * (1 - rate)) / (good / bad))
    return out


def test_quality_against_brute_force(spark):
    """Log-ratios of one round of exchange, and the scores, from rows taken one by one."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.6
        text = " ".join(rng.choices(["calm", "lake", "River", "stone."] if good else ["***", "$$$", "BUY!!", "lake"], k=rng.randint(1, 40)))
        rows.append((i, text, "en", "good" if good else "bad", float(len(text))))
        if i % 3 == 0:
            labels.append((i, int(good)))
    rows += [(None, "calm " * 9, None, None, None)] * 3 + [(2, "***", "en", "bad", 3.0)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars double")
    known = spark.createDataFrame([*labels, (2, None), (None, 1)], "doc_id long, quality int")
    found = Q.measured(docs, known)
    first = Q.train(found, rounds=0)
    every = found.collect()
    assert len(every) == len(rows) and {r["role"] for r in every} == {Q.POOL, Q.LEARN, Q.CALIBRATE, Q.HELD_OUT}
    pool = [slow_odds(first, r) for r in every if r["role"] == Q.POOL]
    step = lambda z: int(np.floor((min(30, max(-30, z)) + 30) * Q._STEPS))
    bounds, rate = Q.surest(found.filter("role = 0"), first, 0.1), 1 / (1 + np.exp(-first.prior))
    for (low, high), zs in zip(bounds, zip(*pool)):
        steps = [step(z) for z in zs]
        # The widest bounds that hold the share, pulled in to where the view is confident.
        by_low = next(k for k in range(2000) if sum(s <= k for s in steps) >= 0.1 * len(zs) * (1 - rate))
        by_high = next(k for k in range(1200, -1, -1) if sum(s >= k for s in steps) >= 0.1 * len(zs) * rate)
        assert (low, high) == (min(by_low, step(-np.log(9)) - 1), max(by_high, step(np.log(9)) + 1))
    sums, given = Counter(), 0
    for r in every:
        if r["role"] not in (Q.POOL, Q.LEARN):
            continue
        named = [None, None]
        if r["y"] is None:
            for view, z in enumerate(slow_odds(first, r)):  # each view names labels for the other
                s = step(z)
                named[1 - view] = 1 if s >= bounds[view][1] else 0 if s <= bounds[view][0] else None
            given += sum(x is not None for x in named)
        else:
            named = [int(r["y"])] * 2
        for view, (label, cells) in enumerate(zip(named, slow_cells(first, r))):
            if label is not None:
                for c in ["rows", *cells]:
                    sums[c, view, label] += 1.0 if r["y"] is not None else Q.PSEUDO_WEIGHT
    assert given > 0
    second = Q.learned(found.filter("role < 2"), first, bounds)
    expected = slow_ratios(sums)
    assert np.allclose(second.cells[list(expected)], list(expected.values())) and np.count_nonzero(np.delete(second.cells, list(expected))) == 0
    last, got = Q.train(found), sorted((r["doc_id"] or -1, r["score"]) for r in Q.score(docs, known).collect())
    slow = sorted((r["doc_id"] if r["doc_id"] is not None else -1, 1 / (1 + np.exp(-(sum(slow_odds(last, r)) - last.prior)))) for r in every)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in every) == [i for i, _ in slow]
    assert np.allclose(sorted(s for _, s in got), sorted(s for _, s in slow), atol=2e-6)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = Q.op4_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.9 * len(out)
