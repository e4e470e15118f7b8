import hashlib
import random
import re

import pytest

from sparkseek.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 600])
def test_against_brute_force(spark, block_bytes):
    rng = random.Random(4)
    vocabulary = [*"abcde", "é", "ß", "x1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 9, 10, 11, 25])))) for i in range(30)] + [(7, "again a"), (40, None), (41, "!!!")]
    docs = [(i, ", ".join(rng.choices(vocabulary, k=rng.randint(0, 60))).upper()) for i in range(40)] + [(50, None), (51, ""), (52, items[5][1]), (0, "a-b"), (53, ("a b c d e " * 3000) + (items[6][1] or ""))]
    d = spark.createDataFrame([(a, b, 9) for a, b in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in D.scan(d, b, block_bytes=block_bytes).collect()), key=str)
    assert got == slow(docs, items)


def test_filter_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", "k"), (2, "clean text", "k"), (3, None, None)], "doc_id long, text string, extra string")
    items = spark.createDataFrame([(1, "Two three four five six seven eight nine, ten ELEVEN!")], "item_id long, text string")
    out = D.decontaminate(docs, items)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 3]
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, none).count() == 3 and D.scan(docs.limit(0), items).count() == 0


def test_query(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in D.op6_decontamination(spark, data).collect()), key=str) == slow(docs, items)
