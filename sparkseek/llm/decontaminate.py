"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of benchmark words. Patterns of one length form a matcher: a shift table over blocks of two words
tells how far the search may move on, a block that ends some pattern leads to a bucket of the patterns with that
suffix, and a direct comparison of all words confirms. Texts are read once for each block of patterns; a block has a
bounded size, so what is sent to the executors doesn't grow with the benchmark.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import bounded_batches, table, text_of, written

WINDOW = 10
#: Bytes of benchmark text in one block of patterns.
BLOCK_BYTES = 8 << 20
#: Bytes to bytes: A-Z to a-z; what isn't a digit, a letter or beyond ASCII becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class WuManber:
    """Patterns of one length, in words. find() gives (end, pattern) of every occurrence."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.m = len(patterns[0])
        self.b = min(2, self.m)
        self.far = self.m - self.b + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(dict)  # by suffix block; a bucket's own hash spares comparing its members one by one
        for n, p in enumerate(patterns):
            for end in range(self.b, self.m + 1):
                block = self._block(p, end)
                self.shift[block] = min(self.shift.get(block, self.far), self.m - end)
            self.buckets[self._block(p, self.m)][p] = n
        self.buckets = dict(self.buckets)

    def _block(self, words, end: int):
        return words[end - 1] if self.b == 1 else (words[end - 2], words[end - 1])

    def find(self, words: list[bytes]):
        m, far, get, buckets = self.m, self.far, self.shift.get, self.buckets
        i, n = m, len(words)
        if self.b == 1:
            while i <= n:
                if get(words[i - 1], far) == 0:
                    yield i, buckets[words[i - 1]][(words[i - 1],)]
                i += 1
            return
        while i <= n:
            block = (words[i - 2], words[i - 1])
            step = get(block, far)
            if step:
                i += step
                continue
            number = buckets[block].get(tuple(words[i - m : i]))
            if number is not None:
                yield i, number
            i += 1


class Matcher:
    """All windows of the given (item_id, text) items; find() marks hit words and gives the items that occur."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                owners[tuple(words[i : i + size])].add(item)
        by_length = defaultdict(list)
        for p in owners:
            by_length[len(p)].append(p)
        self.engines = [(WuManber(ps), [owners[p] for p in ps]) for _, ps in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Word positions inside occurrences, in order, and the items."""
        spans, items = [], set()
        for engine, owners in self.engines:
            for end, number in engine.find(words):
                spans.append((end - engine.m, end))
                items |= owners[number]
        if not spans:
            return np.empty(0, dtype=np.int64), items
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        for a, b in spans:
            cover[a] += 1
            cover[b] -= 1
        return np.nonzero(np.cumsum(cover[:-1]))[0], items


def blocks_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(item, text, block) with the number of blocks, from the measured size of the benchmark."""
    items = benchmark.select(benchmark[id_col].cast("string").alias("item"), text_of(benchmark, text_col).alias("text")).filter("item is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = max(1, -(-size * 2 // block_bytes))
    return items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count))), count


def annotated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a column __scan: struct<n_words, n_hit, n_items, items_sha256, contaminated>."""
    bounded_batches(docs.sparkSession)
    items, count = blocks_of(benchmark, block_bytes=block_bytes)
    if count == 1:
        return docs.withColumn("__scan", _scan_block(docs.sparkSession, items, window)(text_of(docs)))
    # Many blocks: each gives hit positions and items of the rows it finds something in; these are small.
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "scan")
    found = None
    for block in range(count):
        hits = written(_hits(rows, items.filter(F.col("block") == block), window), "hits")
        found = hits if found is None else found.unionAll(hits)
    n_hit = found.select("__row", F.explode("positions").alias("p")).distinct().groupBy("__row").agg(F.count("*").alias("__hit"))
    named = found.select("__row", F.explode("items").alias("i")).distinct().groupBy("__row").agg(F.array_sort(F.collect_list("i")).alias("__items"))
    listed, hit = F.coalesce("__items", F.array().cast("array<string>")), F.coalesce("__hit", F.lit(0).cast("long"))
    scan = F.struct(
        _count_words(text_of(rows)).alias("n_words"), hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
    return rows.join(n_hit, "__row", "left").join(named, "__row", "left").withColumn("__scan", scan).select(*_names(docs), "__scan")


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


@F.pandas_udf(LongType())
def _count_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(words_of(t))).astype("int64")


def _items(items: DataFrame) -> list[tuple[str, str]]:
    """One block, whose bytes are bounded, on the driver."""
    return [(r["item"], r["text"]) for r in items.collect()]


def _hits(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(_items(items))

    def search(batches):
        matcher = Matcher(shared.value, window)
        for batch in batches:
            out = []
            for row, text in zip(batch["__row"], batch["text"]):
                positions, found = matcher.find(words_of(text))
                if found:
                    out.append((row, positions.tolist(), sorted(found)))
            yield pd.DataFrame(out, columns=["__row", "positions", "items"])

    texts = rows.select("__row", text_of(rows).alias("text"))
    return texts.mapInPandas(search, "__row long, positions array<long>, items array<string>")


def _scan_block(spark: SparkSession, items: DataFrame, window: int):
    shared = spark.sparkContext.broadcast(_items(items))

    @F.pandas_udf("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value, window)
        for texts in parts:
            out = []
            for text in texts:
                words = words_of(text)
                positions, found = matcher.find(words)
                named = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
                out.append((len(words), len(positions), len(found), named, len(positions) > 0))
            yield pd.DataFrame(out, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return search


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each input row.

    Null and empty texts have no words; items without words or without id are ignored; items of one id count as one;
    repeated rows are searched alike; extra columns are ignored; empty tables give empty results or no hits. Long
    texts are searched whole.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return annotated(rows, benchmark, window, block_bytes).select("doc_id", "__scan.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs; all columns stay."""
    return annotated(docs, benchmark, window).filter("not __scan.contaminated").select(*_names(docs))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
