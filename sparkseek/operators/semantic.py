"""Late-interaction search: exact and through an inverted file of centroids with 4-bit residuals.

Tokens are rows (rowid, sub_idx, embedding). A query is a matrix of a few rows, held on the driver; everything that
grows with the corpus stays distributed. Similarities come as one array a token from a matrix product; maxima are then
plain column aggregates, one for each query token, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import Filter, predicate
from ..functions.text import running_sums
from ..functions.vector import dot, matrix, nearest, nearest_rows, residual_codes, residual_similarities, similarities
from ..tables import bounded_batches, remove, written

#: Probing: clusters for a query token, and the posting budget after which no more are taken.
PROBES, BUDGET = 32, 40_000
#: Measured probing: vectors that are asked, their nearest vectors, and the share of these that probed buckets must hold.
ASKED, NEAREST, HELD = 256, 50, 0.97
#: Candidates by codes for each hit that is wanted, where exact vectors decide.
RESCORED = 8
#: Bytes of centroids that are sent to executors at once.
CENTERS_BYTES = 256 << 20


def with_similarities(tokens: DataFrame, query: np.ndarray, native: bool = False) -> DataFrame:
    """tokens with sims: array<double>, one for each query row. native: by built-in functions only."""
    if native:
        rows = [F.array(*[F.lit(float(x)) for x in row]) for row in np.asarray(query)]
        return tokens.withColumn("sims", F.array(*[dot(F.col("embedding"), r) for r in rows]))
    return tokens.withColumn("sims", similarities(F.col("embedding"), query))


def maxsim(scored: DataFrame, m: int, missing: list[float] | None = None, keys: tuple[str, ...] = ("rowid",)) -> DataFrame:
    """(keys, sub_idx, score) from tokens with sims.

    For each query token the maximum over a sub-document's tokens and those of the sub-documents before it, at least
    `missing`; the score is their mean. So scores don't fall from one sub-document of a document to the next.
    """
    missing = missing or [0.0] * m
    best = scored.groupBy(*keys, "sub_idx").agg(*[F.max(F.col("sims")[i]).alias(f"__q{i}") for i in range(m)])
    w = Window.partitionBy(*keys).orderBy("sub_idx").rowsBetween(Window.unboundedPreceding, 0)
    total = sum((F.greatest(F.max(f"__q{i}").over(w), F.lit(float(missing[i]))) for i in range(m)), F.lit(0.0))
    return best.select(*keys, "sub_idx", (total / m).alias("score"))


def above(scores: DataFrame, threshold: float, missing: list[float] | None = None) -> DataFrame:
    """Scores over the threshold and over what tokens that weren't seen could have had."""
    floor = sum(missing) / len(missing) if missing else 0.0
    return scores.filter(F.col("score") > max(threshold, floor))


def top(scores: DataFrame, top_k: int, documents: DataFrame | None = None, f: Filter | None = None) -> DataFrame:
    """The best top_k; ties by rowid, sub_idx. A filter holds before the limit, after scoring."""
    if f is not None:
        scores = scores.join(documents.filter(predicate(f)).select("rowid"), "rowid", "left_semi")
    return scores.orderBy(F.desc(F.round("score", 9)), "rowid", "sub_idx").limit(top_k)  # ties beyond nine digits go by id


def search_exact(tokens: DataFrame, query: np.ndarray, threshold: float, top_k: int, documents: DataFrame | None = None, f: Filter | None = None) -> DataFrame:
    scores = maxsim(with_similarities(tokens, query), len(query))
    return top(above(scores, threshold), top_k, documents, f)


def sentence_scores(sentences: DataFrame, query: np.ndarray, key: str = "sentence") -> DataFrame:
    """(sentence, score): the mean over query tokens of the maximum over a sentence's tokens; no floor, no order."""
    m = len(query)
    best = with_similarities(sentences, query).groupBy(key).agg(*[F.max(F.col("sims")[i]).alias(f"__q{i}") for i in range(m)])
    return best.select(key, (sum((F.col(f"__q{i}") for i in range(m)), F.lit(0.0)) / m).alias("score"))


# The inverted file.


def centers_wanted(total: int, sampled: int) -> int:
    """16 times the root of the number of vectors, or a quarter of the sample if that is smaller than this."""
    k = max(1, int(16 * sqrt(total) + 0.5))
    return max(1, sampled // 4) if sampled < k else k


def sample_tokens(tokens: DataFrame, key: str = "hash", seed: int = 42) -> DataFrame:
    """Of a chunk's m tokens ceil(sqrt(m)), chosen by the order of a hash."""
    w = Window.partitionBy(key)
    order = w.orderBy(F.xxhash64(F.col(key), F.col("pos"), F.lit(seed)), "pos")
    ranked = tokens.withColumn("__r", F.row_number().over(order)).withColumn("__m", F.count("*").over(w))
    return ranked.filter(F.col("__r") <= F.ceil(F.sqrt(F.col("__m")))).drop("__r", "__m")


def _sums(assigned: DataFrame, dim: int) -> list:
    """A row for each cluster; sums are combined before the shuffle."""
    return assigned.groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(F.col("embedding")[i].cast("double")).alias(f"s{i}") for i in range(dim)]).collect()


def kmeans(vectors: DataFrame, k: int, rounds: int = 5, seed: int = 42, order: tuple[str, ...] = ("rowid", "pos")) -> np.ndarray:
    """k unit centres of (embedding, order columns): first vectors by the order of a hash, then rounds of the nearest
    centre by product and normalised sums. A cluster without vectors takes the next vector in the hash's order.

    Centres are k x dim numbers on the driver; that must fit CENTERS_BYTES, which k's growth with the root allows for.
    """
    first = vectors.orderBy(F.xxhash64(*[F.col(c) for c in order], F.lit(seed)), *order).limit(2 * k).select("embedding").collect()
    if not first:
        return np.zeros((0, 0))
    rows = np.array([r["embedding"] for r in first], dtype=np.float64)
    k = min(k, len(rows))
    if k * rows.shape[1] * 8 > CENTERS_BYTES:
        raise ValueError("centres beyond CENTERS_BYTES: index generations of fewer vectors")
    centers, spare = rows[:k].copy(), list(rows[k:]) or list(rows)
    for turn in range(rounds):
        assigned = vectors.select("embedding", nearest(F.col("embedding"), centers)["bucket"].alias("bucket"))
        found = {r["bucket"]: r for r in _sums(assigned, rows.shape[1])}
        for b in range(k):
            total = np.array([found[b][f"s{i}"] for i in range(rows.shape[1])]) if b in found else spare[(turn * k + b) % len(spare)]
            size = np.linalg.norm(total)
            centers[b] = total / size if size > 0 else centers[b]
    return centers


@dataclass
class Generation:
    """One index generation: centres (bucket, size, center) and postings (generation_id, bucket, rowid, sub_idx, hash, residual)."""

    number: int
    level: int
    centers: np.ndarray
    sizes: np.ndarray
    postings: DataFrame


def build_generation(tokens: DataFrame, number: int = 0, level: int = 0, centers: np.ndarray | None = None, k: int | None = None) -> Generation:
    """Tokens (rowid, sub_idx, pos, hash, embedding) as a generation: sample, k-means, nearest centres, residual codes.

    To keep it, write postings partitioned by bucket, so probes prune files; buckets are known by (generation, bucket).
    """
    bounded_batches(tokens.sparkSession)
    if centers is None:
        sampled = written(sample_tokens(tokens).select("rowid", "pos", "embedding"), "sample")  # every round reads it
        centers = kmeans(sampled, k or centers_wanted(tokens.count(), sampled.count()))
        remove(tokens.sparkSession, sampled)
    coded = tokens.select("rowid", "sub_idx", "hash", residual_codes(F.col("embedding"), centers).alias("c"))
    postings = coded.select(F.lit(number).alias("generation_id"), "c.bucket", "rowid", "sub_idx", "hash", "c.residual")
    sizes = np.zeros(len(centers), dtype=np.int64)
    for r in tokens.select(nearest(F.col("embedding"), centers)["bucket"].alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect():  # a row a centre
        sizes[r["bucket"]] = r["n"]
    return Generation(number, level, centers, sizes, postings)


def probe(centers: np.ndarray, sizes: np.ndarray, query: np.ndarray, probes: int = PROBES, budget: int = BUDGET) -> tuple[list[int], list[float]]:
    """(buckets, missing): for each query token its nearest buckets until their postings reach the budget, the one that
    crosses it included. A token that stays below may miss vectors as similar as its last bucket; others miss nothing
    that counts."""
    sims = np.asarray(query) @ centers.T
    chosen, missing = set(), [0.0] * len(sims)
    for i, row in enumerate(sims):
        order = np.argsort(-row, kind="stable")[:probes]
        before = np.concatenate([[0], np.cumsum(sizes[order])])
        chosen.update(int(b) for b, n in zip(order, before) if n < budget)
        if before[-1] < budget and len(order):
            missing[i] = max(0.0, float(row[order[-1]]))
    return sorted(chosen), missing


def probe_table(centroids: DataFrame, probes: int = PROBES, budget: int = BUDGET) -> DataFrame:
    """The probing rule on a table (qtok, bucket, size, sim), for centroids that don't fit the driver: (qtok, bucket, sim, rank, before)."""
    w = Window.partitionBy("qtok").orderBy(F.desc("sim"), "bucket")
    ranked = centroids.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= probes)
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("before", before).filter(F.col("before") < budget)


def missing_table(centroids: DataFrame, probes: int = PROBES, budget: int = BUDGET) -> DataFrame:
    """(qtok, missing) of such a table."""
    w = Window.partitionBy("qtok").orderBy(F.desc("sim"), "bucket")
    ranked = centroids.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= probes)
    stats = ranked.groupBy("qtok").agg(F.sum("size").alias("total"), F.min("sim").alias("last"))
    return stats.select("qtok", F.greatest(F.when(F.col("total") < budget, F.col("last")).otherwise(0.0), F.lit(0.0)).alias("missing"))


def probes_wanted(tokens: DataFrame, g: Generation, held: float = HELD, asked: int = ASKED, top_k: int = NEAREST, seed: int = 42) -> int:
    """The least number of probes with which a generation's buckets hold `held` of the exact top_k of its vectors.

    A fixed number of vectors, chosen by the order of a hash, are asked against all tokens in one pass; each task hands on
    its best top_k for each of them, with their buckets. The places of these in the asked vectors' orders are found
    afterwards, for one asked vector at a time.
    """
    bounded_batches(tokens.sparkSession)
    chosen = tokens.orderBy(F.xxhash64("rowid", "pos", F.lit(seed)), "rowid", "pos").limit(asked).select("embedding").collect()
    if not chosen or not len(g.centers):
        return 1
    q, c = np.array([r["embedding"] for r in chosen], dtype=np.float64), g.centers

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sims, buckets = np.zeros((len(q), 0)), np.zeros((len(q), 0), dtype=int)
        for p in parts:
            rows = matrix(p["embedding"])
            if not len(rows):
                continue
            sims = np.hstack([sims, q @ rows.T])
            buckets = np.hstack([buckets, np.tile(nearest_rows(rows, c)[0], (len(q), 1))])
            keep = np.argsort(-sims, axis=1, kind="stable")[:, :top_k]
            sims, buckets = np.take_along_axis(sims, keep, 1), np.take_along_axis(buckets, keep, 1)
        n = sims.shape[1]
        yield pd.DataFrame({"q": np.repeat(np.arange(len(q)), n), "sim": sims.ravel(), "bucket": buckets.ravel()})

    found = tokens.select("embedding").mapInPandas(best, "q int, sim double, bucket int")
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "bucket")
    kept = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top_k).groupBy("q", "bucket").count().collect()  # asked x top_k rows at most
    by_query: dict[int, list] = {}
    for r in kept:
        by_query.setdefault(r["q"], []).append(r)
    counts = np.zeros(len(c), dtype=np.int64)
    for i, rows in by_query.items():
        place = np.empty(len(c), dtype=np.int64)
        place[np.argsort(-(c @ q[i]), kind="stable")] = np.arange(len(c))
        for r in rows:
            counts[place[r["bucket"]]] += r["count"]
    sums = np.cumsum(counts)
    return int(np.searchsorted(sums, held * sums[-1])) + 1


def search_index(
    generations: list[Generation], unindexed: DataFrame | None, query: np.ndarray, threshold: float, top_k: int,
    documents: DataFrame | None = None, f: Filter | None = None, probes: int = PROBES, budget: int = BUDGET,
    exact: DataFrame | None = None,
) -> DataFrame:
    """(rowid, sub_idx, score), the best top_k through the index; tokens not indexed yet are scored exactly.

    Candidates are all tokens of the probed buckets; each is scored against every query token as the centre's product
    plus the residual's. With documents, postings of contents that no document has any more don't count. With exact, the
    tokens that the postings stand for, codes only choose RESCORED times top_k candidates, whose documents exact vectors score.
    """
    q = np.asarray(query, dtype=np.float64)
    m, missing, parts = len(q), [0.0] * len(query), []
    for g in generations:
        if not len(g.centers):
            continue
        buckets, own = probe(g.centers, g.sizes, q, probes, budget)
        missing = [max(a, b) for a, b in zip(missing, own)]
        sims = g.centers[buckets] @ q.T  # at most probes x m rows
        spark = g.postings.sparkSession
        near = spark.createDataFrame([(b, [float(x) for x in s]) for b, s in zip(buckets, sims)], "bucket int, base array<double>")
        hit = g.postings.filter(F.col("bucket").isin(buckets)).join(F.broadcast(near), "bucket")
        total = F.zip_with("base", residual_similarities(F.col("residual"), q), lambda a, b: a + b)
        part = hit.select("rowid", "sub_idx", "hash", total.alias("sims"))
        if documents is not None:
            part = part.join(documents.select("rowid", "hash"), ["rowid", "hash"], "left_semi")
        parts.append(part.select("rowid", "sub_idx", "sims"))
    if unindexed is not None:
        parts.append(with_similarities(unindexed, q).select("rowid", "sub_idx", "sims"))
    if not parts:
        raise ValueError("nothing to search")
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    if exact is not None:
        chosen = top(maxsim(scored, m, missing), RESCORED * top_k, documents, f).select("rowid").distinct()
        rows = exact.join(F.broadcast(chosen), "rowid", "left_semi")  # whole documents: unseen sub-documents count too
        if documents is not None and "hash" in exact.columns:
            rows = rows.join(documents.select("rowid", "hash"), ["rowid", "hash"], "left_semi")
        return top(above(maxsim(with_similarities(rows, q), m), threshold), top_k)
    return top(above(maxsim(scored, m, missing), threshold, missing), top_k, documents, f)


# The generations as levels.


@dataclass(frozen=True)
class Levels:
    """Level L holds up to base x fanout^(L + 1) vectors; fewer than base wait unindexed."""

    base: int = 1024
    fanout: int = 16

    def capacity(self, level: int) -> int:
        return self.base * self.fanout ** (level + 1)

    def plan(self, unindexed: int, sizes: dict[int, int]) -> tuple[int, int] | None:
        """(target level, vectors in it) of the merge that takes up `unindexed` vectors, or None while they wait.

        Levels are added up until the total fits; all of them up to the target become one generation."""
        if unindexed < max(1, self.base):
            return None
        total, level = unindexed, 0
        while True:
            total += sizes.get(level, 0)
            if total <= self.capacity(level):
                return level, total
            level += 1


def embeddings_in(chunks: DataFrame) -> Column:
    """The number of vectors of chunks with counts: array<int>."""
    return F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))


def token_subs(ends: Column, lens: Column) -> Column:
    """For token end offsets (code points) the sub-document each belongs to: the number of sub-documents that end before it."""
    def placed(bounds: Column) -> Column:
        return F.transform(ends, lambda e: F.size(F.filter(bounds, lambda b: b < e)))

    return F.transform(F.array(running_sums(lens)), placed)[0]  # bound once for all offsets
