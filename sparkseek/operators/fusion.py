"""Rank fusion, hybrid search, batched search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import Filter
from ..functions.text import code_point_slices
from ..functions.vector import matrix
from . import fulltext, semantic

#: Fusion: the constant of ranks, and how much later the first list starts.
K, FIRST_LIST_DELAY = 60.0, 3.0


def reciprocal_ranks(first: DataFrame, second: DataFrame, k: float = K, keys: tuple[str, ...] = ("rowid", "sub_idx"), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, keys, rrf) of two lists with a column rank from 0; an entry of the first list counts as three ranks later."""
    one = first.select(*by, *keys, (1.0 / (F.col("rank") + FIRST_LIST_DELAY + k)).alias("part"))
    two = second.select(*by, *keys, (1.0 / (F.col("rank") + k)).alias("part"))
    return one.unionByName(two).groupBy(*by, *keys).agg(F.sum("part").alias("rrf"))


def with_ranks(rows: DataFrame, score: str = "score", keys: tuple[str, ...] = ("rowid", "sub_idx"), by: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """rows with rank from 0: score descending, then keys. With a limit every task hands on its best rows only, so
    lists need not be bounded; without one they should be."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round(score, 9)), *keys)
    ranked = rows.withColumn("rank", F.row_number().over(w))
    if limit is not None:
        ranked = ranked.filter(F.col("rank") <= limit)
    return ranked.withColumn("rank", F.col("rank") - 1)


def monotone(rows: DataFrame, rank: str = "rank", score: str = "score") -> DataFrame:
    """Each score at least as great as those after it: the maximum from a row to the end of a bounded list."""
    w = Window.orderBy(rank).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn(score, F.max(score).over(w))


def first_per_document(rows: DataFrame, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy("rowid").orderBy(rank)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def hybrid_search(
    documents: DataFrame, index: fulltext.Index | None, semantic_hits: Callable[[np.ndarray], DataFrame] | None, query: str,
    encode: Callable[[str], np.ndarray], top_k: int, f: Filter | None = None,
) -> DataFrame:
    """(rank, rowid, sub_idx, score, metadata, bodies, date): full-text and semantic hits, fused, one for each document.

    index None: semantic only. The semantic side is asked for queries of more than three bytes; its score counts
    where both sides found an entry. The fused list is cut before documents become unique, so fewer may come. Bodies
    are fetched for the hits only.
    """
    q = " ".join(query.split())
    lexical = fulltext.search(documents, index, q, top_k, f).select("rank", "rowid", "sub_idx", "score") if index else None
    deep = with_ranks(semantic_hits(encode(q))).select("rank", "rowid", "sub_idx", "score") if semantic_hits and len(q.encode()) > 3 else None
    empty = documents.sparkSession.createDataFrame([], "rank int, rowid long, sub_idx int, score double")
    lexical_rows, deep_rows = lexical if lexical is not None else empty, deep if deep is not None else empty
    if index is None:
        fused = deep_rows.withColumn("order", F.col("rank"))
    else:
        fused = reciprocal_ranks(lexical_rows, deep_rows)
        scores = deep_rows.select("rowid", "sub_idx", F.col("score").alias("s2")).join(lexical_rows.select("rowid", "sub_idx", F.col("score").alias("s1")), ["rowid", "sub_idx"], "full_outer")
        fused = fused.join(scores.select("rowid", "sub_idx", F.coalesce("s2", "s1").alias("score")), ["rowid", "sub_idx"])
        fused = fused.withColumn("order", F.row_number().over(Window.orderBy(F.desc("rrf"), "rowid", "sub_idx")) - 1)
    best = first_per_document(fused.filter(F.col("order") < top_k), "order")
    parts = code_point_slices(F.col("body"), F.col("lens"))
    rows = F.broadcast(best).join(documents.select("rowid", "metadata", "body", "lens", "date"), "rowid")  # at most top_k rows
    rows = monotone(rows.select("order", "rowid", "sub_idx", "score", "metadata", parts.alias("bodies"), "date"), "order")
    sub = F.least("sub_idx", F.greatest(F.size("bodies") - 1, F.lit(0)))
    return rows.select(F.col("order").alias("rank"), "rowid", sub.alias("sub_idx"), "score", "metadata", "bodies", "date").orderBy("rank")


def batched_maxsim(tokens: DataFrame, queries: dict[int, np.ndarray], top_k: int = 100, threshold: float = 0.0, block: int = 64) -> DataFrame:
    """(qid, rowid, sub_idx, score, rank): many queries in one pass over the tokens for each block of queries."""
    out = None
    ids = sorted(queries)
    for a in range(0, len(ids), block):
        part = ids[a : a + block]
        stacked = np.vstack([queries[i] for i in part])
        bounds = np.cumsum([0, *[len(queries[i]) for i in part]]).tolist()
        cut = [F.struct(F.lit(i).alias("qid"), F.slice("sims", bounds[n] + 1, bounds[n + 1] - bounds[n]).alias("sims")) for n, i in enumerate(part)]
        rows = semantic.with_similarities(tokens, stacked).select("rowid", "sub_idx", F.explode(F.array(*cut)).alias("q")).select("rowid", "sub_idx", "q.qid", "q.sims")
        most = max(len(queries[i]) for i in part)
        best = rows.groupBy("qid", "rowid", "sub_idx").agg(*[F.max(F.try_element_at("sims", F.lit(i + 1))).alias(f"__q{i}") for i in range(most)])
        w = Window.partitionBy("qid", "rowid").orderBy("sub_idx").rowsBetween(Window.unboundedPreceding, 0)
        total = sum((F.coalesce(F.greatest(F.max(f"__q{i}").over(w), F.lit(0.0)) * F.col(f"__q{i}").isNotNull().cast("int"), F.lit(0.0)) for i in range(most)), F.lit(0.0))
        length = sum((F.col(f"__q{i}").isNotNull().cast("int") for i in range(most)), F.lit(0))
        scored = best.select("qid", "rowid", "sub_idx", (total / length).alias("score")).filter(F.col("score") > threshold)
        ranked = with_ranks(scored, by=("qid",), limit=top_k)
        out = ranked if out is None else out.unionByName(ranked)
    return out


def blocked_maxsim(tokens: DataFrame, queries: DataFrame, top_k: int = 100, threshold: float = 0.0, tokens_in_block: int = 4096, queries_in_block: int = 256) -> DataFrame:
    """(qid, rowid, sub_idx, score, rank) of a table of queries (qid, embedding), a row for each query token, against all tokens.

    Both sides are cut into blocks by a hash, of documents and of queries; every pair of blocks is one product of
    matrices, which hands on its best top_k for each of its queries. Neither side is held by the driver.
    """
    spark = tokens.sparkSession
    sizes = [max(1, -(-tokens.count() // tokens_in_block)), max(1, -(-queries.count() // queries_in_block))]
    cut = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = tokens.groupBy(cut("rowid", sizes[0]).alias("t")).agg(F.collect_list(F.struct("rowid", "sub_idx", "embedding")).alias("d"))
    right = queries.groupBy(cut("qid", sizes[1]).alias("q")).agg(F.collect_list(F.struct("qid", "embedding")).alias("w"))
    pairs = left.crossJoin(right).select("d.rowid", "d.sub_idx", F.col("d.embedding").alias("e"), "w.qid", F.col("w.embedding").alias("f"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rowid, sub, e, qid, f in zip(batch["rowid"], batch["sub_idx"], batch["e"], batch["qid"], batch["f"]):
                yield _best_of_blocks(np.asarray(rowid), np.asarray(sub), matrix(pd.Series(e)), np.asarray(qid), matrix(pd.Series(f)), top_k, threshold)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # a row holds two blocks
    kinds = dict(queries.dtypes) | dict(tokens.dtypes)
    best = pairs.mapInPandas(run, f"qid {kinds['qid']}, rowid {kinds['rowid']}, sub_idx {kinds['sub_idx']}, score double")
    return with_ranks(best, by=("qid",), limit=top_k)


def _best_of_blocks(rowid: np.ndarray, sub: np.ndarray, e: np.ndarray, qid: np.ndarray, f: np.ndarray, top_k: int, threshold: float) -> pd.DataFrame:
    """The best top_k sub-documents of a block for each query of a block: means over a query's tokens of the maxima over
    the tokens of a sub-document and those before it, at least 0."""
    order = np.lexsort((sub, rowid))
    rowid, sub = rowid[order], sub[order]
    sims = e[order] @ f.T
    first = np.flatnonzero(np.r_[True, (rowid[1:] != rowid[:-1]) | (sub[1:] != sub[:-1])])
    peaks, rowid, sub = np.maximum(np.maximum.reduceat(sims, first, axis=0), 0.0), rowid[first], sub[first]
    for i in np.flatnonzero(rowid[1:] == rowid[:-1]) + 1:
        peaks[i] = np.maximum(peaks[i], peaks[i - 1])
    names, at = np.unique(qid, return_inverse=True)
    sums = np.zeros((len(peaks), len(names)))
    np.add.at(sums.T, at, peaks.T)
    scores = sums / np.bincount(at)
    out = []
    for j, name in enumerate(names):
        keep = np.flatnonzero(scores[:, j] > threshold)
        keep = keep[np.lexsort((sub[keep], rowid[keep], -np.round(scores[keep, j], 9)))[:top_k]]
        out.append(pd.DataFrame({"qid": name, "rowid": rowid[keep], "sub_idx": sub[keep], "score": scores[keep, j]}))
    return pd.concat(out)


def batched_search(lexical: DataFrame, deep: DataFrame, top_k: int = 100) -> DataFrame:
    """(qid, rowid, sub_idx, rrf, rank) from both sides' (qid, rowid, sub_idx, rank); documents may come twice."""
    fused = reciprocal_ranks(lexical, deep, by=("qid",))
    return with_ranks(fused, "rrf", by=("qid",), limit=top_k)


def ranked_lines(ranked: DataFrame, key: str = "key") -> DataFrame:
    """(value): a line for each query, its id, a tab, and the keys in order, each followed by a comma. Write it as text."""
    lists = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", key))).alias("r"))
    keys = F.transform("r", lambda x: F.concat(x[key].cast("string"), F.lit(",")))
    return lists.select(F.concat(F.col("qid").cast("string"), F.lit("\t"), F.array_join(keys, "")).alias("value"))
