"""Tables of the queries, and the document relation that stands for them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import content_hash

#: Vectors that serve as query tokens, and the first vectors, which serve as fixed centres.
QUERY_IDS, CENTERS = (3, 101, 250), 16


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """rowid, date, metadata, body, lens, hash of the documents table; dates go round the year with the id."""
    d = read(spark, folder, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    rows = d.select(
        F.col("doc_id").alias("rowid"), F.format_string("d%d", "doc_id").alias("uuid"), F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.to_json(F.struct("lang", "source")).alias("metadata"), F.col("text").alias("body"), F.array(F.char_length("text")).alias("lens"),
    )
    return rows.withColumn("hash", content_hash(F.col("body"), F.col("lens")))


DOC_SQL = """d AS (
  SELECT doc_id AS rowid, 'd' || doc_id AS uuid, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INT), '%Y-%m-%d') AS date, lang, source, text AS body,
    substr(sha256(text || length(text)), 1, 32) AS hash FROM documents)"""


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """rowid, sub_idx, pos, hash, embedding: five vectors a document, two, two and one a sub-document."""
    e = read(spark, folder, "embeddings")
    row = F.floor(F.col("vec_id") / 5).cast("long")
    at = (F.col("vec_id") % 5).cast("int")
    return e.select(row.alias("rowid"), F.floor(at / 2).cast("int").alias("sub_idx"), at.alias("pos"), F.format_string("h%d", row).alias("hash"), "embedding", "vec_id", "label")


def query_matrix(spark: SparkSession, folder: str, ids: tuple[int, ...] = QUERY_IDS) -> np.ndarray:
    """A few vectors, in the order of ids."""
    found = {r["vec_id"]: r["embedding"] for r in read(spark, folder, "embeddings").filter(F.col("vec_id").isin(*ids)).collect()}
    return np.array([found[i] for i in ids], dtype=np.float64)


def fixed_centers(spark: SparkSession, folder: str) -> np.ndarray:
    return query_matrix(spark, folder, tuple(range(CENTERS)))


TOKEN_SQL = """t AS (SELECT CAST(vec_id // 5 AS BIGINT) AS rowid, CAST((vec_id % 5) // 2 AS INT) AS sub_idx, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""
QUERY_SQL = "q AS (SELECT CASE vec_id " + " ".join(f"WHEN {v} THEN {i}" for i, v in enumerate(QUERY_IDS)) + f" END AS qtok, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id IN {QUERY_IDS})"


def maxsim_sql(missing: tuple[float, ...] = (0.0, 0.0, 0.0)) -> str:
    floors = " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(missing))
    return f"""{TOKEN_SQL}, {QUERY_SQL},
best AS (SELECT rowid, sub_idx, qtok, max(list_inner_product(e, qe)) AS s FROM t, q GROUP BY ALL),
run AS (SELECT rowid, sub_idx, qtok, greatest(max(s) OVER (PARTITION BY rowid, qtok ORDER BY sub_idx), CASE qtok {floors} END) AS s FROM best),
scores AS (SELECT rowid, sub_idx, avg(s) AS score FROM run GROUP BY ALL)"""
