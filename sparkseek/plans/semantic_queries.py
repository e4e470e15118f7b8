"""Queries of late-interaction search and its index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import fusion, semantic
from .common import CENTERS, DOC_SQL, QUERY_SQL, TOKEN_SQL, documents, fixed_centers, maxsim_sql, query_matrix, tokens

MISSING, PROBES = (0.1, 0.2, 0.0), 4
VALUES = ", ".join(repr(float(x)) for x in V.code_values())


def _budget(folder_tokens: DataFrame) -> int:
    return max(1, folder_tokens.count() // 8)


def maxsim_exact(spark: SparkSession, d: str) -> DataFrame:
    hits = semantic.search_exact(tokens(spark, d), query_matrix(spark, d), 0.0, 50)
    return hits.select("rowid", "sub_idx", F.round("score", 6).alias("score"))


def maxsim_prefix(spark: SparkSession, d: str) -> DataFrame:
    q = query_matrix(spark, d)
    return semantic.maxsim(semantic.with_similarities(tokens(spark, d), q, native=True), len(q)).select("rowid", "sub_idx", F.round("score", 6).alias("score"))


def maxsim_cutoff(spark: SparkSession, d: str) -> DataFrame:
    q = query_matrix(spark, d)
    scores = semantic.maxsim(semantic.with_similarities(tokens(spark, d), q), len(q), list(MISSING))
    return semantic.above(scores, 0.05, list(MISSING)).select("rowid", "sub_idx", F.round("score", 6).alias("score"))


def maxsim_filtered(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.filters import Condition

    hits = semantic.search_exact(tokens(spark, d), query_matrix(spark, d), 0.0, 30, documents(spark, d), Condition("$.lang", "Equals", "en"))
    return hits.select("rowid", "sub_idx", F.round("score", 6).alias("score"))


def sentence_score(spark: SparkSession, d: str) -> DataFrame:
    rows = tokens(spark, d).withColumn("sentence", F.floor(F.col("vec_id") / 8).cast("long"))
    return semantic.sentence_scores(rows, query_matrix(spark, d)).select("sentence", F.round("score", 6).alias("score"))


def kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    near = V.nearest(F.col("embedding"), fixed_centers(spark, d))
    return tokens(spark, d).select("vec_id", near.alias("n")).select("vec_id", "n.bucket", F.round("n.score", 6).alias("score"))


def _centroid_table(spark: SparkSession, d: str) -> DataFrame:
    centers, q = fixed_centers(spark, d), query_matrix(spark, d)
    sims = q @ centers.T
    table = spark.createDataFrame([(i, b, float(sims[i, b])) for i in range(len(q)) for b in range(len(centers))], "qtok int, bucket int, sim double")
    sizes = tokens(spark, d).select(V.nearest(F.col("embedding"), centers)["bucket"].alias("bucket")).groupBy("bucket").agg(F.count("*").alias("size"))
    return table.join(sizes, "bucket", "left").fillna(0, ["size"])


def ivf_probe_budget(spark: SparkSession, d: str) -> DataFrame:
    found = semantic.probe_table(_centroid_table(spark, d), PROBES, _budget(tokens(spark, d)))
    return found.select("qtok", "bucket", "rank", "before", F.round("sim", 6).alias("sim"))


def missing_sim(spark: SparkSession, d: str) -> DataFrame:
    return semantic.missing_table(_centroid_table(spark, d), PROBES, _budget(tokens(spark, d)) * 4).select("qtok", F.round("missing", 6).alias("missing"))


def residual_score(spark: SparkSession, d: str) -> DataFrame:
    """Every token's similarities through its centre and its coded residual, all buckets probed."""
    g = semantic.build_generation(tokens(spark, d), centers=fixed_centers(spark, d))
    hits = semantic.search_index([g], None, query_matrix(spark, d), 0.0, 1 << 30, probes=CENTERS, budget=1 << 60)
    return hits.select("rowid", "sub_idx", F.round("score", 5).alias("score"))


def ivf_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole way: sample, k-means, codes, as many probes as the vectors need, candidates by codes, exact scores."""
    rows = tokens(spark, d)
    g = semantic.build_generation(rows)
    hits = semantic.search_index([g], None, query_matrix(spark, d), 0.0, 50, probes=semantic.probes_wanted(rows, g), budget=1 << 60, exact=rows)
    return hits.select("rowid", "sub_idx", F.round("score", 4).alias("score"))


def sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    return semantic.sample_tokens(tokens(spark, d).withColumn("hash", F.format_string("c%d", F.floor(F.col("vec_id") / 23).cast("long")))).groupBy("hash").agg(F.count("*").alias("n"))


def mulaw_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(16).select(F.col("id").alias("code"), F.round(V.expand(V.dequantize(F.col("id"))), 6).alias("value"))


def quantize4(spark: SparkSession, d: str) -> DataFrame:
    codes = tokens(spark, d).select(F.explode("embedding").alias("x")).select(V.quantize(V.compand(F.col("x"))).alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("n"))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    unit = V.l2_normalize(F.col("embedding"))
    return tokens(spark, d).select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"), F.round(unit[0], 5).alias("first"), F.round(V.dot(unit, unit), 5).alias("square"))


def vector_max(spark: SparkSession, d: str) -> DataFrame:
    top = F.aggregate(F.sort_array(F.collect_list("embedding")), F.array_repeat(F.lit(-2.0).cast("float"), 64), lambda a, x: V.elementwise_max(a, x))
    return tokens(spark, d).groupBy("rowid").agg(top.alias("m")).select("rowid", F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def level_capacity(spark: SparkSession, d: str) -> DataFrame:
    levels = semantic.Levels()
    return spark.createDataFrame([(i, levels.capacity(i)) for i in range(3)], "level int, capacity long")


def unindexed_count(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all chunks, of the indexed ones (the fixed centres' buckets), and what is left."""
    rows = tokens(spark, d)
    chunks = rows.groupBy("hash").agg(F.array(F.count("*").cast("int")).alias("counts"))
    total = chunks.agg(semantic.embeddings_in(chunks).alias("total"))
    done = rows.filter("label < 5").agg(F.count("*").alias("indexed"))
    return total.crossJoin(F.broadcast(done)).withColumn("unindexed", F.greatest(F.col("total") - F.col("indexed"), F.lit(0)))


def batched_search(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50 as a query of one token: exact scores, the best 20 of each."""
    rows = tokens(spark, d)
    asked = rows.filter("vec_id % 50 = 0").select(F.floor(F.col("vec_id") / 50).cast("long").alias("qid"), "embedding")
    hits = fusion.blocked_maxsim(rows, asked, top_k=20)
    return hits.select("qid", "rank", "rowid", "sub_idx", F.round("score", 6).alias("score"))


def encoder_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of vectors with what their codes decode to."""
    from ..operators.evaluate import agreement

    decoded = F.transform("embedding", lambda x: V.expand(V.dequantize(V.quantize(V.compand(x)))))
    out = agreement(tokens(spark, d).select("embedding", decoded.alias("again")), "embedding", "again")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


QUERIES = {f.__name__: f for f in (
    maxsim_exact, maxsim_prefix, maxsim_cutoff, maxsim_filtered, sentence_score, kmeans_assign, ivf_probe_budget, missing_sim, residual_score, ivf_search, sample_sizes,
    mulaw_table, quantize4, vector_norms, vector_max, level_capacity, unindexed_count, batched_search, encoder_agreement,
)}

_CENTER_SQL = f"c AS (SELECT CAST(vec_id AS INT) AS bucket, CAST(embedding AS DOUBLE[]) AS ce FROM embeddings WHERE vec_id < {CENTERS})"
_ASSIGN_SQL = f"""{TOKEN_SQL}, {_CENTER_SQL},
a AS (SELECT vec_id, rowid, sub_idx, e, bucket, ce, list_inner_product(e, ce) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_inner_product(e, ce), 12) DESC, bucket) AS r FROM t, c),
n AS (SELECT * FROM a WHERE r = 1)"""
_TABLE_SQL = f"""{_ASSIGN_SQL}, {QUERY_SQL},
z AS (SELECT bucket, count(*) AS size FROM n GROUP BY ALL),
g AS (SELECT qtok, c.bucket, coalesce(size, 0) AS size, list_inner_product(qe, ce) AS sim FROM q, c LEFT JOIN z USING (bucket)),
k AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g WINDOW w AS (PARTITION BY qtok ORDER BY sim DESC, bucket))"""
_COMPAND = "(sign({x}) * ln(abs({x}) * 1020 + 1) / ln(256))"
_QUANT = "greatest(0, least(15, round((" + _COMPAND + " + 1) / 2 * 15)))"
_EXPAND = "(sign({y}) * (256 ** abs({y}) - 1) / 255 / 4)"


def _codes(x: str) -> str:
    return _QUANT.format(x=x)


ORACLE_SQL = {
    "maxsim_exact": f"WITH {maxsim_sql()} SELECT rowid, sub_idx, round(score, 6) AS score FROM scores WHERE score > 0 ORDER BY round(score, 9) DESC, rowid, sub_idx LIMIT 50",
    "maxsim_prefix": f"WITH {maxsim_sql()} SELECT rowid, sub_idx, round(score, 6) AS score FROM scores",
    "maxsim_cutoff": f"WITH {maxsim_sql(MISSING)} SELECT rowid, sub_idx, round(score, 6) AS score FROM scores WHERE score > {max(0.05, sum(MISSING) / 3)}",
    "maxsim_filtered": f"WITH {maxsim_sql()}, {DOC_SQL} SELECT rowid, sub_idx, round(score, 6) AS score FROM scores JOIN d USING (rowid) WHERE score > 0 AND lang = 'en' ORDER BY round(score, 9) DESC, rowid, sub_idx LIMIT 30",
    "sentence_score": f"WITH {TOKEN_SQL}, {QUERY_SQL}, b AS (SELECT vec_id // 8 AS sentence, qtok, max(list_inner_product(e, qe)) AS s FROM t, q GROUP BY ALL) SELECT sentence, round(avg(s), 6) AS score FROM b GROUP BY ALL",
    "kmeans_assign": f"WITH {_ASSIGN_SQL} SELECT vec_id, bucket, round(score, 6) AS score FROM n",
    "ivf_probe_budget": f"WITH {_TABLE_SQL} SELECT qtok, bucket, rank, CAST(before AS BIGINT) AS before, round(sim, 6) AS sim FROM k WHERE rank <= {PROBES} AND before < greatest(1, (SELECT count(*) FROM embeddings) // 8)",
    "missing_sim": f"WITH {_TABLE_SQL}, s AS (SELECT qtok, sum(size) AS total, min(sim) AS last FROM k WHERE rank <= {PROBES} GROUP BY ALL) SELECT qtok, round(greatest(CASE WHEN total < greatest(1, (SELECT count(*) FROM embeddings) // 8) * 4 THEN last ELSE 0 END, 0), 6) AS missing FROM s",
    "residual_score": f"""WITH {_ASSIGN_SQL}, {QUERY_SQL},
x AS (SELECT vec_id, rowid, sub_idx, ce, list_transform(list_zip(e, ce), lambda p: ([{VALUES}])[1 + CAST({_codes("(p[1] - p[2])")} AS INT)]) AS res FROM n),
w AS (SELECT rowid, sub_idx, qtok, max(list_inner_product(ce, qe) + list_inner_product(res, qe)) AS s FROM x, q GROUP BY ALL),
l AS (SELECT qtok, greatest(0, min(list_inner_product(qe, ce))) AS missing FROM q, c GROUP BY ALL),
run AS (SELECT rowid, sub_idx, qtok, greatest(max(s) OVER (PARTITION BY rowid, qtok ORDER BY sub_idx), missing) AS s FROM w JOIN l USING (qtok)),
o AS (SELECT rowid, sub_idx, avg(s) AS score FROM run GROUP BY ALL)
SELECT rowid, sub_idx, round(score, 5) AS score FROM o WHERE score > (SELECT avg(missing) FROM l)""",
    "sample_sizes": "SELECT 'c' || (vec_id // 23) AS hash, CAST(ceil(sqrt(count(*))) AS BIGINT) AS n FROM embeddings GROUP BY ALL",
    "mulaw_table": f"SELECT i AS code, round({_EXPAND.format(y='(i / 15.0 * 2 - 1)')}, 6) AS value FROM range(16) r(i)",
    "quantize4": f"WITH x AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT CAST({_codes('x')} AS INT) AS code, count(*) AS n FROM x GROUP BY ALL",
    "vector_norms": f"WITH {TOKEN_SQL}, u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM t) SELECT vec_id, round(n, 5) AS norm, round(e[1] / n, 5) AS first, round(list_inner_product(e, e) / n / n, 5) AS square FROM u",
    "vector_max": "WITH x AS (SELECT vec_id // 5 AS rowid, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT rowid, i, max(v) AS v FROM x GROUP BY ALL) SELECT rowid, round(sum(CAST(v AS DOUBLE)), 4) AS total FROM m GROUP BY ALL",
    "level_capacity": "SELECT CAST(i AS INT) AS level, CAST(1024 * 16 ** (i + 1) AS BIGINT) AS capacity FROM range(3) r(i)",
    "unindexed_count": "SELECT count(*) AS total, count(*) FILTER (WHERE label < 5) AS indexed, count(*) - count(*) FILTER (WHERE label < 5) AS unindexed FROM embeddings",
    "batched_search": f"""WITH {TOKEN_SQL},
q AS (SELECT vec_id // 50 AS qid, vec_id AS qtok, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id % 50 = 0),
best AS (SELECT qid, rowid, sub_idx, qtok, max(list_inner_product(e, qe)) AS s FROM t, q GROUP BY ALL),
run AS (SELECT qid, rowid, sub_idx, greatest(0, max(s) OVER (PARTITION BY qid, rowid, qtok ORDER BY sub_idx)) AS s FROM best),
o AS (SELECT qid, rowid, sub_idx, avg(s) AS score FROM run GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rowid, sub_idx) - 1 AS rank FROM o WHERE score > 0)
SELECT CAST(qid AS BIGINT) AS qid, CAST(rank AS INT) AS rank, rowid, sub_idx, round(score, 6) AS score FROM k WHERE rank < 20""",
    "encoder_agreement": f"""WITH {TOKEN_SQL}, a AS (SELECT e, list_transform(e, lambda x: ([{VALUES}])[1 + CAST({_codes("x")} AS INT)]) AS y FROM t),
c AS (SELECT list_inner_product(e, y) / sqrt(list_inner_product(e, e)) / sqrt(list_inner_product(y, y)) AS cosine FROM a)
SELECT round(avg(cosine), 6) AS mean, round(min(cosine), 6) AS least, round(max(cosine), 6) AS greatest FROM c""",
}

