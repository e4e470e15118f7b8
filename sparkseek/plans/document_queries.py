"""Queries of the document model, of filters, and of full-text search and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jaro
from ..functions.filters import Condition, all_of, any_of, facets, predicate
from ..functions.text import uuid5
from ..operators import documents as D
from ..operators import fulltext, fusion, semantic
from ..sources.tsv import OID
from ..streaming.ingest import HashEncoder
from ..tables import bounded_batches
from .common import DOC_SQL, documents, maxsim_sql, query_matrix, read, tokens

AND_QUERY, PREFIX_QUERY, EMPTY = "the That ", "of th", ""


def doc_hash(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("rowid", "hash")


def doc_uuid(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", uuid5(OID, F.col("text")).alias("uuid"))


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Events as document versions keyed by user: the last one stays."""
    rows = read(spark, d, "events").select(F.format_string("u%d", "user_id").alias("uuid"), F.struct("ts", "event_id").alias("seq"), F.col("props").alias("metadata"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("body"))
    out = D.upsert(spark.createDataFrame([], D.DOCUMENT), rows.withColumn("date", F.lit("2024-01-01")), order="seq")
    return out.select("uuid", "metadata", "body", "hash", F.col("lens")[0].alias("n"))


def upsert_rowids(spark: SparkSession, d: str) -> DataFrame:
    """Half of the documents are stored; all are put in: stored ones keep their rowid, new ones get the next, by uuid."""
    rows = documents(spark, d)
    stored = rows.filter("lens[0] < 1500")
    fresh = rows.withColumn("body", F.concat("body", F.lit("!"))).drop("rowid", "hash", "lens")
    return D.upsert(stored, fresh).select("uuid", "rowid", "hash")


def dedup_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).groupBy("hash").agg(F.min("rowid").alias("first"), F.count("*").alias("n"))


def embed_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Contents without a chunk, where labelled documents' contents have one."""
    docs = documents(spark, d)
    chunks = docs.join(read(spark, d, "labels").select(F.col("doc_id").alias("rowid")), "rowid", "left_semi").select("hash")
    return D.backlog(docs, chunks).select("hash", F.length("body").alias("n"))


def orphan_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return D.orphans(docs.select("hash").distinct(), docs.filter(F.get_json_object("metadata", "$.lang") == "en"))


def live_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return D.live_chunks(docs.select("hash").distinct(), docs.filter(F.get_json_object("metadata", "$.lang") == "en"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").withColumnRenamed("props", "metadata")


def filter_group(spark: SparkSession, d: str) -> DataFrame:
    f = all_of(Condition("$.k", "GreaterThan", 20), any_of(Condition("$.k", "LessThan", 40), Condition("$.k", "Equals", 77.0)), Condition("$.k", "NotEquals", 33))
    return _events(spark, d).filter(predicate(f)).select("event_id", "metadata")


def filter_typed(spark: SparkSession, d: str) -> DataFrame:
    """A number is never equal to a text and always less."""
    rows = _events(spark, d)
    tests = {"eq": Condition("$.k", "Equals", "5"), "ne": Condition("$.k", "NotEquals", "5"), "lt": Condition("$.k", "LessThan", "5"), "ge": Condition("$.k", "GreaterThanOrEquals", "5"), "like": Condition("$.k", "Like", "5%")}
    return rows.agg(*[F.count_if(predicate(c)).alias(n) for n, c in tests.items()])


def filter_like(spark: SparkSession, d: str) -> DataFrame:
    f = all_of(Condition("$.source", "Like", "SRC1%"), Condition("$.lang", "NotLike", "%E"))
    return documents(spark, d).filter(predicate(f)).select("rowid")


def filter_exists(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d)
    return rows.agg(F.count_if(predicate(Condition("$.lang", "Exists"))).alias("there"), F.count_if(predicate(Condition("$.nothing", "Exists"))).alias("absent"), F.count_if(F.coalesce(predicate(Condition("$.nothing", "NotEquals", "x")), F.lit(False))).alias("unequal"))


def filter_date(spark: SparkSession, d: str) -> DataFrame:
    f = all_of(Condition("date", "GreaterThanOrEquals", "2024-03-01"), Condition("date", "LessThan", "2024-06"), Condition("uuid", "Like", "D1%"))
    return documents(spark, d).filter(predicate(f)).select("rowid", "date")


def filter_delete(spark: SparkSession, d: str) -> DataFrame:
    return D.delete_where(documents(spark, d), Condition("$.lang", "Equals", "en")).select("rowid")


def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).withColumn("metadata", F.to_json(F.struct(
        F.get_json_object("metadata", "$.lang").alias("source"), F.get_json_object("metadata", "$.source").alias("session_id"),
        (F.col("rowid") % 2 == 0).alias("is_dm"), (F.col("rowid") % 3 == 0).alias("has_unread"), F.when(F.col("rowid") % 5 > 0, "main").alias("branch"))))
    f = facets(branch="main", exclude=("src1", "src2"), since="2024-02-01", types=("en", "fr"), dm=True, unread=True)
    return rows.filter(predicate(f)).select("rowid")


def _bm25(spark: SparkSession, d: str, query: str, k: int) -> DataFrame:
    docs = documents(spark, d)
    found = fulltext.bm25(fulltext.build(docs), fulltext.query_terms(query)).join(docs.select("rowid", "date"), "rowid")
    return found.orderBy("score", F.desc("date"), "rowid").limit(k).select("rowid", "date", F.round("score", 6).alias("score"))


def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, AND_QUERY, 40)


def bm25_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, PREFIX_QUERY, 40)


def bm25_all_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return fulltext.bm25(fulltext.build(docs), fulltext.query_terms(AND_QUERY)).select("rowid", F.round("score", 6).alias("score"))


def browse_by_date(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.browse(documents(spark, d), 25, Condition("$.lang", "Equals", "de"))


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    index = fulltext.build(documents(spark, d))
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def jw_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Similarity to whole texts, of which only ASCII is kept, as the other side compares bytes."""
    bounded_batches(spark)
    rows = read(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("t"))
    return rows.select("doc_id", F.round(jaro.similarity(F.lit("the that*"), F.col("t")), 6).alias("score"))


def fulltext_search(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return fulltext.search(docs, fulltext.build(docs), PREFIX_QUERY, 20).select("rank", "rowid", "sub_idx", F.round("bm25", 6).alias("bm25"))


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("rowid"), (F.col("doc_id") % 3).cast("int").alias("sub_idx"), "n_chars")
    first = rows.orderBy(F.desc("n_chars"), "rowid").limit(60).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "rowid")) - 1)
    second = rows.orderBy(F.desc(F.col("n_chars") % 1009), "rowid").limit(200).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.col("n_chars") % 1009), "rowid")) - 1)
    return first, second


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_ranks(*_lists(spark, d)).select("rowid", "sub_idx", F.round("rrf", 9).alias("rrf"))


def hybrid_monotone(spark: SparkSession, d: str) -> DataFrame:
    """Exact semantic hits: first per document, scores made monotone along another order."""
    hits = semantic.search_exact(tokens(spark, d), query_matrix(spark, d), 0.0, 60).withColumn("rank", (F.row_number().over(Window.orderBy("rowid", F.desc("sub_idx"))) - 1))
    return fusion.monotone(fusion.first_per_document(hits)).select("rank", "rowid", "sub_idx", F.round("score", 6).alias("score"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Both sides by way of the hash encoder, which stands in for a model."""
    docs = documents(spark, d)
    encoder = HashEncoder(64)
    rows = tokens(spark, d)
    found = fusion.hybrid_search(docs, fulltext.build(docs), lambda q: semantic.search_exact(rows, q, 0.0, 10), "of th", lambda t: encoder.encode(t)[0], 10)
    return found.select("rank", "rowid", "sub_idx", F.round("score", 6).alias("score"), F.size("bodies").alias("parts"), "date")


def ranked_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.col("lang").alias("qid"), F.col("doc_id").alias("key"), F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return fusion.ranked_lines(rows.filter("rank <= 10"))


QUERIES = {f.__name__: f for f in (
    doc_hash, doc_uuid, upsert_last_wins, upsert_rowids, dedup_by_hash, embed_backlog, orphan_chunks, live_chunks, filter_group, filter_typed, filter_like, filter_exists,
    filter_date, filter_delete, facet_filter, bm25_and, bm25_prefix, bm25_all_scores, browse_by_date, term_statistics, jw_rerank, fulltext_search, rrf_fusion,
    hybrid_monotone, hybrid_search, ranked_lines,
)}

_TERMS = f"""{DOC_SQL},
w AS (SELECT rowid, unnest(regexp_extract_all(translate(lower(body), '{fulltext.ACCENTED}', '{fulltext.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')) AS term FROM d),
p AS (SELECT rowid, term, count(*) AS tf FROM w GROUP BY ALL),
n AS (SELECT d.rowid, count(term) AS n FROM d LEFT JOIN w USING (rowid) GROUP BY ALL),
s AS (SELECT count(*) AS c, avg(n) AS a FROM n)"""


def _bm25_sql(query: str) -> str:
    parts = [f"SELECT {i} AS i, rowid, sum(tf) AS tf FROM p WHERE {f'''starts_with(term, '{t}')''' if prefix else f'''term = '{t}' '''} GROUP BY ALL" for i, (t, prefix) in enumerate(fulltext.query_terms(query))]
    return f"""WITH {_TERMS},
h AS ({" UNION ALL ".join(parts)}),
f AS (SELECT i, count(*) AS df FROM h GROUP BY ALL),
r AS (SELECT rowid, round(-sum(greatest(ln((c - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / a))), 9) AS score, count(*) AS m
  FROM h JOIN f USING (i) JOIN n USING (rowid), s GROUP BY rowid HAVING m = {len(parts)})"""


ORACLE_SQL = {
    "doc_hash": f"WITH {DOC_SQL} SELECT rowid, hash FROM d",
    "doc_uuid": f"""WITH h AS (SELECT doc_id, sha1(unhex('{OID.replace("-", "")}') || encode(text)) AS x FROM documents)
SELECT doc_id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(x, 17, 1)), 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS uuid FROM h""",
    "upsert_last_wins": """WITH r AS (SELECT 'u' || user_id AS uuid, props AS metadata, event_type || ' ' || event_id AS body, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT uuid, metadata, body, substr(sha256(body || length(body)), 1, 32) AS hash, length(body) AS n FROM r WHERE r = 1""",
    "upsert_rowids": f"""WITH {DOC_SQL}, n AS (SELECT uuid, (SELECT max(rowid) FROM d WHERE length(body) < 1500) + row_number() OVER (ORDER BY uuid) AS rowid, body || '!' AS body FROM d WHERE length(body) >= 1500),
a AS (SELECT uuid, rowid, body || '!' AS body FROM d WHERE length(body) < 1500 UNION ALL SELECT * FROM n)
SELECT uuid, rowid, substr(sha256(body || length(body)), 1, 32) AS hash FROM a""",
    "dedup_by_hash": f"WITH {DOC_SQL} SELECT hash, min(rowid) AS first, count(*) AS n FROM d GROUP BY ALL",
    "embed_backlog": f"WITH {DOC_SQL}, c AS (SELECT hash FROM d WHERE rowid IN (SELECT doc_id FROM labels)) SELECT hash, length(min(body)) AS n FROM d WHERE body <> '' AND hash NOT IN (SELECT hash FROM c) GROUP BY hash",
    "orphan_chunks": f"WITH {DOC_SQL} SELECT hash FROM d GROUP BY hash HAVING NOT bool_or(lang = 'en')",
    "live_chunks": f"WITH {DOC_SQL} SELECT hash FROM d GROUP BY hash HAVING bool_or(lang = 'en')",
    "filter_group": "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) SELECT event_id, props AS metadata FROM e WHERE k > 20 AND (k < 40 OR k = 77) AND k <> 33",
    "filter_typed": "WITH e AS (SELECT json_extract_string(props, '$.k') AS k FROM events) SELECT count(*) FILTER (WHERE false) AS eq, count(k) AS ne, count(k) AS lt, count(*) FILTER (WHERE false) AS ge, count(*) FILTER (WHERE k LIKE '5%') AS like FROM e",
    "filter_like": f"WITH {DOC_SQL} SELECT rowid FROM d WHERE source ILIKE 'SRC1%' AND lang NOT ILIKE '%E'",
    "filter_exists": "SELECT count(*) AS there, CAST(0 AS BIGINT) AS absent, CAST(0 AS BIGINT) AS unequal FROM documents",
    "filter_date": f"WITH {DOC_SQL} SELECT rowid, date FROM d WHERE date >= '2024-03-01' AND date < '2024-06' AND uuid ILIKE 'D1%'",
    "filter_delete": f"WITH {DOC_SQL} SELECT rowid FROM d WHERE lang <> 'en'",
    "facet_filter": f"WITH {DOC_SQL} SELECT rowid FROM d WHERE rowid % 5 > 0 AND source NOT IN ('src1', 'src2') AND date >= '2024-02-01' AND lang IN ('en', 'fr') AND rowid % 2 = 0 AND rowid % 3 = 0",
    "bm25_and": f"{_bm25_sql(AND_QUERY)} SELECT rowid, date, round(score, 6) AS score FROM r JOIN d USING (rowid) ORDER BY r.score, date DESC, rowid LIMIT 40",
    "bm25_prefix": f"{_bm25_sql(PREFIX_QUERY)} SELECT rowid, date, round(score, 6) AS score FROM r JOIN d USING (rowid) ORDER BY r.score, date DESC, rowid LIMIT 40",
    "bm25_all_scores": f"{_bm25_sql(AND_QUERY)} SELECT rowid, round(score, 6) AS score FROM r",
    "browse_by_date": f"WITH {DOC_SQL} SELECT rowid, 0.0::DOUBLE AS score FROM d WHERE lang = 'de' ORDER BY date DESC, rowid LIMIT 25",
    "term_statistics": f"WITH {_TERMS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM p GROUP BY ALL",
    "jw_rerank": "SELECT doc_id, round(jaro_winkler_similarity('the that*', regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')), 6) AS score FROM documents",
    "fulltext_search": f"{_bm25_sql(PREFIX_QUERY)}, o AS (SELECT rowid, score, row_number() OVER (ORDER BY score, date DESC, rowid) - 1 AS rank FROM r JOIN d USING (rowid)) SELECT CAST(rank AS INT) AS rank, rowid, 0 AS sub_idx, round(score, 6) AS bm25 FROM o WHERE rank < 20",
    "rrf_fusion": """WITH r AS (SELECT doc_id AS rowid, CAST(doc_id % 3 AS INT) AS sub_idx, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS a, row_number() OVER (ORDER BY n_chars % 1009 DESC, doc_id) - 1 AS b FROM documents),
u AS (SELECT rowid, sub_idx, 1.0 / (3 + 60 + a) AS p FROM r WHERE a < 60 UNION ALL SELECT rowid, sub_idx, 1.0 / (60 + b) FROM r WHERE b < 200) SELECT rowid, sub_idx, round(sum(CAST(p AS DOUBLE)), 9) AS rrf FROM u GROUP BY ALL""",
    "hybrid_monotone": f"""WITH {maxsim_sql()}, h AS (SELECT * FROM scores WHERE score > 0 ORDER BY round(score, 9) DESC, rowid, sub_idx LIMIT 60),
k AS (SELECT *, row_number() OVER (ORDER BY rowid, sub_idx DESC) - 1 AS rank FROM h), f AS (SELECT *, row_number() OVER (PARTITION BY rowid ORDER BY rank) AS n FROM k)
SELECT CAST(rank AS INT) AS rank, rowid, sub_idx, round(max(score) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS score FROM f WHERE n = 1""",
    "ranked_lines": "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT lang || chr(9) || string_agg(doc_id || ',', '' ORDER BY r) AS value FROM r WHERE r <= 10 GROUP BY lang",
}
