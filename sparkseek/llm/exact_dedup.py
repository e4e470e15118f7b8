"""Exact deduplication as a stateful stream.

Every document becomes a small event (digest of the normalised text, length, stable identifier, content locator). A
streaming aggregation keyed by digest, its state in RocksDB on the executors' disks and without watermark or expiry,
retains for each digest the document that stays, its locator and a count. Texts never enter the state. A document
whose digest is held by another one is a hit: both full texts are fetched by locator and their bytes compared, and a
document that differs gets a group of its own.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, scratch_path, table, text_of, written

#: What equality of texts ignores.
IGNORED = "[\\x20\\x09-\\x0D]+"
#: A group this large is compared in parts, each with its own copy of the text that stays.
ROWS_PER_PART = 2000
#: State in RocksDB; a store is closed when its task commits, so an executor holds as many open as it has cores, and a
#: commit uploads what changed.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, IGNORED, "")


def as_files(docs: DataFrame) -> DataFrame:
    """docs as a scan of files, whose rows have stable places; anything else is written to the shared folder first."""
    if not docs.inputFiles():
        return written(docs, "content")
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema
        return docs
    except AnalysisException:
        return written(docs, "content")


def located(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The events: doc_id, digest (SHA-256 of the normalised text), points, and the locator (file, place)."""
    text = text_of(docs, text_col)
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.sha2(normalised(text), 256).alias("digest"),
        F.char_length(text).cast("long").alias("points"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("place"),
    )


def _rank() -> Column:
    """Greatest for the row that stays: most code points, then least doc_id (null last), then first place."""
    return F.struct(
        F.col("points"),
        F.col("doc_id").isNotNull().alias("named"),
        (-F.col("doc_id")).alias("minus_id"),
        F.col("file"),
        (-F.col("place")).alias("minus_place"),
    )


def stream_state(spark: SparkSession, events_path: str, schema, state_path: str, checkpoint: str, files_per_batch: int | None = None) -> None:
    """Run the stream over all events that have come and append each batch's changed state to state_path.

    Called again with the same checkpoint, it takes up the state and reads only new files.
    """
    before = {k: spark.conf.get(k, None) for k in STREAM_SETTINGS}
    for k, v in STREAM_SETTINGS.items():
        spark.conf.set(k, v)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(events_path).groupBy("digest").agg(F.max(_rank()).alias("stays"), F.count("*").alias("n"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again after a failure overwrites what it left.
        batch.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    try:
        query = (
            state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def current_state(spark: SparkSession, state_path: str) -> DataFrame:
    """(digest, keep_id, keep_file, keep_place, n): each digest as of the last batch that changed it."""
    rows = spark.read.parquet(state_path)
    last = rows.groupBy("digest").agg(F.max_by(F.struct("stays", "n"), "batch").alias("s"))
    return last.select(
        "digest",
        (-F.col("s.stays.minus_id")).alias("keep_id"),
        F.col("s.stays.file").alias("keep_file"),
        (-F.col("s.stays.minus_place")).alias("keep_place"),
        F.col("s.n").alias("n"),
    )


def _differing(docs: DataFrame, hits: DataFrame, held: DataFrame, text_col: str) -> DataFrame:
    """Of the hits (digest, file, place, n) those whose bytes differ from the text that the state holds for their digest."""
    body = normalised(text_of(docs, text_col))
    content = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), body.alias("body"))
    salt = F.pmod(F.xxhash64("file", "place"), F.ceil(F.col("n") / ROWS_PER_PART)).cast("int")
    other = content.join(hits, ["file", "place"]).select("digest", "file", "place", "body", salt.alias("part"))
    heads = held.filter("n > 1").select("digest", F.col("keep_file").alias("file"), F.col("keep_place").alias("place"), "n")
    first = content.join(heads, ["file", "place"]).select(
        "digest", F.col("body").alias("head"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / ROWS_PER_PART) - 1).cast("int"))).alias("part")
    )
    return other.join(first, ["digest", "part"]).filter("body <> head").select("digest", "file", "place", F.sha2(F.concat(F.lit("#"), "body"), 512).alias("second"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256, file, place.

    Texts are equal when they are identical after `IGNORED` is deleted; null counts as empty, and empty texts equal
    each other. Of equal texts the row with the most code points stays, ties by least doc_id, repeated rows by first
    place, so exactly one row of a group is kept. An empty table gives an empty table; extra columns are ignored.
    """
    spark = docs.sparkSession
    docs = as_files(docs)
    events = written(located(docs, id_col, text_col), "events")
    files = events.inputFiles()
    state_path, checkpoint = scratch_path(spark, "state"), scratch_path(spark, "stream")
    held = spark.createDataFrame([], "digest string, keep_id long, keep_file string, keep_place long, n long")
    if files and not events.isEmpty():
        stream_state(spark, files[0].rsplit("/", 1)[0], events.schema, state_path, checkpoint, files_per_batch)
        held = written(current_state(spark, state_path), "held")  # a join with a table can split a hot digest's rows
        remove(spark, checkpoint)
    out = events.join(held, "digest")
    is_head = (F.col("file") == F.col("keep_file")) & (F.col("place") == F.col("keep_place"))
    hits = out.filter("n > 1").filter(~is_head).select("digest", "file", "place", "n")
    clash = written(_differing(docs, hits, held, text_col), "clash")
    if not clash.isEmpty():  # equal digests of different bytes: groups by a second digest
        own = events.join(clash, ["digest", "file", "place"]).groupBy("digest", "second").agg(F.max(_rank()).alias("r"), F.count("*").alias("m"))
        gone = clash.groupBy("digest").agg(F.count("*").alias("gone"))
        out = (
            out.join(clash, ["digest", "file", "place"], "left").join(own, ["digest", "second"], "left").join(gone, "digest", "left")
            .withColumn("keep_id", F.when(F.col("second").isNull(), F.col("keep_id")).otherwise(-F.col("r.minus_id")))
            .withColumn("keep_file", F.coalesce("r.file", "keep_file"))
            .withColumn("keep_place", F.coalesce(-F.col("r.minus_place"), "keep_place"))
            .withColumn("n", F.when(F.col("second").isNull(), F.col("n") - F.coalesce("gone", F.lit(0))).otherwise(F.col("m")))
        )
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), is_head.alias("kept"), F.col("digest").alias("text_sha256"), "file", "place")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns, one of each group of equal texts."""
    docs = as_files(docs)
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    kept = groups(docs).filter("kept").select(F.col("file").alias("__file"), F.col("place").alias("__place"))
    return rows.join(kept, ["__file", "__place"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).drop("file", "place")


#: The whole result in SQL.
OP8_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
