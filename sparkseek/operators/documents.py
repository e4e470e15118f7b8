"""The document relation: content hashes, upserts, deletes, and the content-addressed chunks that documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import Empty, Filter, predicate, to_sql
from ..tables import written

DOCUMENT = "rowid long, uuid string, date string, metadata string, hash string, body string, lens array<int>"


def lens_csv(lens: Column) -> Column:
    return F.array_join(lens.cast("array<string>"), ",")


def content_hash(body: Column, lens: Column) -> Column:
    """32 hex digits of the SHA-256 of the body followed by its lengths."""
    return F.substring(F.sha2(F.concat(body, lens_csv(lens)), 256), 1, 32)


def prepare(rows: DataFrame) -> DataFrame:
    """Rows (uuid, date?, metadata, body, lens?) with the defaults: one length, of the whole body; now; and the hash."""
    has = set(rows.columns)
    lens = F.array(F.char_length("body"))
    if "lens" in has:
        lens = F.coalesce(F.when(F.size("lens") > 0, F.col("lens").cast("array<int>")), lens)
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    date = F.coalesce("date", now) if "date" in has else now
    return rows.withColumn("lens", lens).withColumn("date", date).withColumn("hash", content_hash(F.col("body"), F.col("lens")))


def upsert(documents: DataFrame, rows: DataFrame, order: str | None = None) -> DataFrame:
    """documents with rows put in by uuid; of rows with one uuid the last by `order` wins. rowids are never used again.

    A row that replaces another keeps its rowid. New rows get the next ones, in the order of uuid, numbered by range
    partitions, so no task sees all of them.
    """
    last = rows
    if order:
        w = Window.partitionBy("uuid").orderBy(F.desc(order))
        last = rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    last = prepare(last).select("uuid", "date", "metadata", "hash", "body", "lens")
    known = documents.select("uuid", "rowid")
    joined = last.join(known, "uuid", "left")
    first = documents.agg(F.coalesce(F.max("rowid"), F.lit(0)).alias("m")).first()["m"]
    fresh = numbered(joined.filter("rowid is null").drop("rowid"), "uuid", "rowid", first + 1)
    kept = documents.join(last.select("uuid"), "uuid", "left_anti")
    names = ["rowid", "uuid", "date", "metadata", "hash", "body", "lens"]
    return kept.select(*names).unionByName(joined.filter("rowid is not null").select(*names)).unionByName(fresh.select(*names))


def numbered(rows: DataFrame, order: str, name: str, first: int = 0) -> DataFrame:
    """rows with consecutive numbers in the order of a column: sizes of range partitions give each its first number.

    The ranges are sampled anew by every job, so the rows are written once with their partition and their place in it,
    and sizes are counted on the written table.
    """
    ranged = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    ranged = ranged.withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    ranged = written(ranged, "numbered")
    sizes = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    starts, total = [], first
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    if not starts:
        return rows.withColumn(name, F.lit(None).cast("long"))
    start = F.create_map(*[F.lit(x) for pair in starts for x in pair])
    return ranged.withColumn(name, (start[F.col("__part")] + F.col("__at")).cast("long")).drop("__part", "__at")


def remove(documents: DataFrame, uuid: str) -> DataFrame:
    return documents.filter(F.col("uuid") != uuid)


def delete_where(documents: DataFrame, f: Filter | None) -> DataFrame:
    """Without the documents for which the filter is true; an empty filter clears everything."""
    if not to_sql(f or Empty())[0]:
        return documents.limit(0)
    return documents.filter(~F.coalesce(predicate(f), F.lit(False)))


def backlog(documents: DataFrame, chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """(hash, body, lens) of documents that have a body and no chunk yet, each content once; by hash if limited."""
    waiting = documents.filter(F.length("body") > 0).join(chunks.select("hash"), "hash", "left_anti")
    once = waiting.groupBy("hash").agg(F.min(F.struct("rowid", "body", "lens")).alias("d")).select("hash", "d.body", "d.lens")
    return once.orderBy("hash").limit(limit) if limit else once


def live_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose content some document still has."""
    return chunks.join(documents.select("hash"), "hash", "left_semi")


def orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.select("hash"), "hash", "left_anti")


def add_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """chunks and those of fresh whose hash is new."""
    new = fresh.join(chunks.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
    return chunks.unionByName(new)
