"""Conversations as documents: interactions, titles, latest rows, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import uuid5

TITLE_CHARS = 240
#: Namespaces of document UUIDs, of the two kinds of session logs.
SESSION_NAMESPACE, SECOND_NAMESPACE = "a3f7c8d16e2b4a91b5d08f1e3c7a9b2d", "b4e8d9e27f3c5ba2c6e1902f4d8bac3e"


def interactions(turns: DataFrame, by: str = "session_id", order: tuple[str, ...] = ("ts_ms", "line")) -> DataFrame:
    """turns with interaction: from 0, one more at every user turn but a session's first turn."""
    w = Window.partitionBy(by).orderBy(*order)
    starts = ((F.col("role") == "user") & (F.row_number().over(w) > 1)).cast("int")
    return turns.withColumn("__start", starts).withColumn("interaction", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def titles(turns: DataFrame, by: str = "session_id", order: tuple[str, ...] = ("ts_ms", "line"), custom: Column | None = None) -> DataFrame:
    """(by, title): the custom title if any, else the first 240 characters of the first user turn, else empty."""
    key = F.struct(*order)
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", key))
    named = F.max_by(custom, F.when(custom.isNotNull(), key)) if custom is not None else F.lit(None).cast("string")
    return turns.groupBy(by).agg(F.coalesce(named, F.substring(first, 1, TITLE_CHARS), F.lit("")).alias("title"))


def interaction_documents(turns: DataFrame, sessions: DataFrame, source: str, assistant: str, mtime: Column | None = None, namespace: str = SESSION_NAMESPACE) -> DataFrame:
    """(uuid, date, metadata, body, lens) for each interaction.

    turns: session_id, interaction, role, text, timestamp, ts_ms, line, off, len, branch; sessions: session_id, title,
    project, cwd, path. The body is a header line and a labelled line for each turn, one length for each.
    """
    label = F.when(F.col("role") == "user", "[User] ").otherwise(f"[{assistant}] ")
    line = F.struct("ts_ms", "line", F.concat(label, F.col("text"), F.lit("\n")).alias("part"), "role", "timestamp", "off", "len", "branch")
    grouped = turns.groupBy("session_id", "interaction").agg(F.array_sort(F.collect_list(line)).alias("turns")).join(sessions, "session_id")
    header = F.concat(F.lit("["), F.col("project"), F.lit("] "), F.col("title"), F.lit("\n"))
    parts = F.concat(F.array(header), F.transform("turns", lambda t: t["part"]))
    branch = F.try_element_at(F.filter(F.transform("turns", lambda t: t["branch"]), lambda b: b.isNotNull()), F.lit(-1))
    meta = F.struct(
        F.lit(source).alias("source"), F.col("project"), F.col("session_id"), F.col("title").alias("session_name"), F.col("interaction").alias("turn"),
        F.col("path"), F.col("cwd"), (mtime if mtime is not None else F.lit(None).cast("long")).alias("mtime_ms"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["timestamp"].alias("timestamp"), t["off"].alias("off"), t["len"].alias("len"))).alias("turns"),
        branch.alias("branch"),
    )
    return grouped.select(
        uuid5(namespace, F.concat("session_id", F.lit(":"), F.col("interaction").cast("string"))).alias("uuid"),
        F.col("turns")[0]["timestamp"].alias("date"),
        F.to_json(meta).alias("metadata"),
        F.array_join(parts, "").alias("body"),
        F.transform(parts, lambda p: F.char_length(p)).alias("lens"),
    )


def latest_per_session(documents: DataFrame, sources: tuple[str, ...] | None = None, limit: int | None = 200) -> DataFrame:
    """(session_id, date, metadata, body) of each session's latest document, latest sessions first."""
    rows = documents.withColumn("session_id", F.get_json_object("metadata", "$.session_id")).filter("session_id <> ''")
    if sources:
        rows = rows.filter(F.get_json_object("metadata", "$.source").isin(*sources))
    last = rows.groupBy("session_id").agg(F.max_by(F.struct("date", "metadata", "body"), F.struct("date", "rowid")).alias("d")).select("session_id", "d.*")
    ordered = last.orderBy(F.desc("date"), "session_id")
    return ordered.limit(limit) if limit else ordered


def turns_between(documents: DataFrame, first: int, last: int) -> DataFrame:
    """Documents whose turn number lies in the range; those without one are left out."""
    return documents.filter(F.get_json_object("metadata", "$.turn").try_cast("long").between(first, last))


def dump(documents: DataFrame, ident: str, since: str | None = None) -> DataFrame:
    """Documents of a session by turn, else of a thread by date, else of a channel by turn, latest first; the first that has any."""
    path = lambda p: F.get_json_object("metadata", p)
    name = ident.removeprefix("#")
    channel = documents.filter((path("$.channel_id") == ident) | (path("$.channel_name") == name))
    if since is not None:
        channel = channel.filter(F.col("date") >= since)
    turn = path("$.turn").try_cast("long")
    options = (
        documents.filter(path("$.session_id") == ident).orderBy(turn, "rowid"),
        documents.filter(path("$.conv_key").endswith(f"-{name.removeprefix('thr:')}")).orderBy("date", "rowid"),
        channel.orderBy(F.desc(turn), "rowid"),
    )
    return next((o for o in options if not o.isEmpty()), options[-1])
