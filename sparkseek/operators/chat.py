"""Chat messages: which count, edits and copies, conversations, and their renewal when messages come late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_ms, uuid5

#: Gaps that end a conversation and its longest span, in milliseconds; message kinds that say nothing.
DM_GAP, CHANNEL_GAP, SPAN = 90 * 60_000, 30 * 60_000, 24 * 3_600_000
SYSTEM_SUBTYPES = (
    "channel_join", "channel_joined", "group_join", "group_joined", "channel_leave", "group_leave", "channel_archive", "group_archive",
    "channel_unarchive", "group_unarchive", "channel_name", "group_name", "channel_purpose", "group_purpose", "channel_topic", "group_topic",
    "pinned_item", "unpinned_item", "message_changed", "message_deleted",
)
BOT_SUBTYPES = ("bot_message", "slackbot_response")
#: Fixed value: the namespace of the UUIDs of chat documents.
CHAT_NAMESPACE = "95dcade95daa4de2913be5acfd9d3c07"


def effective(message: Column, subtype: Column, inner: Column) -> tuple[Column, Column]:
    """(message that counts, is an update): of a change the inner message, of a deletion none."""
    changed = subtype == "message_changed"
    return F.when(changed, inner).when(F.coalesce(subtype, F.lit("")) != "message_deleted", message), F.coalesce(changed, F.lit(False))


def counts(m: str, sender_is_bot: Column) -> Column:
    """Whether a message struct m (user, username, subtype, bot_id, app_id, has_bot_profile, profile_is_bot, hidden, text) counts."""
    at = lambda name: F.col(f"{m}.{name}")
    skip = (
        F.coalesce(sender_is_bot, F.lit(False)) | (F.coalesce(at("user"), F.lit("")) == "USLACKBOT") | F.coalesce(at("profile_is_bot"), F.lit(False))
        | F.contains(F.lower(F.coalesce(at("username"), F.lit(""))), F.lit("slackbot"))
        | F.coalesce(at("subtype"), F.lit("")).isin(*SYSTEM_SUBTYPES, *BOT_SUBTYPES)
        | at("bot_id").isNotNull() | F.coalesce(at("has_bot_profile"), F.lit(False)) | at("app_id").isNotNull() | F.coalesce(at("hidden"), F.lit(False))
        | (F.coalesce(at("text"), F.lit("")) == "")
    )
    return ~skip


def without_copies(messages: DataFrame, order: tuple[str, ...] = ("seq",), per_channel: bool = True) -> DataFrame:
    """One message for each client id, or for each ts where there is none.

    Read in order, a later message replaces the kept one if it is an update, or if it isn't a broadcast and the kept
    one is. In one step: the last update that isn't the first row, else the first row; if that is a broadcast, the
    first row after it that isn't one.
    """
    own = F.concat_ws("\x1f", "channel_id", "ts") if per_channel else F.col("ts")
    key = F.when(F.col("client_msg_id").isNotNull(), F.concat(F.lit("c"), "client_msg_id")).otherwise(F.concat(F.lit("t"), own))
    rows = messages.withColumn("__key", key)
    w = Window.partitionBy("__key")
    rows = rows.withColumn("__n", F.row_number().over(w.orderBy(*order)))
    anchor = F.coalesce(F.max(F.when(F.col("is_update") & (F.col("__n") > 1), F.col("__n"))).over(w), F.lit(1))
    rows = rows.withColumn("__anchor", anchor)
    rows = rows.withColumn("__wide", F.max(F.when(F.col("__n") == F.col("__anchor"), F.col("is_broadcast"))).over(w))
    after = F.min(F.when((F.col("__n") > F.col("__anchor")) & ~F.col("is_broadcast"), F.col("__n"))).over(w)
    rows = rows.withColumn("__pick", F.when(F.col("__wide"), F.coalesce(after, F.col("__anchor"))).otherwise(F.col("__anchor")))
    return rows.filter("__n = __pick").drop("__key", "__n", "__anchor", "__wide", "__pick")


def gap_sessions(events: DataFrame, channel: str, ts_ms: str, gap: Column, order: tuple[str, ...] = ()) -> DataFrame:
    """events with session_start: the ts of the first event of its run; a longer gap than `gap` starts another. No cap on spans."""
    w = Window.partitionBy(channel).orderBy(ts_ms, *order)
    fresh = F.coalesce(F.col(ts_ms) - F.lag(ts_ms).over(w) > gap, F.lit(True))
    rows = events.withColumn("__start", F.when(fresh, F.col(ts_ms)))
    return rows.withColumn("session_start", F.last("__start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def capped_sessions(events: DataFrame, channel: str, ts_ms: str, gap: Column, span: int = SPAN, order: tuple[str, ...] = ()) -> DataFrame:
    """As gap_sessions, and a session ends where its span would exceed `span`.

    A run without gaps is cut in order, so it needs a fold; runs are independent, so the fold is by (channel, run), on
    times alone, read as a stream of sorted batches that carries only the open session.
    """
    rows = gap_sessions(events, channel, ts_ms, gap, order).withColumnRenamed("session_start", "__run")
    runs = rows.groupBy(channel, "__run").agg((F.max(ts_ms) - F.min(ts_ms)).alias("__span"))
    long_runs = runs.filter(F.col("__span") > span).select(channel, "__run")
    times = rows.join(long_runs, [channel, "__run"], "left_semi").select(F.col(channel).alias("c"), F.col("__run").alias("r"), F.col(ts_ms).alias("t")).distinct()
    sorted_times = times.repartition("c", "r").sortWithinPartitions("c", "r", "t")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, start = None, 0
        for b in batches:
            starts = []
            for c, r, t in zip(b["c"], b["r"], b["t"]):
                if (c, r) != run or t - start > span:
                    run, start = (c, r), t
                starts.append(start)
            yield b.assign(s=pd.Series(starts, index=b.index, dtype="int64"))

    kind = dict(rows.dtypes)
    cut = sorted_times.mapInPandas(fold, f"c {kind[channel]}, r {kind['__run']}, t {kind[ts_ms]}, s long")
    cut = cut.select(F.col("c").alias(channel), F.col("r").alias("__run"), F.col("t").alias(ts_ms), "s")
    joined = rows.join(cut, [channel, "__run", ts_ms], "left")
    return joined.withColumn("session_start", F.coalesce("s", "__run")).drop("s", "__run")


def conversations(messages: DataFrame, cursors: DataFrame | None = None) -> DataFrame:
    """Conversations of messages (channel_id, channel_name, team_id, is_dm, ts, ts_ms, thread_ts, sender_name, text).

    A thread is one; other messages of a channel form sessions by gap and span. Unread: ts after the channel's
    cursor, as text. Columns: key, channel and team, root_ts, first_ts_ms, latest_ts, latest_ts_ms, has_unread,
    unread_count, parts (labelled lines by time), turn (the ordinal in its channel).
    """
    gap = F.when(F.col("is_dm"), DM_GAP).otherwise(CHANNEL_GAP)
    loose = capped_sessions(messages.filter("thread_ts is null"), "channel_id", "ts_ms", gap, order=("ts",))
    first = F.min("ts").over(Window.partitionBy("channel_id", "session_start", F.col("ts_ms") == F.col("session_start")))
    root = F.max(F.when(F.col("ts_ms") == F.col("session_start"), first)).over(Window.partitionBy("channel_id", "session_start"))
    loose = loose.withColumn("root_ts", root).withColumn("key", F.concat(F.lit("sess:"), "channel_id", F.lit("-"), "root_ts")).drop("session_start")
    threads = messages.filter("thread_ts is not null").withColumn("root_ts", F.col("thread_ts")).withColumn("key", F.concat(F.lit("thr:"), "channel_id", F.lit("-"), "thread_ts"))
    rows = loose.unionByName(threads)
    if cursors is not None:
        rows = rows.join(cursors.select("channel_id", "cursor"), "channel_id", "left")
    else:
        rows = rows.withColumn("cursor", F.lit(None).cast("string"))
    line = F.concat(F.lit("["), format_ms(F.col("ts_ms")), F.lit("] ["), F.col("sender_name"), F.lit("] "), F.col("text"), F.lit("\n"))
    unread = F.coalesce(F.col("ts") > F.col("cursor"), F.lit(False))
    out = rows.groupBy("key", "channel_id", "root_ts").agg(
        F.first("channel_name").alias("channel_name"), F.first("team_id").alias("team_id"), F.first("is_dm").alias("is_dm"),
        F.min("ts_ms").alias("first_ts_ms"), F.max("ts_ms").alias("latest_ts_ms"), F.max(F.struct("ts_ms", "ts"))["ts"].alias("latest_ts"),
        F.bool_or(unread).alias("has_unread"), F.count_if(unread).alias("unread_count"),
        F.array_sort(F.collect_list(F.struct("ts_ms", "ts", line.alias("line")))).alias("parts"),
    )
    turn = F.row_number().over(Window.partitionBy("channel_id").orderBy("first_ts_ms", "key")) - 1
    return out.withColumn("parts", F.transform("parts", lambda p: p["line"])).withColumn("turn", turn)


def conversation_documents(convs: DataFrame) -> DataFrame:
    """(uuid, date, metadata, body, lens) of conversations."""
    meta = F.struct(
        F.lit("slack").alias("source"), F.when(F.col("is_dm"), "DM").otherwise(F.col("channel_name")).alias("project"), "channel_id", "channel_name", "is_dm", "team_id",
        F.col("key").alias("conv_key"), "root_ts", "latest_ts", "turn", F.col("channel_id").alias("session_id"), F.size("parts").alias("message_count"), "has_unread", "unread_count",
    )
    at = F.to_utc_timestamp(F.timestamp_seconds(F.floor(F.col("first_ts_ms") / 1000)), F.current_timezone())
    return convs.select(
        uuid5(CHAT_NAMESPACE, F.concat("channel_id", F.lit("-"), "root_ts")).alias("uuid"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("date"), F.to_json(meta).alias("metadata"),
        F.array_join("parts", "").alias("body"), F.transform("parts", lambda p: F.char_length(p)).alias("lens"),
    )


def subsumed(documents: DataFrame, convs: DataFrame) -> DataFrame:
    """(uuid) of stored session documents whose root now lies inside a longer session of the same channel and team."""
    path = lambda p: F.get_json_object("metadata", p)
    stored = documents.filter((path("$.source") == "slack") & path("$.conv_key").startswith("sess:")).select(
        "uuid", path("$.channel_id").alias("channel_id"), F.coalesce(path("$.team_id"), F.lit("")).alias("team_id"), path("$.conv_key").alias("conv_key")
    )
    stored = stored.withColumn("root", F.regexp_extract("conv_key", r"-([^-]*)$", 1).try_cast("double"))
    grown = convs.filter(F.col("key").startswith("sess:")).select(
        "channel_id", F.coalesce("team_id", F.lit("")).alias("team_id"), "key", F.col("root_ts").try_cast("double").alias("a"), F.col("latest_ts").try_cast("double").alias("b")
    )
    # In the order of their starts, a root lies inside a session that starts before it and ends last, or in none. A
    # session that starts with the root doesn't hold it, so roots come before the starts of their own time.
    marks = stored.select("channel_id", "team_id", F.col("root").alias("at"), F.lit(0).alias("start"), "uuid", F.lit(None).cast("double").alias("b"))
    marks = marks.unionByName(grown.select("channel_id", "team_id", F.col("a").alias("at"), F.lit(1).alias("start"), F.lit(None).cast("string").alias("uuid"), "b"))
    before = Window.partitionBy("channel_id", "team_id").orderBy("at", "start").rowsBetween(Window.unboundedPreceding, -1)
    found = marks.filter("at is not null").withColumn("last", F.max("b").over(before))
    return found.filter((F.col("start") == 0) & (F.col("at") <= F.col("last"))).select("uuid").distinct()


def changes(documents: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh documents that differ from the stored ones, with body_changed: text or lengths, not only metadata."""
    old = documents.select("uuid", F.col("metadata").alias("__m"), F.col("body").alias("__b"), F.col("lens").alias("__l"))
    rows = fresh.join(old, "uuid", "left")
    body = ~(F.col("body").eqNullSafe(F.col("__b")) & F.col("lens").eqNullSafe(F.col("__l")))
    return rows.withColumn("body_changed", body).filter(body | ~F.col("metadata").eqNullSafe(F.col("__m"))).drop("__m", "__b", "__l")
