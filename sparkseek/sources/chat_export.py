"""Chat workspaces: a state object of channels, members and messages, as rows of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_message, sender_label, ts_to_ms
from ..operators.chat import counts

_MESSAGE = (
    "type:string,subtype:string,ts:string,thread_ts:string,user:string,username:string,text:string,client_msg_id:string,source_team_id:string,"
    "bot_id:string,app_id:string,hidden:boolean,bot_profile:variant,user_profile:struct<is_bot:boolean>"
)
STATE = (
    f"messages map<string,map<string,struct<{_MESSAGE},message:struct<{_MESSAGE}>>>>, members map<string,struct<real_name:string,name:string,is_bot:boolean>>, "
    "channels map<string,struct<id:string,name:string,is_im:boolean>>, channelCursors map<string,string>, selfTeamIds struct<defaultWorkspaceId:string>, "
    "defaultTeamId string, bootData struct<user_id:string>"
)


def parse_states(rows: DataFrame, column: str = "value") -> DataFrame:
    """States of JSON texts, one a row; texts without messages are left out."""
    return rows.select(F.from_json(column, STATE).alias("s")).select("s.*").filter("messages is not null")


def messages(states: DataFrame) -> DataFrame:
    """(channel_id, channel_name, team_id, is_dm, ts, ts_ms, thread_ts, sender_name, text, client_msg_id, is_broadcast, is_update, seq)
    of the messages that count: edits as their new text, no deletions, no bots, no system notes, no empty texts."""
    teams = F.coalesce("selfTeamIds.defaultWorkspaceId", "defaultTeamId", F.lit("")).alias("team")
    rows = states.select("members", "channels", "bootData", teams, F.explode("messages").alias("channel_id", "bucket"))
    rows = rows.select("*", F.explode("bucket").alias("__ts", "outer")).drop("bucket", "__ts")
    update = F.coalesce(F.col("outer.subtype") == "message_changed", F.lit(False))
    inner = F.struct(*[F.col(f"outer.{f.split(':')[0]}") for f in _fields()])
    message = F.when(update, F.col("outer.message")).otherwise(F.when(F.coalesce("outer.subtype", F.lit("")) != "message_deleted", inner))
    rows = rows.withColumn("m", message).withColumn("is_update", update).filter("m is not null and m.ts is not null")
    flags = rows.withColumn("m", F.col("m").withField("has_bot_profile", F.col("m.bot_profile").isNotNull()).withField("profile_is_bot", F.col("m.user_profile.is_bot")))
    member = F.col("members")[F.col("m.user")]
    flags = flags.filter(counts("m", member["is_bot"])).withColumn("ts_ms", ts_to_ms(F.col("m.ts"))).filter("ts_ms is not null")
    channel = F.col("channels")[F.col("channel_id")]
    name = F.coalesce(channel["name"], "channel_id")
    real = F.transform_values("members", lambda _, v: v["real_name"])
    channel_names = F.transform_values("channels", lambda _, v: v["name"])
    me = F.col("members")[F.col("bootData.user_id")]
    self_label = F.when(me["real_name"] != "", F.concat(me["real_name"], F.coalesce(F.when(me["name"] != "", F.concat(F.lit(" (@"), me["name"], F.lit(")"))), F.lit(""))))
    text = normalize_message(F.col("m.text"), real, F.coalesce(channel_names, F.create_map().cast("map<string,string>")), F.col("channel_id"), name)
    out = flags.select(
        "channel_id", name.alias("channel_name"), F.coalesce("m.source_team_id", "team").alias("team_id"), F.coalesce(channel["is_im"], F.lit(False)).alias("is_dm"),
        F.col("m.ts").alias("ts"), "ts_ms", F.col("m.thread_ts").alias("thread_ts"),
        sender_label(member["real_name"], member["name"], F.col("m.user") == F.col("bootData.user_id"), self_label, F.col("m.username")).alias("sender_name"),
        text.alias("text"), F.col("m.client_msg_id").alias("client_msg_id"),
        F.coalesce(F.col("m.subtype").isin("thread_broadcast", "reply_broadcast"), F.lit(False)).alias("is_broadcast"), "is_update",
    )
    return out.filter(F.trim("text") != "").withColumn("seq", F.struct("ts_ms", F.col("is_update").cast("int").alias("u"), "channel_id", "ts"))


def _fields() -> list[str]:
    """Top-level fields of a message; struct types have commas of their own inside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(_MESSAGE):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(_MESSAGE[start:i])
            start = i + 1
    return [*out, _MESSAGE[start:]]


def cursors(states: DataFrame) -> DataFrame:
    """(channel_id, cursor): the latest ts read, as text."""
    return states.select(F.explode("channelCursors").alias("channel_id", "cursor"))
