"""Session logs of assistants, one JSON object a line, in two layouts.

Files are read whole, because a turn's byte offset is the sum of the lines before it: a file is one session and bounded
by what one session writes. Lines that aren't JSON are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sanitize_plain, sanitize_session, session_id_of
from ..operators.sessions import TITLE_CHARS

LEAST_CHARS, MOST_CHARS = 5, 4000
BRANCH = r"(?:Switched to (?:a new )?branch|Already on) '([^']+)'"
FIRST = "type string, timestamp string, gitBranch string, customTitle string, cwd string, message struct<role:string,content:variant>"
SECOND = "type string, timestamp string, payload struct<type:string,role:string,content:variant,cwd:string,git:struct<branch:string>,output:string,text:string>"


def read_files(spark: SparkSession, path: str, suffix: str = "*.jsonl", modified_after: str | None = None) -> DataFrame:
    """(path, stem, mtime_ms, raw) of the files below a folder; with modified_after only newer ones."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    rows = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"), F.col("value").alias("raw"))
    return rows.withColumn("stem", name)


def lines(files: DataFrame) -> DataFrame:
    """(path, stem, mtime_ms, line, off, len, text): offset and length in bytes; blank lines are left out."""
    rows = files.select("path", "stem", "mtime_ms", F.posexplode(F.split("raw", "\n")).alias("line", "text"))
    rows = rows.withColumn("text", F.regexp_replace("text", "\r$", "")).withColumn("len", F.octet_length("text"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("off", F.coalesce(F.sum(F.col("len") + 1).over(w), F.lit(0)))
    return rows.filter(F.trim("text") != "")


def _parsed(rows: DataFrame, schema: str) -> DataFrame:
    return rows.withColumn("e", F.from_json("text", schema, {"mode": "PERMISSIVE"})).filter(F.col("e.type").isNotNull())


def _blocks(content: Column, kinds: Column) -> Column:
    """Texts of the blocks of a kind, joined by lines; NULL without any."""
    items = F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == kinds)
    texts = F.filter(F.transform(items, lambda b: F.try_variant_get(b, "$.text", "string")), lambda t: t.isNotNull())
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))


def _kept(rows: DataFrame, text: Column) -> DataFrame:
    """Turns with a text of 5 to 4000 code points and a time after 1970."""
    stamp = F.when(F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.unix_millis(F.try_to_timestamp("timestamp")))
    out = rows.withColumn("text", text).withColumn("ts_ms", stamp)
    return out.filter(F.char_length("text").between(LEAST_CHARS, MOST_CHARS) & (F.col("ts_ms") > 0))


def first_layout(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, sessions) of logs whose lines are {type, timestamp, message{role, content}, gitBranch, customTitle, cwd}.

    turns: session_id, role, text, timestamp, ts_ms, line, off, len, branch. sessions: session_id, title, project, cwd,
    path, mtime_ms; the last custom title counts, and the first cwd.
    """
    rows = _parsed(lines(files), FIRST)
    content = F.col("e.message.content")
    whole = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    spoken = rows.filter(F.col("e.type").isin("user", "assistant") & F.col("e.message.role").isin("user", "assistant"))
    raw = spoken.select("path", F.col("stem").alias("session_id"), F.col("e.message.role").alias("role"), F.col("e.timestamp").alias("timestamp"), "line", "off", "len", F.col("e.gitBranch").alias("branch"), F.coalesce(whole, _blocks(content, F.lit("text"))).alias("raw"))
    turns = _kept(raw.filter("raw is not null"), sanitize_session(F.col("raw"))).drop("raw")
    info = rows.groupBy("path", F.col("stem").alias("session_id"), "mtime_ms").agg(
        F.max_by(F.when(F.col("e.type") == "custom-title", F.col("e.customTitle")), F.when((F.col("e.type") == "custom-title") & F.col("e.customTitle").isNotNull(), F.col("line"))).alias("custom"),
        F.min_by("e.cwd", F.when(F.col("e.cwd").isNotNull() & (F.col("e.type") != "custom-title"), F.col("line"))).alias("cwd"),
    )
    folder = F.element_at(F.split("path", "/"), -2)
    project = F.coalesce(F.ltrim("cwd", F.lit("/")), F.ltrim(F.replace(folder, F.lit("-"), F.lit("/")), F.lit("/")))
    return turns, _with_titles(info.withColumn("project", project), turns)


def second_layout(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, sessions) of logs whose lines are {type, timestamp, payload}.

    Messages and reasoning are turns. The branch is the last one a command switched to, else the first the session
    names; it holds for the whole session. The project is the last part of cwd.
    """
    rows = _parsed(lines(files), SECOND)
    p = "e.payload."
    kind = F.when(F.col(p + "role") == "user", "input_text").when(F.col(p + "role") == "assistant", "output_text")
    message = F.when((F.col("e.type") == "response_item") & (F.col(p + "type") == "message"), _blocks(F.col(p + "content"), kind))
    thought = F.when((F.col("e.type") == "event_msg") & (F.col(p + "type") == "agent_reasoning"), F.col(p + "text"))
    meta = F.col("e.type") == "session_meta"
    switched = F.when(~meta & (F.col(p + "type") == "function_call_output"), F.nullif(F.regexp_extract(F.col(p + "output"), BRANCH, 1), F.lit("")))
    ident = session_id_of(F.col("stem"))
    info = rows.groupBy("path", ident.alias("session_id"), "mtime_ms").agg(
        F.min_by(p + "cwd", F.when(meta & F.col(p + "cwd").isNotNull(), F.col("line"))).alias("cwd"),
        F.coalesce(F.max_by(switched, F.when(switched.isNotNull(), F.col("line"))), F.min_by(p + "git.branch", F.when(meta & F.col(p + "git.branch").isNotNull(), F.col("line")))).alias("branch"),
    )
    role = F.when(thought.isNotNull(), "assistant").otherwise(F.col(p + "role"))
    raw = rows.filter(~meta).select("path", ident.alias("session_id"), role.alias("role"), F.col("e.timestamp").alias("timestamp"), "line", "off", "len", F.coalesce(message, thought).alias("raw"))
    turns = _kept(raw.filter("raw is not null"), sanitize_plain(F.col("raw"))).drop("raw").join(info.select("session_id", "branch"), "session_id")
    project = F.coalesce(F.element_at(F.split(F.rtrim("cwd", F.lit("/")), "/"), -1), F.lit(""))
    return turns, _with_titles(info.drop("branch").withColumn("custom", F.lit(None).cast("string")).withColumn("project", project), turns)


def _with_titles(info: DataFrame, turns: DataFrame) -> DataFrame:
    first = turns.filter("role = 'user'").groupBy("session_id").agg(F.substring(F.min_by("text", F.struct("ts_ms", "line")), 1, TITLE_CHARS).alias("first"))
    return info.join(first, "session_id", "left").select("session_id", F.coalesce("custom", "first", F.lit("")).alias("title"), "project", "cwd", "path", "mtime_ms")


def named(sessions: DataFrame, names: DataFrame) -> DataFrame:
    """sessions with the titles of an index (id, thread_name), where it has one."""
    index = names.select(F.col("id").alias("session_id"), F.col("thread_name").alias("__name"))
    return sessions.join(index, "session_id", "left").withColumn("title", F.coalesce("__name", "title")).drop("__name")


def written_paths(files: DataFrame) -> DataFrame:
    """(file_path): distinct files that tool calls named Write wrote, sorted."""
    rows = _parsed(lines(files), FIRST).select(F.explode(F.try_variant_get("e.message.content", "$", "array<variant>")).alias("b"))
    get = lambda p: F.try_variant_get("b", p, "string")
    return rows.filter((get("$.type") == "tool_use") & (get("$.name") == "Write")).select(get("$.input.file_path").alias("file_path")).filter("file_path is not null").distinct().orderBy("file_path")


def read_turns(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, off, text): the lines of wanted (path, off), read again from the files' own bytes."""
    return lines(files).join(wanted, ["path", "off"]).select("path", "off", "text")
