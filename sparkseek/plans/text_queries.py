"""Queries of text functions, sessions, chats and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat, evaluate, sessions
from .common import DOC_SQL, documents, read

HOUR = 3_600_000


def split_codepoints(spark: SparkSession, d: str) -> DataFrame:
    third = F.floor(F.col("n_chars") / 3).cast("int")
    lens = F.array(third, third, F.col("n_chars").cast("int") - 2 * third)
    parts = T.code_point_slices(F.col("text"), lens)
    return read(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("part", "piece")).select("doc_id", "part", F.md5("piece").alias("md5"))


def split_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Lengths that don't add up give no parts."""
    lens = T.lengths_from_csv(F.concat_ws(",", F.col("n_chars").cast("string"), F.lit("x"), F.when(F.col("doc_id") % 2 == 0, "1")))
    return read(spark, d, "documents").select("doc_id", F.size(T.code_point_slices(F.col("text"), lens)).alias("parts"))


def strip_code(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with code put around their words."""
    mixed = F.concat(F.lit("a `x y` b ```"), "text", F.lit("``` c "), "text", F.lit(" ```open "), "text")
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(T.strip_code(mixed)).alias("md5"))


def strip_tables(spark: SparkSession, d: str) -> DataFrame:
    mixed = F.concat(F.lit("| a | b |\n"), "text", F.lit("\n  | c |  \nend |"))
    return read(spark, d, "documents").select("doc_id", F.md5(T.strip_tables(mixed)).alias("md5"))


def text_sanitize(spark: SparkSession, d: str) -> DataFrame:
    """Pages without tags and code, whitespace compacted."""
    return read(spark, d, "pages").select("page_id", F.md5(T.sanitize_plain(F.col("html"))).alias("md5"))


def session_sanitize(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.concat(F.lit("<sys-note a=1>hidden "), "text", F.lit("</sys-note>keep  "), "text", F.lit("\n<x:y>to the end\nnext [Request interrupted by user for tool use]"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(T.sanitize_session(noisy)).alias("md5"))


def entity_decode(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.md5(T.named_entities(F.col("html"))).alias("md5"))


def entity_numeric(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.lit("&#"), (F.col("event_id") % 90 + 33).cast("string"), F.lit("; &#x4A; &nope; &AMP;"))
    return read(spark, d, "events").select("event_id", T.decode_entities(code).alias("shown"))


def query_normalize(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("  it's\t"), "text", F.lit(" "))
    return read(spark, d, "benchmark").select("item_id", T.squeeze(q).alias("squeezed"), T.query_param(q).alias("exact"), T.query_param(F.concat(q, F.lit("z"))).alias("prefix"))


def message_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Messages made of events: a label, an emoji, a mention, a channel, a link."""
    user = F.col("user_id").cast("string")
    raw = F.concat(F.lit("[bot] :TADA: :none: <@U"), user, F.lit("> in <#C1|general> (<#C"), user, F.lit(">) <https://e.org/a|label> <http://b.c> &lt;`code`  "), "event_type")
    names = F.create_map(F.lit("U1"), F.lit("Ada"), F.lit("U2"), F.lit("Bob"))
    channels = F.create_map(F.lit("C2"), F.lit("two"), F.lit("C3"), F.lit(""))
    shown = T.normalize_message(raw, names, channels, F.lit("C4"), F.lit("own"))
    return read(spark, d, "events").select("event_id", shown.alias("shown"))


def sender_labels(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    label = T.sender_label(F.when(u % 2 == 0, F.concat(F.lit("N"), u)).otherwise(""), F.when(u % 3 == 0, F.concat(F.lit("h"), u)), u % 5 == 0, F.lit("me"), F.when(u % 7 == 0, "app"))
    return read(spark, d, "events").select("event_id", label.alias("label"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as messages."""
    return read(spark, d, "events").withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))


def format_times(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    odd = F.when(F.col("event_id") % 9 == 0, "bad").otherwise(iso)
    back = T.ts_to_ms((F.col("ts_ms") / 1000).cast("decimal(20,3)").cast("string"))
    return rows.select("event_id", T.format_ms(F.col("ts_ms")).alias("from_ms"), T.format_iso(odd).alias("from_iso"), (back - F.col("ts_ms")).between(-1, 1).alias("same"))


def since_durations(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat((F.col("user_id") % 50).cast("string"), F.element_at(F.array(*map(F.lit, ("h", "d", "w", "m"))), (F.col("event_id") % 4 + 1).cast("int")))
    return read(spark, d, "events").select("event_id", F.coalesce(T.since_ms(text), F.lit(-1)).alias("ms"))


def path_names(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", r"[?#].*$", "")
    return read(spark, d, "pages").select("page_id", T.last_segment(path).alias("last"), T.project_name(F.replace(F.lit("-home-a-b"), F.lit("b"), F.col("page_id").cast("string"))).alias("project"))


def display_lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", T.strip_role(F.concat(F.lit("[User] "), T.first_line(F.concat(F.lit("\n  \n"), "text")))).alias("line"))


# Sessions.


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as sessions, user and assistant turns in order."""
    rows = read(spark, d, "conversations").filter(F.col("role").isin("user", "assistant"))
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ts_ms"), F.col("turn").alias("line"), "role", F.coalesce("text", F.lit("")).alias("text"))


def interactions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.interactions(_turns(spark, d)).select("session_id", "line", "interaction")


def session_title(spark: SparkSession, d: str) -> DataFrame:
    return sessions.titles(_turns(spark, d))


def interaction_documents(spark: SparkSession, d: str) -> DataFrame:
    turns = sessions.interactions(_turns(spark, d)).withColumns({"timestamp": F.format_string("t%d", "line"), "off": F.col("line") * 10, "len": F.lit(10), "branch": F.when(F.col("line") % 3 == 1, F.concat(F.lit("b"), F.col("line").cast("string")))})
    info = sessions.titles(_turns(spark, d)).withColumns({"project": F.lit("p"), "cwd": F.lit(None).cast("string"), "path": F.lit("x")})
    out = sessions.interaction_documents(turns, info, "a", "Assistant")
    return out.select("date", F.get_json_object("metadata", "$.session_id").alias("session_id"), F.get_json_object("metadata", "$.turn").alias("turn"), F.get_json_object("metadata", "$.branch").alias("branch"), F.md5("body").alias("md5"), F.array_join(F.col("lens").cast("array<string>"), ",").alias("lens"))


def latest_per_session(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source, the latest of each."""
    rows = documents(spark, d).withColumn("metadata", F.to_json(F.struct(F.get_json_object("metadata", "$.source").alias("session_id"))))
    return sessions.latest_per_session(rows).select("session_id", "date", F.md5("body").alias("md5"))


def turn_range(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") != 1, F.to_json(F.struct("turn"))).otherwise("{}").alias("metadata"))
    return sessions.turns_between(rows, *T.parse_range("1-3")).select("conv_id", "turn")


def context_slice(spark: SparkSession, d: str) -> DataFrame:
    grouped = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    bodies = F.transform("t", lambda x: x["text"])
    return grouped.select("conv_id", F.md5(F.array_join(T.context_slice(bodies, F.lit(2)), "|")).alias("md5"))


# Chats.


def _gaps(spark: SparkSession, d: str, gap: int) -> DataFrame:
    rows = chat.gap_sessions(_events(spark, d), "user_id", "ts_ms", F.lit(gap), ("event_id",))
    return rows.select("event_id", "user_id", "session_start")


def gap_sessions_30(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d, 30 * 60_000)


def gap_sessions_90(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d, 90 * 60_000)


def capped_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of up to twelve hours, spans of up to a day."""
    return chat.capped_sessions(_events(spark, d), "user_id", "ts_ms", F.lit(12 * HOUR), 24 * HOUR, ("event_id",)).select("event_id", "session_start")


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return chat.gap_sessions(_events(spark, d), "user_id", "ts_ms", F.lit(90 * 60_000), ("event_id",))


def unread_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _sessions(spark, d).withColumn("cursor", F.expr("unix_millis(timestamp '2024-01-15 00:00:00')") + F.col("user_id") * HOUR)
    unread = F.col("ts_ms") > F.col("cursor")
    return rows.groupBy("user_id", "session_start").agg(F.max("ts_ms").alias("latest"), F.bool_or(unread).alias("has_unread"), F.count_if(unread).alias("unread"), F.count("*").alias("n"))


def channel_ordinal(spark: SparkSession, d: str) -> DataFrame:
    convs = _sessions(spark, d).select("user_id", "session_start").distinct()
    return convs.withColumn("turn", F.row_number().over(Window.partitionBy("user_id").orderBy("session_start")) - 1)


def chat_copies(spark: SparkSession, d: str) -> DataFrame:
    """Events as messages with few client ids, some broadcasts, some updates: which ones stay."""
    rows = _events(spark, d).select(
        "event_id", F.col("event_type").alias("channel_id"), F.col("ts_ms").cast("string").alias("ts"), F.when(F.col("event_id") % 4 > 0, F.format_string("c%d", F.col("event_id") % 997)).alias("client_msg_id"),
        (F.col("event_id") % 3 == 0).alias("is_broadcast"), (F.col("event_id") % 11 == 0).alias("is_update"),
    )
    return chat.without_copies(rows, ("event_id",)).select("event_id")


def subsumed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by short gaps whose root lies inside one by long gaps."""
    short, long = _gaps(spark, d, 30 * 60_000), _gaps(spark, d, 90 * 60_000)
    key = F.concat(F.lit("sess:"), F.col("user_id").cast("string"), F.lit("-"), F.col("session_start").cast("string"))
    stored = short.select("user_id", "session_start").distinct().select(
        key.alias("uuid"), F.to_json(F.struct(F.lit("slack").alias("source"), F.col("user_id").cast("string").alias("channel_id"), key.alias("conv_key"))).alias("metadata"))
    ends = long.join(_events(spark, d).select("event_id", "ts_ms"), "event_id").groupBy("user_id", "session_start").agg(F.max("ts_ms").alias("latest"))
    convs = ends.select(F.col("user_id").cast("string").alias("channel_id"), F.lit("").alias("team_id"), key.alias("key"), F.col("session_start").cast("string").alias("root_ts"), F.col("latest").cast("string").alias("latest_ts"))
    return chat.subsumed(stored, convs)


def changed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every third text and every fifth metadata differ from what is stored; every seventh document is new."""
    rows = documents(spark, d).select("rowid", "uuid", "metadata", "body", "lens")
    fresh = rows.withColumn("body", F.when(F.col("rowid") % 3 == 0, F.concat("body", F.lit("."))).otherwise(F.col("body"))).withColumn("metadata", F.when(F.col("rowid") % 5 == 0, "{}").otherwise(F.col("metadata")))
    return chat.changes(rows.filter("rowid % 7 > 0"), fresh).select("rowid", "body_changed")


# Evaluation.


def ndcg10(spark: SparkSession, d: str) -> DataFrame:
    """Languages as queries, documents by length as results, quality labels as relevance."""
    docs = read(spark, d, "documents").select(F.col("lang").alias("qid"), F.col("doc_id").alias("key"), "n_chars")
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n_chars"), "key")))
    rel = read(spark, d, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("rel")).join(docs.select("qid", "key"), "key")
    return evaluate.ndcg(ranked, rel).select("qid", F.round("ndcg", 6).alias("ndcg"))


def p95_disc(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.clamped_quantile(read(spark, d, "events"), "value", 0.95, 150.0, ("event_type",)).select("event_type", F.round("quantile", 6).alias("p95"))


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.histogram(read(spark, d, "events"), F.col("value"), 0.0, 200.0, 20)


QUERIES = {f.__name__: f for f in (
    split_codepoints, split_mismatch, strip_code, strip_tables, text_sanitize, session_sanitize, entity_decode, entity_numeric, query_normalize, message_normalize, sender_labels,
    format_times, since_durations, path_names, display_lines, interactions, session_title, interaction_documents, latest_per_session, turn_range, context_slice,
    gap_sessions_30, gap_sessions_90, capped_sessions, unread_counts, channel_ordinal, chat_copies, subsumed_sessions, changed_documents, ndcg10, p95_disc, score_histogram,
)}

_STRIP = "regexp_replace(regexp_replace(regexp_replace({x}, '(?s)```.*?```', ' ', 'g'), '(?s)```.*$', ' ', 'g'), '`[^`]*`', ' ', 'g')"
_TURNS = "t AS (SELECT conv_id AS session_id, turn AS line, role, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant')), i AS (SELECT *, sum(CASE WHEN role = 'user' AND r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line) AS interaction FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line) AS r FROM t)), n AS (SELECT session_id, coalesce(substr(arg_min(text, line) FILTER (WHERE role = 'user'), 1, 240), '') AS title FROM t GROUP BY ALL)"


def _gap_sql(minutes: int, name: str = "s") -> str:
    return f"""{name}_e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ts_ms FROM events),
{name}_g AS (SELECT *, CASE WHEN coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) > {minutes * 60_000}, true) THEN ts_ms END AS start FROM {name}_e),
{name} AS (SELECT event_id, user_id, ts_ms, last_value(start IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS session_start FROM {name}_g)"""


ORACLE_SQL = {
    "split_codepoints": "SELECT doc_id, CAST(i AS INT) AS part, md5(CASE WHEN i < 2 THEN substr(text, 1 + i * (n_chars // 3), n_chars // 3) ELSE substr(text, 1 + 2 * (n_chars // 3)) END) AS md5 FROM documents, range(3) r(i)",
    "split_mismatch": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS parts FROM documents",
    "strip_code": f"SELECT conv_id, turn, md5({_STRIP.format(x='''('a `x y` b ```' || text || '``` c ' || text || ' ```open ' || text)''')}) AS md5 FROM conversations",
    "strip_tables": "SELECT doc_id, md5(array_to_string(list_filter(string_split('| a | b |' || chr(10) || text || chr(10) || '  | c |  ' || chr(10) || 'end |', chr(10)), lambda x: NOT (starts_with(trim(x), '|') AND ends_with(trim(x), '|'))), chr(10))) AS md5 FROM documents",
    "text_sanitize": f"SELECT page_id, md5(regexp_replace(regexp_replace({_STRIP.format(x='''regexp_replace(html, '<[^>]+>', '', 'g')''')}, '\\s{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS md5 FROM pages",
    "session_sanitize": f"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(array_to_string(list_filter(string_split({_STRIP.format(x='''('keep  ' || text || chr(10) || 'next ')''')}, chr(10)), lambda x: NOT (starts_with(trim(x), '|') AND ends_with(trim(x), '|'))), chr(10)), '\\s{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS md5 FROM conversations",
    "entity_decode": "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', chr(160)), '&mdash;', chr(8212)), '&ndash;', chr(8211)), '&hellip;', chr(8230)), '&amp;', '&')) AS md5 FROM pages",
    "entity_numeric": "SELECT event_id, chr(CAST(event_id % 90 + 33 AS INT)) || ' J &nope; &' AS shown FROM events",
    "query_normalize": "WITH q AS (SELECT item_id, '  it''s' || chr(9) || text || ' ' AS q FROM benchmark), r AS (SELECT *, regexp_replace(q, '[^\\p{L}\\p{N}\\s]', '', 'g') AS k FROM q) SELECT item_id, trim(regexp_replace(q, '\\s+', ' ', 'g')) AS squeezed, trim(k) AS exact, k || 'z*' AS prefix FROM r",
    "message_normalize": "SELECT event_id, chr(127881) || '  ' || CASE user_id WHEN 1 THEN 'Ada ' WHEN 2 THEN 'Bob ' ELSE '' END || 'in #general ' || CASE user_id WHEN 2 THEN '#two ' WHEN 4 THEN '#own ' ELSE '' END || 'label http://b.c < ' || event_type AS shown FROM events",
    "sender_labels": "SELECT event_id, CASE WHEN user_id % 2 = 0 AND user_id % 3 = 0 THEN 'N' || user_id || ' (@h' || user_id || ')' WHEN user_id % 2 = 0 THEN 'N' || user_id WHEN user_id % 3 = 0 THEN '@h' || user_id WHEN user_id % 5 = 0 THEN 'me' WHEN user_id % 7 = 0 THEN 'app' ELSE 'Unknown' END AS label FROM events",
    "format_times": "SELECT event_id, strftime(ts, '%b %d %H:%M') AS from_ms, CASE WHEN event_id % 9 = 0 THEN '??? ?? ??:??' ELSE strftime(ts, '%b %d %H:%M') END AS from_iso, true AS same FROM events",
    "since_durations": "SELECT event_id, CAST(coalesce(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 24 WHEN 2 THEN 168 END * (user_id % 50) * 3600000, -1) AS BIGINT) AS ms FROM events",
    "path_names": "WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS u FROM pages) SELECT page_id, string_split(u, '/')[-1] AS last, 'home/a/' || page_id AS project FROM p",
    "display_lines": "SELECT conv_id, turn, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS line FROM conversations",
    "interactions": f"WITH {_TURNS} SELECT session_id, line, CAST(interaction AS BIGINT) AS interaction FROM i",
    "session_title": f"WITH {_TURNS} SELECT session_id, title FROM n",
    "interaction_documents": f"""WITH {_TURNS}, x AS (SELECT session_id, interaction, line, CASE role WHEN 'user' THEN '[User] ' ELSE '[Assistant] ' END || text || chr(10) AS part FROM i)
SELECT 't' || min(line) AS date, CAST(session_id AS VARCHAR) AS session_id, CAST(CAST(interaction AS BIGINT) AS VARCHAR) AS turn, 'b' || max(CASE WHEN line % 3 = 1 THEN line END) AS branch,
md5('[p] ' || title || chr(10) || string_agg(part, '' ORDER BY line)) AS md5, length('[p] ' || title || chr(10)) || ',' || string_agg(CAST(length(part) AS VARCHAR), ',' ORDER BY line) AS lens FROM x JOIN n USING (session_id) GROUP BY session_id, interaction, title""",
    "latest_per_session": f"WITH {DOC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY date DESC, rowid DESC) AS r FROM d) SELECT source AS session_id, date, md5(body) AS md5 FROM r WHERE r = 1",
    "turn_range": "SELECT conv_id, turn FROM conversations WHERE turn BETWEEN 1 AND 3 AND turn <> 1",
    "context_slice": "WITH g AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, md5(array_to_string(t[2:5], '|')) AS md5 FROM g",
    "gap_sessions_30": f"WITH {_gap_sql(30)} SELECT event_id, user_id, session_start FROM s",
    "gap_sessions_90": f"WITH {_gap_sql(90)} SELECT event_id, user_id, session_start FROM s",
    "unread_counts": f"WITH {_gap_sql(90)} SELECT user_id, session_start, max(ts_ms) AS latest, bool_or(ts_ms > c) AS has_unread, count(*) FILTER (WHERE ts_ms > c) AS unread, count(*) AS n FROM (SELECT *, epoch_ms(TIMESTAMP '2024-01-15') + user_id * {HOUR} AS c FROM s) GROUP BY ALL",
    "channel_ordinal": f"WITH {_gap_sql(90)}, c AS (SELECT DISTINCT user_id, session_start FROM s) SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY session_start) - 1 AS INT) AS turn FROM c",
    "chat_copies": """WITH m AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN 'c' || (event_id % 997) ELSE 't' || event_type || '|' || epoch_us(ts) // 1000 END AS key, event_id % 3 = 0 AS wide, event_id % 11 = 0 AS upd FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id) AS n FROM m),
a AS (SELECT key, coalesce(max(n) FILTER (WHERE upd AND n > 1), 1) AS anchor FROM r GROUP BY key),
p AS (SELECT key, anchor, bool_or(wide) FILTER (WHERE n = anchor) AS w, min(n) FILTER (WHERE n > anchor AND NOT wide) AS nxt FROM r JOIN a USING (key) GROUP BY ALL)
SELECT event_id FROM r JOIN p USING (key) WHERE n = CASE WHEN w THEN coalesce(nxt, anchor) ELSE anchor END""",
    "subsumed_sessions": f"""WITH {_gap_sql(30, 'a')}, {_gap_sql(90, 'b')}, l AS (SELECT user_id, session_start, max(ts_ms) AS latest FROM b GROUP BY ALL)
SELECT DISTINCT 'sess:' || a.user_id || '-' || a.session_start AS uuid FROM a JOIN l ON a.user_id = l.user_id AND a.session_start > l.session_start AND a.session_start <= l.latest""",
    "changed_documents": "SELECT doc_id AS rowid, (doc_id % 7 = 0 OR doc_id % 3 = 0) AS body_changed FROM documents WHERE doc_id % 7 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0",
    "ndcg10": """WITH r AS (SELECT lang AS qid, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
l AS (SELECT qid, doc_id, quality AS rel, rank, row_number() OVER (PARTITION BY qid ORDER BY quality DESC, doc_id) AS ideal FROM labels JOIN r USING (doc_id))
SELECT qid, round(sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 10 THEN rel / log2(ideal + 1) ELSE 0 END), 6) AS ndcg FROM l GROUP BY qid""",
    "p95_disc": "SELECT event_type, round(quantile_disc(least(value, 150.0), 0.95), 6) AS p95 FROM events GROUP BY ALL",
    "score_histogram": "SELECT CAST(greatest(0, least(19, floor(value / 10))) AS INT) AS bin, count(*) AS n FROM events GROUP BY ALL",
}
