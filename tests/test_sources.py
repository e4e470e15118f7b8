import json

from pyspark.sql import functions as F

from sparkseek.operators import chat, sessions
from sparkseek.operators import documents as D
from sparkseek.sources import chat_export, markdown, session_logs, tsv
from sparkseek.streaming import ingest


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def say(role, text, ts, **more):
    return {"type": role, "timestamp": ts, "message": {"role": role, "content": text}, **more}


def test_first_layout(spark, tmp_path):
    blocks = [{"type": "text", "text": "part one"}, {"type": "tool_use", "name": "Write", "input": {"file_path": "/x/b.md"}}, {"type": "text", "text": "part two"}]
    lines = [
        say("user", "hello there", "2025-01-15T10:30:00Z", cwd="/home/me/proj", gitBranch="main"), "", "not json", say("assistant", blocks, "2025-01-15T10:31:00Z"),
        {"type": "custom-title", "customTitle": "first"}, {"type": "custom-title", "customTitle": "My title"}, say("user", "no", "2025-01-15T10:32:00Z"), say("system", "ignored text", "2025-01-15T10:32:00Z"),
        say("user", "second question", "2025-01-15T10:33:00+00:00", gitBranch="dev"), say("user", "no time at all", ""), say("assistant", "early answer", "2025-01-15T10:29:00Z"),
    ]
    write(tmp_path / "-home-me-proj" / "abc.jsonl", lines)
    files = session_logs.read_files(spark, str(tmp_path))
    turns, info = session_logs.first_layout(files)
    got = [(r["role"], r["text"]) for r in turns.orderBy("ts_ms", "line").collect()]
    assert got == [("assistant", "early answer"), ("user", "hello there"), ("assistant", "part one\npart two"), ("user", "second question")]
    row = info.first()
    assert (row["title"], row["project"], row["cwd"], row["session_id"]) == ("My title", "home/me/proj", "/home/me/proj", "abc")
    raw = (tmp_path / "-home-me-proj" / "abc.jsonl").read_bytes()
    for r in turns.collect():
        assert json.loads(raw[r["off"] : r["off"] + r["len"]])["timestamp"] == r["timestamp"]
    docs = sessions.interaction_documents(sessions.interactions(turns), info, "agent", "Agent").collect()
    by_turn = {json.loads(d["metadata"])["turn"]: d for d in docs}
    assert by_turn[0]["body"] == "[home/me/proj] My title\n[Agent] early answer\n"
    assert by_turn[1]["body"] == "[home/me/proj] My title\n[User] hello there\n[Agent] part one\npart two\n" and json.loads(by_turn[1]["metadata"])["branch"] == "main"
    assert by_turn[2]["lens"] == [len("[home/me/proj] My title\n"), len("[User] second question\n")] and by_turn[2]["date"] == "2025-01-15T10:33:00+00:00"
    assert [r["file_path"] for r in session_logs.written_paths(files).collect()] == ["/x/b.md"]
    assert session_logs.read_turns(files, turns.select("path", "off")).count() == 4


def test_second_layout(spark, tmp_path):
    message = lambda role, kind, text: {"type": "response_item", "timestamp": "2025-02-01T00:00:00Z", "payload": {"type": "message", "role": role, "content": [{"type": kind, "text": text}]}}
    lines = [
        {"type": "session_meta", "timestamp": "2025-02-01T00:00:00Z", "payload": {"cwd": "/work/repo", "git": {"branch": "main"}}},
        message("user", "input_text", "please do this"), message("assistant", "input_text", "wrong kind here"), message("assistant", "output_text", "done it now"), message("developer", "input_text", "not a turn"),
        {"type": "event_msg", "timestamp": "2025-02-01T00:00:01Z", "payload": {"type": "agent_reasoning", "text": "thinking hard"}},
        {"type": "response_item", "timestamp": "2025-02-01T00:00:02Z", "payload": {"type": "function_call_output", "output": "Switched to a new branch 'feature'"}},
        {"type": "response_item", "timestamp": "2025-02-01T00:00:03Z", "payload": {"type": "function_call_output", "output": "Already on 'last'"}},
    ]
    ident = "0123abcd-0000-4000-8000-0123456789ab"
    write(tmp_path / "deep" / f"rollout-{ident}.jsonl", lines)
    turns, info = session_logs.second_layout(session_logs.read_files(spark, str(tmp_path)))
    assert [(r["role"], r["text"], r["branch"]) for r in turns.orderBy("ts_ms", "line").collect()] == [("user", "please do this", "last"), ("assistant", "done it now", "last"), ("assistant", "thinking hard", "last")]
    assert (info.first()["project"], info.first()["title"], info.first()["session_id"]) == ("repo", "please do this", ident)
    names = spark.createDataFrame([(ident, "Named")], "id string, thread_name string")
    assert session_logs.named(info, names).first()["title"] == "Named"


def test_tsv(spark, tmp_path):
    write(tmp_path / "docs.tsv", ["one\t" + "A sentence here. " * 40, "two\tshort"])
    rows = {json.loads(r["metadata"])["key"]: r for r in tsv.read_documents(spark, str(tmp_path / "docs.tsv")).collect()}
    assert rows["two"]["body"] == "short\n" and rows["two"]["lens"] == [6]
    assert sum(rows["one"]["lens"]) == len(rows["one"]["body"]) and max(rows["one"]["lens"]) <= 301 and len(rows["one"]["lens"]) > 1
    write(tmp_path / "q.tsv", ["1\twhat is it"])
    assert tsv.read_questions(spark, str(tmp_path / "q.tsv")).first()["question"] == "what is it"


def test_markdown(spark, tmp_path):
    write(tmp_path / "m" / "note.md", ["---", "name: x", "---", "# Title", "text"])
    write(tmp_path / "m" / "ROOT.md", ["@sub/a.md and more", "note.md - a note", "missing.md - none"])
    write(tmp_path / "m" / "sub" / "a.md", ["@../ROOT.md", "@b.md"])
    write(tmp_path / "m" / "sub" / "b.md", ["end"])
    files = session_logs.read_files(spark, str(tmp_path / "m"), "*.md")
    doc = {r["body"].split("\n")[0]: r for r in markdown.documents(files, "memory", "agent", "p").collect()}["[p] note"]
    assert doc["body"] == "[p] note\n# Title\ntext\n" and sum(doc["lens"]) == len(doc["body"])
    root = next(r["path"] for r in files.collect() if r["path"].endswith("ROOT.md"))
    assert [r["path"].rsplit("/", 1)[-1] for r in markdown.closure(files, [root]).collect()] == ["ROOT.md", "note.md", "a.md", "b.md"]


#: A day in a boat club's channel, from 2025-03-09 06:00 UTC: three people, a robot, two busy spells and one thread.
CLUB = {
    "messages": {
        "CBOATS": {
            "a": {"ts": "1741500000.000200", "user": "UMIRA", "text": "who rows today?", "client_msg_id": "row-1"},
            "b": {"ts": "1741500300.000000", "user": "UTARO", "text": "me, if <@UMIRA> steers"},
            "c": {"ts": "1741500900.000000", "user": "UROBO", "text": "wind 3 from the west"},
            "d": {"subtype": "message_changed", "message": {"ts": "1741500000.000200", "user": "UMIRA", "text": "who rows at noon?", "client_msg_id": "row-1"}},
            "e": {"ts": "1741501000.000000", "user": "UTARO", "subtype": "channel_topic", "text": "set the topic"},
            "f": {"ts": "1741500600.000000", "user": "UNOOR", "text": "bring the blue oars", "thread_ts": "1741500300.000000"},
            "g": {"ts": "1741501200.000000", "subtype": "message_deleted", "text": "never mind"},
            "h": {"ts": "1741508000.000000", "user": "UNOOR", "text": "back ashore"},
            "i": {"ts": "1741508500.000000", "user": "UMIRA", "text": "soup is on"},
        }
    },
    "members": {"UMIRA": {"real_name": "Mira Sol", "name": "mira"}, "UTARO": {"real_name": "", "name": "taro"}, "UNOOR": {"real_name": "Noor", "name": ""}, "UROBO": {"is_bot": True}},
    "channels": {"CBOATS": {"name": "boats", "is_im": False}},
    "channelCursors": {"CBOATS": "1741508000.000000"},
    "selfTeamIds": {"defaultWorkspaceId": "TCLUB"},
}


def test_chat(spark):
    states = chat_export.parse_states(spark.createDataFrame([(json.dumps(CLUB),), ("{}",)], "value string"))
    rows = chat.without_copies(chat_export.messages(states))
    said = {r["text"] for r in rows.collect()}
    assert said == {"who rows at noon?", "me, if Mira Sol steers", "bring the blue oars", "back ashore", "soup is on"}
    convs = {r["key"]: r for r in chat.conversations(rows, chat_export.cursors(states)).collect()}
    morning, later, thread = "sess:CBOATS-1741500000.000200", "sess:CBOATS-1741508000.000000", "thr:CBOATS-1741500300.000000"
    assert set(convs) == {morning, later, thread}
    assert convs[morning]["parts"] == ["[Mar 09 06:00] [Mira Sol (@mira)] who rows at noon?\n", "[Mar 09 06:05] [@taro] me, if Mira Sol steers\n"]
    assert convs[thread]["parts"] == ["[Mar 09 06:10] [Noor] bring the blue oars\n"]
    assert (convs[later]["unread_count"], convs[morning]["unread_count"], convs[later]["latest_ts"]) == (1, 0, "1741508500.000000")
    assert {k: c["turn"] for k, c in convs.items()} == {morning: 0, thread: 1, later: 2}
    docs = chat.conversation_documents(chat.conversations(rows.filter("thread_ts is null"), chat_export.cursors(states)))
    stored = docs.withColumn("rowid", F.monotonically_increasing_id())
    assert stored.count() == 2 and chat.changes(stored, docs).count() == 0
    other = docs.withColumn("metadata", F.lit("{}"))
    assert [r["body_changed"] for r in chat.changes(stored, other).collect()] == [False, False]
    schema = "channel_id string, team_id string, key string, root_ts string, latest_ts string"
    grown = lambda a, b: spark.createDataFrame([("CBOATS", "TCLUB", f"sess:CBOATS-{a}", a, b)], schema)
    assert chat.subsumed(stored, grown("1741499000.5", "1741501000.0")).count() == 1
    assert chat.subsumed(stored, grown("1741499000.5", "1741508900.0")).count() == 2
    assert chat.subsumed(stored, grown("1741500000.000200", "1741501000.0")).count() == 0  # a session isn't inside itself


def test_subsumption_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    stored = [(f"u{i}", rng.choice("AB"), rng.randint(0, 60)) for i in range(80)]
    grown = [(rng.choice("AB"), a, a + rng.randint(0, 12)) for a in (rng.randint(0, 60) for _ in range(12))]
    meta = lambda c, r: json.dumps({"source": "slack", "channel_id": c, "team_id": "T", "conv_key": f"sess:{c}-{r}.0"})
    documents = spark.createDataFrame([(u, meta(c, r)) for u, c, r in stored], "uuid string, metadata string")
    convs = spark.createDataFrame([(c, "T", f"sess:{c}-{a}.0", f"{a}.0", f"{b}.0") for c, a, b in grown], "channel_id string, team_id string, key string, root_ts string, latest_ts string")
    expected = {u for u, c, r in stored if any(c == k and a < r <= b for k, a, b in grown)}
    assert {r["uuid"] for r in chat.subsumed(documents, convs).collect()} == expected


def test_capped_sessions(spark):
    import random

    rng = random.Random(7)
    rows, gap, span = [], 50, 200
    for c in range(5):
        t = 0
        for _ in range(60):
            t += rng.choice([1, 10, 40, 60])
            rows.append((c, t))
    got = {(r["c"], r["t"]): r["session_start"] for r in chat.capped_sessions(spark.createDataFrame(rows, "c long, t long"), "c", "t", F.lit(gap), span).collect()}
    for c in range(5):
        start = last = None
        for t in sorted(t for k, t in rows if k == c):
            if last is None or t - last > gap or t - start > span:
                start = t
            last = t
            assert got[c, t] == start


def test_copies_follow_the_fold(spark):
    import random

    rng = random.Random(5)
    rows = [(i, "C", str(rng.randint(0, 40)), rng.choice([None, f"m{rng.randint(0, 20)}"]), rng.random() < 0.4, rng.random() < 0.3) for i in range(600)]
    kept = {}
    for r in rows:
        key = ("c", r[3]) if r[3] else ("t", r[2])
        old = kept.get(key)
        if old is None or r[5] or (not r[4] and old[4]):
            kept[key] = r
    df = spark.createDataFrame(rows, "seq int, channel_id string, ts string, client_msg_id string, is_broadcast boolean, is_update boolean")
    assert sorted(r["seq"] for r in chat.without_copies(df).collect()) == sorted(r[0] for r in kept.values())


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder / "p" / "s1.jsonl", [say("user", "hello there", "2025-01-15T10:30:00Z"), say("assistant", "answer one", "2025-01-15T10:31:00Z")])
    documents = ingest.Store(spark, str(tmp_path / "docs"), D.DOCUMENT)
    chunks = ingest.Store(spark, str(tmp_path / "chunks"), ingest.CHUNK)
    encoder = ingest.HashEncoder(8)

    def to_documents(files):
        turns, info = session_logs.first_layout(files)
        return sessions.interaction_documents(sessions.interactions(turns), info, "agent", "Agent")

    run = lambda: ingest.run_stream(spark, str(folder), to_documents, documents, str(tmp_path / "cp"), chunks, encoder)
    assert run() == 1 and documents.read().count() == 1
    first = chunks.read().groupBy("sub_idx").count().collect()
    assert {r["sub_idx"] for r in first} == {0, 1, 2}
    assert run() == 0
    write(folder / "p" / "s2.jsonl", [say("user", "another one", "2025-01-16T10:30:00Z"), say("user", "and another", "2025-01-16T10:31:00Z")])
    assert run() == 2
    rows = documents.read().collect()
    assert sorted(r["rowid"] for r in rows) == [1, 2, 3] and chunks.read().select("hash").distinct().count() == 3


def test_closure_of_a_long_chain(spark):
    rows = [(f"/r/{i}.md", f"@{i + 1}.md") for i in range(24)] + [("/r/24.md", "@0.md"), ("/r/other.md", "")]
    found = markdown.closure(spark.createDataFrame(rows, "path string, raw string"), ["/r/0.md"]).collect()
    assert {r["path"] for r in found} == {f"/r/{i}.md" for i in range(25)}
