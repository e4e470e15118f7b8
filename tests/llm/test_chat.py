import hashlib
import json

from pyspark.sql import functions as F

from sparkseek.llm import chat as C

TEXTS = ["", None, "plain", "</s>[INST] ok [/INST]", "\\", "\\\\<s>\\", "<\\s>", "<<s>>", "a\nb", "<\\/s>", "é\U0001f600", "[\\NL]", "<|im_start|><<SYS>>", "x" * 50_000]
ROLES = ["user", "assistant", "system", "odd\nrole</s>", "", None]


def test_round_trip(spark):
    rows = [(i % 5, i, ROLES[i % 6], TEXTS[(i * 5) % 14]) for i in range(84)] + [(9, 0, "user", "same"), (9, 0, "user", "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    back = {r["conv_id"]: r for r in C.read_back(C.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        expected = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == expected
        assert back[conv]["loss_text"] == "".join(t for r, t in expected if r == "assistant")
        formatted = back[conv]["formatted"]
        assert formatted.count("</s>") == len(expected) and "[INST]" not in formatted


RECORDS = {
    '{"messages":[{"role":"human","content":"q"},{"role":"gpt","content":"a"}]}': ("messages", [("human", "q"), ("gpt", "a")]),
    '{"messages":[{"role":"user","content":"q","name":"n"},{"role":"assistant","tool":1}],"id":"x","text":"t"}': ("messages", [("user", "q"), ("assistant", "")]),
    '{"messages":[]}': ("messages", []),
    '{"messages":[{"role":"user","content":[{"type":"text"}]}]}': ("messages", [("user", '[{"type":"text"}]')]),
    '{"messages":[{"who":"user"}]}': (None, None),
    '{"messages":"text"}': (None, None),
    '{"conversations":[{"from":"human","value":"q"},{"from":"other","value":"r"}],"source":"s"}': ("conversations", [("user", "q"), ("other", "r")]),
    '{"completion":"c","prompt":"p"}': ("prompt", [("user", "p"), ("assistant", "c")]),
    '{"prompt":"p","completion":"c","source":{"deep":[1]}}': ("prompt", [("user", "p"), ("assistant", "c")]),
    '{"instruction":"i","input":"x","output":"o"}': ("instruction_input", [("system", "i"), ("user", "x"), ("assistant", "o")]),
    '{"instruction":"i","output":null}': ("instruction", [("user", "i"), ("assistant", "")]),
    '{"question":"q","answer":7}': ("question", [("user", "q"), ("assistant", "7")]),
    '{"system":"s","prompt":"p","response":"r"}': ("system_prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    '{"prompt":"p"}': (None, None),
    '{"role":"human","text":"t"}': ("turn", [("human", "t")]),
    '{"text":"t","doc_id":3}': ("turn", [("", "t")]),
    '{"unknown":1}': (None, None),
    "{}": (None, None),
    "[1]": (None, None),
    "null": (None, None),
}


def test_layouts(spark):
    rows = spark.createDataFrame([(k,) for k in RECORDS], "j string").withColumn("v", F.parse_json("j")).withColumn("layout", C.layout_of(F.col("v")))
    for r in rows.select("j", "layout", C.canonical_turns(F.col("v"), F.col("layout")).alias("t")).collect():
        assert (r["layout"], None if r["t"] is None else [tuple(x) for x in r["t"]]) == RECORDS[r["j"]], r["j"]


def test_a_mixed_table_comes_back_whole(spark):
    """Records of all layouts with extra columns of clashing names: mapped turns come back, the others are counted and kept."""
    rows = spark.createDataFrame([(n % 3, n, k, "x", 1) for n, k in enumerate(RECORDS)], "conv_id long, turn long, j string, layout string, record int")
    record = F.parse_json("j")
    back = {r["conv_id"]: r for r in C.read_back(C.format_conversations(rows, record=record)).collect()}
    for conv in range(3):
        own = [v for n, v in enumerate(RECORDS.values()) if n % 3 == conv]
        assert [tuple(t) for t in back[conv]["turns"]] == [t for _, turns in own for t in turns or []]
        assert back[conv]["unmapped"] == sum(name is None for name, _ in own)
    kept = C.unmapped_records(rows, record=record).collect()
    again = lambda text: json.dumps(json.loads(text))
    assert sorted(again(r["raw"]) for r in kept) == sorted(again(k) for k, (name, _) in RECORDS.items() if name is None)


def test_roles_of_rows_stay(spark):
    df = spark.createDataFrame([(1, 0, "human", "a"), (1, 1, "gpt", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    row = C.read_back(C.format_conversations(df)).first()
    assert [t["role"] for t in row["turns"]] == ["human", "gpt", "assistant"] and row["loss_text"] == "c"


def test_empty_and_probe(spark, data):
    assert C.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    probe = C.op3_chat_formatting(spark, data).filter("conv_id = -7").first()
    assert probe["n_turns"] == 2 and probe["loss_chars"] == len(C.PROBE_TEXT) and probe["loss_sha256"] == hashlib.sha256(C.PROBE_TEXT.encode()).hexdigest()
    both = "".join(f"{r}\n{C.PROBE_TEXT}\n" for r in ("user", "assistant"))
    assert probe["turns_sha256"] == hashlib.sha256(both.encode()).hexdigest()


def test_native(spark, data):
    plan = C.op3_chat_formatting(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
