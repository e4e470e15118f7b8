"""Chat records of many layouts as canonical turns, and a reversible training format with a loss mask.

Schema fingerprinting: of the nested field paths of a record those that a layout knows are written out and hashed; the
fingerprint selects a declarative mapping - the paths of the turns, roles and texts - registered under the fingerprints
of the sets of paths that the layout takes. Other fields don't matter. Records of one table may have any mix of
layouts; records that no layout takes have no layout, are counted beside what is formatted, and stay as they are in a
table of their own. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed strings of the format: each turn is OPEN role NEWLINE text CLOSE.
OPEN, CLOSE, NEWLINE = "<s>", "</s>", "\n"
#: Strings that mean control in this and in common other formats; inside roles and texts they are escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"
#: A conversation of two turns that say control strings.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"
TURN_TYPE = "array<struct<role:string,text:string>>"


#: Other names of the roles in layouts that have a speaker instead of a role.
SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


@dataclass(frozen=True)
class Layout:
    """How records with certain field paths become turns.

    turns: path of an array of messages, with role and text paths inside a message; without it, `fixed` lists
    (role, path) pairs of the record itself, where a role starting with "$" is a path too. partial: some of the paths
    are enough. roles: other names of roles, as (name, role).
    """

    name: str
    turns: str | None = None
    role: str = "$.role"
    text: str = "$.content"
    fixed: tuple[tuple[str, str], ...] = ()
    partial: bool = False
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        """The field paths that the mapping reads; [] stands for an array, [*] for any message in it."""
        if self.turns:
            return (f"{self.turns}[]", f"{self.turns}[*]", f"{self.turns}[*]{self.role[1:]}", f"{self.turns}[*]{self.text[1:]}")
        return tuple(p for pair in self.fixed for p in pair if p.startswith("$"))

    @property
    def takes(self) -> list[tuple[str, ...]]:
        """The sets of paths that select this mapping: all; of an array also none in it; of partial layouts any."""
        if self.turns:
            return [self.paths, self.paths[:1]]
        return [c for n in range(len(self.paths), 0, -1) for c in combinations(self.paths, n)] if self.partial else [self.paths]


#: In the order in which they are tried: arrays of messages, then more fields before fewer.
LAYOUTS = (
    Layout("messages", turns="$.messages"),
    Layout("conversations", turns="$.conversations", role="$.from", text="$.value", roles=SPEAKERS),
    Layout("system_prompt", fixed=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("instruction_input", fixed=(("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Layout("prompt", fixed=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("prompt_response", fixed=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("question", fixed=(("user", "$.question"), ("assistant", "$.answer"))),
    Layout("instruction", fixed=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("turn", fixed=(("$.role", "$.text"),), partial=True),
)


def _messages(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "array<variant>")


def _there(record: Column, path: str) -> Column:
    """Whether a record has a path, null values included; a path in an array is there if any message has it."""
    if path.endswith("[]"):
        return _messages(record, path[:-2]).isNotNull()
    array, any_message, rest = path.partition("[*]")
    if not any_message:
        return F.try_variant_get(record, path, "variant").isNotNull()
    return F.coalesce(F.exists(_messages(record, array), lambda m: F.try_variant_get(m, f"${rest}", "variant").isNotNull()), F.lit(False))


def fingerprint(record: Column, layout: Layout) -> Column:
    """The hash of those of the layout's field paths that the record has."""
    return F.xxhash64(F.concat_ws("\n", *[F.when(_there(record, p), F.lit(p)) for p in layout.paths]))


def layout_of(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The name of the first layout that knows the record's fingerprint; null if none does."""
    names = []
    for layout in layouts:
        known = [F.xxhash64(F.lit("\n".join(paths))) for paths in layout.takes]
        names.append(F.when(fingerprint(record, layout).isin(*known), F.lit(layout.name)))
    return F.coalesce(*names)


def _string(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))


def _turns(layout: Layout, record: Column) -> Column:
    def role(value: Column) -> Column:
        if not layout.roles:
            return value
        return F.coalesce(F.create_map(*[F.lit(x) for kv in layout.roles for x in kv])[value], value)

    if layout.turns:
        return F.transform(_messages(record, layout.turns), lambda m: F.struct(role(_string(m, layout.role)).alias("role"), _string(m, layout.text).alias("text")))
    return F.array(*[F.struct(role(_string(record, r) if r.startswith("$") else F.lit(r)).alias("role"), _string(record, t).alias("text")) for r, t in layout.fixed])


def canonical_turns(record: Column, layout: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """array<struct<role, text>> of a variant record by the mapping of its layout; null without a layout.

    Null and absent texts and roles are empty; a text that isn't a string is its JSON. Roles are renamed only where
    the layout says so.
    """
    out = F.lit(None).cast(TURN_TYPE)
    for one in reversed(layouts):
        out = F.when(layout == one.name, _turns(one, record).cast(TURN_TYPE)).otherwise(out)
    return out


def escape(text: Column) -> Column:
    """Doubles the escape sign, then puts one after the first sign of every control string."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for word in CONTROL:
        out = F.replace(out, F.lit(word), F.lit(word[0] + ESCAPE + word[1:]))
    return out


def unescape(text: Column) -> Column:
    """The inverse of escape: a single escape sign follows a first sign only where escape put it."""
    out = text
    for word in CONTROL:
        out = F.replace(out, F.lit(word[0] + ESCAPE + word[1:]), F.lit(word))
    return F.replace(out, F.lit(ESCAPE * 2), F.lit(ESCAPE))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(NEWLINE), F.lit("[\\NL]"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("[\\NL]"), F.lit(NEWLINE)))


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), _escape_role(role), F.lit(NEWLINE), escape(text), F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            _unescape_role(F.substring(F.substring_index(p, NEWLINE, 1), len(OPEN) + 1, 1 << 30)).alias("role"),
            unescape(F.substr(p, F.instr(p, NEWLINE) + 1)).alias("text"),
        ),
    )


def _records(rows: DataFrame, conv: str, turn: str, record: Column | None) -> DataFrame:
    """(conv_id, turn, record, layout)."""
    if record is None:
        record = F.to_variant_object(F.struct(rows["role"].cast("string").alias("role"), rows["text"].cast("string").alias("text")))
    found = rows.select(rows[conv].cast("long").alias("conv_id"), rows[turn].cast("long").alias("turn"), record.alias("record"))
    return found.withColumn("layout", layout_of(F.col("record")))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", record: Column | None = None) -> DataFrame:
    """(conv_id, formatted, unmapped): rows (conv_id, turn, role, text) or records of other layouts, as one string a conversation.

    Each row is mapped, escaped and formatted by itself before the shuffle; a conversation's formatted turns are then
    put in the order of turn (null first), ties by their own text. Repeated rows stay. unmapped counts the records of a
    conversation that have no layout (a null record too): they add nothing to formatted, and `unmapped_records` gives
    them. A conversation is one value of the result, so its turns do meet in one task.
    """
    each = _records(rows, conv, turn, record).select(
        "conv_id", "turn", "layout", F.array_join(F.transform(canonical_turns(F.col("record"), F.col("layout")), lambda t: format_turn(t["role"], t["text"])), "").alias("piece")
    )
    pieces = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), F.coalesce("piece", F.lit("")).alias("piece"))))
    return each.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("formatted"), F.count_if(F.col("layout").isNull()).alias("unmapped"))


def unmapped_records(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", record: Column | None = None) -> DataFrame:
    """(conv_id, turn, raw): the records that no layout takes, as JSON."""
    return _records(rows, conv, turn, record).filter("layout is null").select("conv_id", "turn", F.to_json("record").alias("raw"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text): parsed turns, and what the loss mask selects, every assistant text once."""
    parsed = formatted.withColumn("turns", parse(F.col("formatted")))
    spoken = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"])
    return parsed.withColumn("loss_text", F.array_join(spoken, ""))


def _with_probe(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    own = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), rows["role"].cast("string").alias("role"), rows["text"].cast("string").alias("text"))
    return own.unionAll(probe)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation and the probe, read back from the formatted strings."""
    back = read_back(format_conversations(_with_probe(table(spark, sf_dir, "conversations"))))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for word in CONTROL:
        out = f"replace({out}, '{word}', '{word[0]}\\{word[1:]}')"
    return out


OP3_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}'
  UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'),
f AS (SELECT *, '{OPEN}' || {_escaped_sql("role")} || chr(10) || {_escaped_sql("text")} || '{CLOSE}' AS piece FROM r),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, piece) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, piece), '') AS loss,
    sum(length(piece)) AS formatted_chars
  FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
