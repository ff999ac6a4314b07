"""Chat formatting by schema fingerprints (operator 3).

A record's layout is known by the hash of its nested field paths (``messages``,
``messages[].role`` ...), taken over the names that any mapping uses, so extra fields do
not disturb it.  The hash selects a declarative mapping, and the mapping turns the record
into canonical turns ``array<struct<role, text>>``.  Tables with one row per turn are
recognised the same way, by the paths of their schema.

A template marks turns; inside texts and roles a backslash is doubled and every control
string gets a backslash after its first character, so no control string is left in them
and reading back removes exactly one backslash from each pair.  The loss mask is a list of
runs ``(length, trained)`` over the code points of the formatted text.

Everything is DataFrame work.  Defined cases: NULL text and role count as empty; turns are
ordered by turn number (NULL first), then role, then text; a record whose layout no
mapping knows, or that is no JSON object, has NULL turns and layout; an empty list of
turns formats to an empty text; one conversation is one record and is kept whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

# Names of speakers in other layouts and the role they stand for.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


@dataclass(frozen=True)
class Listed:
    """Turns are a list: ``field[].role``, ``field[].text``."""

    name: str
    field: str
    role: str
    text: str

    def paths(self) -> tuple[str, ...]:
        return (self.field, f"{self.field}[].{self.role}", f"{self.field}[].{self.text}")


@dataclass(frozen=True)
class Fielded:
    """Turns are fields: each role with the fields whose texts, joined by a blank line, it says."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...]

    def paths(self) -> tuple[str, ...]:
        return tuple(f for _, fields in self.turns for f in fields)


@dataclass(frozen=True)
class Rows:
    """One row per turn."""

    name: str
    conversation: str
    turn: str
    role: str
    text: str

    def paths(self) -> tuple[str, ...]:
        return (self.conversation, self.turn, self.role, self.text)


MAPPINGS: tuple[Listed | Fielded, ...] = (
    Listed("messages", "messages", "role", "content"),
    Listed("messages_text", "messages", "role", "text"),
    Listed("conversations", "conversations", "from", "value"),
    Listed("dialogue", "dialogue", "speaker", "utterance"),
    Fielded("instruction", (("user", ("instruction",)), ("assistant", ("output",)))),
    Fielded("instruction_input", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Fielded("instruction_system", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Fielded("prompt_completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Fielded("prompt_response", (("user", ("prompt",)), ("assistant", ("response",)))),
    Fielded("question_answer", (("user", ("question",)), ("assistant", ("answer",)))),
)
ROW_MAPPINGS = (
    Rows("turn_rows", "conv_id", "turn", "role", "text"),
    Rows("message_rows", "conversation_id", "position", "from", "value"),
)


@dataclass(frozen=True)
class Template:
    """How turns are written; ``guards`` are the control strings kept out of texts."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    guards: tuple[str, ...] = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for guard in self.guards:
            out = F.replace(out, F.lit(guard), F.lit(f"{guard[0]}\\{guard[1:]}"))
        return out

    def head(self, role: Column) -> Column:
        return F.concat(F.lit(self.open), F.replace(self.escape(role), F.lit("\n"), F.lit("\\\n")), F.lit(self.after_role))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Nested field paths of a table."""
    out = []
    for f in schema.fields:
        kind, path = f.dataType, f"{prefix}{f.name}"
        out.append(path)
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, f"{path}[]"
        if isinstance(kind, T.StructType):
            out += schema_paths(kind, f"{path}.")
    return out


def _prefixed(prefix: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(prefix), n))


def _items(record: Column, field: str) -> Column:
    """The fields of every item of a list in a JSON record; NULL if it is no list."""
    return F.transform(F.from_json(F.get_json_object(record, f"$.{field}"), "array<string>"), lambda x: F.json_object_keys(x))


def record_fingerprint(record: Column, mappings=MAPPINGS) -> Column:
    """Hash of the known nested field paths of a JSON record, over all items of its lists."""
    known = sorted({p for m in mappings for p in m.paths()})
    nothing = F.array().cast("array<string>")
    paths = F.coalesce(F.json_object_keys(record), nothing)
    for field in sorted({m.field for m in mappings if isinstance(m, Listed)}):
        inner = F.array_distinct(F.flatten(F.filter(_items(record, field), lambda x: x.isNotNull())))
        paths = F.concat(paths, F.coalesce(_prefixed(f"{field}[].", inner), nothing))
    paths = F.array_intersect(paths, F.array(*map(F.lit, known)))
    return F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)


def _role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(role)), role, F.lit(""))


def _turns(record: Column, m: Listed | Fielded) -> Column:
    if isinstance(m, Listed):
        inner = T.ArrayType(T.StructType([T.StructField(m.role, T.StringType()), T.StructField(m.text, T.StringType())]))
        items = F.from_json(F.get_json_object(record, f"$.{m.field}"), inner)
        return F.transform(items, lambda x: F.struct(_role(x[m.role]).alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text")))
    said = []
    for role, fields in m.turns:
        parts = F.array(*[F.nullif(F.get_json_object(record, f"$.{f}"), F.lit("")) for f in fields])
        said.append(F.struct(F.lit(role).alias("role"), F.array_join(parts, "\n\n").alias("text")))
    return F.filter(F.array(*said), lambda t: (t["role"] != "system") | (t["text"] != ""))


def from_records(df: DataFrame, record: str, mappings=MAPPINGS) -> DataFrame:
    """``df`` with ``layout`` (name of the mapping) and ``turns``.

    Both are NULL where no mapping fits, also where an item of a list lacks a field of the
    mapping that fits the record as a whole: no turn is lost without notice.
    """
    by_hash = {fingerprint(m.paths()): m for m in mappings}
    mark, layout, turns = record_fingerprint(F.col(record), mappings), F.lit(None).cast("string"), F.lit(None)
    for h, m in by_hash.items():
        fits = F.col("_mark") == h
        if isinstance(m, Listed):
            own = F.array(F.lit(m.role), F.lit(m.text))
            fits &= F.coalesce(F.forall(_items(F.col(record), m.field), lambda x: F.size(F.array_intersect(x, own)) == 2), F.lit(False))
        layout = F.when(fits, m.name).otherwise(layout)
        turns = F.when(fits, _turns(F.col(record), m)).otherwise(turns)
    return df.withColumn("_mark", mark).withColumns({"layout": layout, "turns": turns}).drop("_mark")


def from_rows(df: DataFrame, mappings=ROW_MAPPINGS) -> DataFrame:
    """``conv_id, turns`` of a table with one row per turn, roles as given; other columns are not read."""
    there = schema_paths(df.schema)
    known = {fingerprint(m.paths()): m for m in mappings}
    names = {p for m in mappings for p in m.paths()}
    found = known.get(fingerprint([p for p in there if p in names]))
    if found is None:
        raise ValueError(f"no mapping for the field paths {sorted(there)}")
    turn = F.struct(F.col(found.turn).alias("turn"), F.coalesce(F.col(found.role), F.lit("")).alias("role"),
                    F.coalesce(F.col(found.text), F.lit("")).alias("text"))
    rows = df.select(F.col(found.conversation).alias("conv_id"), turn.alias("_t"))
    turns = F.transform(F.array_sort(F.collect_list("_t"), _by_turn), lambda t: F.struct(t["role"], t["text"]))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def _by_turn(a: Column, b: Column) -> Column:
    """Order of turns: number with NULL first, role, text."""
    def cmp(x: Column, y: Column, rest: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1).otherwise(rest)
    ties = cmp(a["role"], b["role"], cmp(a["text"], b["text"], F.lit(0)))
    nulls = cmp(a["turn"].isNotNull().cast("int"), b["turn"].isNotNull().cast("int"), ties)
    return F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(nulls)


def format_turns(df: DataFrame, template: Template = Template()) -> DataFrame:
    """``df`` with ``formatted`` and ``loss_mask`` (``array<struct<length, trained>>``)."""
    def run(text: Column, trained: Column) -> Column:
        return F.struct(F.char_length(text).cast("long").alias("length"), trained.alias("trained"), text.alias("text"))

    def parts(t: Column) -> Column:
        return F.array(run(template.head(t["role"]), F.lit(False)),
                       run(template.escape(t["text"]), t["role"].isin(*template.trained)),
                       run(F.lit(template.close), F.lit(False)))

    df = df.withColumn("_runs", F.flatten(F.transform("turns", parts)))
    return df.withColumns({
        "formatted": F.array_join(F.transform("_runs", lambda r: r["text"]), ""),
        "loss_mask": F.transform("_runs", lambda r: F.struct(r["length"], r["trained"]))}).drop("_runs")


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """Turns of a formatted text."""
    marked = F.filter(F.split(formatted, _quoted(template.close)), lambda x: x != "")
    head = "(?s)^" + _quoted(template.open) + r"((?:[^\\\n]|\\.)*)" + _quoted(template.after_role) + "(.*)$"
    return F.transform(marked, lambda x: F.struct(
        unescape(F.regexp_extract(x, head, 1)).alias("role"), unescape(F.regexp_extract(x, head, 2)).alias("text")))


def masked_text(formatted: Column, mask: Column, template: Template = Template()) -> Column:
    """What stands under the loss mask, unescaped.

    The text is cut at the ends of turns once, and the three runs of a turn are measured
    inside its own piece, so a long conversation is read in proportion to its length.
    """
    turns = F.filter(F.split(formatted, _quoted(template.close)), lambda x: x != "")
    text = lambda x, i: F.substr(x, F.get(mask, 3 * i)["length"].cast("int") + 1, F.get(mask, 3 * i + 1)["length"].cast("int"))
    said = F.transform(turns, lambda x, i: F.when(F.get(mask, 3 * i + 1)["trained"], unescape(text(x, i))).otherwise(F.lit("")))
    return F.array_join(said, "")


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\^$.|?*+()[]{}<>" and c not in "<>" else c for c in text)


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = format_turns(from_rows(rows))
    back = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
                       masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def _sql_escaped(col: str, template: Template = Template()) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for guard in template.guards:
        out = f"replace({out}, '{guard}', '{guard[0]}\\{guard[1:]}')"
    return out


SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(Template.open) + len(Template.after_role) + len(Template.close)} + length({_sql_escaped('role')}) + length({_sql_escaped('text')}))::BIGINT
    AS formatted_chars
FROM r GROUP BY conv_id
"""
