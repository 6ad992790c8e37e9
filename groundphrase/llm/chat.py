"""Chat formatting with schema fingerprints; DataFrame functions only.

A layout is known by its nested field paths: sorted, joined and hashed they are a fingerprint that selects a
declarative mapping to canonical turns (conv_id, turn, role, text). For tables the paths are those of the schema; for
mixed JSON records they are those of each record's variant schema.

Template. A turn is "[INST] role\\ntext [/INST]\\n", or "<s> role\\ntext </s>\\n" for the assistant. Within texts a
control string gets one more backslash before it, on top of any that stand there, so none is left bare, and taking one
away gives the text back. Roles are URL-encoded. The loss mask is a list of (start, length) in code points that covers
the assistant's escaped texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"
ASSISTANT = "assistant"
_TURN = r"(?s)(?:\[INST\]|<s>) ([^\n]*)\n(.*?) (?:\[/INST\]|</s>)\n"


def nested_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Field paths of a schema; an array adds [] to its path."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in nested_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return nested_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(p.lower() for p in paths)).encode()).hexdigest()


def _rows(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", "role", "text")


def _messages(field: str, role: str, text: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select("conv_id", F.posexplode(field).alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("long"), F.col(f"m.{role}").alias("role"), F.col(f"m.{text}").alias("text")
    )


def _fields(*turns: tuple[str, Callable[[], Column]]) -> Callable[[DataFrame], DataFrame]:
    def make(df: DataFrame) -> DataFrame:
        cells = [F.struct(F.lit(role).alias("role"), text().alias("text")) for role, text in turns]
        return _messages("m", "role", "text")(df.select("conv_id", F.array(*cells).alias("m")))

    return make


def _with_input() -> Column:
    return F.concat_ws("\n", "instruction", F.when(F.col("input") != "", F.col("input")))


#: Nested field paths of a layout, and how it becomes turns.
LAYOUTS: list[tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]] = [
    (("conv_id", "turn", "role", "text"), _rows),
    (("conv_id", "messages[].role", "messages[].content"), _messages("messages", "role", "content")),
    (("conv_id", "conversations[].from", "conversations[].value"), _messages("conversations", "from", "value")),
    (("conv_id", "instruction", "input", "output"), _fields(("user", _with_input), (ASSISTANT, lambda: F.col("output")))),
    (("conv_id", "instruction", "output"), _fields(("user", lambda: F.col("instruction")), (ASSISTANT, lambda: F.col("output")))),
    (("conv_id", "prompt", "completion"), _fields(("user", lambda: F.col("prompt")), (ASSISTANT, lambda: F.col("completion")))),
    (("conv_id", "prompt", "response"), _fields(("user", lambda: F.col("prompt")), (ASSISTANT, lambda: F.col("response")))),
    (("conv_id", "question", "answer"), _fields(("user", lambda: F.col("question")), (ASSISTANT, lambda: F.col("answer")))),
]
MAPPINGS = {fingerprint(paths): make for paths, make in LAYOUTS}
#: Other names of roles.
ROLES = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
_KNOWN = {p.lower() for paths, _ in LAYOUTS for p in paths}


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table in any known layout; columns that no layout knows are passed over.

    Where the known fields are more than those of one layout, the first layout that they cover counts; where they cover
    none, the table is refused before anything runs. Null texts and roles become empty.
    """
    if id_col != "conv_id":
        df = df.drop("conv_id").withColumnRenamed(id_col, "conv_id")
    paths = {p.lower() for p in nested_paths(df.schema)} & _KNOWN
    covered = [fingerprint(layout) for layout, _ in LAYOUTS if paths.issuperset(layout)]
    make = MAPPINGS.get(fingerprint(paths)) or (MAPPINGS[covered[0]] if covered else None)
    if make is None:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    role = F.coalesce("role", F.lit(""))
    for old, new in ROLES.items():
        role = F.when(role == old, new).otherwise(role)
    return make(df).select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def turns_from_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, layout, turn, role, text) of mixed JSON records, each by its own fingerprint.

    The fingerprint hashes the record's variant schema without scalar types. Records of an unknown layout, and text that
    is no JSON, give one row with null layout, turn, role and text: none is lost.
    """
    v = df.select(F.col(id_col).alias("conv_id"), F.try_parse_json(F.col(json_col)).alias("v"))
    shape = F.regexp_replace(F.schema_of_variant("v"), r": (STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DECIMAL\(\d+,\d+\)|VARIANT)", ":")
    v = v.withColumn("print", F.sha2(shape, 256))

    def listed(field: str, role: str, text: str) -> Column:
        kind = f"array<struct<`{role}`:string,`{text}`:string>>"
        cell = lambda m: F.struct(m[role].alias("role"), m[text].alias("text"))
        return F.transform(F.try_variant_get("v", f"$.{field}", kind), cell)

    def single(*turns: tuple[str, str]) -> Column:
        get = lambda f: F.try_variant_get("v", f"$.{f}", "string")
        return F.array(*[F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *[F.when(get(f) != "", get(f)) for f in fields.split("+")]).alias("text")) for role, fields in turns])

    of_list = lambda f, a, b: f"OBJECT<{f}: ARRAY<OBJECT<{', '.join(f'{x}:' for x in sorted((a, b)))}>>>"
    of_fields = lambda *f: f"OBJECT<{', '.join(f'{x}:' for x in sorted(f))}>"
    layouts = {
        "messages": (of_list("messages", "role", "content"), listed("messages", "role", "content")),
        "conversations": (of_list("conversations", "from", "value"), listed("conversations", "from", "value")),
        "instruction_input": (of_fields("instruction", "input", "output"), single(("user", "instruction+input"), (ASSISTANT, "output"))),
        "instruction": (of_fields("instruction", "output"), single(("user", "instruction"), (ASSISTANT, "output"))),
        "completion": (of_fields("prompt", "completion"), single(("user", "prompt"), (ASSISTANT, "completion"))),
        "response": (of_fields("prompt", "response"), single(("user", "prompt"), (ASSISTANT, "response"))),
        "question": (of_fields("question", "answer"), single(("user", "question"), (ASSISTANT, "answer"))),
    }
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, (form, made) in layouts.items():
        here = F.col("print") == F.sha2(F.lit(form), 256)
        layout, turns = F.when(here, name).otherwise(layout), F.when(here, made).otherwise(turns)
    out = v.select("conv_id", layout.alias("layout"), turns.alias("turns")).select(
        "conv_id", "layout", F.posexplode_outer("turns").alias("turn", "t")
    )
    role = F.col("t.role")
    for old, new in ROLES.items():
        role = F.when(role == old, new).otherwise(role)
    return out.select("conv_id", "layout", F.col("turn").cast("long"), role.alias("role"), F.col("t.text").alias("text"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({CONTROL})", "$1$2")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of canonical turns; one row per conversation.

    Turns are ordered by turn, then role and text (ties), null first. Offsets are running sums, so the work is linear
    in a conversation's turns; one shuffle by conv_id serves the window and the grouping. A null conv_id is one
    conversation. No turns, no row.
    """
    learn = F.col("role") == ASSISTANT
    head = F.concat(F.when(learn, "<s> ").otherwise("[INST] "), F.url_encode("role"), F.lit("\n"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pieces = (
        turns.select("conv_id", "turn", "role", "text", learn.alias("learn"), head.alias("head"), escaped(F.col("text")).alias("body"))
        .withColumn("piece", F.concat("head", "body", F.when(F.col("learn"), " </s>\n").otherwise(" [/INST]\n")))
        .withColumn("n", F.row_number().over(order))
        .withColumn("end", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("end") - F.length("piece") + F.length("head"))
    )
    span = F.when(F.col("learn"), F.struct("start", F.length("body").cast("long").alias("length")))
    return (
        pieces.groupBy("conv_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("n", "piece"))).alias("p"),
            F.sort_array(F.collect_list(span)).alias("loss_spans"),
        )
        .select("conv_id", F.concat_ws("", F.col("p.piece")).alias("formatted"), "loss_spans")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>, as they were before escaping."""
    roles, texts = (F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(i)) for i in (1, 2))
    return F.zip_with(
        roles, texts, lambda r, t: F.struct(F.url_decode(r).alias("role"), unescaped(t).alias("text"))
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, in order."""
    return F.concat_ws(
        "", F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    )
