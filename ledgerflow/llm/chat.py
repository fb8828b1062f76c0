r"""Chat formatting by schema fingerprint (operator 9), in DataFrame functions only.

Records arrive as JSON in different layouts: a list of messages, an instruction with
input and output, a prompt with its completion. ``fingerprint`` hashes the sorted
nested field paths of a record; the hash selects one declarative mapping
(``MAPPINGS``) that says where the turns lie, and ``canonical_turns`` reads them with
it. A new layout is a new row of the registry, not new code.

``format_turns`` writes the canonical turns with the template

    <|turn|>ROLE<|text|>TEXT<|end|>

Control strings (``CONTROLS``) inside roles and texts are broken by a backslash after
their first character and a backslash is doubled, so the template's own marks are the
only ones in the output and ``unescape`` gives the text back exactly. The loss mask is
a list of (start, length) spans of code points: the texts of assistant turns.

Defined cases: null role or text counts as empty; equal turn numbers are ordered by
role, then text; repeated rows stay repeated turns; a record of no known layout keeps
its row with null turns; an empty table gives an empty result; other columns are not read.
One conversation is one record: its turns meet in one row because the result is one text.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.arrays import cut_out, let, scan, shifted

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# The template's marks and the control strings of common chat templates.
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
            "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<pad>", "<unk>", "[PAD]")
_CONTROL = "|".join(rf"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)
TURNS_TYPE = "array<struct<role:string,text:string>>"

# Names that other layouts use for the canonical roles.
ROLE_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

# Declarative mappings, each with the shape of its layout. ``list`` layouts read a field holding a list of
# messages with the names of their role and text; ``fields`` layouts read (role, fields) in order, the
# texts of several fields joined by a blank line, empty ones left out. ``roles`` renames a layout's own roles; without
# it they stay as they are.
MAPPINGS = (
    {"name": "messages", "list": ("messages", "role", "content")},
    {"name": "turns", "list": ("turns", "role", "text")},
    {"name": "conversations", "list": ("conversations", "from", "value"), "roles": ROLE_NAMES},
    {"name": "instruction", "fields": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    {"name": "instruction_bare", "fields": (("user", ("instruction",)), ("assistant", ("output",)))},
    {"name": "prompt_completion", "fields": (("user", ("prompt",)), ("assistant", ("completion",)))},
    {"name": "prompt_response", "fields": (("user", ("prompt",)), ("assistant", ("response",)))},
    {"name": "system_prompt_response",
     "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    {"name": "question_answer", "fields": (("user", ("question",)), ("assistant", ("answer",)))},
)



def field_paths(record: Column) -> Column:
    """The nested field paths of a JSON record as one text, e.g. ``OBJECT<turns: ARRAY<OBJECT<role: *, text: *>>>``:
    names in order at every level, the fields of a list's items merged, values of any kind as ``*``.
    Null for text that is not JSON."""
    shape = F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), "ARRAY<VOID>", "ARRAY<>")
    return F.regexp_replace(shape, r"(?<=: )(?!OBJECT<|ARRAY<)[A-Z]\w*(\([0-9, ]*\))?(?=[,>])", "*")


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths."""
    return F.sha2(field_paths(record), 256)


def shapes(mapping: dict) -> list[str]:
    """The field paths that a mapping reads, as ``field_paths`` writes them; an empty list is a second shape."""
    if "list" in mapping:
        path, *names = mapping["list"]
        return [f"OBJECT<{path}: ARRAY<OBJECT<{', '.join(f'{n}: *' for n in sorted(names))}>>>", f"OBJECT<{path}: ARRAY<>>"]
    return ["OBJECT<" + ", ".join(f"{n}: *" for n in sorted(f for _, fs in mapping["fields"] for f in fs)) + ">"]


def canonical_turns(record: Column, print_: Column) -> Column:
    """Turns as array<struct<role,text>>, read by the mapping whose fingerprint ``print_`` is; null for none."""
    out = F.lit(None).cast(TURNS_TYPE)
    for m in MAPPINGS:
        if "list" in m:
            path, role, text = m["list"]
            rows = F.from_json(record, f"struct<{path}:array<struct<`{role}`:string,`{text}`:string>>>")[path]
            turns = _renamed(rows, role, text, m.get("roles", ()))
        else:
            names = [p for _, paths in m["fields"] for p in paths]
            row = F.from_json(record, "struct<" + ",".join(f"`{n}`:string" for n in names) + ">")
            turns = F.array(*(F.struct(F.lit(role).alias("role"), F.array_join(
                F.filter(F.array(*(F.coalesce(row[p], F.lit("")) for p in paths)), lambda t: t != ""), "\n\n").alias("text"))
                for role, paths in m["fields"]))
        keys = [hashlib.sha256(shape.encode()).hexdigest() for shape in shapes(m)]
        out = F.when(print_.isin(keys), turns).otherwise(out)
    return out


def _renamed(rows: Column, role: str, text: str, names: tuple[tuple[str, str], ...]) -> Column:
    def canonical(own: Column) -> Column:
        out = F.coalesce(own, F.lit(""))
        for other, name in names:
            out = F.when(own == other, F.lit(name)).otherwise(out)
        return out

    return F.transform(rows, lambda r: F.struct(
        canonical(r[role]).alias("role"), F.coalesce(r[text], F.lit("")).alias("text")))


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"({_CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def records_from_rows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                      text: str = "text") -> DataFrame:
    """One JSON record per conversation, in the ``turns`` layout, from a table with one row per turn."""
    own = rows.select(F.col(conv_id).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")),
                        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return own.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.to_json(F.struct("turns")).alias("record"))


def format_turns(turns: Column) -> Column:
    """The turns in the template; null turns give null."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """(start, length) in code points, 0-based, of every assistant text inside the formatted text."""
    marks = len(TURN) + len(TEXT) + len(END)
    sizes = F.transform(turns, lambda t: F.struct(
        (t["role"] == "assistant").alias("learned"), F.length(escape(t["text"])).alias("size"),
        (F.length(escape(t["role"])) + F.length(escape(t["text"])) + marks).alias("all")))

    def placed(s: Column) -> Column:
        spans = F.zip_with(s, scan(F.transform(s, lambda x: x["all"]), lambda a, b: a + b), lambda x, end: F.when(x["learned"], F.struct(
            (end - len(END) - x["size"]).cast("long").alias("start"), x["size"].cast("long").alias("length"))))
        return F.filter(spans, lambda x: x.isNotNull())

    return F.when(turns.isNotNull(), let(sizes, placed))


def format_chats(records: DataFrame, record_col: str = "record", keep: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """``keep`` columns, ``layout`` (fingerprint), ``formatted`` and ``loss`` spans, one row per record."""
    found = records.select(*keep, F.col(record_col).alias("_record"), fingerprint(F.col(record_col)).alias("layout"))
    turns = found.select(*keep, "layout", canonical_turns(F.col("_record"), F.col("layout")).alias("_turns"))
    return turns.select(*keep, "layout", format_turns(F.col("_turns")).alias("formatted"),
                        loss_spans(F.col("_turns")).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Turns read back from a formatted text."""
    pieces = F.filter(F.split(formatted, re.escape(TURN)), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    items = F.zip_with(loss, shifted(F.transform(loss, lambda s: s["start"] + s["length"]), 1, F.lit(0).cast("long")), lambda s, before: F.concat(
        (s["start"] - before).cast("string"), F.lit(":"), s["length"].cast("string")))
    return F.array_join(F.transform(cut_out(formatted, items), unescape), "")
