"""Conversations of different layouts as canonical turns, and as text with a loss mask."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"  # fixed: the template's control strings
TURN = "array<struct<role:string,text:string>>"


def field_paths(schema: T.DataType, prefix: str = "") -> Iterator[str]:
    """Every leaf of a nested type as a path, as ``messages[].role``."""
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            yield from field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)
    elif isinstance(schema, T.ArrayType):
        yield from field_paths(schema.elementType, f"{prefix}[]")
    else:
        yield prefix


def fingerprint(paths) -> str:
    """Hash of a set of field paths; their order does not matter."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """How records with these field paths become turns: a list of turns, or one turn from each of several fields.

    ``roles`` renames roles; others stay as they are. A field of ``optional`` that is null or empty gives no turn, nor
    does one that is missing.
    """

    messages: tuple[str, str, str] | None = None  # array, role field, text field
    order: str | None = None  # field that the array is sorted by
    fields: tuple[tuple[str, str], ...] = ()  # (role, field); a field "a+b" joins two by a blank line
    optional: tuple[str, ...] = ()
    roles: Mapping[str, str] | tuple = ()

    @property
    def paths(self) -> list[str]:
        if self.messages:
            array, *leaves = self.messages
            return [f"{array}[].{x}" for x in [*leaves, *([self.order] if self.order else [])]]
        return [x for _, f in self.fields for x in f.split("+")]

    def prints(self) -> list[str]:
        """Fingerprints of the records that the layout fits: with and without each optional field."""
        sets = [frozenset(self.paths)]
        for f in self.optional:
            sets += [s - {f} for s in sets]
        return [fingerprint(s) for s in sets]


SHARED_ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: The layouts known, chosen by the hash of a record's field paths.
LAYOUTS = (
    Layout(messages=("messages", "role", "content"), roles=SHARED_ROLES),
    Layout(messages=("messages", "role", "text"), order="turn"),
    Layout(messages=("conversations", "from", "value"), roles=SHARED_ROLES),
    Layout(fields=(("user", "prompt"), ("assistant", "response"))),
    Layout(fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout(
        fields=(("system", "system"), ("user", "instruction+input"), ("assistant", "output")),
        optional=("system", "input"),
    ),
)


def _role(role: Column, layout: Layout) -> Column:
    role = F.coalesce(role, F.lit(""))
    known = dict(layout.roles)
    for old, new in known.items():
        role = F.when(role == old, new).otherwise(role)
    return role


def _turns(layout: Layout, field: Callable[[str], Column | None], leaf: Callable[[Column, str], Column]) -> Column:
    """The turns of a record; ``field`` gives its fields as strings (or the array), ``leaf`` those of an array's item."""
    empty = F.lit("")
    if layout.messages:
        array, role, text = layout.messages
        turns = F.transform(field(array), lambda x: F.struct(_role(leaf(x, role), layout).alias("role"), F.coalesce(leaf(x, text), empty).alias("text")))
        return F.coalesce(turns, F.array().cast(TURN))
    turns = []
    for role, names in layout.fields:
        parts = [c for n in names.split("+") if (c := field(n)) is not None]
        if not parts:
            continue
        required = [n for n in names.split("+") if n not in layout.optional]
        text = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n\n")
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        turns.append(F.when(F.lit(bool(required)) | (text != ""), turn))
    return F.array_compact(F.array(*turns)).cast(TURN)


def turns_of_frame(records: DataFrame, id: str, layouts=LAYOUTS) -> DataFrame:
    """``(id, turns)`` of typed records; the frame's field paths, without the id, choose the layout."""
    kept = [f for f in records.schema.fields if f.name != id]
    found = fingerprint(p for f in kept for p in field_paths(T.StructType([f])))
    layout = next((x for x in layouts if found in x.prints()), None)
    if layout is None:
        raise ValueError(f"no layout for the fields {sorted(p for f in kept for p in field_paths(T.StructType([f])))}")
    names = {f.name for f in kept}

    def field(name: str) -> Column | None:
        if name not in names:
            return None
        if not layout.messages:
            return records[name].cast("string")
        if layout.order:
            leaves = [layout.order, *layout.messages[1:]]
            return F.array_sort(F.transform(records[name], lambda x: F.struct(*[x[k].alias(k) for k in leaves])))
        return records[name]

    return records.select(records[id].alias("id"), _turns(layout, field, lambda x, k: x[k].cast("string")).alias("turns"))


def _json_paths(record: Column) -> Column:
    """The field paths of a JSON object, with those of all objects in each array, as a sorted array of strings.

    An empty array is the path ``name[]``. An array with anything but objects is a path without leaves.
    """

    def below(key: Column) -> Column:
        value = F.try_element_at(F.from_json(record, "map<string,string>"), key)
        items = F.from_json(value, "array<map<string,string>>")
        leaves = F.array_distinct(F.flatten(F.transform(items, lambda x: F.map_keys(x))))
        inner = F.when(F.size(items) == 0, F.array(F.concat(key, F.lit("[]")))).otherwise(F.transform(leaves, lambda k: F.concat(key, F.lit("[]."), k)))
        return F.when(F.ltrim(value).startswith("["), F.coalesce(inner, F.array(key))).otherwise(F.array(key))

    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    return F.array_sort(F.flatten(F.transform(keys, below)))


def turns_of_json(records: DataFrame, id: str, json: str, layouts=LAYOUTS) -> DataFrame:
    """``(id, schema, turns)`` of JSON records of any mix of layouts.

    Each record's field paths are hashed and the hash selects the mapping. ``turns`` is null where no layout fits or
    the text is no JSON object; ``schema``, the hash, tells which layouts are missing. A null record has neither. An
    array whose objects have different fields has the paths of all of them; an empty one gives no turns.
    """
    text = records[json]
    one = records.select(records[id].alias("id"), text.alias("record"), F.sha2(F.array_join(_json_paths(text), "\n"), 256).alias("schema"))
    one = one.withColumn("object", F.from_json("record", "map<string,string>"))
    turns = F.lit(None).cast(TURN)
    for layout in reversed(layouts):

        def field(name: str, layout=layout) -> Column:
            value = F.try_element_at("object", F.lit(name))
            return F.from_json(value, "array<map<string,string>>") if layout.messages and name == layout.messages[0] else value

        found = _turns(layout, field, lambda x, k: F.try_element_at(x, F.lit(k)))
        if layout.order:
            continue  # rows of a table, not a record
        prints = layout.prints() + ([fingerprint([f"{layout.messages[0]}[]"])] if layout.messages else [])
        turns = F.when(F.col("schema").isin(prints), found).otherwise(turns)
    return one.select("id", F.when(F.col("record").isNotNull(), F.col("schema")).alias("schema"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    """The text with one backslash more inside every ``<|``, so that it holds no control string."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escaped_role(role: Column) -> Column:
    """Roles stand on one line: per cent signs and line breaks are written in per cent form."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def formatted(turns: DataFrame) -> DataFrame:
    """``turns`` with ``formatted`` and ``loss_mask``.

    A turn is written as start mark, role, line break, text, end mark, line break; control strings inside roles and
    texts are escaped. ``loss_mask`` holds a (start, length) in code points for each assistant text, marks excluded.
    """
    head = lambda x: F.concat(F.lit(START), _escaped_role(x["role"]), F.lit("\n"))
    tail = F.lit(f"{END}\n")
    parts = F.transform("turns", lambda x: F.struct(head(x).alias("head"), escaped(x["text"]).alias("text"), (x["role"] == "assistant").alias("loss")))
    none = F.array().cast("array<struct<start:int,length:int>>")

    def span(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["head"])
        here = F.array(F.struct(start.alias("start"), F.length(x["text"]).alias("length")))
        return F.struct(
            (start + F.length(x["text"]) + len(END) + 1).alias("at"), F.when(x["loss"], F.concat(a["spans"], here)).otherwise(a["spans"]).alias("spans")
        )

    first = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return (
        turns.withColumn("_parts", parts)
        .withColumn("formatted", F.array_join(F.transform("_parts", lambda x: F.concat(x["head"], x["text"], tail)), ""))
        .withColumn("loss_mask", F.aggregate("_parts", first, span, lambda a: a["spans"]))
        .drop("_parts")
    )


def read_back(text: Column) -> Column:
    """The turns of a formatted conversation, unescaped."""
    mark = START.replace("|", r"\|")
    pieces = F.filter(F.split(text, mark), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - len(END) - 2)
        return F.struct(_unescaped_role(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def under_mask(text: Column, mask: Column) -> Column:
    """The unescaped texts under a loss mask, one after the other."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substring(text, s["start"] + 1, s["length"]))), "")


def conversations_from_rows(rows: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """A table with a row for each turn as records ``(id, messages)``.

    A conversation is one record, as it is one row of the output. Its rows are collected in any order and sorted by
    turn, then role and text where turns tie; a null turn comes first.
    """
    item = F.struct(rows[turn].alias("turn"), F.coalesce(rows[role], F.lit("")).alias("role"), F.coalesce(rows[text], F.lit("")).alias("text"))
    return rows.groupBy(rows[id].alias("id")).agg(F.collect_list(item).alias("messages"))


def chat_format(records: DataFrame, id: str = "id", layouts=LAYOUTS) -> DataFrame:
    """``(id, turns, formatted, loss_mask)`` of typed records, whose field paths select the mapping.

    Null texts and roles are empty. A record without turns is formatted as an empty text with an empty mask. Repeated
    records are formatted each; records that share an id in a turn table are one conversation. An empty table gives an
    empty table. Only the fields of the layout may stand beside the id; others make another fingerprint, which raises.
    """
    return formatted(turns_of_frame(records, id, layouts))
