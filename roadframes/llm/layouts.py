"""Schema fingerprints that select declarative mappings from records to canonical turns.

A record's shape is the set of its nested field paths that hold a value, written as nested names in order
(``OBJECT<messages: ARRAY<OBJECT<content, role>>>``); types of single values do not count, and
fields that are null count as absent. Its SHA-256 is the fingerprint. A layout declares its paths (some of
them optional) and steps that make turns from them; every combination of optional paths
has its fingerprint in the table that is looked up. Records are JSON texts, whose shape Spark works out
row by row, or structs, whose nested names are known from the schema and whose null fields are told
row by row, so one table may hold many layouts side by side.

Steps (``Step``): ``one`` turn of a given role from one or more paths joined by a blank line;
``each`` element of an array of objects with a role and a text; ``pairs`` of user and assistant
texts; ``alternate`` texts, the user's first. Roles are renamed as the layout says.

Records of no known layout, and texts that are no JSON, have a null layout and no turns; they
stay in the result. Null roles and texts in a turn are empty; a text that is no string is its JSON.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURNS = "array<struct<role string, text string>>"


@dataclass(frozen=True)
class Step:
    """How to make turns: ``kind`` is one, each, pairs or alternate."""

    kind: str
    paths: tuple[str, ...]
    role: str = ""  # the turn's role (one) or the name of the role's field (each)
    text: str = ""  # the name of the text's field (each), or path of the parts' text below it


@dataclass(frozen=True)
class Layout:
    """Paths like ``messages[].role``; ``optional`` ones may be absent."""

    name: str
    paths: tuple[str, ...]
    steps: tuple[Step, ...]
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
LAYOUTS = (
    Layout("turn_row", ("conv_id", "turn", "role", "text"), (Step("each", (), "role", "text"),), ("conv_id", "turn", "role", "text")),
    Layout("prompt_completion", ("prompt", "completion"),
           (Step("one", ("system",), "system"), Step("one", ("prompt",), "user"), Step("one", ("completion",), "assistant")), ("system",)),
    Layout("prompt_response", ("prompt", "response"),
           (Step("one", ("system",), "system"), Step("one", ("prompt",), "user"), Step("one", ("response",), "assistant")), ("system",)),
    Layout("question_answer", ("question", "answer"),
           (Step("one", ("context", "question"), "user"), Step("one", ("answer",), "assistant")), ("context",)),
    Layout("instruction", ("instruction", "output"),
           (Step("one", ("system",), "system"), Step("pairs", ("history",)), Step("one", ("instruction", "input"), "user"),
            Step("one", ("output",), "assistant")), ("system", "input", "history[][]")),
    Layout("messages", ("messages[].role", "messages[].content"),
           (Step("each", ("messages",), "role", "content"),), ("id", "messages[].content")),
    Layout("message_parts", ("messages[].role", "messages[].content[].type", "messages[].content[].text"),
           (Step("each", ("messages",), "role", "content[].text"),), ("id",)),
    Layout("speakers", ("conversations[].from", "conversations[].value"),
           (Step("one", ("system",), "system"), Step("each", ("conversations",), "from", "value")), ("id", "system"), SPEAKERS),
    Layout("dialog", ("dialog[]",), (Step("alternate", ("dialog",)),)),
)


def shape_of(paths: list[str] | tuple[str, ...]) -> str:
    """The nested form of some paths."""
    inside: dict[str, list[str]] = {}
    for path in paths:
        name, dot, rest = path.partition(".")
        inside.setdefault(name, [])
        if dot:
            inside[name].append(rest)
    parts = []
    for name, rest in inside.items():
        depth = name.count("[]")
        inner = shape_of(rest) if rest else ""
        if depth:
            inner = "ARRAY<" * depth + inner + ">" * depth
        parts.append((name.replace("[]", ""), inner))
    return "OBJECT<" + ", ".join(f"{n}: {inner}" if inner else n for n, inner in sorted(parts)) + ">"


def fingerprint_of(paths: list[str] | tuple[str, ...]) -> str:
    return hashlib.sha256(shape_of(paths).encode()).hexdigest()


def fingerprints(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, str]:
    """Layout names by fingerprint; two layouts that claim one shape are an error."""
    out: dict[str, str] = {}
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for extra in combinations(layout.optional, n):
                paths = [p for p in layout.paths if p not in layout.optional] + list(extra)
                if out.setdefault(fingerprint_of(paths), layout.name) != layout.name:
                    raise ValueError(f"{layout.name} and {out[fingerprint_of(paths)]} claim one shape: {paths}")
    return out


VALUE = r"(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VARIANT|BINARY|DATE|TIMESTAMP(?:_NTZ)?|DECIMAL\(\d+, ?\d+\))"


def json_shape(variant: Column) -> Column:
    """The shape of a parsed record: value types taken off, null fields taken out."""
    out = F.schema_of_variant(variant)
    out = F.regexp_replace(out, f": {VALUE}(?=[,>])", "")
    out = F.regexp_replace(out, f"<(?:{VALUE}|VOID)>", "<>")
    out = F.regexp_replace(out, r"(?:`(?:[^`]|``)*`|\w+): VOID(?:, |(?=>))", "")
    return F.regexp_replace(out, ", >", ">")


def type_shape(kind: DataType) -> str:
    """The shape of values of a type, empty for single values."""
    if isinstance(kind, StructType):
        parts = [(f.name, type_shape(f.dataType)) for f in kind.fields]
        return "OBJECT<" + ", ".join(f"{n}: {inner}" if inner else n for n, inner in sorted(parts)) + ">"
    if isinstance(kind, ArrayType):
        return f"ARRAY<{type_shape(kind.elementType)}>"
    return ""


def struct_shape(record: Column, kind: StructType) -> Column:
    """The shape of a struct's fields that are not null in this row."""
    names = sorted((f.name, type_shape(f.dataType)) for f in kind.fields)
    parts = [F.when(record.getField(n).isNotNull(), F.lit(f"{n}: {inner}" if inner else n)) for n, inner in names]
    return F.concat(F.lit("OBJECT<"), F.concat_ws(", ", *parts), F.lit(">"))


def _json_get(variant: Column) -> Callable[[str, str], Column]:
    return lambda path, kind: F.try_variant_get(variant, f"$.{path}" if path else "$", kind)


def _struct_get(record: Column, kind: StructType) -> Callable[[str, str], Column]:
    def get(path: str, wanted: str) -> Column:
        if not path:
            return _picked(record, kind, StructType.fromDDL(wanted.removeprefix("struct<").removesuffix(">")))
        if path not in kind.names:
            return F.lit(None).cast(wanted)
        return _picked(record.getField(path), kind[path].dataType, StructType.fromDDL(f"x {wanted}")["x"].dataType)

    return get


def _picked(value: Column, kind: DataType, wanted: DataType) -> Column:
    """A value with the wanted fields alone, by name."""
    if isinstance(wanted, StructType) and isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(
            (_picked(value.getField(f.name), kind[f.name].dataType, f.dataType) if f.name in kind.names else F.lit(None).cast(f.dataType))
            .alias(f.name) for f in wanted.fields)))
    if isinstance(wanted, ArrayType) and isinstance(kind, ArrayType):
        return F.transform(value, lambda v: _picked(v, kind.elementType, wanted.elementType))
    if isinstance(wanted, (StructType, ArrayType)):
        return F.lit(None).cast(wanted)
    return F.to_json(value) if isinstance(kind, (StructType, ArrayType)) else value.cast(wanted)


def _turn(role: Column, text: Column, roles: dict[str, str]) -> Column:
    if roles:
        names = F.create_map(*(F.lit(x) for pair in roles.items() for x in pair))
        role = F.coalesce(names[role], role)
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _step(step: Step, get: Callable[[str, str], Column], roles: dict[str, str]) -> Column:
    if step.kind == "one":
        texts = [get(p, "string") for p in step.paths]
        some = F.filter(F.array(*texts), lambda t: t.isNotNull() & (t != ""))
        turn = F.array(_turn(F.lit(step.role), F.array_join(some, "\n\n"), {}))
        given = texts[0].isNotNull()
        for t in texts[1:]:
            given = given | t.isNotNull()
        return F.when(given, turn)
    if step.kind == "each":
        name, parts, inner = step.text.partition("[].")
        kind = f"{step.role}: string, {name}: " + (f"array<struct<{inner}: string>>" if parts else "string")

        def turn(m: Column) -> Column:
            text = m[name]
            if parts:
                text = F.array_join(F.transform(text, lambda p: p[inner]), "")
            return _turn(m[step.role], text, roles)

        if not step.paths:
            return F.array(turn(get("", f"struct<{kind}>")))
        return F.transform(get(step.paths[0], f"array<struct<{kind}>>"), turn)
    if step.kind == "pairs":
        pairs = get(step.paths[0], "array<array<string>>")
        return F.flatten(F.transform(pairs, lambda p: F.array(
            _turn(F.lit("user"), F.get(p, 0), {}), _turn(F.lit("assistant"), F.get(p, 1), {}))))
    if step.kind == "alternate":
        return F.transform(get(step.paths[0], "array<string>"), lambda t, k: _turn(
            F.when(k % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")), t, {}))
    raise ValueError(f"unknown step {step.kind}")


def with_turns(rows: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``fingerprint, layout, turns`` of the record column (JSON text or struct); they replace columns of these names."""
    kind = rows.schema[record].dataType
    if isinstance(kind, StructType):
        get = _struct_get(F.col(record), kind)
        shape = F.when(F.col(record).isNotNull(), struct_shape(F.col(record), kind))
    else:
        parsed = F.try_parse_json(F.col(record))
        get, shape = _json_get(parsed), json_shape(parsed)
    out = rows.withColumn("fingerprint", F.sha2(shape, 256))
    table = fingerprints(layouts)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in reversed(layouts):
        known = F.col("fingerprint").isin(*(k for k, name in table.items() if name == x.name))
        steps = [F.coalesce(_step(s, get, x.roles), F.lit([]).cast(TURNS)) for s in x.steps]
        layout = F.when(known, F.lit(x.name)).otherwise(layout)
        turns = F.when(known, F.concat(*steps) if len(steps) > 1 else steps[0]).otherwise(turns)
    return out.withColumns({"layout": layout, "turns": F.coalesce(turns, F.lit([]).cast(TURNS))})
