"""Tool-call linking: calls and results of chat messages joined by identifier, ordered, validated and written as canonical JSON.

A call is an entry of "tool_calls" in an assistant's message that is a JSON object ({"id", "name", "arguments"}, or the
same below "function"); a result is a tool's message that is a JSON object with "tool_call_id". Arguments may refer to an earlier
call by {"$result": id}. All other messages are plain.

Everything is joined on (conversation, identifier), so a long conversation is spread over tasks: the order is given
by ``level``, the length of the longest chain of references below a call (its result has the next level), and reading
order within a level. Levels are found by rounds that settle calls whose references are settled; what never settles is a cycle.

Defined results: a null text is empty; messages without a conv_id are one conversation; a message that isn't valid JSON (NaN, infinite
numbers and nesting over ``DEPTH`` levels aren't) is plain; half of a surrogate pair stays as its escape; a result without a call, or before it, is
unlinked; of calls with one id the first in reading order takes results and the others are marked "duplicate id"; a reference to no
known call and a cycle are errors; repeated rows stay rows; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch

TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
#: Levels of nesting that a message may have.
DEPTH = 150
HALF = re.compile("[\ud800-\udfff]")


def finite(digits: str) -> float:
    value = float(digits)
    if not math.isfinite(value):
        raise ValueError("not a finite number")
    return value


def parsed(text: str) -> object:
    """The JSON value; ValueError for what isn't JSON or is nested too deep."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        value = json.loads(text, parse_constant=refuse, parse_float=finite)
    except RecursionError:
        raise ValueError("nested too deep") from None
    level, depth = [value], 0
    while level := [y for x in level if isinstance(x, dict | list) for y in (x.values() if isinstance(x, dict) else x)]:
        depth += 1
        if depth > DEPTH:
            raise ValueError("nested too deep")
    return value


def written(text: str) -> str:
    """Halves of surrogate pairs as escapes: UTF-8 has no form for them."""
    return HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    """Sorted keys, no white space, UTF-8; a whole float within 2**53 is written as an integer."""

    def plain(x: object) -> object:
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float) and x == int(x) and abs(x) < 2**53:
            return int(x)
        return x

    return written(json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def of_type(value: object, kind: object) -> bool:
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    return not isinstance(kind, str) or kind not in TYPES or isinstance(value, TYPES[kind])


def violations(value: object, schema: object, at: str = "") -> list[str]:
    """What a value breaks of a schema: type (one or several), enum, required, properties, additionalProperties, items, minimum, maximum;
    the schema false allows nothing, and what is no schema allows all."""
    if schema is False:
        return [f"{at or '.'}: not allowed"]
    if not isinstance(schema, dict):
        return []
    out = []
    kinds = schema.get("type")
    if kinds:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(of_type(value, k) for k in kinds):
            return [f"{at or '.'}: not {' or '.join(map(str, kinds))}"]
    if isinstance(schema.get("enum"), list) and canonical(value) not in map(canonical, schema["enum"]):  # true isn't 1
        out.append(f"{at or '.'}: not in enum")
    if isinstance(value, dict):
        properties = schema["properties"] if isinstance(schema.get("properties"), dict) else {}
        out += [f"{at}.{k}: missing" for k in schema.get("required") or [] if k not in value]
        for k, v in value.items():
            if k in properties:
                if not (isinstance(v, dict) and set(v) == {"$result"}):
                    out += violations(v, properties[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at or '.'}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at or '.'}: above maximum")
    return out


def references(value: object) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return [value["$result"]]
        return [r for v in value.values() for r in references(v)]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


def items_of(role: str | None, text: str | None, schemas: dict) -> list[tuple]:
    """(kind, call id, tool, references, errors, canonical JSON) of each item of a message."""
    text = text or ""
    data = None
    if role in ("assistant", "tool") and text.lstrip()[:1] == "{":
        try:
            data = parsed(text)
        except ValueError:
            data = None
    if isinstance(data, dict) and role == "assistant" and isinstance(data.get("tool_calls"), list):
        out = []
        for call in data["tool_calls"]:
            inner = call.get("function") if isinstance(call, dict) and isinstance(call.get("function"), dict) else call
            if not isinstance(inner, dict):
                out.append(("call", None, None, [], ["not an object"], canonical(call)))
                continue
            name, given, errors = inner.get("name"), inner.get("arguments", {}), []
            if isinstance(given, str):
                try:
                    given = parsed(given)
                except ValueError:
                    errors.append("arguments are not JSON")
            if not isinstance(call.get("id"), str):
                errors.append("no id")
            if isinstance(name, str) and name in schemas:
                errors += violations(given, schemas[name])
            elif schemas:
                errors.append("unknown tool")
            own = call.get("id") if isinstance(call.get("id"), str) else None
            shown = [written(x) if isinstance(x, str) else None for x in (own, name)]
            out.append(("call", *shown, sorted({written(r) for r in references(given)}), [written(e) for e in errors], canonical({"arguments": given, "id": own, "name": name})))
        return out
    if isinstance(data, dict) and role == "tool" and isinstance(data.get("tool_call_id"), str):
        return [("result", written(data["tool_call_id"]), None, [], [], canonical({"content": data.get("content"), "tool_call_id": data["tool_call_id"]}))]
    return [("plain", None, None, [], [], canonical({"content": text, "role": role}))]


ITEMS = "conv_id long, turn long, item long, role string, kind string, call_id string, tool string, refs array<string>, errors array<string>, json string"


def _items(schemas: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ITEMS.split(", ")]
        strings = pa.list_(pa.string())
        kinds = [pa.int64()] * 3 + [pa.string()] * 4 + [strings, strings, pa.string()]
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows += [(conv, turn, i, role, *item) for i, item in enumerate(items_of(role, text, schemas))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def link_calls(messages: DataFrame, schemas: dict | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each item of a message: conv_id, turn, item, role, kind (plain, call, result), call_id, tool, level,
    linked, errors (joined by "; "), json. schemas: tool name -> JSON schema of its arguments; none: not checked."""
    scratch = Scratch(messages.sparkSession, "chat")
    own = messages.select(F.col(conv_col).cast("long"), F.col(turn_col).cast("long"), F.col(role_col).cast("string"), F.col(text_col).cast("string"))
    items = scratch.cut(own.mapInArrow(_items(schemas or {}), ITEMS))
    at = F.struct("turn", "item")
    # a join on conv_id would lose the conversation without one
    called = items.filter("call_id is not null").withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    calls = called.filter("kind = 'call'")
    first = scratch.cut(calls.groupBy("conv", "call_id").agg(F.min(at).alias("first"), F.min_by("refs", at).alias("refs")))
    refs = first.select("conv", "call_id", F.explode("refs").alias("ref"))
    known = first.select("conv", F.col("call_id").alias("ref"), F.lit(True).alias("known"))
    refs = scratch.cut(refs.join(known, ["conv", "ref"], "left"))
    lost = refs.filter("known is null").groupBy("conv", "call_id").agg(F.concat(F.lit("unknown reference "), F.array_join(F.array_sort(F.collect_set("ref")), ", ")).alias("lost"))
    needs = refs.filter("known").select("conv", "call_id", "ref")
    settled = first.join(needs, ["conv", "call_id"], "left_anti").select("conv", "call_id", F.lit(0).alias("level"))
    scratch.add("levels", settled)
    waiting = scratch.cut(needs.select("conv", "call_id").distinct())
    depth = 0
    while waiting.limit(1).count():  # one round for each level, which reads and writes what is left; the last one settles nothing
        depth += 1
        unsettled = needs.join(waiting.withColumnRenamed("call_id", "ref"), ["conv", "ref"], "left_semi")
        ready = scratch.cut(waiting.join(unsettled, ["conv", "call_id"], "left_anti"))
        if not ready.limit(1).count():
            break
        scratch.add("levels", ready.withColumn("level", F.lit(depth)))
        waiting = scratch.cut(waiting.join(ready, ["conv", "call_id"], "left_anti"))
        scratch.keep(items, first, refs, waiting)
    levels = scratch.added("levels")
    scratch.keep(items, first, refs)

    answered = called.filter("kind = 'result'").groupBy("conv", "call_id").agg(F.max("turn").alias("answer"))
    facts = (
        first.select("conv", "call_id", "first").join(levels, ["conv", "call_id"], "left").join(lost, ["conv", "call_id"], "left")
        .join(answered, ["conv", "call_id"], "left").withColumn("call", F.lit(True))
    )
    # items without an id have nothing to join: a long conversation of plain messages would meet in one task
    named = called.join(facts, ["conv", "call_id"], "left")
    joined = named.unionByName(items.filter("call_id is null"), allowMissingColumns=True)
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    own_place = F.col("first") == at
    late = F.col("turn") > F.col("first.turn")
    more = F.array_compact(F.array(
        F.when(is_call & ~own_place, F.lit("duplicate id")), F.when(is_call & F.col("call") & F.col("level").isNull(), F.lit("cycle")),
        F.when(is_call & own_place, F.col("lost")),
    ))
    return joined.select(
        "conv_id", "turn", "item", "role", "kind", "call_id", "tool",
        F.when(is_call, F.col("level")).when(is_result, F.col("level") + 1).cast("int").alias("level"),
        F.when(is_call, own_place & (F.col("answer") > F.col("first.turn"))).when(is_result, F.coalesce(late, F.lit(False))).alias("linked"),
        F.array_join(F.concat("errors", more), "; ").alias("errors"), "json",
    ).withColumn("linked", F.when(F.col("kind") == "plain", F.lit(None)).otherwise(F.coalesce("linked", F.lit(False))))
