"""Chat formatting: tool calls linked to their results, ordered topologically, validated, in canonical JSON.

A message whose text is a JSON object may hold tool calls (``{"tool_calls": [{"id", "name", "arguments"}]}``,
the name and arguments also under ``function``, arguments also as JSON text) or a tool's result
(``{"tool_call_id", "content"}``). Each call and each other message becomes one row. Calls and results are
hash-joined by conversation and identifier. A call may use other calls' results by ``{"$ref": "<id>"}`` in its
arguments; it comes after them. Nothing is collected by conversation, so one with any number of turns is fine.

The canonical form is that of RFC 8785 (keys in the order of their UTF-16 units, numbers as ECMAScript writes them),
but whole numbers written without point or exponent keep all their digits.

Defined cases: a null text counts as empty, a null role as ``user``; text that is no JSON object, or one that repeats
a key or nests deeper than DEPTH levels, is an ordinary message, and arguments that are such text are invalid; half a
surrogate pair, which UTF-8 can't hold, stays the escape that it was written as; long texts are parsed whole; other
columns, whatever their names, are not read; an empty table gives an empty result; of calls that share an identifier in a conversation the first (turn, place) is linked, the others are
``duplicate_call``; a result without a call is ``orphan_result``, and so is one whose conversation is null;
repeated rows give repeated messages; calls that need each other in a circle are ``cyclic`` and come last in
their turn. Columns other than the four named are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize, small_batches

DEPTH = 200
_CIRCLE = 1 << 40  # level of calls in a circle, above that of any chain
_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', re.DOTALL)
_HALF = re.compile("[\ud800-\udfff]")

#: types of JSON schemas and what they admit
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}

#: schemas of the tools that the registered query knows
TOOLS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "additionalProperties": False},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}},
}


def _number(v: float) -> str:
    """A finite number as ECMAScript writes it."""
    if v.is_integer() and abs(v) < 1e21:
        return str(int(v))
    said = repr(v)
    if "e" not in said and 0 < abs(v) < 1e-6:
        said = f"{v:e}"
    mantissa, _, exponent = said.partition("e")
    if not exponent:
        return said
    power = int(exponent)
    if -7 < power < 0:
        digits = mantissa.replace(".", "").lstrip("-")
        return ("-" if v < 0 else "") + "0." + "0" * (-power - 1) + digits
    return f"{mantissa}e{'+' if power > 0 else '-'}{abs(power)}"


def _whole(text: str | None) -> str | None:
    """Text that UTF-8 can hold: halves of surrogate pairs as the escapes that they were."""
    return text and _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _quoted(text: str) -> str:
    return _whole(json.dumps(text, ensure_ascii=False))


def canonical(value: Any) -> str:
    """Canonical JSON; NaN and infinity, which JSON lacks, become null."""
    if isinstance(value, dict):
        items = sorted(((str(k), v) for k, v in value.items()), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_quoted(k)}:{canonical(v)}" for k, v in items) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value) if math.isfinite(value) else "null"
    return _quoted(value) if isinstance(value, str) else json.dumps(value)


#: the keywords of JSON schemas that are checked; title and description say nothing of values
KEYWORDS = frozenset("type enum const minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum multipleOf required properties additionalProperties minProperties maxProperties items minItems maxItems uniqueItems anyOf oneOf allOf not title description default".split())


def check_schema(schema: Any, at: str = "$") -> None:
    """Refuse a schema with a keyword or type that isn't supported, instead of passing what it forbids."""
    if isinstance(schema, bool):
        return
    unknown = sorted(set(schema) - KEYWORDS)
    kinds = schema.get("type", [])
    unknown += [k for k in (kinds if isinstance(kinds, list) else [kinds]) if k not in _KINDS]
    if unknown:
        raise ValueError(f"{at}: schema keywords not supported: {', '.join(unknown)}")
    for k in ("items", "not", "additionalProperties"):
        if k in schema:
            check_schema(schema[k], f"{at}.{k}")
    for k in ("anyOf", "oneOf", "allOf"):
        for i, part in enumerate(schema.get(k, [])):
            check_schema(part, f"{at}.{k}[{i}]")
    for k, part in schema.get("properties", {}).items():
        check_schema(part, f"{at}.{k}")


def _is(value: Any, kind: str) -> bool:
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, _KINDS[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))


def _bound(value: float, schema: dict) -> bool:
    lows = schema.get("minimum", -math.inf) <= value and schema.get("exclusiveMinimum", -math.inf) < value
    highs = schema.get("maximum", math.inf) >= value and schema.get("exclusiveMaximum", math.inf) > value
    step = schema.get("multipleOf")
    return lows and highs and (not step or math.isclose(value / step, round(value / step), abs_tol=1e-9))


def violation(value: Any, schema: Any, at: str = "$") -> str | None:
    """The first way in which a value breaks a JSON schema, else None; a reference to a result fits any type."""
    if isinstance(schema, bool):
        return None if schema else f"{at}: unknown"
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return None  # filled by another call's result
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return f"{at}: not {'/'.join(kinds)}"
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return f"{at}: not in enum"
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return f"{at}: not the constant"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at}: too short"
        if len(value) > schema.get("maxLength", len(value)):
            return f"{at}: too long"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return f"{at}: not like the pattern"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not _bound(value, schema):
        return f"{at}: out of bounds"
    if isinstance(value, dict):
        props = schema.get("properties", {})
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
            return f"{at}: out of bounds"
        for k in schema.get("required", []):
            if k not in value:
                return f"{at}.{k}: missing"
        for k in sorted(value):
            if bad := violation(value[k], props.get(k, schema.get("additionalProperties", True)), f"{at}.{k}"):
                return bad
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return f"{at}: out of bounds"
        if schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value):
            return f"{at}: not unique"
        for i, x in enumerate(value):
            if bad := violation(x, schema.get("items", True), f"{at}[{i}]"):
                return bad
    for k, least, most in (("anyOf", 1, math.inf), ("oneOf", 1, 1), ("allOf", len(schema.get("allOf", [])), math.inf)):
        if k in schema and not least <= sum(violation(value, part, at) is None for part in schema[k]) <= most:
            return f"{at}: breaks {k}"
    if "not" in schema and violation(value, schema["not"], at) is None:
        return f"{at}: breaks not"
    return None


def _refs(value: Any) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"}:
            return [str(value["$ref"])]
        return [r for v in value.values() for r in _refs(v)]
    return [r for v in value for r in _refs(v)] if isinstance(value, list) else []


def _unique(pairs: list[tuple[str, Any]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key is repeated")
    return dict(pairs)


def _deep(text: str) -> bool:
    """Whether brackets nest deeper than DEPTH, by one pass over the text; those in strings don't count."""
    if text.count("[") + text.count("{") <= DEPTH:
        return False
    at = 0
    for m in _BRACKETS.finditer(text):
        at += {"[": 1, "{": 1, "]": -1, "}": -1}.get(m[0], 0)
        if at > DEPTH:
            return True
    return False


def _json(text: str) -> Any:
    if _deep(text):
        raise ValueError("nested too deep")
    return json.loads(text, object_pairs_hook=_unique)


def _object(text: str) -> dict | None:
    if text.lstrip()[:1] != "{":
        return None
    try:
        got = _json(text)
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def parse_message(role: str | None, text: str | None, tools: dict[str, dict]) -> list[dict]:
    """The rows of one message: place, kind, call_id, name, refs, valid, problem, body."""
    role, text = role or "user", text or ""
    made, base = [], {"call_id": None, "name": None, "refs": [], "valid": None, "problem": None}
    got = _object(text)
    calls = got.get("tool_calls") if got else None
    if isinstance(calls, list):
        for c in calls:
            c = c if isinstance(c, dict) else {}
            inner = c.get("function") if isinstance(c.get("function"), dict) else c
            name, args, bad = inner.get("name"), inner.get("arguments"), None
            if isinstance(args, str):
                try:
                    args = _json(args)
                except ValueError:
                    bad = "$: no JSON"
            if not bad:
                bad = violation(args, tools[name]) if isinstance(name, str) and name in tools else "unknown tool"
            ident = None if c.get("id") is None else str(c["id"])
            made.append(base | {"kind": "call", "call_id": ident, "name": None if name is None else str(name), "refs": sorted(set(_refs(args))), "valid": bad is None, "problem": bad, "body": canonical({"arguments": args, "id": ident, "name": name, "role": role, "type": "call"})})
        content = got.get("content")
        if isinstance(content, str) and content:
            made.insert(0, base | {"kind": "message", "body": canonical({"content": content, "role": role, "type": "message"})})
    elif got and "tool_call_id" in got:
        ident = None if got["tool_call_id"] is None else str(got["tool_call_id"])
        made.append(base | {"kind": "result", "call_id": ident, "body": canonical({"content": got.get("content"), "id": ident, "role": role, "type": "result"})})
    if not made:
        made.append(base | {"kind": "message", "body": canonical({"content": text, "role": role, "type": "message"})})
    fit = lambda x: x | {k: _whole(x[k]) for k in ("call_id", "name", "problem")} | {"refs": sorted({_whole(r) for r in x["refs"]})}
    return [fit(x) | {"place": i} for i, x in enumerate(made)]


_PARSED = [("place", "int"), ("kind", "string"), ("call_id", "string"), ("name", "string"), ("refs", "array<string>"), ("valid", "boolean"), ("problem", "string"), ("body", "string")]
_ARROW = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}


def format_chat(conversations: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    """One row per message, call or result, with its link, validity, order and canonical JSON.

    Within a conversation the order is that of ``topo_turn, topo_level, turn, place``: a linked result follows
    its call in the call's turn, and a call follows the calls whose results it uses: if one of those is of a later
    turn, ``topo_turn`` is that turn.
    """
    tools = TOOLS if tools is None else tools
    for schema in tools.values():
        check_schema(schema)
    small_batches(conversations.sparkSession)
    src = conversations.select("conv_id", "turn", "role", "text")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [parse_message(r, t, tools) for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                take = pa.array([i for i, m in enumerate(rows) for _ in m], pa.int64())
                cols = [part.column(k).take(take) for k in range(3)]
                cols += [pa.array([x[k] for m in rows for x in m], _ARROW[kind]) for k, kind in _PARSED]
                yield pa.RecordBatch.from_arrays(cols, ["conv_id", "turn", "role", *(k for k, _ in _PARSED)])

    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, " + ", ".join(f"{k} {v}" for k, v in _PARSED)
    rows = materialize(src.withColumn("role", F.col("role").cast("string")).mapInArrow(parse, schema), "chat")

    calls = rows.filter("kind = 'call' and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct(F.coalesce("turn", F.lit(0)).alias("t"), "place")).alias("at"), F.first("refs").alias("refs0"))
    firsts = calls.select(F.col("conv_id").alias("c_conv"), F.col("call_id").alias("c_id"), F.col("at.t").alias("c_turn"), F.col("at.place").alias("c_place"))
    levels = _levels(rows, firsts)
    known = firsts.join(levels, ["c_conv", "c_id"], "left").withColumns({"level": F.coalesce("level", F.lit(0)), "reach": F.coalesce("reach", "c_turn")})
    results = rows.filter("kind = 'result' and call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results")).select(F.col("conv_id").alias("c_conv"), F.col("call_id").alias("c_id"), "n_results")
    known = known.join(results, ["c_conv", "c_id"], "left")

    own = (F.col("conv_id") == F.col("c_conv")) & (F.col("call_id") == F.col("c_id"))
    # Messages that are neither calls nor results have no identifier and need no join.
    linked = rows.filter("call_id is not null").join(known, own, "left")
    plain = rows.filter("call_id is null").select("*", *(F.lit(None).cast(k).alias(n) for n, k in (("c_conv", kinds["conv_id"]), ("c_id", "string"), ("c_turn", kinds["turn"]), ("c_place", "int"), ("level", "bigint"), ("reach", kinds["turn"]), ("n_results", "bigint"))))
    first = (F.coalesce("turn", F.lit(0)) == F.col("c_turn")) & (F.col("place") == F.col("c_place"))
    link = (
        F.when(F.col("kind") == "message", "none")
        .when(F.col("kind") == "result", F.when(F.col("c_id").isNull(), "orphan_result").otherwise("linked"))
        .when(F.col("call_id").isNull() | F.col("c_id").isNull(), "no_id")
        .when(~first, "duplicate_call")
        .when(F.col("level") < 0, "cyclic")
        .when(F.col("n_results").isNull(), "no_result")
        .otherwise("linked")
    )
    joined = linked.unionByName(plain)
    depth = F.coalesce(F.when(F.col("level") < 0, F.lit(_CIRCLE)).otherwise(F.col("level")), F.lit(0))
    return joined.select(
        "conv_id", "turn", "place", "role", "kind", "call_id", "name", link.alias("link"), "valid", "problem",
        F.when(F.col("kind") == "result", F.coalesce("reach", "turn")).when((F.col("kind") == "call") & first & (F.col("reach") > F.col("c_turn")), F.col("reach")).otherwise(F.col("turn")).alias("topo_turn"),
        (2 * depth + F.when(F.col("kind") == "result", 1).otherwise(0)).cast("bigint").alias("topo_level"),
        F.col("body").alias("json"),
    )


def _levels(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """``c_conv, c_id, level, reach``: the longest chain of references below each call that has any, and the latest
    turn of the chain; -1 and null in circles, and for what needs a call of one.

    Chains are cut short first: a call with one need points to it, and pointers are doubled until each ends at a call
    without needs or with several, which takes as many steps as the logarithm of the longest chain. Only calls with
    several needs are then peeled off as Kahn does, in a round for each that lies above another.
    """
    turn = firsts.schema["c_turn"].dataType.simpleString()
    needs = rows.filter("kind = 'call' and call_id is not null and size(refs) > 0").select(F.col("conv_id").alias("c_conv"), F.col("call_id").alias("c_id"), F.col("turn"), "place", F.explode("refs").alias("need"))
    needs = needs.join(firsts, ["c_conv", "c_id"]).filter("coalesce(turn, 0) = c_turn and place = c_place").select("c_conv", "c_id", "c_turn", "need")
    targets = firsts.select("c_conv", F.col("c_id").alias("need"), F.col("c_turn").alias("need_turn"))
    if needs.isEmpty():
        return firsts.select("c_conv", "c_id", F.lit(0).cast("bigint").alias("level"), F.col("c_turn").alias("reach")).limit(0)
    edges = materialize(needs.join(targets, ["c_conv", "need"]).distinct(), "chat-needs")
    per = edges.groupBy("c_conv", "c_id").agg(F.count("*").alias("n"))
    single = edges.join(per.filter("n = 1"), ["c_conv", "c_id"])
    chains = materialize(single.select("c_conv", "c_id", F.col("need").alias("end"), F.lit(1).cast("bigint").alias("steps"), F.greatest("c_turn", "need_turn").alias("reach")), "chat-chains")
    for _ in range(chains.count().bit_length() + 1):
        more = chains.select("c_conv", F.col("c_id").alias("end"), F.col("end").alias("end2"), F.col("steps").alias("steps2"), F.col("reach").alias("reach2"))
        longer = chains.join(more, ["c_conv", "end"], "left")
        if longer.filter("end2 is not null").isEmpty():
            break
        grown = materialize(longer.select("c_conv", "c_id", F.coalesce("end2", "end").alias("end"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.greatest("reach", F.coalesce("reach2", "reach")).alias("reach")), "chat-chains")
        discard(chains)
        chains = grown
    # what still points to a call with one need is in a circle of such calls or needs one
    ring = chains.join(chains.select("c_conv", F.col("c_id").alias("end")), ["c_conv", "end"], "left_semi").select("c_conv", "c_id")
    ended = chains.join(ring, ["c_conv", "c_id"], "left_anti")

    jump = ended.select("c_conv", F.col("c_id").alias("need"), "end", "steps", F.col("reach").alias("far"))
    several = edges.join(per.filter("n > 1").select("c_conv", "c_id"), ["c_conv", "c_id"]).join(jump, ["c_conv", "need"], "left")
    lost = ring.select("c_conv", F.col("c_id").alias("need"), F.lit(True).alias("lost"))
    several = several.join(lost, ["c_conv", "need"], "left").select("c_conv", "c_id", F.when(~F.coalesce("lost", F.lit(False)), F.coalesce("end", "need")).alias("end"), F.coalesce("steps", F.lit(0)).alias("steps"), F.greatest("c_turn", "need_turn", F.coalesce("far", "need_turn")).alias("reach"))
    # each need of such a call: whether it still waits (a null end is one in a circle and waits for ever), the level below
    ids = several.select("c_conv", F.col("c_id").alias("end")).distinct().withColumn("known", F.lit(True))
    waits = F.col("end").isNull() | F.coalesce("known", F.lit(False))
    open_ = materialize(several.join(ids, ["c_conv", "end"], "left").select("c_conv", "c_id", "end", waits.alias("waits"), (F.coalesce("steps", F.lit(0)) + F.lit(0).cast("bigint")).alias("under"), "reach"), "chat-open")
    done = open_.sparkSession.createDataFrame([], f"c_conv {rows.schema['conv_id'].dataType.simpleString()}, c_id string, level bigint, reach {turn}")
    while not open_.isEmpty():
        ready = materialize(open_.groupBy("c_conv", "c_id").agg(F.max("waits").alias("w"), (F.max("under") + 1).alias("level"), F.max("reach").alias("reach")).filter("not w").drop("w"), "chat-ready")
        if ready.isEmpty():
            done = done.unionByName(open_.select("c_conv", "c_id").distinct().withColumns({"level": F.lit(-1).cast("bigint"), "reach": F.lit(None).cast(turn)}))
            break
        done = done.unionByName(ready)
        met = ready.select("c_conv", F.col("c_id").alias("end"), "level", F.col("reach").alias("far"))
        left = open_.join(ready.select("c_conv", "c_id"), ["c_conv", "c_id"], "left_anti").join(met, ["c_conv", "end"], "left")
        rest = materialize(left.select("c_conv", "c_id", "end", (F.col("waits") & F.col("level").isNull()).alias("waits"), (F.col("under") + F.coalesce("level", F.lit(0))).alias("under"), F.greatest("reach", F.coalesce("far", "reach")).alias("reach")), "chat-open")
        discard(open_)
        open_ = rest

    at_end = done.select("c_conv", F.col("c_id").alias("end"), F.col("level").alias("below"), F.col("reach").alias("far"))
    stuck = F.coalesce(F.col("below"), F.lit(0)) < 0
    alone = ended.join(at_end, ["c_conv", "end"], "left").select("c_conv", "c_id", F.when(stuck, -1).otherwise(F.coalesce("below", F.lit(0)) + F.col("steps")).cast("bigint").alias("level"), F.when(~stuck, F.greatest("reach", F.coalesce("far", "reach"))).alias("reach"))
    return done.unionByName(alone).unionByName(ring.withColumns({"level": F.lit(-1).cast("bigint"), "reach": F.lit(None).cast(turn)}))
