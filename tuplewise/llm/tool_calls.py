"""Tool-call linking for chat data.

Calls and results are hash-joined by conversation and identifier, put in a
topological order of the calls' dependencies, their arguments validated against the
tools' schemas, and each call serialised with its result as canonical JSON (keys
sorted, no white space, UTF-8 as it is, no NaN).

Order.  ``level`` is the length of the longest chain of calls that a call depends on, so
rows sorted by (conv_id, level, turn, call_id) are in topological order.  Calls that
wait on a cycle have a null level and an error.

Levels are found by blocks: a block holds a conversation's calls of ``BLOCK_TURNS``
turns, or, where these are more than ``BLOCK_CALLS``, a part of them by hash.  A task
settles all calls of a block that wait for nothing outside it (small blocks share a
bin of about ``BLOCK_CALLS`` dependencies, and settle together); what blocks have
settled then reaches the others, and unsettled blocks go again.  Rounds follow the
number of blocks that a chain crosses and come back to (one for conversations of
ordinary size), not its length, and no task holds more than a bin of some blocks, so a
conversation may be as long as it likes.  Of several calls (results) of one
identifier the one of the earliest turn counts, then the smallest text; minima
combine map-side.

Arguments.  Whatever they hold ends in a value or an error.  Numbers beyond the range
of a double, integers of more digits than Python reads, NaN and infinities are broken
JSON; so is more than ``MAX_DEPTH`` levels of nesting, with an error of its own. Lone
surrogates, which UTF-8 lacks, become U+FFFD.  Schemas are objects, true (anything) or
false (nothing); one that is broken or misused gives an error to each of its calls.

Defined results: a call without a result has a null result and status 'no result'; a
result without a call gives a row of status 'no call' and null level; null ids match
nothing and are 'no call'/'no result' rows; null or empty arguments are the JSON null;
unknown or null tool names are errors (valid = false); dependencies on ids that the
conversation lacks are errors, and don't count for the level; extra columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplewise.llm.common import cut, small_batches

BLOCK_TURNS, BLOCK_CALLS = 4096, 1 << 16
#: bins at least, so that small tables use several tasks
BINS = 32
MAX_DEPTH = 100
_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
_LONE = re.compile("[\ud800-\udfff]")


def _refuse(constant: str):
    raise ValueError(f"{constant} is not JSON")


def _finite(digits: str) -> float:
    value = float(digits)
    if math.isinf(value):
        raise ValueError("beyond the range of a double")
    return value


def canonical(value) -> str:
    return _LONE.sub("\ufffd", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _depth(value) -> int:
    """Levels of nesting, found without recursion; counted to one more than MAX_DEPTH at most."""
    level, depth = [value], 0
    while depth <= MAX_DEPTH and (level := [y for x in level if isinstance(x, dict | list) for y in (x.values() if isinstance(x, dict) else x)]):
        depth += 1
    return depth


def errors_of(value, schema: dict | bool, at: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema``: type, enum, required, properties, additionalProperties, items, lengths and bounds."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if kinds:
        fits = {"number": number, "integer": number and (isinstance(value, int) or value.is_integer())} | {k: isinstance(value, t) for k, t in _TYPES.items()}
        if not any(fits.get(k, False) for k in kinds):
            return [f"{at}: not of type {'/'.join(kinds)}"]
    out = [f"{at}: not one of the listed values"] if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]) else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += errors_of(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += errors_of(item, schema["items"], f"{at}[{i}]")
    if isinstance(value, str | list):
        name = "Length" if isinstance(value, str) else "Items"
        out += [f"{at}: too short"] if len(value) < schema.get(f"min{name}", 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get(f"max{name}", len(value)) else []
    if number:
        out += [f"{at}: too small"] if value < schema.get("minimum", value) else []
        out += [f"{at}: too large"] if value > schema.get("maximum", value) else []
    return out


@lru_cache(maxsize=1024)
def _schema(text: str) -> dict | bool | None:
    """A schema; None if it is none."""
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict | bool) and _depth(found) <= MAX_DEPTH else None


def checked(arguments: str | None, schema: str | None) -> tuple[object, list[str]]:
    """The value of a call's arguments, and what is wrong with them; never raises."""
    try:
        value = json.loads(arguments or "null", parse_constant=_refuse, parse_float=_finite)
    except RecursionError:
        return None, ["$: nested too deep"]
    except ValueError:
        return None, ["$: broken JSON"]
    if _depth(value) > MAX_DEPTH:
        return None, ["$: nested too deep"]
    if schema is None:
        return value, ["no such tool"]
    if (rules := _schema(schema)) is None:
        return value, ["broken schema"]
    try:
        return value, [_LONE.sub("\ufffd", e) for e in errors_of(value, rules)]
    except (TypeError, AttributeError, ValueError, KeyError):  # a schema whose keywords hold what they can't
        return value, ["broken schema"]


def _serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        valid, errors, lines = [], [], []
        for r in batch.to_pylist():
            found, value = list(r["problems"] or []), None
            if r["status"] != "no call":
                value, wrong = checked(r["arguments"], r["schema"])
                found += wrong
            line = {"id": r["call_id"], "name": r["name"], "arguments": value, "after": sorted(x for x in r["after"] or [] if x is not None), "result": r["result"], "status": r["status"]}
            valid.append(not found and r["status"] != "no call")
            errors.append(found)
            lines.append(canonical(line))
        kept = [batch.column(c) for c in ("conv_id", "call_id", "level", "turn", "status")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(lines, pa.string())], names=["conv_id", "call_id", "level", "turn", "status", "valid", "errors", "json"])


def _settled(key: tuple[pa.Scalar, ...], edges: pa.Table) -> pa.Table:
    """Levels of the calls of one bin that wait for nothing that isn't settled, from their edges (conv_id, call_id, dep, dep_level)."""
    conversations, names, deps, levels = (edges[c].to_pylist() for c in ("conv_id", "call_id", "dep", "dep_level"))
    waits: dict[tuple[str, str], int] = {}
    least: dict[tuple[str, str], int] = {}
    users: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for conv, name, dep, level in zip(conversations, names, deps, levels, strict=True):
        call = conv, name
        waits.setdefault(call, 0)
        if level is None:
            waits[call] += 1
            users.setdefault((conv, dep), []).append(call)
        else:
            least[call] = max(least.get(call, 0), level + 1)
    out, ready = {}, [c for c, n in waits.items() if not n]
    while ready:
        call = ready.pop()
        out[call] = least[call]
        for user in users.get(call, ()):
            least[user] = max(least.get(user, 0), out[call] + 1)
            waits[user] -= 1
            if not waits[user]:
                ready.append(user)
    columns = {"conv_id": [c for c, _ in out], "call_id": [n for _, n in out]}
    return pa.table({k: pa.array(v, pa.string()) for k, v in columns.items()} | {"level": pa.array(list(out.values()), pa.int32())})


def _levels(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that have ``edges`` (conv_id, call_id, turn, dep), each from a call to another; null where a cycle is waited for."""
    ids = ["conv_id", "call_id"]
    block = F.floor(F.coalesce("turn", F.lit(0)) / BLOCK_TURNS)
    calls = cut(edges.groupBy(*ids).agg(F.min(block).alias("block")))
    sizes = calls.groupBy("conv_id", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CALLS).alias("parts"))
    part = F.pmod(F.xxhash64("call_id"), F.col("parts"))
    bins = max(BINS, -(-edges.count() // BLOCK_CALLS))
    placed = calls.join(sizes, ["conv_id", "block"]).select(*ids, F.pmod(F.xxhash64("conv_id", "block", part), F.lit(bins)).alias("bin"))
    open_ = edges.select(*ids, "dep").join(placed, ids)
    waits = calls.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("waits"))
    level = F.when(F.col("waits").isNull(), F.lit(0)).alias("dep_level")  # what waits for nothing is of level 0
    open_ = cut(open_.join(waits, ["conv_id", "dep"], "left").select(*ids, "bin", "dep", level))
    settled = None
    while True:
        new = open_.groupBy("bin").applyInArrow(_settled, "conv_id string, call_id string, level int")
        new = cut(new)
        settled = new if settled is None else cut(settled.union(new))
        left = open_.join(new.select(*ids), ids, "left_anti").join(new.select("conv_id", F.col("call_id").alias("dep"), F.col("level").alias("own")), ["conv_id", "dep"], "left")
        open_ = cut(left.select(*ids, "bin", "dep", F.coalesce("dep_level", "own").alias("dep_level")))
        # blocks go again only if what was settled is news to an unsettled one
        if not new.limit(1).count() or not open_.limit(1).count():
            return calls.select(*ids).join(settled, ids, "left")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Links ``calls`` (conv_id, call_id, turn, name, arguments, after) with ``results`` (conv_id, call_id, turn, content).

    ``arguments`` is JSON text, ``after`` the list of call ids that must come before,
    ``schemas`` (name, schema) the tools' JSON schemas.  Returns conv_id, call_id,
    level, turn, status, valid, errors and json, a row for each identifier.
    """
    small_batches(calls.sparkSession)
    ids = ["conv_id", "call_id"]
    named = lambda df: df.withColumns({c: F.col(c).cast("string") for c in ids} | {"turn": F.col("turn").cast("long")})
    # a row with a null id is a group of its own
    apart = lambda df: df.withColumn("_own", F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), F.monotonically_increasing_id()))
    first = apart(named(calls)).groupBy(*ids, "_own").agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"))
    first = cut(first.select(*ids, "c.*", F.lit(True).alias("called")))
    answer = apart(named(results)).groupBy(*ids, "_own").agg(F.min(F.struct("turn", "content")).alias("r"))
    answer = answer.select(*ids, F.col("r.content").alias("result"), F.col("r.turn").alias("result_turn"), F.lit(True).alias("answered"))

    edges = first.select(*ids, "turn", F.explode(F.array_distinct("after")).alias("dep")).filter("dep IS NOT NULL")
    target = first.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("known"))
    edges = cut(edges.join(target, ["conv_id", "dep"], "left"))
    lacking = edges.filter("known IS NULL").groupBy(*ids).agg(F.array_sort(F.collect_list(F.concat(F.lit("no such dependency: "), F.col("dep")))).alias("missing"))
    levels = _levels(edges.filter("known")).withColumn("waits", F.lit(True))
    joined = first.join(answer, ids, "full").join(lacking, ids, "left").join(levels, ids, "left")
    none = F.array().cast("array<string>")
    cycle = F.when(F.col("waits") & F.col("level").isNull(), F.array(F.lit("waits on a cycle"))).otherwise(none)
    joined = joined.withColumns({
        "turn": F.coalesce("turn", "result_turn"), "problems": F.concat(F.coalesce("missing", none), cycle),
        "level": F.when(F.col("waits"), F.col("level")).when(F.col("called"), F.lit(0)),
    })
    status = F.when(F.col("called").isNull(), "no call").when(F.col("answered").isNull(), "no result").otherwise("linked")
    tools = schemas.groupBy("name").agg(F.min("schema").alias("schema"))
    rows = joined.withColumn("status", status).join(tools, "name", "left")
    rows = rows.select(*ids, "level", "turn", "status", "name", "arguments", "after", "result", "schema", "problems")
    return rows.mapInArrow(_serialised, "conv_id string, call_id string, level int, turn long, status string, valid boolean, errors array<string>, json string")
