"""Chat formatting with tool-call linking.

An assistant text that is a JSON object with ``tool_calls`` (objects with ``id``, ``name``, ``arguments``) holds calls; a text
of role ``tool`` that is a JSON object with ``tool_call_id`` is a result. Calls and results are hash-joined on conversation and
call id. A result goes behind its call, and a call behind the calls whose results its arguments name as
``{"$ref": "<call id>"}``. Arguments are checked against the tool's JSON schema. Every event is one row with its canonical
JSON (sorted keys, no spaces); rows sort by ``(conv_id, order_turn, order_rank, turn, pos)``, so a conversation of any
length never has to meet in one task.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.llm.scratch import Scratch


_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|(")|(-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?)|(true|false|null|NaN|-?Infinity))')
_LITERALS = {"true": True, "false": False, "null": None, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}


def whole_text(s: str) -> str:
    """``s`` with surrogates that stand alone (JSON can name them, UTF-8 cannot hold them) as U+FFFD."""
    return s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


class _Ready(str):
    """Text that is JSON as it stands."""


def _written(value: Any) -> str:
    """``canonical`` of values that ``json.dumps`` turns away: nested too deeply for recursion, or with NaN and infinity in them."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Ready):
            out.append(v)
        elif isinstance(v, (dict, list)):
            inner = []
            for k in sorted(v) if isinstance(v, dict) else range(len(v)):
                name = f"{json.dumps(k, ensure_ascii=False)}:" if isinstance(v, dict) else ""
                inner += [_Ready(("," if inner else "") + name), v[k]]
            out.append("{" if isinstance(v, dict) else "[")
            todo.append(_Ready("}" if isinstance(v, dict) else "]"))
            todo += reversed(inner)
        else:
            out.append("null" if isinstance(v, float) and not math.isfinite(v) else json.dumps(v, ensure_ascii=False))
    return "".join(out)


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces; what JSON cannot hold (NaN, infinity) is null, lone surrogates are U+FFFD."""
    try:
        out = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    except (ValueError, RecursionError):
        out = _written(value)
    return whole_text(out)


def read_nested(text: str) -> Any:
    """``json.loads`` for texts nested too deeply for recursion; a ValueError for what is no JSON."""
    root: list = []
    open_, names, want, at = [root], [None], "value", 0
    while m := _TOKEN.match(text, at):
        mark, quote, number, fraction, exponent, literal = m.groups()
        at, top = m.end(), open_[-1]
        if quote and want in ("name", "name or end"):
            names[-1], at = scanstring(text, at)
            want = "colon"
        elif mark == ":" and want == "colon":
            want = "value"
        elif mark == "," and want == "next" and top is not root:
            want = "name" if isinstance(top, dict) else "value"
        elif mark and mark in "]}" and want in ("next", "value or end", "name or end") and top is not root and isinstance(top, dict) == (mark == "}"):
            open_.pop(), names.pop()
            want = "next"
        elif want in ("value", "value or end") and mark not in ("]", "}", ",", ":"):
            if quote:
                value, at = scanstring(text, at)
            elif number:
                value = float(number) if fraction or exponent else int(number)
            else:
                value = _LITERALS[literal] if literal else [] if mark == "[" else {}
            if isinstance(top, dict):
                top[names[-1]] = value
            else:
                top.append(value)
            want = "next"
            if mark:
                open_.append(value), names.append(None)
                want = "value or end" if mark == "[" else "name or end"
        else:
            raise ValueError("no JSON")
    if want != "next" or len(open_) > 1 or text[at:].strip(" \t\n\r"):
        raise ValueError("no JSON")
    return root[0]


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}


def _is(value: Any, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean" or kind not in _TYPES
    return isinstance(value, _TYPES.get(kind, object)) or (kind == "integer" and isinstance(value, float) and value.is_integer())


def _same(a: Any, b: Any) -> bool:
    """Equality of JSON values: 1 is 1.0 but not true."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return set(a) == set(b) and all(_same(a[k], b[k]) for k in a)
    return a == b


def schema_error(value: Any, schema: dict, path: str = "$") -> str | None:
    """The first way in which ``value`` breaks ``schema`` (type, enum, const, required, properties, items, bounds, pattern), or None.

    A ``{"$ref": id}`` object stands for a later value and fits everything. A pattern that is no regular expression fits nothing.
    Only the schema is walked, so a value may be nested as deeply as it likes.
    """
    if not schema:
        return None
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return None
    kind = schema.get("type")
    if kind:
        kinds = kind if isinstance(kind, list) else [kind]
        if not any(_is(value, k) for k in kinds):
            return f"{path}: not {'/'.join(kinds)}"
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]) or "const" in schema and not _same(value, schema["const"]):
        return f"{path}: not an allowed value"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and (value < schema.get("minimum", value) or value > schema.get("maximum", value)):
        return f"{path}: out of range"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            return f"{path}: length"
        if "pattern" in schema:
            try:
                found = re.search(schema["pattern"], value)
            except re.error:
                return f"{path}: pattern of the schema is broken"
            if not found:
                return f"{path}: pattern"
    if isinstance(value, dict):
        for k in schema.get("required", []):
            if k not in value:
                return f"{path}.{k}: missing"
        known = schema.get("properties", {})
        for k in sorted(value):
            sub = known.get(k, schema.get("additionalProperties", {}))
            if sub is False:
                return f"{path}.{k}: unknown"
            if isinstance(sub, dict) and (e := schema_error(value[k], sub, f"{path}.{k}")):
                return e
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, x in enumerate(value):
            if e := schema_error(x, schema["items"], f"{path}[{i}]"):
                return e
    return None


def _refs(value: Any) -> set[str]:
    found, todo = set(), [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict) and set(v) == {"$ref"}:
            found.add(_id(v["$ref"]))
        elif isinstance(v, (dict, list)):
            todo += v.values() if isinstance(v, dict) else v
    return found


def _id(value: Any) -> str:
    """An identifier as text; objects and lists as their canonical JSON."""
    return canonical(value) if isinstance(value, (dict, list)) else whole_text(str(value))


def _object(text: str | None) -> dict | None:
    if not text or text.lstrip()[:1] != "{":
        return None
    try:
        value = json.loads(text)
    except RecursionError:
        try:
            value = read_nested(text)
        except ValueError:
            return None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


_EVENTS = "conv_id long, turn long, role string, pos int, kind string, call_id string, name string, problem string, refs array<string>, json string"
_EVENT_NAMES = [x.split()[0] for x in _EVENTS.split(", ")]
_EVENT_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(x.split()[1], pa.list_(pa.string())) for x in _EVENTS.split(", ")]


def events(chats: DataFrame, tools: dict[str, dict] | None) -> DataFrame:
    """One row for each message, call and result."""

    def rows(conv: Any, turn: Any, role: str | None, text: str | None) -> Iterator[tuple]:
        value = _object(text) if role in ("assistant", "tool") else None
        if role == "tool" and value and value.get("tool_call_id") is not None:
            own = _id(value["tool_call_id"])
            yield conv, turn, role, 0, "result", own, None, None, [], canonical({"content": value.get("content"), "role": role, "tool_call_id": own})
            return
        calls = value.get("tool_calls") if value and role == "assistant" else None
        if not isinstance(calls, list):
            yield conv, turn, role, 0, "message", None, None, None, [], canonical({"content": text or "", "role": role})
            return
        yield conv, turn, role, 0, "message", None, None, None, [], canonical({"content": value.get("content") or "", "role": role})
        for k, call in enumerate(calls, 1):
            call = call if isinstance(call, dict) else {}
            args = call.get("arguments")
            if isinstance(args, str):
                args = _object(args)
            problem = None
            if call.get("id") is None or not isinstance(call.get("name"), str):
                problem = "no id or name"
            elif not isinstance(args, dict):
                problem = "arguments are no object"
            elif tools is not None:
                problem = schema_error(args, tools[call["name"]]) if call["name"] in tools else "unknown tool"
            own = None if call.get("id") is None else _id(call["id"])
            name = whole_text(call["name"]) if isinstance(call.get("name"), str) else None
            yield conv, turn, role, k, "call", own, name, problem and whole_text(problem), sorted(_refs(args)), canonical({"arguments": args, "id": own, "name": name})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in rows(*x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(_EVENT_TYPES)], _EVENT_NAMES)

    return chats.mapInArrow(run, _EVENTS)


_AT = "at struct<turn:long,rank:long>"


def _ordered_in_groups(needs: DataFrame, groups: int) -> DataFrame:
    """``conv_id, call_id, at`` for calls whose needs can all be met; whole conversations (of counted, bounded size) share a group."""

    def run(table: pa.Table) -> pa.Table:
        own, at, left, behind = set(), {}, Counter(), defaultdict(list)
        for conv, call, need, first, dep in zip(*(table[c].to_pylist() for c in ("conv_id", "call_id", "needed", "at", "dep")), strict=True):
            own.add((conv, call))
            at[conv, call], at[conv, need] = (first["turn"], first["rank"]), (dep["turn"], dep["rank"])
            behind[conv, need].append((conv, call))
            left[conv, call] += 1
        ready, done = [c for c in at if not left[c]], []
        while ready:
            c = ready.pop()
            if c in own:
                done.append(c)
            for b in behind[c]:
                at[b] = max(at[b], (at[c][0], at[c][1] + 2))
                left[b] -= 1
                if not left[b]:
                    ready.append(b)
        ats = pa.array([{"turn": at[c][0], "rank": at[c][1]} for c in done], pa.struct([("turn", pa.int64()), ("rank", pa.int64())]))
        return pa.table([pa.array([c[0] for c in done], pa.int64()), pa.array([c[1] for c in done], pa.string()), ats], ["conv_id", "call_id", "at"])

    return needs.groupBy(F.pmod(F.xxhash64("conv_id"), F.lit(groups))).applyInArrow(run, f"conv_id long, call_id string, {_AT}")


def _ordered_by_rounds(needs: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for conversations of any size: each round takes the calls whose needs are all met, until a round finds none."""
    key = ["conv_id", "call_id"]
    calls = needs.groupBy(*key).agg(F.max("at").alias("at"), F.count("*").alias("left"))
    roots = needs.join(calls.select("conv_id", F.col("call_id").alias("needed")), ["conv_id", "needed"], "left_anti")
    front = scratch.save(roots.select("conv_id", "needed", F.col("dep").alias("at")).distinct(), "front-0")
    edges = needs.select(*key, "needed")
    calls, done, k = scratch.save(calls, "open-0"), [], 0
    while front.limit(1).count():
        k += 1
        met = edges.join(front.withColumnRenamed("at", "dep"), ["conv_id", "needed"]).groupBy(*key).agg(F.count("*").alias("met"), F.max("dep").alias("dep"))
        behind = F.struct(F.col("dep.turn").alias("turn"), (F.col("dep.rank") + 2).alias("rank"))
        calls = calls.join(met, key, "left").select(*key, F.when(F.col("dep").isNull(), F.col("at")).otherwise(F.greatest("at", behind)).alias("at"), (F.col("left") - F.coalesce("met", F.lit(0))).alias("left"))
        calls = scratch.save(calls, f"open-{k}")
        now = scratch.save(calls.where("left = 0").select(*key, "at"), f"done-{k}")
        done.append(now)
        calls = calls.where("left > 0")
        front = now.withColumnRenamed("call_id", "needed")
        if k > 1:
            scratch.drop(f"open-{k - 2}")
    out = done[0] if done else needs.select(*key, "at").limit(0)
    for d in done[1:]:
        out = out.union(d)
    return out


def link_tool_calls(chats: DataFrame, *, tools: dict[str, dict] | None = None, most_in_group: int = 100_000) -> DataFrame:
    """``conv_id, turn, pos, role, kind, call_id, name, status, linked_turn, order_turn, order_rank, json`` for every event.

    status of a call: ``invalid`` (JSON or schema, with the reason in ``problem``), ``repeated`` (its id was used before in the
    conversation), ``cycle`` (it waits for itself, for calls that wait for it, or for such calls), ``unanswered``, else ``ok``;
    of a result: ``orphan`` or ``ok``; of a message: null. An id stands for its first call: that one's arguments tell
    what it needs. References to ids that no call has are ignored. Null texts are empty messages; null roles, turns
    and conversation ids stay null, and link with nothing. Texts may be nested to any depth; ids that are lists or objects count by their canonical JSON. Repeated
    rows are repeated events. Other columns are not read. Conversations with up to ``most_in_group`` references between their calls are
    ordered in one task each, others by rounds of joins; both are exact.
    """
    scratch = Scratch(chats.sparkSession, "toolcalls")
    chats = chats.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    all_ = scratch.save(events(chats, tools), "events")
    key = ["conv_id", "call_id"]
    # repeated rows tie in turn and pos and have equal references
    calls = all_.where("kind = 'call' and call_id is not null and conv_id is not null").groupBy(*key).agg(F.min(F.struct(F.struct("turn", "pos").alias("first"), "refs")).alias("x")).select(*key, "x.first", "x.refs")
    answered = all_.where("kind = 'result'").groupBy(*key).agg(F.min("turn").alias("answer"))
    at = F.struct(F.col("first.turn").alias("turn"), F.lit(1).cast("long").alias("rank"))
    needs = calls.select(*key, at.alias("at"), F.explode("refs").alias("needed"))
    needs = scratch.save(needs.join(calls.select("conv_id", F.col("call_id").alias("needed"), at.alias("dep")), ["conv_id", "needed"]), "needs")
    large = needs.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > most_in_group).select("conv_id")
    groups = max(1, -(-needs.count() // most_in_group))
    if large.limit(1).count():
        large = scratch.save(large, "large")
        small = needs.join(large, "conv_id", "left_anti")
        met = _ordered_in_groups(small, groups).unionByName(_ordered_by_rounds(scratch.save(needs.join(large, "conv_id", "left_semi"), "needs-large"), scratch))
    else:
        met = _ordered_in_groups(needs, groups)
    waits = needs.select(*key).distinct().withColumn("waits", F.lit(True))
    level = calls.join(waits, key, "left").join(met.withColumnRenamed("at", "met"), key, "left")
    level = level.select(*key, F.coalesce("met", at).alias("at"), (F.col("waits").isNotNull() & F.col("met").isNull()).alias("moved"))
    out = all_.join(calls.select(*key, "first"), key, "left").join(level, key, "left").join(answered, key, "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    status = (
        F.when(is_call & F.col("problem").isNotNull(), "invalid")
        .when(is_call & (F.struct("turn", "pos") != F.col("first")), "repeated")
        .when(is_call & F.coalesce("moved", F.lit(False)), "cycle")
        .when(is_call & F.col("answer").isNull(), "unanswered")
        .when(is_result & F.col("first").isNull(), "orphan")
        .when(is_call | is_result, "ok")
    )
    own = F.struct(F.col("turn"), F.when(is_result, 2).when(is_call, 1).otherwise(0).cast("long").alias("rank"))
    at = F.when(is_call & F.col("at").isNotNull(), F.greatest(own, "at")).when(is_result & F.col("at").isNotNull(), F.greatest(own, F.struct(F.col("at.turn").alias("turn"), (F.col("at.rank") + 1).alias("rank")))).otherwise(own)
    linked = F.when(is_result, F.col("first.turn")).when(is_call, F.col("answer"))
    return out.select("conv_id", "turn", "pos", "role", "kind", "call_id", "name", status.alias("status"), "problem", linked.alias("linked_turn"), at["turn"].alias("order_turn"), at["rank"].alias("order_rank"), "json")
