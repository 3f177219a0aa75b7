"""Chat formatting: tool calls and results linked by id, ordered, checked against schemas, written as canonical JSON.

A message's text may hold lines of JSON: {"tool_call": {"id", "name", "arguments", "after": [ids]}} and {"tool_result": {"id",
"content"}}. They are parsed where the messages lie. Results meet calls in an equi join on (conversation, id), so a
long conversation spreads over its ids. Calls are ordered by levels: those that wait for nothing first, then those
whose last need was met. Chains are jumped over, so deep conversations take few rounds of joins, each cut on shared storage.
"""
from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.common import slices
from newsgauge.session import cut_point

EVENTS = "conv_id long, turn long, pos int, role string, kind string, call_id string, name string, body string, after array<string>, error string"
CIRCLE = 1 << 40            # above any level
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def canonical(value) -> str:
    """JSON with sorted keys and without blanks; NaN and infinities are not JSON."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fault(name, arguments, tools: dict) -> str | None:
    """Why arguments do not fit the tool's schema, or None. `tools`: name -> {parameter: {"type", "required", "enum"}}."""
    if name not in tools:
        return "unknown tool"
    if not isinstance(arguments, dict):
        return "arguments are no object"
    for key in sorted(set(arguments) - set(tools[name])):
        return f"unknown argument {key}"
    for key, rule in sorted(tools[name].items()):
        if key not in arguments:
            if rule.get("required"):
                return f"missing {key}"
        elif not isinstance(arguments[key], KINDS[rule["type"]]) or (isinstance(arguments[key], bool) and rule["type"] in ("integer", "number")):
            return f"{key} is no {rule['type']}"
        elif "enum" in rule and arguments[key] not in rule["enum"]:
            return f"{key} is not allowed"
    return None


def parsed(text: str | None, tools: dict) -> list[dict]:
    """The events of one message: what is said, then its calls and results in their order. A line that is no event is said."""
    said, events = [], []
    for line in (text or "").split("\n"):
        found = None
        if line.startswith('{"tool_'):
            try:
                found = json.loads(line)
                call, result = found.get("tool_call"), found.get("tool_result")
                inner = call if isinstance(call, dict) else result if isinstance(result, dict) else None
                ok = inner is not None and len(found) == 1 and isinstance(inner.get("id"), str)
                canonical(found)
            except ValueError:
                ok = False
            if ok and inner is call:
                name, args, after = inner.get("name"), inner.get("arguments"), inner.get("after", [])
                after = [a for a in after if isinstance(a, str)] if isinstance(after, list) else []
                name = name if isinstance(name, str) else canonical(name)
                events.append({"kind": "call", "call_id": inner["id"], "name": name, "body": canonical(args), "after": sorted(set(after)), "error": fault(name, args, tools)})
            elif ok:
                events.append({"kind": "result", "call_id": inner["id"], "body": canonical(inner.get("content"))})
            else:
                found = None
        if found is None:
            said.append(line)
    return [{"kind": "message", "body": canonical("\n".join(said))}, *events]


def events_of(messages: DataFrame, tools: dict) -> DataFrame:
    def run(batches):
        kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("pos", pa.int32()), ("role", pa.string()), ("kind", pa.string()), ("call_id", pa.string()),
                           ("name", pa.string()), ("body", pa.string()), ("after", pa.list_(pa.string())), ("error", pa.string())])
        for b in slices(batches):
            rows = [{"conv_id": m["conv_id"], "turn": m["turn"], "role": m["role"], "pos": i, **e} for m in b.to_pylist() for i, e in enumerate(parsed(m["text"], tools))]
            yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in kinds.names} for r in rows], schema=kinds)
    return messages.select("conv_id", "turn", "role", "text").mapInArrow(run, EVENTS)


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that wait for no other call; null in circles and behind them. Needs without a call are ignored.

    A row of the state is a need that is still open, `steps` away, or, without a need, what is known of a call: its level is `least` or more.
    Each round a need that waits for nothing becomes knowledge, and one that waits for a single call is replaced by that call, so
    chains and trees of any depth take as many rounds as the logarithm of it. A call that waits for several is met when those are,
    so only layers of such calls take a round each. A way longer than the conversation has calls runs in a circle, and so does
    one that comes back to its start; what waits for a circle stays open, and the rounds end when nothing moves.
    """
    needs = calls.select("conv_id", "call_id", F.explode("after").alias("need"))
    needs = needs.join(calls.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_semi")
    longest = calls.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 0
    known = calls.select("conv_id", "call_id", F.lit(None).cast("string").alias("need"), F.lit(0).cast("long").alias("steps"), F.lit(0).cast("long").alias("least"))
    state = cut_point(known.union(needs.select("conv_id", "call_id", "need", F.lit(1).cast("long"), F.lit(0).cast("long"))), "needs")
    moving = True
    while moving:
        about = state.groupBy("conv_id", F.col("call_id").alias("need")).agg(
            F.max("least").alias("far"), F.count("need").alias("n_open"), F.max("need").alias("next"), F.max("steps").alias("more"))
        seen = state.filter("need is not null").join(about, ["conv_id", "need"])
        free = (F.col("n_open") <= 1) & (F.col("far") < CIRCLE)             # what waits for a circle stays open
        need, steps = F.when(free, F.col("next")).otherwise(F.col("need")), F.col("steps") + F.when(free, F.col("more")).otherwise(F.lit(0))
        least = F.when(free, F.greatest("least", F.col("steps") + F.col("far"))).otherwise(F.col("least"))
        seen = seen.select("conv_id", "call_id", need.alias("need"), steps.alias("steps"), least.alias("least"), free.alias("moved"))
        circle = F.col("need").isNotNull() & ((F.col("need") == F.col("call_id")) | (F.col("steps") > longest))
        seen = seen.select("conv_id", "call_id", F.when(~circle, F.col("need")).alias("need"), F.when(circle | F.col("need").isNull(), 0).otherwise(F.col("steps")).alias("steps"),
                           F.when(circle, F.lit(CIRCLE)).otherwise(F.col("least")).alias("least"), (F.col("moved") | circle).alias("moved"))
        rows = state.filter("need is null").select("conv_id", "call_id", "need", "steps", "least", F.lit(False).alias("moved")).union(seen)
        rows = cut_point(rows.groupBy("conv_id", "call_id", "need").agg(F.max("steps").alias("steps"), F.max("least").alias("least"), F.max("moved").alias("moved")), "needs")
        moving = rows.agg(F.max("moved").alias("any")).first()["any"]
        state = rows.drop("moved")
    done = state.groupBy("conv_id", "call_id").agg(F.max("least").alias("least"), F.count("need").alias("n_open"))
    return cut_point(done.select("conv_id", "call_id", F.when((F.col("least") < CIRCLE) & (F.col("n_open") == 0), F.col("least")).cast("int").alias("level")), "levels")


def formatted(messages: DataFrame, tools: dict) -> DataFrame:
    """One row per event of messages (conv_id, turn, role, text): conv_id, turn, pos, role, kind, call_id, level, status, json.

    Sort calls of a conversation by (level, turn, pos). Status of a call: ok, unanswered, circular, duplicate (a later call with a used
    id) or the schema's fault; of a result: ok, orphan, or duplicate (a second answer, which no call takes up). Empty and null
    texts are an empty message. Rows without conv_id or turn stay, linked with nothing. Repeated rows repeat their events.
    """
    events = cut_point(events_of(messages, tools), "events")
    place = F.struct("turn", "pos")
    keyed = events.filter("kind <> 'message' and conv_id is not null")
    first = cut_point(keyed.groupBy("conv_id", "call_id").agg(
        F.min(F.when(F.col("kind") == "call", place)).alias("call_at"), F.min(F.when(F.col("kind") == "result", place)).alias("result_at"),
        F.min_by(F.when(F.col("kind") == "result", F.col("body")), F.when(F.col("kind") == "result", place)).alias("result")), "ids")
    calls = keyed.filter("kind = 'call'").join(first.select("conv_id", "call_id", "call_at"), ["conv_id", "call_id"]).filter(place == F.col("call_at"))
    calls = cut_point(calls.groupBy("conv_id", "call_id").agg(F.first("after").alias("after")), "calls")
    levels = call_levels(calls)
    wide = events.join(first, ["conv_id", "call_id"], "left").join(levels.withColumn("placed", F.lit(True)), ["conv_id", "call_id"], "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    status = (F.when(F.col("conv_id").isNull() & (is_call | is_result), "orphan")
              .when(is_call & (place != F.col("call_at")), "duplicate").when(is_call & F.col("error").isNotNull(), F.col("error"))
              .when(is_call & F.col("level").isNull(), "circular").when(is_call & F.col("result_at").isNull(), "unanswered")
              .when(is_result & F.col("call_at").isNull(), "orphan").when(is_result & (place != F.col("result_at")), "duplicate").otherwise("ok"))
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    answer = F.when(F.col("status") == "duplicate", "null").otherwise(F.coalesce("result", F.lit("null")))
    j = (F.when(is_call, F.concat(F.lit('{"arguments":'), "body", F.lit(',"id":'), text("call_id"), F.lit(',"name":'), text("name"), F.lit(',"result":'), answer, F.lit("}")))
         .when(is_result, F.concat(F.lit('{"content":'), "body", F.lit(',"id":'), text("call_id"), F.lit("}")))
         .otherwise(F.concat(F.lit('{"content":'), "body", F.lit(',"role":'), text("role"), F.lit("}"))))
    return wide.withColumn("status", status).withColumn("json", j).select(
        "conv_id", "turn", "pos", "role", "kind", "call_id", F.when(is_call & (F.col("status") != "duplicate"), F.col("level")).alias("level"), "status", "json")
