"""Tool calls of conversations, linked to their results, ordered, validated and written as canonical JSON.

DataFrame functions alone. Calls and results are hash-joined by (conversation, call id). A call may wait for one other
call of its conversation; its level is the length of that chain, found by pointer doubling (rounds grow with the logarithm
of the longest chain), and calls are ordered by level, position and id: a topological order. Arguments are parsed as
variants and checked against the tool's schema. Canonical JSON has sorted keys and no spaces.

A conversation may hold a third of all rows: joins are by call, ranks are counted within slices of SLICE positions of a
level and stitched by the counts of slices and of blocks of levels, and no list of a conversation's calls is ever collected.

Defined results: of calls that share an id the first (by position, then arguments) counts, and so with results; a call
without a result has status ``pending``; results without a call are left out; a call that waits for an unknown call is on
level 0 with an error; one on, or behind, a cycle has no level, comes last and has an error; arguments that are null or no
JSON object are an error, as is a tool without a schema; null conversation or call ids take no part; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavilion.llm.tables import looked_up, written

#: Positions of a slice, and levels of a block.
SLICE, LEVELS = 1024, 1024
#: What schema_of_variant says of a value of each type.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}
Schema = dict[str, tuple[str, bool]]


def _first(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(F.struct(*values)).alias("_f")).select(*keys, *[F.col(f"_f.{v}").alias(v) for v in values])


def _errors(schemas: dict[str, Schema]) -> Column:
    """What is wrong with the arguments of a call, in the order of tools and parameters; nulls stand for nothing."""
    keys = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
    found = [F.when(~F.coalesce(F.col("_kind").rlike("^OBJECT<"), F.lit(False)), F.lit("arguments: not an object")), F.when(~F.coalesce(F.col("name").isin([*schemas]), F.lit(False)), F.lit("name: no such tool"))]
    for tool, schema in sorted(schemas.items()):
        own = F.col("name") == tool
        for parameter, (kind, required) in sorted(schema.items()):
            value = F.schema_of_variant(F.try_variant_get("_args", f"$['{parameter}']", "variant"))
            if required:
                found.append(F.when(own & ~F.array_contains(keys, parameter), F.lit(f"{parameter}: missing")))
            found.append(F.when(own & F.array_contains(keys, parameter) & ~F.coalesce(value.rlike(f"^({TYPES[kind]})$"), F.lit(False)), F.lit(f"{parameter}: not of type {kind}")))
        extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(p) for p in sorted(schema)]).cast("array<string>")))
        found.append(F.when(own & (F.size(extra) > 0), F.concat(F.array_join(extra, ","), F.lit(": unknown"))))
    return F.array_compact(F.array(*found))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level (null on or behind a cycle) of calls with ``depends_on``, a call id of the same table or null."""
    key = F.struct("conv_id", "call_id")
    at = written(calls.select(key.alias("node"), F.when(F.col("depends_on").isNotNull(), F.struct("conv_id", F.col("depends_on").alias("call_id"))).alias("next"), F.when(F.col("depends_on").isNotNull(), 1).otherwise(0).cast("long").alias("level")), "levels")
    # A chain is no longer than the calls there are: after so many doublings only cycles are left.
    for _ in range(max(1, at.count()).bit_length() + 1):
        moving = at.where("next is not null")
        if moving.isEmpty():
            break
        jump = at.select(F.col("node").alias("next"), F.col("next").alias("beyond"), F.col("level").alias("more"))
        moved = looked_up(moving, jump, "next", "node").select("node", F.col("beyond").alias("next"), (F.col("level") + F.col("more")).alias("level"))
        at = written(at.where("next is null").unionByName(moved), "levels")
    return at.select("node.conv_id", "node.call_id", F.when(F.col("next").isNull(), F.col("level")).alias("level"))


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row a call: conv_id, call_id, level, rank (from 0 in its conversation), status, errors and record.

    ``calls``: conv_id, call_id, position, name, arguments (JSON), depends_on. ``results``: conv_id, call_id, position, content.
    """
    ids = "conv_id is not null and call_id is not null"
    calls = written(_first(calls.where(ids), ["conv_id", "call_id"], ["position", "name", "arguments", "depends_on"]), "calls")
    results = _first(results.where(ids), ["conv_id", "call_id"], ["position", "content"]).withColumnRenamed("position", "result_position")
    known = calls.select("conv_id", F.col("call_id").alias("depends_on"), F.lit(True).alias("_known"))
    waits = calls.where("depends_on is not null").select("conv_id", "call_id", "depends_on").withColumn("_w", F.struct("conv_id", "depends_on"))
    found = looked_up(waits, known.select(F.struct("conv_id", "depends_on").alias("_w"), "_known"), "_w", "call_id", "left").select("conv_id", "call_id", F.coalesce("_known", F.lit(False)).alias("_known"))
    joined = calls.join(found, ["conv_id", "call_id"], "left")
    graph = joined.select("conv_id", "call_id", F.when(F.col("_known"), F.col("depends_on")).alias("depends_on"))
    joined = joined.join(levels(graph), ["conv_id", "call_id"]).join(results, ["conv_id", "call_id"], "left")
    parsed = joined.withColumn("_args", F.try_parse_json("arguments")).withColumn("_kind", F.schema_of_variant("_args"))
    graph_errors = F.array(F.when(~F.coalesce("_known", F.lit(True)), F.lit("depends_on: unknown call")), F.when(F.col("level").isNull(), F.lit("depends_on: cycle")))
    checked = parsed.withColumn("errors", F.array_compact(F.concat(_errors(schemas), graph_errors)))
    record = F.to_json(F.struct(F.col("_args").alias("arguments"), F.col("call_id"), F.col("conv_id"), F.col("depends_on"), F.col("errors"), F.col("level"), F.col("name"), F.col("content").alias("result")), {"ignoreNullFields": "true"})
    status = F.when(F.size("errors") > 0, "invalid").when(F.col("result_position").isNull(), "pending").otherwise("complete")
    rows = written(checked.select("conv_id", "call_id", F.coalesce("level", F.lit((1 << 62))).alias("_level"), "level", "position", status.alias("status"), "errors", record.alias("record"), F.floor(F.coalesce("position", F.lit(-1)) / SLICE).alias("_slice")), "linked")
    # The calls before a slice: sums over the slices of its block of levels, and over the blocks before. A chain has a level
    # for each call, so one window over a conversation's levels would be a row for each of its calls.
    part = ["conv_id", "_block", "_level", "_slice"]
    rows = rows.withColumn("_block", F.floor(F.col("_level") / LEVELS))
    sums = lambda over: F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = rows.groupBy(*part).agg(F.count("*").alias("_n"))
    blocks = slices.groupBy("conv_id", "_block").agg(F.sum("_n").alias("_n")).select("conv_id", "_block", sums(Window.partitionBy("conv_id").orderBy("_block")).alias("_base"))
    counts = slices.select(*part, sums(Window.partitionBy("conv_id", "_block").orderBy("_level", "_slice")).alias("_before")).join(blocks, ["conv_id", "_block"])
    at = F.row_number().over(Window.partitionBy(*part).orderBy("position", "call_id")) - 1
    return rows.withColumn("_at", at).join(counts, part).select("conv_id", "call_id", "level", (F.col("_at") + F.col("_before") + F.col("_base")).cast("long").alias("rank"), "status", "errors", "record")


#: Turns of plain conversations as calls: a user's turn asks for a reply and waits for the exchange before it. It has to have
#: a text, and to follow a turn that is there; one that follows another user's turn is of a tool that there isn't.
REPLY: dict[str, Schema] = {"reply": {"after": ("string", True), "text": ("string", True), "n_chars": ("integer", True)}}


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns (conv_id, turn, role, text)."""
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    asked = conversations.where("role = 'user' and turn is not null and conv_id is not null").select("conv_id", "turn", "text")
    roles = conversations.where("conv_id is not null and turn is not null").groupBy("conv_id", (turn + 1).alias("turn")).agg(F.min("role").alias("_role"))
    asked = asked.join(roles, ["conv_id", "turn"], "left").withColumn("after", F.when(turn == 0, "start").otherwise(F.col("_role")))
    earlier = F.when(turn >= 2, name(turn - 2))
    arguments = F.to_json(F.struct("after", F.length("text").alias("n_chars"), "text"), {"ignoreNullFields": "true"})
    calls = asked.select("conv_id", name(turn).alias("call_id"), turn.alias("position"), F.when(F.col("after") == "user", "interruption").otherwise("reply").alias("name"), arguments.alias("arguments"), earlier.alias("depends_on"))
    results = conversations.where("role = 'assistant' and turn is not null").select("conv_id", name(turn - 1).alias("call_id"), turn.alias("position"), F.col("text").alias("content"))
    return calls, results


def digest(conversations: DataFrame) -> DataFrame:
    return linked(*exchanges(conversations), REPLY)
