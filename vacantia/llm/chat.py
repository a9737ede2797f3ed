"""Tool-call linking and canonical chat records.

Messages come one row each: (conv_id, turn, role, text, calls array<struct<id, name, arguments>>, answers), where ``arguments`` is
JSON text and ``answers`` the id of the call that a tool message answers. Every message is one event, and so is every call. Calls and
results meet in a hash join on (conversation, id). Events are put in topological order: a result after its call, whatever their
turns. Arguments are validated against the tool's schema, and every event is written as canonical JSON: keys
sorted by code point, no spaces, numbers as they are.

An event's level is 0 for what depends on nothing and one more than its call's level for a result. As calls only depend on
the message that makes them, sorting by (turn of the call or own turn, level, turn, place) is a topological order. Places within
a conversation come from a global sort in ranges and the first rank of the conversation, so a conversation
with a third of all rows is spread over many tasks; no conversation is gathered.

Defined results: a call without a result is ``unanswered``, a result without a call is an ``orphan``, and both are kept. If an id is
called more than once in a conversation, the first call (turn, place) owns it and the others are ``repeated``; a second result of one
call is ``repeated`` too, and all are kept. Arguments that are null or not a JSON object are invalid; so are those of a tool without a schema.
Null texts are JSON null. Null conversation ids form one conversation of their own. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators.ranking import rank_rows

CALLS = "array<struct<id: string, name: string, arguments: string>>"
# JSON kinds a schema can ask for, as the SQL names of a variant's schema.
_KINDS = {
    "string": r"^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$",
    "boolean": r"^BOOLEAN$",
    "object": r"^OBJECT<",
    "array": r"^ARRAY<",
}


@dataclass(frozen=True)
class Field:
    """One argument of a tool: its JSON kind, whether it must be given, and bounds on a number or a text's length."""

    name: str
    kind: str
    required: bool = True
    least: float | None = None
    most: float | None = None


def _field_ok(arguments: Column, field: Field) -> Column:
    path = f"$['{field.name}']"
    kind = F.schema_of_variant(F.try_variant_get(arguments, path, "variant"))
    given = kind.isNotNull() & (kind != "VOID")
    good = F.coalesce(kind.rlike(_KINDS[field.kind]), F.lit(False))
    if field.least is not None or field.most is not None:
        text = F.try_variant_get(arguments, path, "string")
        measure = F.length(text).cast("double") if field.kind == "string" else text.try_cast("double")
        if field.least is not None:
            good = good & F.coalesce(measure >= field.least, F.lit(False))
        if field.most is not None:
            good = good & F.coalesce(measure <= field.most, F.lit(False))
    return F.when(given, good).otherwise(F.lit(not field.required))


def valid_arguments(name: Column, arguments: Column, schemas: dict[str, list[Field]]) -> Column:
    """Do the arguments hold what the tool's schema asks for, and nothing it does not name?"""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT<"), F.lit(False))
    out = F.lit(False)
    for tool, fields in schemas.items():
        known = F.size(F.array_except(F.json_object_keys(arguments), F.array(*(F.lit(f.name) for f in fields)))) == 0
        good = F.coalesce(known, F.lit(False))
        for field in fields:
            good = good & _field_ok(parsed, field)
        out = F.when(name == tool, good).otherwise(out)
    return F.coalesce(is_object & out, F.lit(False))


def canonical(arguments: Column) -> Column:
    """An object with its keys sorted and no spaces; null where it is not an object."""
    parsed = F.try_parse_json(arguments)
    # A map of values as JSON text, written key by key in order.
    as_map = F.from_json(F.to_json(parsed), "map<string, variant>")
    entries = F.array_sort(F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))))
    body = F.array_join(F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ",")
    return F.when(F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT<"), F.lit(False)), F.concat(F.lit("{"), body, F.lit("}")))


def _quoted(text: Column) -> Column:
    """A string as JSON; ``to_json`` writes it inside an array of one."""
    alone = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substr(alone, F.lit(2), F.length(alone) - 2))


def _record(**fields: Column) -> Column:
    """A JSON object of already written values, keys in order."""
    parts = []
    for name in sorted(fields):
        parts += [F.lit(("," if parts else "") + f'"{name}":'), F.coalesce(fields[name], F.lit("null"))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def events(messages: DataFrame) -> DataFrame:
    """A row per message (place -1) and a row per call (place from 0)."""
    rows = messages.select("conv_id", "turn", "role", "text", F.col("calls").cast(CALLS).alias("calls"), F.col("answers").cast("string").alias("answers"))
    said = rows.select(
        "conv_id", "turn", F.lit(-1).alias("place"), F.when(F.col("answers").isNotNull(), F.lit("result")).otherwise(F.lit("message")).alias("kind"),
        "role", "text", F.col("answers").alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
    )
    called = rows.select("conv_id", "turn", "role", F.posexplode("calls").alias("place", "call")).select(
        "conv_id", "turn", "place", F.lit("call").alias("kind"), "role", F.lit(None).cast("string").alias("text"),
        F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"),
    )
    return said.unionByName(called)


def link(messages: DataFrame, schemas: dict[str, list[Field]]) -> DataFrame:
    """One row per event: conv_id, position, turn, kind, call_id, name, status, valid, record.

    ``valid`` is null but for calls. ``position`` counts from 0 in each conversation, in topological order.
    """
    rows = events(messages)
    here = F.struct("turn", "place")
    conv = F.coalesce(F.to_json(F.struct(F.col("conv_id").alias("c"))), F.lit("{}"))
    keyed = rows.withColumn("_conv", conv)
    owner = keyed.where((F.col("kind") == "call") & F.col("call_id").isNotNull()).groupBy("_conv", "call_id").agg(F.min(here).alias("_call"))
    answer = keyed.where(F.col("kind") == "result").groupBy("_conv", "call_id").agg(F.min(here).alias("_result"))
    pairs = owner.join(answer, ["_conv", "call_id"], "full")
    # Only calls and results meet by id; messages, of which one conversation may hold most, stay where they are.
    meets = F.col("call_id").isNotNull()
    nothing = [F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in ("_call", "_result")]
    linked = keyed.where(meets).join(pairs, ["_conv", "call_id"], "left").unionByName(keyed.where(~meets).select("*", *nothing))
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    status = (
        F.when(is_call & F.col("call_id").isNull(), "unanswered")
        .when(is_call & (here != F.col("_call")), "repeated")
        .when(is_call & F.col("_result").isNull(), "unanswered")
        .when(is_result & F.col("_call").isNull(), "orphan")
        .when(is_result & (here != F.col("_result")), "repeated")
        .when(is_call | is_result, "linked")
    )
    # A result that stands before its call moves behind it; all else keeps its turn.
    after = F.when(is_result & F.col("_call").isNotNull(), F.greatest(F.col("turn"), F.col("_call.turn"))).otherwise(F.col("turn"))
    level = F.when(is_call, 1).when(is_result, 2).otherwise(0)
    told = linked.select(
        "conv_id", "_conv", "turn", "place", "kind", "call_id", "name", status.alias("status"), after.alias("_after"), level.alias("_level"),
        F.when(is_call, valid_arguments(F.col("name"), F.col("arguments"), schemas)).alias("valid"),
        F.when(is_call, _record(arguments=F.coalesce(canonical(F.col("arguments")), _quoted(F.col("arguments"))), id=_quoted(F.col("call_id")), name=_quoted(F.col("name")), type=F.lit('"call"')))
        .when(is_result, _record(content=_quoted(F.col("text")), id=_quoted(F.col("call_id")), role=_quoted(F.col("role")), type=F.lit('"result"')))
        .otherwise(_record(content=_quoted(F.col("text")), role=_quoted(F.col("role")), type=F.lit('"message"')))
        .alias("record"),
    )
    ranked = rank_rows(told, "_conv", F.col("_after").asc_nulls_first(), "_level", F.col("turn").asc_nulls_first(), "place", "record", rank="_rank")
    begins = ranked.groupBy("_conv").agg(F.min("_rank").alias("_begin"))
    return ranked.join(begins, "_conv").select(
        "conv_id", (F.col("_rank") - F.col("_begin")).alias("position"), "turn", "kind", "call_id", "name", "status", "valid", "record"
    )


REPLY = {
    "reply": [Field("language", "string", required=False), Field("prompt", "string", least=1), Field("words", "integer", least=1, most=200)],
}


def with_reply_calls(turns: DataFrame) -> DataFrame:
    """Plain conversations as tool use: each user turn calls ``reply``, and the assistant turns after it answer that call.

    The turn that is answered is the last user turn before; it is found by a running maximum over the conversation's turns in
    blocks, so that a very long conversation does not meet in one task.
    """
    block = F.floor(F.col("turn") / _TURNS)
    asked = F.when(F.col("role") == "user", F.col("turn"))
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.select("conv_id", "turn", "role", "text").withColumn("_block", block)
    per_block = placed.groupBy("conv_id", "_block").agg(F.max(asked).alias("_asked"))
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = per_block.select("conv_id", "_block", F.max("_asked").over(earlier).alias("_before"))
    rows = (
        placed.withColumn("_inside", F.max(asked).over(inside))
        .join(before.withColumnsRenamed({"conv_id": "_c", "_block": "_b"}), F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("_block").eqNullSafe(F.col("_b")), "left")
        .withColumn("_of", F.coalesce("_inside", "_before"))
    )
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    arguments = F.to_json(F.struct(words.alias("words"), F.col("text").alias("prompt")))
    call = F.struct(F.concat(F.lit("call-"), F.col("turn").cast("string")).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    return rows.select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("role") == "user", F.array(call)).otherwise(F.array().cast(CALLS)).alias("calls"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("call-"), F.coalesce(F.col("_of").cast("string"), F.lit("none")))).alias("answers"),
    )


_TURNS = 1024
