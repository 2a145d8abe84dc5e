"""Chat formatting (native): tool-call linking.

Calls and results meet in a hash join by identifier, calls are put in topological order of what they depend on, their
arguments are validated against the tools' schemas, and each is serialised as canonical JSON: keys in order, no spaces.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written
from .quality_rules import let

#: What schema_of_variant says of a value, by JSON schema type.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}
#: Calls of a conversation that are put in order within a row, where some call waits for several; larger such conversations take rounds.
IN_A_ROW = 500


@dataclass(frozen=True)
class Tool:
    """`schema`: a JSON schema of the arguments, of the words WORDS, to any depth. A word that isn't known is an error, but for NOTES, which say nothing about values."""

    name: str
    schema: str

    @staticmethod
    def of(name: str, schema: dict) -> "Tool":
        return Tool(name, json.dumps(schema))


NONE = "cast(array() as array<string>)"
#: Words of schemas that are checked. additionalProperties is true, false or a schema; items a schema.
WORDS = "type properties required additionalProperties items enum const minimum maximum exclusiveMinimum exclusiveMaximum minLength maxLength pattern minItems maxItems anyOf".split()
NOTES = "title description default examples $schema $id $comment".split()


def is_number(v: Column) -> Column:
    return F.rlike(F.schema_of_variant(v), F.lit(f"^({KINDS['number']})$"))


def number(v: Column) -> Column:
    """A variant's number, null for anything else."""
    return F.when(is_number(v), F.try_variant_get(v, "$", "double"))


def is_kind(v: Column, kind: str) -> Column:
    """Whether a variant is of a type of KINDS. A number without fraction is an integer, however it is written."""
    own = F.rlike(F.schema_of_variant(v), F.lit(f"(?s)^({KINDS[kind]})$"))
    return own | F.coalesce(number(v) == F.floor(number(v)).cast("double"), F.lit(False)) if kind == "integer" else own


def equals(v: Column, value) -> Column:
    """Whether a variant is a value of JSON; numbers by value, objects whatever their keys' order."""
    if isinstance(value, int | float) and not isinstance(value, bool):
        return F.coalesce(number(v) == float(value), F.lit(False))
    return F.to_json(v) == json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def member(v: Column, name: str) -> Column:
    """A member of a variant that is an object, by any name."""
    plain = name.isidentifier()
    return F.try_variant_get(v, f"$.{name}", "variant") if plain else F.get(F.map_values(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: k == name)), F.lit(0))


def misfits(v: Column, schema: dict | bool, at: str = "") -> Column:
    """Array of what is wrong with a variant by a schema, each with the path of the value; empty where it fits."""
    say = lambda what: F.lit(f"{at or 'arguments'} {what}")
    if isinstance(schema, bool):
        return F.expr(NONE) if schema else F.array(say("is not allowed"))
    if strange := sorted(set(schema) - {*WORDS, *NOTES}):
        raise ValueError(f"{at or 'arguments'}: words of a schema that aren't known: {', '.join(strange)}")
    kinds = [schema["type"]] if isinstance(schema.get("type"), str) else list(schema.get("type", []))
    if unknown := [k for k in kinds if k not in KINDS]:
        raise ValueError(f"{at or 'arguments'}: types that aren't known: {', '.join(unknown)}")
    found, unless = [], lambda ok, what: F.when(~F.coalesce(ok, F.lit(True)), F.array(say(what)))
    if kinds:
        found.append(unless(reduce(Column.__or__, [is_kind(v, k) for k in kinds]), f"is not {' or '.join(kinds)}"))
    for word, values in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if values is not None:
            found.append(unless(reduce(Column.__or__, [equals(v, x) for x in values], F.lit(False)), "is none of its values" if word == "enum" else "is not its value"))
    n = number(v)
    for word, fits, what in (("minimum", n.__ge__, "less"), ("maximum", n.__le__, "more"), ("exclusiveMinimum", n.__gt__, "not more"), ("exclusiveMaximum", n.__lt__, "not less")):
        if word in schema:
            found.append(unless(fits(F.lit(float(schema[word]))), f"is {what} than {schema[word]:g}"))
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    is_object, is_array = F.rlike(F.schema_of_variant(v), F.lit("(?s)^OBJECT<")), F.rlike(F.schema_of_variant(v), F.lit("(?s)^ARRAY<"))
    size = F.when(is_array, F.size(F.try_variant_get(v, "$", "array<variant>")))
    for word, fits, what in (("minLength", F.length(text).__ge__, "shorter"), ("maxLength", F.length(text).__le__, "longer"), ("minItems", size.__ge__, "shorter"), ("maxItems", size.__le__, "longer")):
        if word in schema:
            found.append(unless(fits(F.lit(int(schema[word]))), f"is {what} than {schema[word]}"))
    if "pattern" in schema:
        found.append(unless(F.rlike(text, F.lit(schema["pattern"])), "does not match its pattern"))
    if "anyOf" in schema:
        found.append(unless(reduce(Column.__or__, [F.size(misfits(v, x, at)) == 0 for x in schema["anyOf"]], F.lit(False)), "fits none of its schemas"))
    keys = F.json_object_keys(F.to_json(v))
    for name, own in schema.get("properties", {}).items():
        path = f"{at}.{name}" if at else name
        missing = F.array(F.lit(f"missing {path}")) if name in schema.get("required", []) else F.expr(NONE)
        found.append(F.when(is_object, F.when(F.array_contains(keys, name), misfits(member(v, name), own, path)).otherwise(missing)))
    for name in [n for n in schema.get("required", []) if n not in schema.get("properties", {})]:
        found.append(F.when(is_object & ~F.array_contains(keys, name), F.array(F.lit(f"missing {f'{at}.{name}' if at else name}"))))
    others = schema.get("additionalProperties", True)
    known = F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")
    if others is False:
        more = F.array_except(keys, known)
        found.append(F.when(is_object, F.transform(F.sort_array(more), lambda k: F.concat(F.lit(f"unexpected {at}." if at else "unexpected "), k))))
    elif isinstance(others, dict):
        values = F.map_values(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~F.array_contains(known, k)))
        found.append(F.when(is_object, F.array_distinct(F.flatten(F.transform(values, lambda x: misfits(x, others, f"{at}.*" if at else "*"))))))
    if "items" in schema:
        wrong = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: misfits(x, schema["items"], f"{at}[]"))
        found.append(F.when(is_array, F.array_distinct(F.flatten(wrong))))
    return F.concat(F.expr(NONE), *[F.coalesce(f, F.expr(NONE)) for f in found])


def errors(name: Column, arguments: Column, tools: list[Tool]) -> Column:
    """Array of what is wrong with the arguments of a call; empty where they fit the tool's schema."""
    v = F.try_parse_json(arguments)
    case = F.array(F.lit("unknown tool"))
    for tool in tools:
        case = F.when(name == tool.name, misfits(v, json.loads(tool.schema))).otherwise(case)
    return F.when(v.isNull() | F.json_object_keys(arguments).isNull(), F.array(F.lit("arguments are not an object"))).otherwise(case)


def places(calls: DataFrame, in_a_row: int = IN_A_ROW) -> DataFrame:
    """calls(conv_id, call_id, pos, after), identifiers distinct -> conv_id, call_id, place: in the order of (place, pos, call_id) each call of a conversation
    comes after all that it depends on. Calls of a cycle and those behind one are missing.

    Where all calls of a conversation depend on earlier ones only, their positions are such an order. In others place is 0 for calls that wait for none, else one more than the highest
    that they wait for. Where each waits for one at most, pointers are doubled: rounds grow with the logarithm of the longest chain, however large the conversation. Else up to in_a_row calls are
    put in order within a row, and more of them by rounds (Kahn), one a level.
    """
    with scratch() as keep:
        ids = keep(written(calls.select("conv_id", "call_id", "pos"), "calls"))
        known = ids.select("conv_id", F.col("call_id").alias("dep"), F.col("pos").alias("_at"))
        waits = calls.select("conv_id", "call_id", "pos", F.explode(F.array_distinct("after")).alias("dep")).join(known.hint("shuffle_hash"), ["conv_id", "dep"])
        waits = written(waits, "waits")
        forward = ~F.coalesce(F.col("_at") < F.col("pos"), F.lit(False))
        fans = waits.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.max(forward.cast("int")).alias("forward"))
        tangled = keep(written(fans.groupBy("conv_id").agg(F.max("n").alias("most"), F.max("forward").alias("forward")).where("forward = 1").select("conv_id", "most"), "tangled"))
        out = ids.join(tangled, "conv_id", "left_anti").select("conv_id", "call_id", F.col("pos").cast("long").alias("place"))
        if tangled.isEmpty():
            return out
        own = written(ids.join(tangled, "conv_id").select("conv_id", "call_id", "most"), "tangled-calls")
        size = own.groupBy("conv_id").agg(F.max("most").alias("most"), F.count("*").alias("n"))
        size = written(size.select("conv_id", F.when(F.col("most") == 1, "chains").when(F.col("n") <= in_a_row, "row").otherwise("rounds").alias("way")), "ways")
        waits = waits.select("conv_id", "call_id", "dep")
        for way, order in (("chains", _chains), ("row", _in_rows), ("rounds", _rounds)):
            some = size.where(F.col("way") == way).select("conv_id")
            if not some.isEmpty():
                out = out.unionByName(keep(order(own.join(some, "conv_id", "left_semi").select("conv_id", "call_id"), waits.join(some, "conv_id", "left_semi"))))
    return out


def _chains(ids: DataFrame, waits: DataFrame) -> DataFrame:
    """Places where each call waits for one at most. After as many doublings as the number of calls has bits, only what is in or behind a cycle still waits."""
    state = written(ids.join(waits.hint("shuffle_hash"), ["conv_id", "call_id"], "left").select("conv_id", "call_id", "dep", F.when(F.col("dep").isNotNull(), 1).otherwise(0).cast("long").alias("place")), "chains")
    most = state.groupBy("conv_id").count().agg(F.max("count")).first()[0]
    for _ in range(int(most).bit_length()):
        if state.where("dep is not null").isEmpty():
            break
        to = state.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("_dep"), F.col("place").alias("_place"))
        step = state.join(to.hint("shuffle_hash"), ["conv_id", "dep"], "left")
        state = written(step.select("conv_id", "call_id", F.col("_dep").alias("dep"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place")), "chains")
    return written(state.where("dep is null").select("conv_id", "call_id", "place"), "chain-places")


def _in_rows(ids: DataFrame, waits: DataFrame) -> DataFrame:
    """Places within a row a conversation, of so many calls at most as the caller has checked: levels are raised until nothing changes."""
    deps = waits.groupBy("conv_id", "call_id").agg(F.collect_list("dep").alias("deps"))
    calls = ids.join(deps, ["conv_id", "call_id"], "left").select("conv_id", F.struct("call_id", F.coalesce("deps", F.expr(NONE)).alias("deps")).alias("c"))
    rows = calls.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    rows = rows.withColumn("ids", F.transform("c", lambda c: c["call_id"]))
    rows = rows.withColumn("at", F.transform("c", lambda c: F.transform(c["deps"], lambda d: F.array_position("ids", d).cast("int"))))
    unknown = F.transform("ids", lambda _: F.lit(-1))

    def step(acc: Column, _: Column) -> Column:
        level = lambda j: F.element_at(acc["l"], j)
        known = lambda at: F.forall(at, lambda j: level(j) >= 0)
        raised = F.transform("at", lambda at, i: F.when(level(i + 1) >= 0, level(i + 1)).when(known(at), F.aggregate(at, F.lit(0), lambda m, j: F.greatest(m, level(j) + 1))).otherwise(F.lit(-1)))
        return F.when(acc["more"], let(raised, lambda l: F.struct(l.alias("l"), (l != acc["l"]).alias("more")))).otherwise(acc)  # noqa: E741

    done = F.aggregate(F.sequence(F.lit(1), F.size("ids") + 1), F.struct(unknown.alias("l"), F.lit(True).alias("more")), step)
    each = rows.select("conv_id", F.explode(F.arrays_zip(F.col("ids").alias("call_id"), done["l"].alias("place"))).alias("z"))
    return written(each.select("conv_id", "z.call_id", F.col("z.place").cast("long").alias("place")).where("place >= 0"), "row-places")


def _rounds(ids: DataFrame, waits: DataFrame) -> DataFrame:
    """Places by Kahn's rounds, one a level; every 16 rounds what is ready so far becomes one table."""
    waits = written(waits, "waits")
    ready = written(ids.join(waits.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumn("place", F.lit(0).cast("long")), "places")
    out, depth = ready, 0
    while not ready.isEmpty():
        depth += 1
        left = written(waits.join(ready.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_anti"), "waits")
        free = waits.select("conv_id", "call_id").distinct().join(left.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
        ready, waits = written(free.withColumn("place", F.lit(depth).cast("long")), "places"), left
        out = out.unionByName(ready)
        if depth % 16 == 0:
            out = written(out, "places")
    return written(out, "places")


def plain(messages: DataFrame) -> DataFrame:
    """messages(conv_id, pos, role, content) that neither call nor answer -> rows like link()'s, one a message: no identifier, status `message`, its position as its place, and its role and content as canonical JSON."""
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit("null"))
    quoted = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(text(F.col(c)))
    whole = F.concat(F.lit('{"content":'), quoted("content"), F.lit(',"role":'), quoted("role"), F.lit("}"))
    none = F.lit(0).cast("long")
    return messages.select("conv_id", F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("status"), none.alias("n_calls"), none.alias("n_results"), F.col("pos").cast("long").alias("place"), F.lit(True).alias("valid"), F.expr(NONE).alias("errors"), whole.alias("json"))


def link(calls: DataFrame, results: DataFrame, tools: list[Tool]) -> DataFrame:
    """calls(conv_id, call_id, pos, name, arguments, after), results(conv_id, call_id, pos, content) -> one row an identifier: conv_id, call_id, status,
    n_calls, n_results, place, valid, errors, json.

    Of calls (results) that repeat an identifier the first by pos counts, then by content; how many there were is told, so copies make no pairs.
    status: linked, unanswered (no result) or orphan (a result without call: no place, not valid). A call in or behind a
    cycle has no place and the error `cyclic`; dependencies on unknown identifiers are errors that don't hold it back. Null arguments and text that isn't a JSON object are
    errors; a null identifier links with nothing and is left out; very long texts are kept whole; other columns are left out; an empty table gives an empty one.
    """
    calls = calls.where("conv_id is not null and call_id is not null")
    one = written(calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("pos", "name", "arguments", "after")).alias("c"), F.count("*").alias("n_calls")), "first-calls")
    answers = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("pos", "content")).alias("r"), F.count("*").alias("n_results"))
    flat = one.select("conv_id", "call_id", "c.pos", F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    place = places(flat)
    asked = flat.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("dep")).join(one.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_anti")
    unknown = asked.groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("unknown dependency "), F.col("dep")))).alias("unknown"))
    out = one.join(place, ["conv_id", "call_id"], "left").join(unknown, ["conv_id", "call_id"], "left").join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    c, none = F.col("c"), F.array().cast("array<string>")
    cyclic = F.when(c.isNotNull() & F.col("place").isNull(), F.array(F.lit("cyclic"))).otherwise(none)
    wrong = F.when(c.isNull(), F.array(F.lit("no call"))).otherwise(F.concat(errors(c["name"], c["arguments"], tools), F.coalesce("unknown", none), cyclic))
    out = out.withColumns({
        "status": F.when(c.isNull(), "orphan").when(F.col("r").isNull(), "unanswered").otherwise("linked"),
        "n_calls": F.coalesce("n_calls", F.lit(0)).cast("long"),
        "n_results": F.coalesce("n_results", F.lit(0)).cast("long"),
        "errors": wrong,
    })
    return out.select("conv_id", "call_id", "status", "n_calls", "n_results", "place", (F.size("errors") == 0).alias("valid"), "errors", canonical(c["name"], c["arguments"], F.col("call_id"), F.col("r.content")).alias("json"))


def canonical(name: Column, arguments: Column, call_id: Column, content: Column) -> Column:
    """One JSON object with keys in order; a value that isn't known is null. Objects inside the arguments have their keys in order as well, since a variant keeps them so; arguments that
    aren't JSON are a string."""
    text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    quoted = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(text(c))
    v = F.try_parse_json(arguments)
    return F.concat(F.lit('{"arguments":'), F.when(v.isNotNull(), F.to_json(v)).otherwise(quoted(arguments)), F.lit(',"id":'), quoted(call_id), F.lit(',"name":'), quoted(name), F.lit(',"result":'), quoted(content), F.lit("}"))


def turns(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, other messages): tool traffic of plain chats, messages(conv_id, turn, role, text): each user turn calls the tool `answer`, each assistant turn is the result of the turn before it; all other turns, such as the system's,
    are messages in their place.

    A call depends on the user turn before it; in conversations whose number leaves 1 by 5 on the one after it, so that positions are no order; in those that leave 2 the first and the
    second depend on each other."""
    own = messages.select("conv_id", "turn", "role", "text")
    at = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    kind = F.pmod(F.col("conv_id").cast("long"), F.lit(5))
    before = F.when(F.col("turn") >= 2, F.array(at(2))).otherwise(F.expr(NONE))
    after = F.when((kind == 1) | ((kind == 2) & (F.col("turn") < 2)), F.array(at(-2))).otherwise(before)
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    calls = own.where("role = 'user'").select("conv_id", at(0).alias("call_id"), F.col("turn").alias("pos"), F.lit("answer").alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = own.where("role = 'assistant'").select("conv_id", at(1).alias("call_id"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    others = own.where("role is null or role not in ('user', 'assistant')").select("conv_id", F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    return calls, results, others


#: The schema that plain chats' calls are held against.
ANSWER = Tool.of("answer", {"type": "object", "properties": {"prompt": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["prompt", "turn"], "additionalProperties": False})
