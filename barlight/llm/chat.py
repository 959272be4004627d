"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.session import reliable_checkpoint

# Most rows of the table of tool parameters, which is broadcast.
MOST_PARAMETERS = 10_000


def _canonical(v: Column) -> Column:
    """JSON text of a variant: keys sorted, no white space."""
    return F.to_json(v)


def calls_of(messages: DataFrame) -> DataFrame:
    """``(conv, call_id, turn, name, args)`` of every call in ``{"tool_calls": [{"id", "name", "arguments"}]}``; the first one of an id, and how many there are."""
    v = F.try_parse_json("text")
    each = messages.select(F.col("conv_id").alias("conv"), "turn", F.posexplode(F.try_variant_get(v, "$.tool_calls", "array<variant>")).alias("pos", "c"))
    get = lambda p, kind: F.try_variant_get("c", p, kind)
    each = each.select("conv", F.coalesce(get("$.id", "string"), F.concat_ws("-", F.lit("turn"), F.col("turn"), F.col("pos"))).alias("call_id"),
                       F.struct("turn", "pos", get("$.name", "string").alias("name"), _canonical(get("$.arguments", "variant")).alias("args")).alias("m"))
    one = each.groupBy("conv", "call_id").agg(F.min("m").alias("m"), F.count(F.lit(1)).alias("n_calls"))
    return one.select("conv", "call_id", "m.turn", "m.name", "m.args", "n_calls")


def results_of(messages: DataFrame) -> DataFrame:
    """``(conv, call_id, result_turn, content)`` of every ``{"tool_call_id", "content"}``; the first one of an id, and how many there are."""
    v = F.try_parse_json("text")
    each = messages.select(F.col("conv_id").alias("conv"), F.try_variant_get(v, "$.tool_call_id", "string").alias("call_id"),
                           F.struct("turn", _canonical(F.try_variant_get(v, "$.content", "variant")).alias("content")).alias("m")).where("call_id is not null")
    one = each.groupBy("conv", "call_id").agg(F.min("m").alias("m"), F.count(F.lit(1)).alias("n_results"))
    return one.select("conv", "call_id", F.col("m.turn").alias("result_turn"), "m.content", "n_results")


def levels(calls: DataFrame) -> DataFrame:
    """``(conv, call_id, level)``: 0 for calls that refer to no other call, else one more than the deepest they refer to; null on or behind a cycle.

    A call refers to another of its conversation by an argument ``"@<call id>"``.
    Calls whose references are all done are peeled off, level by level; each
    round is two anti-joins on what is left, so the number of rounds is the depth.
    """
    values = F.map_values(F.from_json("args", "map<string,string>"))
    refs = calls.select("conv", "call_id", F.explode(F.array_distinct(F.filter(values, lambda x: x.startswith("@")))).alias("r"))
    refs = refs.select("conv", "call_id", F.expr("substring(r, 2)").alias("dep"))
    known = calls.select(F.col("conv").alias("c2"), F.col("call_id").alias("dep"))
    edges = reliable_checkpoint(refs.join(known, (F.col("conv").eqNullSafe(F.col("c2"))) & (refs.dep == known.dep), "left_semi"))
    node = ["conv", "call_id"]

    def without(a: DataFrame, b: DataFrame, key: str = "call_id") -> DataFrame:
        return a.join(b.select(*node).toDF("_c", "_i"), F.col("conv").eqNullSafe(F.col("_c")) & (F.col(key) == F.col("_i")), "left_anti")

    done = without(calls.select(*node), edges)
    out, level = done.select(*node, F.lit(0).alias("level")), 0
    while not edges.isEmpty():
        level += 1
        left = reliable_checkpoint(without(edges, done, "dep"))
        done = reliable_checkpoint(without(edges.select(*node).distinct(), left))
        if done.isEmpty():
            return out.unionAll(left.select(*node).distinct().withColumn("level", F.lit(None).cast("int")))
        out = out.unionAll(done.select(*node, F.lit(level).alias("level")))
        edges = left
    return out


def _fits(v: Column, kind: Column) -> Column:
    is_ = F.schema_of_variant(v)
    whole = is_ == "BIGINT"
    return (F.when(kind == "string", is_ == "STRING").when(kind == "integer", whole).when(kind == "number", whole | is_.startswith("DECIMAL") | is_.isin("DOUBLE", "FLOAT"))
            .when(kind == "boolean", is_ == "BOOLEAN").when(kind == "array", is_.startswith("ARRAY")).when(kind == "object", is_.startswith("OBJECT")).otherwise(F.lit(False)))


def errors_of(args: Column, params: Column) -> Column:
    """Sorted messages: what the parameters miss, have in a wrong kind, or do not know."""
    m = F.expr("try_cast(_v as map<string,variant>)")
    has = lambda k: F.coalesce(F.array_contains(F.map_keys(m), k), F.lit(False))
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~has(p["parameter"])), lambda p: F.concat(F.lit("missing "), p["parameter"]))
    wrong = F.transform(F.filter(params, lambda p: has(p["parameter"]) & ~_fits(F.try_element_at(m, p["parameter"]), p["kind"])), lambda p: F.concat(F.lit("kind "), p["parameter"]))
    names = F.transform(params, lambda p: p["parameter"])
    other = F.transform(F.array_except(F.map_keys(m), names), lambda k: F.concat(F.lit("unknown "), k))
    return F.when(params.isNull(), F.array(F.lit("unknown tool"))).when(m.isNull(), F.array(F.lit("arguments"))).otherwise(F.array_sort(F.concat(missing, wrong, other)))


def link_tool_calls(messages: DataFrame, parameters: DataFrame) -> DataFrame:
    """One row per call, and per result without a call: ``conv, call_id, name, turn, result_turn, level, n_calls, n_results, errors, json``.

    ``messages`` has ``conv_id, turn, text``; ``parameters`` has ``name,
    parameter, kind, required`` and at most ``MOST_PARAMETERS`` rows, else it
    raises. Calls and results are joined by conversation and identifier; ``level``
    then ``turn`` is a topological order. A call without an id is named after its
    place; of repeated ids the first counts and the numbers say how many there
    were. Texts that are null, empty or no such JSON hold no call. Null
    conversations count as one. Empty tables give no rows. Other columns are
    ignored. No step gathers a conversation, so its size does not matter.
    """
    if parameters.count() > MOST_PARAMETERS:
        raise ValueError(f"more than {MOST_PARAMETERS} parameters")
    calls, results = reliable_checkpoint(calls_of(messages)), results_of(messages)
    order = levels(calls).toDF("conv3", "id3", "level")
    known = parameters.groupBy(F.col("name").alias("tool")).agg(F.collect_list(F.struct("parameter", "kind", F.coalesce("required", F.lit(False)).alias("required"))).alias("params"))
    c = calls.join(order, F.col("conv").eqNullSafe(F.col("conv3")) & (F.col("call_id") == F.col("id3")), "left").join(F.broadcast(known), F.col("name") == F.col("tool"), "left")
    c = c.withColumn("_v", F.try_parse_json("args"))
    c = c.select(F.struct("conv", "call_id").alias("key"), "name", "turn", "level", "n_calls", "args", errors_of(F.col("_v"), F.col("params")).alias("errors"))
    r = results.select(F.struct("conv", "call_id").alias("key2"), "result_turn", "content", "n_results")
    both = c.join(r, F.col("key").eqNullSafe(F.col("key2")), "full")
    key = F.coalesce("key", "key2")
    errors = F.coalesce("errors", F.array(F.lit("no call")))
    line = F.struct(F.try_parse_json("args").alias("arguments"), key["call_id"].alias("call_id"), errors.alias("errors"), F.col("level").alias("level"), F.col("name").alias("name"),
                    F.try_parse_json("content").alias("result"), F.col("result_turn").alias("result_turn"), F.col("turn").alias("turn"))
    return both.select(key["conv"].alias("conv"), key["call_id"].alias("call_id"), "name", "turn", "result_turn", "level", F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
                       F.coalesce("n_results", F.lit(0)).alias("n_results"), F.array_join(errors, "; ").alias("errors"), F.to_json(line, {"ignoreNullFields": "false"}).alias("json"))
