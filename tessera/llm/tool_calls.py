"""Chat formatting: links tool calls with their results, orders them, validates arguments, serialises canonical JSON.

Main path: DataFrame functions only. A message is a row (conv_id, turn, role, text). An assistant message may be
a JSON object {"tool_calls": [{"id", "name", "arguments": {...}, "depends_on": [ids]}, ...]}; a tool message
is {"tool_call_id", "content"}. A schema is a row (name, field, type, required), with type one of string, integer,
number, boolean, object, array, null.

Calls and results are reduced to one row for each (conversation, identifier) by partial aggregates and then
hash-joined on it; a conversation is never gathered, so one that holds a third of all rows is spread like any other.
A call's level is 0 without dependencies, else one more than the highest level it depends on; chains of calls with one
dependency are shortened by pointer doubling, and the rest is settled round by round over the edges alone. (level, turn, slot) is a topological order within a conversation; a result stands right after its call.

Defined results. status: linked; unanswered (no result); orphan (no call); early (the result stands before the call).
The first of several calls or results with one identifier counts, by turn, then slot, then JSON; n_calls and n_results say how many there
were. valid: arguments are an object, all required fields are there, all fields are known and have their type; a tool
without schema is not valid; null for orphans. Calls in or behind a cycle, or behind an unknown identifier,
have level null. Null, empty and other texts are plain messages and give no rows; rows with null conv_id or turn are
read like others, and null joins null; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import discard, settle

SCHEMA_ROWS = 100_000
KIND = "CASE WHEN k = 'STRING' THEN 'string' WHEN k = 'BIGINT' THEN 'integer' WHEN k LIKE 'DECIMAL%' OR k IN ('DOUBLE', 'FLOAT') THEN 'number' WHEN k = 'BOOLEAN' THEN 'boolean' WHEN k LIKE 'OBJECT%' THEN 'object' WHEN k LIKE 'ARRAY%' THEN 'array' ELSE 'null' END"


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All calls (conv_id, turn, slot, call_id, name, arguments, depends_on) and all results (conv_id, turn, call_id, content)."""
    spark = messages.sparkSession
    base = messages.select(F.col("conv_id").cast("string"), F.col("turn").cast("long"), "role", F.col("text").cast("string"))
    said = base.where("role = 'assistant'").select("conv_id", "turn", F.expr("try_variant_get(try_parse_json(text), '$.tool_calls', 'variant')").alias("v"))
    said = said.where("schema_of_variant(v) LIKE 'ARRAY%'")
    calls = spark.sql("SELECT conv_id, turn, e.pos AS slot, e.value AS c FROM {said}, LATERAL variant_explode(v) AS e", said=said).selectExpr(
        "conv_id", "turn", "CAST(slot AS long) AS slot", "try_variant_get(c, '$.id', 'string') AS call_id", "try_variant_get(c, '$.name', 'string') AS name", "to_json(try_variant_get(c, '$.arguments', 'variant')) AS arguments", "try_variant_get(c, '$.depends_on', 'array<string>') AS depends_on"
    )
    back = base.where("role = 'tool'").select("conv_id", "turn", F.expr("try_parse_json(text)").alias("v"))
    results = back.selectExpr("conv_id", "turn", "try_variant_get(v, '$.tool_call_id', 'string') AS call_id", "to_json(try_variant_get(v, '$.content', 'variant')) AS content")
    return calls.where("call_id IS NOT NULL"), results.where("call_id IS NOT NULL")


def violations(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, call_id, bad: how many rules its arguments break."""
    spark = calls.sparkSession
    given = calls.select("conv_id", "call_id", "name", F.expr("try_parse_json(arguments)").alias("a"))
    fields = spark.sql("SELECT conv_id, call_id, name, e.key AS field, schema_of_variant(e.value) AS k FROM {given}, LATERAL variant_explode(CASE WHEN schema_of_variant(a) LIKE 'OBJECT%' THEN a END) AS e", given=given).withColumn("kind", F.expr(KIND))
    rules = settle(schemas.select(F.col("name").alias("_n"), F.col("field").alias("_f"), F.col("type").alias("_t"), F.coalesce("required", F.lit(False)).alias("_r")).where("_n IS NOT NULL").distinct())
    must = rules.groupBy("_n").agg(F.count_if("_r").alias("_must"))
    if rules.count() <= SCHEMA_ROWS:
        rules, must = F.broadcast(rules), F.broadcast(must)
    fits = (F.col("_t") == F.col("kind")) | ((F.col("_t") == "number") & (F.col("kind") == "integer"))
    seen = fields.join(rules, (F.col("name") == F.col("_n")) & (F.col("field") == F.col("_f")), "left")
    seen = seen.groupBy("conv_id", "call_id").agg(F.count_if(~F.coalesce(fits, F.lit(False))).alias("_wrong"), F.count_if(F.coalesce("_r", F.lit(False))).alias("_has"))
    seen = seen.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), "_wrong", "_has")
    every = given.select("conv_id", "call_id", "name", F.coalesce(F.expr("schema_of_variant(a) LIKE 'OBJECT%'"), F.lit(False)).alias("_object")).join(must, F.col("name") == F.col("_n"), "left")
    every = every.join(seen, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_i")), "left")
    missing = F.col("_must") - F.coalesce("_has", F.lit(0))
    return every.select("conv_id", "call_id", F.when(~F.col("_object") | F.col("_must").isNull(), F.lit(1)).otherwise(missing + F.coalesce("_wrong", F.lit(0))).alias("bad"))


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _jumps(edges: DataFrame) -> DataFrame:
    """Calls with one dependency: to, the first call behind them that has not just one (or isn't there), and d, the steps to it.

    Pointers double until none moves, so a chain of n calls takes log2(n) rounds; those that then still move are in or
    behind a cycle, and to is null.
    """
    one = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("dep").alias("to"))
    now = settle(one.where("n = 1").select("conv_id", "call_id", "to", F.lit(1).cast("long").alias("d"), F.lit(True).alias("moves")))
    for _ in range(now.count().bit_length() + 1):
        step = now.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.col("to").alias("_to"), F.col("d").alias("_d"))
        new = now.join(step, _same("conv_id", "_c") & (F.col("to") == F.col("_i")), "left")
        new = settle(new.select("conv_id", "call_id", F.coalesce("_to", "to").alias("to"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"), F.col("_i").isNotNull().alias("moves")))
        discard(now)
        now = new
        if now.where("moves").isEmpty():
            break
    return now.withColumn("to", F.when(~F.col("moves"), F.col("to"))).drop("moves")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of calls that have dependencies; without level where these can't be met.

    Chains are first made one step each; then calls with several dependencies are settled round by round.
    """
    edges = settle(calls.select("conv_id", "call_id", F.explode("depends_on").alias("dep")).distinct())
    if edges.isEmpty():
        return edges.select("conv_id", "call_id", F.lit(None).cast("long").alias("level"))
    waits = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"))
    jumps = _jumps(edges)
    step = jumps.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), "to", "d")
    many = edges.join(waits.where("n > 1").select(F.col("conv_id").alias("_wc"), F.col("call_id").alias("_wi")), _same("conv_id", "_wc") & (F.col("call_id") == F.col("_wi")), "left_semi")
    many = many.join(step, _same("conv_id", "_c") & (F.col("dep") == F.col("_i")), "left")
    # a dependency in a cycle has no target, and is never met
    open_ = settle(many.select("conv_id", "call_id", F.when(F.col("_i").isNotNull(), F.col("to")).otherwise(F.col("dep")).alias("dep"), (F.coalesce("d", F.lit(0)) + 1).alias("w")))
    none = waits.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"))
    done = settle(calls.select("conv_id", "call_id").join(none, _same("conv_id", "_c") & (F.col("call_id") == F.col("_i")), "left_anti").withColumn("level", F.lit(0).cast("long")))
    while not open_.isEmpty():
        known = done.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), "level")
        state = open_.join(known, _same("conv_id", "_c") & (F.col("dep") == F.col("_i")), "left").groupBy("conv_id", "call_id").agg(F.bool_and(F.col("level").isNotNull()).alias("ready"), F.max(F.col("level") + F.col("w")).alias("level"))
        new = settle(state.where("ready").select("conv_id", "call_id", "level"))
        if new.isEmpty():
            break
        done = settle(done.union(new))
        open_ = settle(open_.join(new.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i")), _same("conv_id", "_c") & (F.col("call_id") == F.col("_i")), "left_anti"))
    known = done.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), "level")
    single = jumps.join(known, _same("conv_id", "_c") & (F.col("to") == F.col("_i")), "left").select("conv_id", "call_id", (F.col("level") + F.col("d")).alias("level"))
    several = waits.where("n > 1").join(known, _same("conv_id", "_c") & (F.col("call_id") == F.col("_i")), "left").select("conv_id", "call_id", "level")
    return single.union(several)


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, call_id, name, call_turn, slot, result_turn, level, n_calls, n_results, status, valid, json: one row for each identifier."""
    calls, results = parse(messages)
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "slot", "name", "arguments", "depends_on")).alias("c"), F.count("*").alias("n_calls"))
    first = settle(first.select("conv_id", "call_id", "c.*", "n_calls"))
    answer = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    answer = answer.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    both = first.join(answer.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "full_outer")
    both = both.select(F.coalesce("conv_id", "rc").alias("conv_id"), F.coalesce("call_id", "ri").alias("call_id"), "name", F.col("turn").alias("call_turn"), "slot", "arguments", "content", "result_turn", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"))
    rules = violations(first, schemas).select(F.col("conv_id").alias("_vc"), F.col("call_id").alias("_vi"), "bad")
    depth = levels(first).select(F.col("conv_id").alias("_lc"), F.col("call_id").alias("_li"), "level", F.lit(True).alias("_waits"))
    out = both.join(rules, F.col("conv_id").eqNullSafe(F.col("_vc")) & (F.col("call_id") == F.col("_vi")), "left").join(depth, F.col("conv_id").eqNullSafe(F.col("_lc")) & (F.col("call_id") == F.col("_li")), "left")
    status = F.when(F.col("n_calls") == 0, "orphan").when(F.col("n_results") == 0, "unanswered").when(F.col("result_turn") < F.col("call_turn"), "early").otherwise("linked")
    whole = F.expr("to_json(to_variant_object(named_struct('arguments', try_parse_json(arguments), 'call_id', call_id, 'name', name, 'result', try_parse_json(content))))")
    return out.select(
        "conv_id", "call_id", "name", "call_turn", "slot", "result_turn", F.when(F.col("n_calls") > 0, F.when(F.col("_waits"), F.col("level")).otherwise(0)).cast("long").alias("level"), "n_calls", "n_results", status.alias("status"), F.when(F.col("n_calls") > 0, F.coalesce(F.col("bad") == 0, F.lit(False))).alias("valid"), whole.alias("json")
    )


def as_calls(conversations: DataFrame) -> DataFrame:
    """A conversation as tool messages: each user turn is a call, and an assistant turn answers the turn before it.

    The first user turn calls "ask", the others "follow_up", which depends on the user turn before it, the third one on both before it. Arguments: text (unless null), turn,
    lines if there are several, and from the seventh turn on a limit as text.
    """
    call = """named_struct('id', concat(conv_id, ':', turn), 'name', if(turn < 2, 'ask', 'follow_up'),
      'arguments', named_struct('limit', if(turn >= 6, string(turn), null), 'lines', if(text like '%\\n%', length(text) - length(replace(text, '\\n', '')) + 1, null), 'text', text, 'turn', turn),
      'depends_on', filter(array(if(turn >= 2, concat(conv_id, ':', turn - 2), null), if(turn IN (4, 5), concat(conv_id, ':', turn - 4), null)), x -> x is not null))"""
    ask = F.expr(f"to_json(named_struct('tool_calls', array({call})))")
    reply = F.expr("to_json(named_struct('tool_call_id', concat(conv_id, ':', turn - 1), 'content', coalesce(text, '')))")
    rows = conversations.where("role IN ('user', 'assistant')")
    asked = F.col("role") == "user"
    return rows.select("conv_id", "turn", F.when(asked, "assistant").otherwise("tool").alias("role"), F.when(asked, ask).otherwise(reply).alias("text"))
