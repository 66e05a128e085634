"""Chat formatting: tool calls linked with their results, ordered, validated, as canonical JSON.

Calls (call_id, name, arguments: map of texts, depends_on: ids) and results (call_id, content) are
joined by identifier. A call's level is the longest chain of calls below it. A round shortens every
chain of calls by half, so a chain takes as many rounds as the logarithm of its length; only where calls
wait for several open calls can it be one for each level. Arguments are checked against schemas (name, argument, type, required), a table of a user's tools. The JSON has
its keys in order, no white space, and nulls spelled out. DataFrame operations only.

Nulls and repeats: calls with a null id are dropped. Calls that repeat an id but not their name, arguments
and dependencies have a row each and share a level, which waits for what any of them needs; equal ones are one. Of
results the smallest content stays, and ``n_results`` counts them. Results without a
call are left out. A missing result is null. Null arguments are none; a null value counts as not
given. A dependency that isn't a call is an error and not waited for; so is a repeated one counted once. Calls on a
cycle, or behind one, have a null level and an error. An empty table gives an empty result. Extra
columns of the calls are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowhelm.llm.storage import stored

TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}


def levels(calls: DataFrame, waits: DataFrame) -> DataFrame:
    """call_id and level (0: waits for none; null: on or behind a cycle). waits: (call_id, needs), both known calls.

    A row (call_id, needs, steps) says: the level is at least that of ``needs`` plus ``steps``, or ``steps``
    where ``needs`` is null. A round puts the rows of a needed call that itself waits for at most one other in
    its place, so chains halve, and a call whose needs are all settled is settled. When a round settles no
    call, the open ones are on or behind a cycle.
    """
    start = calls.select("call_id", F.lit(None).cast("string").alias("needs"), F.lit(0).cast("bigint").alias("steps"))
    rows = stored(start.union(waits.distinct().select("call_id", "needs", F.lit(1).cast("bigint"))), "waits")
    n_open = None
    while True:
        waiting = rows.filter("needs is not null")
        left = waiting.select("call_id").distinct().count()
        if left in (0, n_open):
            break
        n_open = left
        steps = F.col("steps")
        single = (
            rows.groupBy(F.col("call_id").alias("needs"))
            .agg(
                F.count("needs").alias("n"), F.max("needs").alias("next"),
                F.max(F.when(F.col("needs").isNull(), steps)).alias("own"), F.max(F.when(F.col("needs").isNotNull(), steps)).alias("on"),
            )
            .filter("n <= 1")
        )
        # Steps round a cycle would grow without end; a true level never comes near this.
        further = lambda more: F.least(steps + more, F.lit(2**53))
        settled = F.struct(F.lit(None).cast("string").alias("needs"), further(F.col("own")).alias("steps"))
        onward = F.struct(F.col("next").alias("needs"), further(F.col("on")).alias("steps"))
        replaced = (
            F.when(F.col("n").isNull(), F.array(F.struct("needs", "steps")))
            .when(F.col("next").isNull(), F.array(settled))
            .otherwise(F.array(settled, onward))
        )
        moved = waiting.join(single, "needs", "left").select("call_id", F.inline(replaced))
        rows = stored(rows.filter("needs is null").unionByName(moved).groupBy("call_id", "needs").agg(F.max("steps").alias("steps")), "waits")
    level = F.when(F.count("needs") == 0, F.max("steps")).cast("int")
    return rows.groupBy("call_id").agg(level.alias("level"))


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """call_id, variant and its errors in order, for calls that have any."""
    tools = schemas.groupBy("name").agg(F.collect_list(F.struct("argument", "type", "required")).alias("tool"))
    given = F.map_filter(F.coalesce("arguments", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    both = calls.select("call_id", "variant", "name", given.alias("given")).join(tools, "name", "left")

    def fits(kind: Column, value: Column) -> Column:
        out = F.lit(False)
        for name, cast in TYPES.items():
            out = F.when(kind == name, value.try_cast(cast).isNotNull()).otherwise(out)
        return out

    missing = F.transform(F.filter("tool", lambda a: a.required & ~F.map_contains_key("given", a.argument)), lambda a: F.concat(F.lit("missing:"), a.argument))
    wrong = F.transform(
        F.filter("tool", lambda a: F.map_contains_key("given", a.argument) & ~fits(a["type"], F.element_at("given", a.argument))),
        lambda a: F.concat(F.lit("type:"), a.argument),
    )
    known = F.transform("tool", lambda a: a.argument)
    extra = F.transform(F.array_except(F.map_keys("given"), known), lambda k: F.concat(F.lit("unknown:"), k))
    errors = F.when(F.col("tool").isNull(), F.array(F.lit("unknown tool"))).otherwise(F.array_sort(F.concat(missing, wrong, extra)))
    return both.select("call_id", "variant", errors.alias("errors")).filter(F.size("errors") > 0)


def canonical_json(call_id: Column, name: Column, arguments: Column, result: Column) -> Column:
    ordered = F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(arguments, F.create_map().cast("map<string,string>")))))
    return F.to_json(
        F.struct(ordered.alias("arguments"), call_id.alias("id"), name.alias("name"), result.alias("result")), {"ignoreNullFields": "false"}
    )


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """call_id, level, n_results, valid, errors (joined by commas) and json of each distinct call."""
    entries = F.array_sort(F.map_entries("arguments"))
    depends_on = F.array_sort(F.coalesce("depends_on", F.array().cast("array<string>")))
    calls = calls.filter("call_id is not null").select("call_id", "name", entries.alias("entries"), depends_on.alias("depends_on")).distinct()
    variant = F.sha2(F.to_json(F.struct("name", "entries", "depends_on")), 256)
    calls = stored(calls.select("call_id", "name", F.map_from_entries("entries").alias("arguments"), "depends_on", variant.alias("variant")), "calls")
    answers = results.filter("call_id is not null").groupBy("call_id").agg(F.min("content").alias("result"), F.count("*").alias("n_results"))
    needs = calls.select("call_id", F.explode("depends_on").alias("needs")).distinct()
    known = needs.join(calls.select(F.col("call_id").alias("needs"), F.lit(True).alias("known")), "needs", "left")
    known = stored(known, "needs")
    lost = known.filter("known is null").groupBy("call_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("dependency:"), F.coalesce("needs", F.lit(""))))).alias("lost"))
    placed = levels(calls.select("call_id").distinct(), known.filter("known").select("call_id", "needs"))
    none = F.array().cast("array<string>")
    out = (
        calls.join(answers, "call_id", "left")
        .join(placed, "call_id")
        .join(argument_errors(calls, schemas), ["call_id", "variant"], "left")
        .join(lost, "call_id", "left")
    )
    cycle = F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(none)
    errors = F.concat(F.coalesce("errors", none), F.coalesce("lost", none), cycle)
    return out.select(
        "call_id", "level", F.coalesce("n_results", F.lit(0)).alias("n_results"), (F.size(errors) == 0).alias("valid"), F.array_join(errors, ",").alias("errors"),
        canonical_json(F.col("call_id"), F.col("name"), F.col("arguments"), F.col("result")).alias("json"),
    )
