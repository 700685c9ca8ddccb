"""Chat formatting with linked tool calls, in DataFrame operations only.

A message's text may be a JSON object: an assistant's with a list tool_calls of {id, name, arguments, depends_on} or of
{id, function: {name, arguments}} (arguments may be a string of JSON), a tool's with tool_call_id and content; any other
text, JSON or not, is plain content. Further keys are kept. Calls and results are joined by (conversation, identifier); arguments are held against the
tools' parameters; a result follows its call and a call the results that it depends on. Messages are returned one by one
in that order, each as canonical JSON (keys sorted, no blanks, nothing null).

A conversation may hold a third of all messages: nothing is gathered by conversation. The order is a sort key, and places
in a conversation are global ranks (from totals of range partitions) less the conversation's first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import ranged, release, save, table

#: Types of parameters and the types of JSON values that they take.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}
TOOLS = "name string, parameter string, type string, required boolean"
#: Where no list names the tools: calls of a name that are enough to learn from, the share of them that a type or a
#: required parameter must have, and the share that makes a parameter known.
ENOUGH, AGREE, KNOWN = 20, 0.9, 0.05


def _calls(messages: DataFrame) -> DataFrame:
    """A row for each tool call: its message, identifier, name, arguments, the identifiers that it depends on and its other
    keys; raw where it is no object."""
    lists = messages.where("role = 'assistant'").selectExpr("mid", "conv_id", "turn", "try_variant_get(body, '$.tool_calls', 'array<variant>') AS calls")
    each = lists.selectExpr("mid", "conv_id", "turn", "posexplode(calls) AS (k, call)").selectExpr(
        "*", "coalesce(try_variant_get(call, '$.arguments', 'variant'), try_variant_get(call, '$.function.arguments', 'variant')) AS given",
        "try_variant_get(call, '$', 'map<string,variant>') AS own", "try_variant_get(call, '$.function', 'map<string,variant>') AS wrapped",
    )
    inside = "try_parse_json(try_variant_get(given, '$', 'string'))"
    return each.selectExpr(
        "mid", "conv_id", "turn", "k", "try_variant_get(call, '$.id', 'string') AS call_id",
        "coalesce(try_variant_get(call, '$.name', 'string'), try_variant_get(call, '$.function.name', 'string')) AS name",
        f"CASE WHEN schema_of_variant(given) = 'STRING' AND schema_of_variant({inside}) LIKE 'OBJECT%' THEN {inside} ELSE given END AS arguments",
        "try_variant_get(call, '$.depends_on', 'array<string>') AS depends_on",
        f"concat({_entries('own', 'id', 'name', 'arguments', 'function', 'depends_on')}, filter({_entries('wrapped', 'name', 'arguments')}, w -> own[w.key] IS NULL)) AS more",
        "CASE WHEN own IS NULL THEN to_json(call) END AS raw",
    )


def _entries(map_: str, *but: str) -> str:
    """SQL for an array of (key, json) of a map's entries that aren't null, without some keys."""
    names = ", ".join(f"'{b}'" for b in but)
    return (
        f"transform(filter(map_entries(coalesce({map_}, CAST(map() AS map<string,variant>))), e -> e.key NOT IN ({names}) AND e.value IS NOT NULL AND NOT is_variant_null(e.value)), "
        "e -> struct(e.key AS key, to_json(e.value) AS json))"
    )


def _given(calls: DataFrame) -> DataFrame:
    return calls.select("mid", "k", "conv_id", "name", F.expr("try_variant_get(arguments, '$', 'map<string,variant>')").alias("given"))


def _kind(value):
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def _spec(tools: DataFrame, *by: str) -> DataFrame:
    """(by, spec): the parameters of each tool (few), with their types and whether they are required."""
    each = F.collect_set(F.struct("parameter", F.struct("type", F.coalesce("required", F.lit(False)).alias("required")).alias("takes")))
    return tools.where("name IS NOT NULL").groupBy(*by).agg(F.map_from_entries(F.filter(each, lambda p: p["parameter"].isNotNull())).alias("spec"))


def _meets():
    """Whether what is given meets spec: all required parameters are there, none is unknown and all have their types."""
    takes = F.create_map(*[x for t, names in TYPES.items() for x in (F.lit(t), F.array(*map(F.lit, names)))])
    good = F.expr("forall(map_entries(given), e -> spec[e.key] IS NOT NULL)") & F.expr(
        "forall(filter(map_entries(spec), e -> e.value.required), e -> given[e.key] IS NOT NULL AND NOT is_variant_null(given[e.key]))"
    )
    typed = F.forall(F.map_entries("given"), lambda e: F.coalesce(F.exists(takes[F.col("spec")[e["key"]]["type"]], lambda t: _kind(e["value"]) == t), F.lit(True)))
    return F.coalesce(good & typed, F.lit(False))


def _checked(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """(mid, k, valid) of calls held against tools."""
    return _given(calls).join(_spec(tools, "name"), "name", "left").select("mid", "k", _meets().alias("valid"))


def _declared(rows: DataFrame) -> DataFrame:
    """(conv_id, TOOLS) of the lists in system messages: JSON objects with tools of {name, parameters} or {function: {name,
    parameters}}, parameters a JSON schema of an object. Of several of one name the first by turn counts; a list
    that is empty is a row without a name."""
    lists = rows.where(r"role = 'system' AND text RLIKE '^\\s*\\{'").selectExpr("conv_id", "turn", "try_variant_get(try_parse_json(text), '$.tools', 'array<variant>') AS tools").where("tools IS NOT NULL")
    part = lambda path, type_: "coalesce(" + ", ".join(f"try_variant_get(tool, '$.{p}', '{type_}')" for p in (path, f"function.{path}")) + ")"
    each = lists.selectExpr("conv_id", "turn", "posexplode_outer(tools) AS (place, tool)").selectExpr(
        "conv_id", "struct(turn, place) AS at", f"{part('name', 'string')} AS name", f"{part('parameters.properties', 'map<string,variant>')} AS own", f"{part('parameters.required', 'array<string>')} AS needs"
    )
    first = each.groupBy("conv_id", "name").agg(F.min_by(F.struct("own", "needs"), "at").alias("t"))
    return first.selectExpr("conv_id", "name", "t.needs", "explode_outer(map_entries(t.own)) AS p").selectExpr(
        "conv_id", "name", "p.key AS parameter", "try_variant_get(p.value, '$.type', 'string') AS type", "coalesce(array_contains(needs, p.key), false) AS required"
    )


def _learned(given: DataFrame) -> DataFrame:
    """TOOLS as calls of one name agree on them; nothing of names with few calls."""
    objects = given.where("name IS NOT NULL AND given IS NOT NULL")
    names = objects.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= ENOUGH)
    each = objects.select("name", F.explode(F.map_entries("given")).alias("e")).select("name", F.col("e.key").alias("parameter"), _kind(F.col("e.value")).alias("kind")).where("kind <> 'VOID'")
    types = {t: names for t, names in TYPES.items() if t != "integer"}  # a number may be whole by chance
    uses = each.groupBy("name", "parameter").agg(F.count("*").alias("m"), *[F.count_if(F.col("kind").isin(*kinds)).alias(f"as_{t}") for t, kinds in types.items()])
    type_ = F.coalesce(*[F.when(F.col(f"as_{t}") >= AGREE * F.col("m"), t) for t in types])
    return names.join(uses, "name", "left").select("name", F.when(F.col("m") >= KNOWN * F.col("n"), F.col("parameter")).alias("parameter"), type_.alias("type"), (F.col("m") >= AGREE * F.col("n")).alias("required"))


def _judged(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """(mid, k, valid) of calls held against the tools that their conversations list, or where none does, against what
    calls of their name agree on."""
    declared = save(_declared(rows), "declared")
    same = F.col("g.conv_id").eqNullSafe(F.col("l.conv_id"))
    listed = save(_given(calls).alias("g").join(declared.select("conv_id").distinct().withColumn("listed", F.lit(True)).alias("l"), same, "left").select("g.*", "listed"), "given")
    told = listed.where("listed").alias("g").join(_spec(declared, "conv_id", "name").alias("l"), same & (F.col("g.name") == F.col("l.name")), "left").select("mid", "k", "given", "spec")
    free = listed.where("listed IS NULL")
    free = free.join(_spec(_learned(free), "name"), "name", "left").select("mid", "k", F.when(F.col("spec").isNull(), True).otherwise(_meets()).alias("valid"))
    return told.select("mid", "k", _meets().alias("valid")).unionByName(free)


def format_chat(messages: DataFrame, tools: DataFrame | None = None, judge: bool = False) -> DataFrame:
    """(conv_id, turn, role, position, depth, n_calls, n_linked, n_invalid, call_id, json) of each row of messages
    (conv_id long, turn long, role string, text string); tools (TOOLS): a row for each parameter (one
    without a parameter for a tool that takes none), or none to check; with judge, calls are held against the tools that system messages
    of their conversation list ({"tools": [...]} as JSON schemas), and in conversations without a list against what at least ENOUGH
    calls of their name in such conversations agree on (other names aren't judged).

    position counts a conversation's messages from 0: by turn, a result after its call and a call after the results that
    it depends on (depth: the longest such chain before the message); ties by role and text; rows that are alike stand
    in any order. Calls that depend on each other in a ring, and what depends on them, keep their turns and have depth 0. n_linked: calls that have a result, or 1
    for a result that has a call. Of several calls of one identifier the first by turn is linked. An identifier that is
    null links nothing. n_invalid: calls that fail their tool's parameters; an unknown tool fails, without tools or
    judge none does. Of several results of one call each is linked. Text that is no JSON object with tool_calls or tool_call_id, null or
    empty is plain content; keys of messages and calls that have no meaning here are kept as they are, an entry of tool_calls
    that is no object too. Null conv_ids are one conversation, null turns
    come first. Other columns are ignored. An empty table gives no rows.
    """
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    special = F.col("text").rlike(r"^\s*\{") & F.col("role").isin("assistant", "tool")
    # Messages with tool parts get a name; all others pass by.
    form = F.expr(
        "CASE WHEN role = 'tool' THEN try_variant_get(try_parse_json(text), '$.tool_call_id', 'variant') IS NOT NULL "
        "ELSE try_variant_get(try_parse_json(text), '$.tool_calls', 'array<variant>') IS NOT NULL END"
    )
    marked = save(rows.where(special).where(form).withColumn("mid", F.monotonically_increasing_id()), "tools")
    parsed = marked.withColumn("body", F.expr("try_parse_json(text)"))
    calls = save(_calls(parsed), "calls")
    results = parsed.where("role = 'tool'").selectExpr("mid", "conv_id", "turn", "try_variant_get(body, '$.tool_call_id', 'string') AS call_id")
    first = calls.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min_by(F.struct("mid", "k", "turn"), F.struct("turn", "mid", "k")).alias("call"))
    linked = save(
        results.alias("r").join(first.alias("c").hint("shuffle_hash"), F.col("r.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("r.call_id") == F.col("c.call_id")), "left")
        .select("r.mid", "r.conv_id", "r.turn", "r.call_id", F.col("c.call.mid").alias("caller"), F.col("c.call.k").alias("k")),
        "linked",
    )
    answered = linked.where("caller IS NOT NULL").select(F.col("caller").alias("mid"), "k").distinct().withColumn("has", F.lit(1))
    valid = _checked(calls, tools) if tools is not None else _judged(rows, calls) if judge else calls.select("mid", "k", F.lit(True).alias("valid"))
    per_call = calls.join(answered, ["mid", "k"], "left").join(valid, ["mid", "k"], "left")
    shown = per_call.groupBy("mid").agg(
        F.count("*").alias("n_calls"), F.sum(F.coalesce("has", F.lit(0))).alias("n_linked"), F.sum((~F.col("valid")).cast("long")).alias("n_invalid"),
        F.array_sort(F.collect_list(F.struct("k", F.expr("to_json(arguments)").alias("arguments"), "call_id", "name", "more", "raw"))).alias("calls"),
    )  # the calls of one message
    # Edges of the order: a result after its call's message, a call's message after the results that it depends on.
    after = linked.where("caller IS NOT NULL").select(F.col("mid").alias("later"), F.col("caller").alias("earlier"))
    needs = calls.select("mid", "conv_id", F.explode("depends_on").alias("need")).alias("n")
    after = save(
        after.unionByName(
            needs.join(linked.where("caller IS NOT NULL").alias("l"), F.col("n.conv_id").eqNullSafe(F.col("l.conv_id")) & (F.col("n.need") == F.col("l.call_id")))
            .select(F.col("n.mid").alias("later"), F.col("l.mid").alias("earlier"))
        ).where("later <> earlier").distinct(),
        "after",
    )
    levels = _levels(after, marked)
    extra = (
        marked.join(shown, "mid", "left").join(linked.select("mid", "call_id", F.col("caller").isNotNull().cast("long").alias("found")), "mid", "left")
        .join(levels, "mid", "left")
        .withColumn("other", F.expr(_entries("try_variant_get(try_parse_json(text), '$', 'map<string,variant>')", "role", "tool_calls", "tool_call_id")))
    )
    call = lambda c: F.coalesce(c["raw"], _object(("arguments", c["arguments"]), ("id", _quoted(c["call_id"])), ("name", _quoted(c["name"])), more=c["more"]))
    tool_calls = F.concat(F.lit("["), F.array_join(F.transform("calls", call), ","), F.lit("]"))
    with_tools = extra.select(
        "conv_id", "turn", "role", "text", F.coalesce("level", F.lit(0)).alias("depth"), F.coalesce("anchor", "turn").alias("anchor"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_linked", "found", F.lit(0)).alias("n_linked"), F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"), "call_id",
        _object(
            ("role", _quoted(F.col("role"))), ("tool_call_id", _quoted(F.col("call_id"))), ("tool_calls", F.when(F.size("calls") > 0, tool_calls)), more=F.col("other")
        ).alias("json"),
    )
    plain = rows.where(~F.coalesce(special & form, F.lit(False))).select(
        "conv_id", "turn", "role", "text", F.lit(0).alias("depth"), F.col("turn").alias("anchor"), F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_linked"),
        F.lit(0).cast("long").alias("n_invalid"), F.lit(None).cast("string").alias("call_id"), _object(("content", _quoted(F.col("text"))), ("role", _quoted(F.col("role")))).alias("json"),
    )
    both = plain.unionByName(with_tools)
    placed, _ = ranged(both, [F.col(c) for c in ("conv_id", "anchor", "depth", "turn", "role", "text")], F.lit(0))
    placed = save(placed.drop("text", "anchor", "before"), "placed")
    start = placed.groupBy("conv_id").agg(F.min("rank").alias("start"))
    out = placed.alias("p").join(start.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")))
    return out.select("p.conv_id", "turn", "role", (F.col("rank") - F.col("start")).alias("position"), F.col("depth").cast("long").alias("depth"), "n_calls", "n_linked", "n_invalid", "call_id", "json")


def _levels(after: DataFrame, marked: DataFrame) -> DataFrame:
    """(mid, level, anchor) of the messages that edges reach: the longest chain before each, and the largest turn on the
    chains that end at it, so that it sorts behind them.

    A message that follows one other only hangs on it; such chains are shortened by half in each round, until each of their
    messages hangs on one that follows none or several. Only the latter are then taken away round by round, those first
    before which nothing is left. So there are as many rounds as the logarithm of the longest plain chain, and one for
    each message on a chain that follows several. What hangs on a ring, or is left when none can be taken: level 0 and its own turn.
    """
    turns = marked.select("mid", "turn")
    if after.isEmpty():
        return marked.select("mid", F.lit(0).cast("long").alias("level"), F.col("turn").alias("anchor")).limit(0)
    ways = after.groupBy(F.col("later").alias("mid")).agg(F.count("*").alias("n"), F.min("earlier").alias("one"))
    nodes = save(after.select(F.col("later").alias("mid")).union(after.select("earlier")).distinct().join(ways, "mid", "left").join(turns, "mid"), "nodes")
    plain = F.col("n") == 1
    # Where each plain message hangs (to), how far away (d), and the largest turn from it to before that one (top).
    heads = nodes.select(F.col("mid").alias("one"), F.coalesce(~plain, F.lit(True)).alias("done"))
    hung = save(nodes.where(plain).join(heads, "one").select("mid", F.col("one").alias("to"), F.lit(1).cast("long").alias("d"), F.col("turn").alias("top"), "done"), "hung")
    left, steps = hung.count(), [nodes, hung]
    while left > 0 and not hung.where("NOT done").isEmpty():
        on = hung.select(F.col("mid").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("top").alias("top2"), F.col("done").alias("done2"))
        far = hung.where("NOT done").join(on, "to").select("mid", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), F.greatest("top", "top2").alias("top"), F.col("done2").alias("done"))
        hung = save(hung.where("done").unionByName(far), "hung")
        steps.append(hung)
        left //= 2  # a chain of so many messages has come to its end by then: what hasn't is a ring
    ends = hung.select(F.col("mid").alias("earlier"), F.when(F.col("done"), F.col("to")).otherwise(F.lit(-1)).alias("head"), "d", "top")
    several = nodes.where("n > 1").select(F.col("mid").alias("later"))
    edges = save(
        after.join(several, "later", "left_semi").join(ends, "earlier", "left")
        .select("later", F.coalesce("head", "earlier").alias("earlier"), (F.coalesce("d", F.lit(0).cast("long")) + 1).alias("w"), "top"),
        "edges",
    )
    state = save(nodes.where(F.coalesce(~plain, F.lit(True))).select("mid", F.lit(0).cast("long").alias("level"), F.col("turn").alias("anchor")), "state")
    steps += [edges, state]
    done = []
    while True:
        ready = save(state.join(edges.select(F.col("later").alias("mid")).distinct(), "mid", "left_anti"), "ready")
        steps.append(ready)
        if ready.isEmpty():
            break
        done.append(ready)
        passed = edges.join(ready.withColumnRenamed("mid", "earlier"), "earlier")
        passed = passed.groupBy(F.col("later").alias("mid")).agg(F.max(F.col("level") + F.col("w")).alias("up"), F.max(F.greatest("anchor", "top")).alias("high"))
        rest = state.join(ready.select("mid"), "mid", "left_anti").join(passed, "mid", "left")
        state = save(rest.select("mid", F.greatest("level", "up").alias("level"), F.greatest("anchor", "high").alias("anchor")), "state")
        edges = save(edges.join(ready.select(F.col("mid").alias("earlier")), "earlier", "left_anti"), "edges")
        steps += [state, edges]
        if state.isEmpty():
            break
    heads = reduce(DataFrame.unionByName, done) if done else state.limit(0)
    hanging = hung.join(heads.withColumnRenamed("mid", "to"), "to").select("mid", (F.col("level") + F.col("d")).alias("level"), F.greatest("anchor", "top").alias("anchor"))
    found = heads.unionByName(hanging)
    rings = nodes.join(found.select("mid"), "mid", "left_anti").select("mid", F.lit(0).cast("long").alias("level"), F.col("turn").alias("anchor"))
    out = save(found.unionByName(rings), "levels")
    release(*steps)
    return out


def _quoted(c):
    """A string as JSON, null if it is null."""
    j = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(j, F.lit(2), F.length(j) - 2))


def _object(*fields, more=None):
    """A JSON object of those fields that aren't null and of more, an array of (key, json); sorted by key."""
    known = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("json"))) for k, v in fields]))
    each = F.array_sort(known if more is None else F.concat(known, more))
    return F.concat(F.lit("{"), F.array_join(F.transform(each, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["json"])), ","), F.lit("}"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(table(spark, sf_dir, "conversations"), judge=True)
