"""Chat formatting: link tool calls to their results, order them, validate the
arguments and serialise canonical JSON.

* Calls and results meet in an equi-join on (conversation, identifier).
* The topological level of a call is 0 without dependencies, else one more
  than the highest level among them.  Chains of calls with one dependency are
  shortened by pointer jumping (log2 of their length in rounds); calls with
  several are then resolved round by round.  Sorting a conversation by (level,
  call_id) is a topological order; no task needs a whole conversation.
* Arguments are parsed to VARIANT, which sorts object keys; its JSON text is
  the canonical form (sorted keys, no blanks, normalised numbers).

Defined cases: calls without an identifier keep level 0 and find no result.
A dependency on an unknown call gives status ``missing_dependency``; calls on a
cycle, or behind a stuck call, are ``blocked``.  Both have a null level.  Of several results of one call the
smallest text is linked and ``n_results`` counts all.  Results of no call come
as rows with status ``orphan_result``.  Repeated call rows each appear.
Null or malformed arguments give ``bad_json``.  Empty tables give no rows.
Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.common import WORD, staged, table

#: tool -> {argument: (JSON type, required)}
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "summarize": {"text": ("string", True), "max_words": ("integer", False)},
    "note": {"title": ("string", True), "body": ("string", False), "tags": ("array", False), "pinned": ("boolean", False)},
}

_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$",
          "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<"}


def validate(name: Column, arguments: Column, schemas=SCHEMAS) -> Column:
    """``ok`` or the first fault found."""
    v = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(v).rlike("^OBJECT<")
    checks = F.when(v.isNull() | ~is_object, F.lit("bad_json"))
    for tool in sorted(schemas):
        fields = schemas[tool]
        for arg in sorted(fields):
            kind, required = fields[arg]
            got = F.schema_of_variant(F.try_variant_get(v, f"$['{arg}']", "variant"))
            here = name == tool
            missing = got.isNull() | (got == "VOID")
            if required:
                checks = checks.when(here & missing, F.lit(f"missing:{arg}"))
            checks = checks.when(here & ~missing & ~got.rlike(_TYPES[kind]), F.lit(f"type:{arg}"))
        extra = F.size(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(a) for a in sorted(fields)])))
        checks = checks.when((name == tool) & (extra > 0), F.lit("unexpected_argument"))
    known = reduce(lambda a, b: a | b, [name == t for t in schemas], F.lit(False))
    return checks.when(~F.coalesce(known, F.lit(False)), F.lit("unknown_tool")).otherwise(F.lit("ok"))


def _key(conv: Column, call: Column) -> Column:
    return F.concat(F.coalesce(conv.cast("string"), F.lit("\u0000")), F.lit("\u001f"), call)


def _jumped(singles: DataFrame) -> DataFrame:
    """Pointer jumping over calls with one dependency: (k, p, dist, done).  In
    each round a call takes over its parent's pointer, so a chain of n calls
    needs about log2(n) rounds.  ``done``: p is no call of one dependency."""
    keys = singles.select(F.col("k").alias("pk"))
    state = staged(singles.join(keys, F.col("p") == F.col("pk"), "left")
                   .select("k", "p", F.lit(1).cast("long").alias("dist"), F.col("pk").isNull().alias("done")), "tool-jump")
    left = state.where("NOT done").count()
    while left:
        ahead = state.select(F.col("k").alias("bk"), F.col("p").alias("bp"), F.col("dist").alias("bd"), F.col("done").alias("bdone"))
        moved = (state.where("NOT done").join(ahead, F.col("p") == F.col("bk"))
                 .select("k", F.col("bp").alias("p"), (F.col("dist") + F.col("bd")).alias("dist"), F.col("bdone").alias("done")))
        state = staged(state.where("done").unionByName(moved), "tool-jump")
        now = state.where("NOT done").count()
        if now == left:  # what is left runs in circles
            break
        left = now
    return state


def levels(calls: DataFrame) -> DataFrame:
    """(k, level, state) of each identified call; ``calls`` has conv_id,
    call_id and depends_on (array of call ids)."""
    none = F.array().cast("array<string>")
    nodes = (calls.where(F.col("call_id").isNotNull())
             .select(_key(F.col("conv_id"), F.col("call_id")).alias("k"),
                     F.explode_outer(F.transform(F.filter(F.coalesce("depends_on", none), lambda d: d.isNotNull()),
                                                 lambda d: _key(F.col("conv_id"), d))).alias("p"))
             .groupBy("k").agg(F.collect_set("p").alias("deps")))
    nodes = staged(nodes, "tool-nodes")
    roots = nodes.where(F.size("deps") == 0).select("k", F.lit(0).cast("long").alias("level"), F.lit("ok").alias("state"))
    jump = _jumped(nodes.where(F.size("deps") == 1).select("k", F.col("deps")[0].alias("p")))
    many = nodes.where(F.size("deps") > 1).select("k", F.explode("deps").alias("p"))
    j = jump.select(F.col("k").alias("jk"), F.col("p").alias("jp"), "dist", "done")
    open_ = staged(many.join(j, F.col("p") == F.col("jk"), "left").where(F.coalesce("done", F.lit(True)))
                   .select("k", F.coalesce("jp", "p").alias("a"), F.coalesce("dist", F.lit(0)).alias("dist"),
                           F.lit(None).cast("long").alias("above"))
                   .unionByName(many.join(j.where("NOT done"), F.col("p") == F.col("jk"))
                                .select("k", F.col("p").alias("a"), F.lit(0).cast("long").alias("dist"), F.lit(None).cast("long").alias("above"))),
                   "tool-open")
    known, new = [roots], roots
    while not open_.isEmpty():  # one round per link between calls of several dependencies
        up = new.select(F.col("k").alias("nk"), F.col("level").alias("nl"))
        open_ = open_.join(up, F.col("a") == F.col("nk"), "left").select(
            "k", "a", "dist", F.coalesce("above", F.col("nl") + F.col("dist")).alias("above"))
        state = staged(open_.groupBy("k").agg(F.max("above").alias("m"), F.count_if(F.col("above").isNull()).alias("n")), "tool-round")
        new = state.where("n = 0").select("k", (F.col("m") + 1).alias("level"), F.lit("ok").alias("state"))
        if new.isEmpty():
            break
        known.append(new)
        open_ = staged(open_.join(state.where("n > 0").select("k"), "k", "left_semi"), "tool-open")
    sure = reduce(DataFrame.unionByName, known)
    anchor = sure.select(F.col("k").alias("ak"), F.col("level").alias("al"))
    ids = nodes.select(F.col("k").alias("ik"))
    lost = (nodes.select("k", F.explode("deps").alias("p")).join(ids, F.col("p") == F.col("ik"), "left_anti")
            .select(F.col("k").alias("lk")).distinct())
    rest = jump.where("done").join(anchor, F.col("p") == F.col("ak"), "left").select("k", (F.col("al") + F.col("dist")).alias("level")) \
        .unionByName(jump.where("NOT done").select("k", F.lit(None).cast("long").alias("level"))) \
        .unionByName(open_.select("k").distinct().withColumn("level", F.lit(None).cast("long")))
    rest = rest.join(lost, F.col("k") == F.col("lk"), "left").select(
        "k", "level", F.when(F.col("level").isNotNull(), "ok").when(F.col("lk").isNotNull(), "missing_dependency")
        .otherwise("blocked").alias("state"))
    return sure.unionByName(rest)


def link(calls: DataFrame, results: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row per call and per orphan result: conv_id, call_id, name, level,
    status, n_results, canonical."""
    calls = calls.select("conv_id", "call_id", "name", "arguments", "depends_on")
    lv = levels(calls).withColumnRenamed("k", "lk")
    res = (results.where("call_id IS NOT NULL").groupBy(F.col("conv_id").alias("rc"), F.col("call_id").alias("rid"))
           .agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("n")))
    out = (calls.join(res, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("rid")), "left")
           .join(lv, _key(F.col("conv_id"), F.col("call_id")) == F.col("lk"), "left"))
    valid = validate(F.col("name"), F.col("arguments"), schemas)
    status = F.when(F.coalesce("state", F.lit("ok")) != "ok", F.col("state")).when(valid != "ok", valid) \
        .when(F.col("rid").isNull(), F.lit("no_result")).otherwise(F.lit("ok"))
    level = F.when(F.col("call_id").isNull(), F.lit(0)).otherwise(F.col("level"))
    whole = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null")),
        F.lit(',"id":'), _json_text(F.col("call_id")), F.lit(',"name":'), _json_text(F.col("name")),
        F.lit(',"result":'), _json_text(F.col("content")), F.lit("}"))
    linked = out.select("conv_id", "call_id", "name", level.alias("level"), status.alias("status"),
                        F.coalesce("n", F.lit(0)).cast("long").alias("n_results"), whole.alias("canonical"))
    ids = calls.select(F.col("conv_id").alias("cc"), F.col("call_id").alias("cid"))
    orphans = results.join(ids, F.col("conv_id").eqNullSafe(F.col("cc")) & (F.col("call_id") == F.col("cid")), "left_anti")
    return linked.unionByName(orphans.select(
        "conv_id", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("level"),
        F.lit("orphan_result").alias("status"), F.lit(1).cast("long").alias("n_results"),
        F.concat(F.lit('{"id":'), _json_text(F.col("call_id")), F.lit(',"result":'), _json_text(F.col("content")), F.lit("}"))
        .alias("canonical")))


def _json_text(c: Column) -> Column:
    """A JSON string, or null."""
    quoted = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(quoted.substr(F.lit(2), F.length(quoted) - 2))


def calls_of(conversations: DataFrame) -> DataFrame:
    """Tool calls derived from a plain conversation table: the assistant turns
    search, summarize and note in turn, each with its own whole text.  Turns
    alternate, so (turn - 1) div 2 counts those before, with or without a
    system turn.  A summary depends on its search, a note on both and the next
    search on the summary before."""
    t, turn = F.col("text"), F.col("turn")
    words = F.regexp_count(F.coalesce(t, F.lit("")), F.lit(WORD))
    rank = F.floor((turn - 1) / 2)
    kind = F.pmod(rank, F.lit(3))
    args = (F.when(kind == 0, F.to_json(F.struct(t.alias("query"), words.alias("limit"))))
            .when(kind == 1, F.to_json(F.struct(
                F.when(words > 30, words.cast("string")).alias("max_words"), t.alias("text"))))
            .otherwise(F.to_json(F.struct(
                F.array(F.col("role")).alias("tags"), (words > 9).alias("pinned"),
                F.when(words > 5, t.substr(1, 20)).alias("title"), t.alias("body")))))
    name = F.when(kind == 0, "search").when(kind == 1, "summarize").otherwise("note")
    after = (F.when(rank < 1, F.array().cast("array<string>")).when(kind == 0, F.array(_call_id(turn - 4)))
             .when(kind == 1, F.array(_call_id(turn - 2))).otherwise(F.array(_call_id(turn - 2), _call_id(turn - 4))))
    return conversations.where("role = 'assistant'").select(
        "conv_id", _call_id(turn).alias("call_id"), name.alias("name"), args.alias("arguments"), after.alias("depends_on"))


def results_of(conversations: DataFrame) -> DataFrame:
    """Each later user turn answers the call of the turn before."""
    return conversations.where("role = 'user' AND turn > 0").select(
        "conv_id", _call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))


def _call_id(turn: Column) -> Column:
    return F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return link(calls_of(conv), results_of(conv))
