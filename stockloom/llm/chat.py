"""Chat formatting by tool-call linking, with DataFrame functions only.

Calls and results are joined by identifier (a hash join on conversation and call; no result is copied
more than once per call). Calls are ordered so that each follows the calls it needs: a call's level is
one more than the highest level of those, in every conversation. Where every need comes earlier, one
aggregate over the conversation's calls in their order settles them all; other conversations, and such
with more than ``IN_ONE_ROW`` calls and needs, take rounds that settle the calls whose needs are
settled. Arguments are checked against the tool's parameters, and each call with its result becomes
one line of canonical JSON: keys in order, no spaces, the shortest form of each value. Lines of a
conversation are in the order (level, turn).

States: ``linked``, ``no_result`` (a call without result), ``no_call`` (a result without call),
``cyclic`` (a call that needs itself, directly or not). A need that names no call of the conversation
is ignored. Of several results of a call the first by turn counts; of repeated calls the first by turn,
then by content. A call or result with a null conversation or identifier links to nothing and is a row
of its own, however often it is repeated; such a call has level 0. Null arguments, or such as are not a
JSON object, are a fault and are written as null. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import removed, shared_dir, written


@dataclass(frozen=True)
class Parameter:
    """A tool's parameter: kind is string, integer, number or boolean; bounds hold for numbers."""

    kind: str
    required: bool = True
    least: float | None = None
    most: float | None = None


#: The tools of the given conversations: a short message looks something up, a long one has a text composed.
TOOLS = {
    "lookup": {"text": Parameter("string"), "turn": Parameter("integer", least=0), "words": Parameter("integer", least=2, most=20)},
    "compose": {"text": Parameter("string"), "turn": Parameter("integer", least=0), "words": Parameter("integer", least=21, most=60)},
}
#: Calls and needs of a conversation that one row may hold; larger conversations take rounds.
IN_ONE_ROW = 20_000
_KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"]}


def faults(name: Column, arguments: Column, tools: dict[str, dict[str, Parameter]]) -> Column:
    """What is wrong with the arguments (a variant), as a sorted list of texts; empty if nothing is."""
    found = [F.when(~F.coalesce(name.isin(*tools), F.lit(False)), F.lit("unknown tool"))]
    object_ = F.schema_of_variant(arguments).startswith("OBJECT")
    found.append(F.when(arguments.isNull() | ~object_, F.lit("arguments are not an object")))
    text = F.to_json(arguments)
    for tool, parameters in tools.items():
        here = (name == tool) & object_
        extra = F.array_except(F.json_object_keys(text), F.array(*[F.lit(p) for p in parameters]))
        found.append(F.when(here & (F.size(extra) > 0), F.concat(F.lit("unknown: "), F.array_join(F.array_sort(extra), ","))))
        for p, rule in parameters.items():
            value = F.try_variant_get(arguments, f"$.{p}", "variant")
            kind = F.schema_of_variant(value)
            missing = value.isNull() | (kind == "VOID")
            if rule.required:
                found.append(F.when(here & missing, F.lit(f"missing: {p}")))
            right = F.split_part(kind, F.lit("("), F.lit(1)).isin(*_KINDS[rule.kind])
            found.append(F.when(here & ~missing & ~right, F.lit(f"not {rule.kind}: {p}")))
            number = F.try_variant_get(arguments, f"$.{p}", "double")
            if rule.least is not None:
                found.append(F.when(here & (number < rule.least), F.lit(f"too small: {p}")))
            if rule.most is not None:
                found.append(F.when(here & (number > rule.most), F.lit(f"too large: {p}")))
    return F.array_sort(F.array_compact(F.array(*found)))


def levels(calls: DataFrame, needs: DataFrame, name: str = "chat-levels") -> DataFrame:
    """``conv_id, call_id, level``; null for calls on or behind a cycle. One round per level.

    ``calls``: distinct conv_id, call_id. ``needs``: conv_id, call_id, need (distinct). Every round is
    written to the shared folder and reads only the needs of calls that are still open.
    """
    spark = calls.sparkSession
    base = shared_dir(spark, name)
    known = calls.select("conv_id", F.col("call_id").alias("need"))
    edges = written(needs.join(known, ["conv_id", "need"], "left_semi"), f"{base}/edges-0")
    open_calls = edges.select("conv_id", "call_id").distinct()
    settled = written(calls.join(open_calls, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), f"{base}/settled-0")
    done, newest, step = [settled], settled, 0
    while True:
        step += 1
        # An edge goes once its need is settled; a call is settled once it has no edge left.
        hit = newest.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("hit"))
        now = edges.join(hit, ["conv_id", "need"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        state = written(now, f"{base}/state-{step}")
        ready = state.groupBy("conv_id", "call_id").agg(F.min("hit").alias("all")).filter("all").select("conv_id", "call_id", F.lit(step).alias("level"))
        newest = written(ready, f"{base}/settled-{step}")
        if newest.isEmpty():
            break
        done.append(newest)
        # Edges of calls that are still open stay, so that a call waits for the latest of its needs.
        edges = written(_waiting(state, newest), f"{base}/edges-{step}")
        removed(spark, f"{base}/edges-{step - 1}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return calls.join(out, ["conv_id", "call_id"], "left")


def _waiting(state: DataFrame, newest: DataFrame) -> DataFrame:
    waiting = state.filter("NOT hit").select("conv_id", "call_id", "need")
    return waiting.join(newest.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")


def _in_order(own: DataFrame) -> DataFrame:
    """``conv_id, calls, level``: a conversation's call ids and their levels; null levels where a need is not earlier.

    ``own``: conv_id, call_id, turn, needs, distinct in conversation and call.
    """
    row = F.struct("turn", "call_id", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    one = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    one = one.select("conv_id", F.col("c.call_id").alias("calls"), F.col("c.needs").alias("needs"))
    # The places of a call's needs; a need that names no call has none.
    at = F.transform("needs", lambda own: F.filter(F.transform(own, lambda need: F.array_position("calls", need)), lambda x: x > 0))
    one = one.select("conv_id", "calls", at.alias("at"))
    late = F.exists(F.zip_with("at", F.sequence(F.lit(1), F.size("at")), lambda x, i: F.coalesce(F.array_max(x) >= i, F.lit(False))), lambda x: x)
    none = F.array().cast("array<int>")
    found = F.aggregate("at", none, lambda done, own: F.array_append(done, F.coalesce(F.array_max(F.transform(own, lambda i: F.element_at(done, i.cast("int")))) + 1, F.lit(0))))
    return one.select("conv_id", "calls", F.when(~late, found).alias("level"))


def _placed(own: DataFrame, in_one_row: int = IN_ONE_ROW) -> DataFrame:
    """``conv_id, call_id, level`` of all calls; null on or behind a cycle."""
    spark = own.sparkSession
    base = shared_dir(spark, "chat-order")
    sizes = own.groupBy("conv_id").agg((F.count(F.lit(1)) + F.sum(F.coalesce(F.size("needs"), F.lit(0)))).alias("n"))
    large = written(sizes.filter(F.col("n") > in_one_row).select("conv_id"), f"{base}/large")
    some_large = not large.isEmpty()
    ordered = _in_order(own.join(large, "conv_id", "left_anti") if some_large else own)
    rows = written(ordered, f"{base}/ordered")
    settled = rows.filter("level IS NOT NULL").select("conv_id", F.explode(F.arrays_zip("calls", "level")).alias("z")).select("conv_id", F.col("z.calls").alias("call_id"), F.col("z.level").alias("level"))
    rest = rows.filter("level IS NULL").select("conv_id")
    if some_large:
        rest = rest.unionByName(large)
    elif rest.isEmpty():
        return settled
    calls = own.join(rest, "conv_id", "left_semi")
    ranked = levels(calls.select("conv_id", "call_id"), calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct())
    return settled.unionByName(ranked)


def linked(calls: DataFrame, results: DataFrame, tools: dict[str, dict[str, Parameter]] = TOOLS) -> DataFrame:
    """One row per call or unlinked result: ``conv_id, call_id, turn, level, state, faults, line``.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON), needs (array of call ids).
    ``results``: conv_id, call_id, turn, content.
    """
    first = F.min(F.struct("turn", "name", "arguments", "needs"))
    named = calls.filter("conv_id IS NOT NULL AND call_id IS NOT NULL")
    own = named.groupBy("conv_id", "call_id").agg(first.alias("c")).select("conv_id", "call_id", "c.*")
    answered = results.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    answered = answered.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), F.lit(True).alias("has_result"))
    placed = _placed(own)
    met = own.withColumn("has_call", F.lit(True)).join(placed, ["conv_id", "call_id"]).join(answered, ["conv_id", "call_id"], "full")
    nameless = F.col("conv_id").isNull() | F.col("call_id").isNull()
    lone = calls.filter(nameless).select("conv_id", "call_id", "turn", "name", "arguments", F.lit(True).alias("has_call"), F.lit(0).alias("level"))
    lost = results.filter(nameless).select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.lit(True).alias("has_result"))
    met = met.drop("needs").unionByName(lone, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)
    met = met.withColumn("variant", F.try_parse_json("arguments"))
    state = F.when(F.col("has_call").isNull(), "no_call").when(F.col("level").isNull(), "cyclic").when(F.col("has_result").isNull(), "no_result").otherwise("linked")
    wrong = F.when(F.col("has_call"), faults(F.col("name"), F.col("variant"), tools)).otherwise(F.array().cast("array<string>"))
    quoted = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.struct(F.col(c).alias("v")))), F.lit('{"v":null}'))
    value = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.regexp_extract(quoted(c), r'(?s)^\{"v":(.*)\}$', 1))
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.when(F.schema_of_variant("variant").startswith("OBJECT"), F.to_json("variant")), F.lit("null")),
        F.lit(',"call_id":'), value("call_id"), F.lit(',"name":'), value("name"), F.lit(',"result":'), value("content"), F.lit("}"),
    )
    return met.select("conv_id", "call_id", F.coalesce("turn", "result_turn").alias("turn"), "level", state.alias("state"), F.array_join(wrong, "; ").alias("faults"), line.alias("line"))


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn calls, the assistant's next turn is its result.

    A call needs the call two turns before. Messages with equal conversation and turn are repeated
    calls or results.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    words = F.regexp_count("text", F.lit(r"\S+")).cast("long")
    arguments = F.to_json(F.struct(F.col("turn"), words.alias("words"), F.col("text")))
    calls = rows.filter("role = 'user'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.when(words <= 20, "lookup").otherwise("compose").alias("name"),
        arguments.alias("arguments"), F.array(name(F.col("turn") - 2)).alias("needs"),
    )
    results = rows.filter("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op7_chat(messages: DataFrame) -> DataFrame:
    """Every call and every unlinked result of all conversations as canonical JSON lines."""
    return linked(*from_messages(messages))


ORACLE_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS words FROM conversations),
c AS (SELECT conv_id, 'call-' || turn AS call_id, turn, text, words, CASE WHEN words <= 20 THEN 'lookup' ELSE 'compose' END AS name, 'call-' || (turn - 2) AS need, true AS is_call FROM m WHERE role = 'user'),
r AS (SELECT conv_id, 'call-' || (turn - 1) AS call_id, turn AS result_turn, text AS content, true AS is_result FROM m WHERE role = 'assistant'),
v(conv_id, call_id, level) AS (
  SELECT conv_id, call_id, 0 FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.conv_id = c.conv_id AND d.call_id = c.need)
  UNION ALL SELECT c.conv_id, c.call_id, v.level + 1 FROM v JOIN c ON c.conv_id = v.conv_id AND c.need = v.call_id),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.result_turn) AS turn,
  coalesce(is_call, false) AS has_call, coalesce(is_result, false) AS has_result, c.text, c.turn AS own_turn, words, name, content
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT j.conv_id, j.call_id, j.turn, CASE WHEN has_call THEN coalesce(v.level, 0) END AS level,
  CASE WHEN NOT has_call THEN 'no_call' WHEN has_result THEN 'linked' ELSE 'no_result' END AS state,
  concat_ws('; ', CASE WHEN has_call AND own_turn IS NULL THEN 'missing: turn' END,
    CASE WHEN name = 'lookup' AND words < 2 THEN 'too small: words' WHEN name = 'compose' AND words > 60 THEN 'too large: words' END) AS faults,
  '{"arguments":' || CASE WHEN has_call THEN '{"text":' || to_json(text)::VARCHAR || coalesce(',"turn":' || own_turn, '') || ',"words":' || words || '}' ELSE 'null' END
  || ',"call_id":' || coalesce(to_json(j.call_id)::VARCHAR, 'null') || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS line
FROM j LEFT JOIN v ON v.conv_id = j.conv_id AND v.call_id = j.call_id
"""
