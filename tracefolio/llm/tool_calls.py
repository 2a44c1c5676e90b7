"""Tool-call linking for chat formatting, in DataFrame functions only.

Messages are rows (conv_id, turn, role, text). A text that is a JSON object with ``tool_calls`` makes calls, one with
``tool_call_id`` is a result, any other is a plain message. Calls and results are joined by (conv_id, call id); arguments are
parsed as variants and checked against schemas; everything is written as canonical JSON (keys in order, no white space).

Order: messages by turn; within a turn the plain content, then each call, in the message's order, with its results right after it,
wherever these came in; then results that belong to no call. That is the key (anchor_turn, item, step), and it is a topological order:
content, call, its results, next call, next turn. It is made of columns, not of a window, so one conversation that holds a third of all
rows needs no task of its own; ``transcript`` sorts by it over ranges.

Ids that calls repeat in a conversation: the first call (by turn, then item) has the id, later ones are ``duplicate`` and link to
nothing. Results that repeat are all linked to it. A result without a call is an orphan and keeps its own turn.

Joins are hash joins: what is built has one row for each id, so a key that many rows share is one row there; these rows are a table in the
shared folder, so that Spark can split the other side.

Defined results: null roles, turns or texts stay null in the JSON (a null text is a plain message without content); a null conv_id
links nothing; broken JSON, and JSON of another shape, is plain text; arguments that are not an object, or have keys twice, are
invalid; rows that repeat are each kept, ties of the key are ordered by their JSON; a very long text is one value of its row; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefolio.llm.common import settle

ENVELOPE = "content string, tool_call_id string, tool_calls array<struct<id:string,name:string,arguments:string>>"
#: What a schema may ask of an argument, and the variant types that meet it.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}
#: The item of a result without a call: after all calls of its turn.
LAST = (1 << 31) - 1
#: The key of a conversation's order; the JSON breaks ties.
ORDER = ("conv_id", "anchor_turn", "item", "step", "json")


def messages_to_items(messages: DataFrame) -> DataFrame:
    """One row for each plain message, call and result."""
    text = F.col("text")
    parsed = messages.select("conv_id", "turn", "role", "text", F.when(F.ltrim(text).startswith("{"), F.from_json(text, ENVELOPE)).alias("j"))
    called = F.coalesce(F.size("j.tool_calls"), F.lit(0)) > 0
    result = F.col("j.tool_call_id").isNotNull()
    null = lambda kind: F.lit(None).cast(kind)
    item = lambda kind, call, name, k, content, args: F.struct(F.lit(kind).alias("kind"), call.alias("call_id"), name.alias("name"), k.cast("int").alias("item"), content.alias("content"), args.alias("args"))
    plain = item("message", null("string"), null("string"), F.lit(-1), F.when(called, F.col("j.content")).otherwise(text), null("string"))
    calls = F.transform("j.tool_calls", lambda c, k: item("call", c["id"], c["name"], k, null("string"), c["arguments"]))
    res = item("result", F.col("j.tool_call_id"), null("string"), F.lit(0), F.col("j.content"), null("string"))
    items = F.when(called, F.concat(F.when(F.col("j.content").isNotNull(), F.array(plain)).otherwise(F.slice(F.array(plain), 1, 0)), calls)).when(result, F.array(res)).otherwise(F.array(plain))
    return parsed.select("conv_id", "turn", "role", F.explode(items).alias("i")).select("conv_id", "turn", "role", "i.*")


def argument_errors(name: Column, args: Column, schemas: dict[str, dict[str, str]]) -> Column:
    """How the arguments (a variant) miss their tool's schema: a list of messages. A key that ends in ``?`` may be left out."""
    checks = []
    for tool in sorted(schemas):
        mine = name == tool
        wants = {k.rstrip("?"): (v, k.endswith("?")) for k, v in schemas[tool].items()}
        for key in sorted(wants):
            kind, optional = wants[key]
            value = F.try_variant_get(args, f"$['{key}']", "variant")
            missing = mine & value.isNull()
            if not optional:
                checks.append(F.when(missing, F.lit(f"missing {key}")))
            checks.append(F.when(mine & value.isNotNull() & ~F.schema_of_variant(value).rlike(f"^{TYPES[kind]}$"), F.lit(f"{key} is not {kind}")))
        known = F.array(*(F.lit(k) for k in wants)) if wants else F.array().cast("array<string>")
        keys = F.json_object_keys(F.to_json(args))
        checks.append(F.when(mine & (F.size(F.array_except(keys, known)) > 0), F.lit("unknown argument")))
    known = name.isin(sorted(schemas))
    shape = F.when(args.isNull() | ~F.schema_of_variant(args).startswith("OBJECT"), F.lit("arguments are not an object"))
    return F.array_compact(F.array(F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown tool")), shape, *(F.when(shape.isNull(), c) for c in checks)))


#: Null fields stay in the JSON, whatever the session's setting.
WITH_NULLS = {"ignoreNullFields": "false"}


def link(items: DataFrame, schemas: dict[str, dict[str, str]]) -> DataFrame:
    """Linked, ordered and checked items: conv_id, turn, role, kind, call_id, linked, duplicate, errors, anchor_turn, item, step, json."""
    key = ["conv_id", "call_id"]
    calls = items.where("kind = 'call' and call_id is not null and conv_id is not null")
    first = calls.groupBy(*key).agg(F.min(F.struct("turn", "item")).alias("owner"))
    answers = items.where("kind = 'result' and call_id is not null and conv_id is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("answers"))
    owners = first.join(answers.hint("shuffle_hash"), key, "left").select(F.col("conv_id").alias("o_conv"), F.col("call_id").alias("o_call"), "owner", "answers")
    # written first: the join has an exchange on either side then, and the many rows of one conversation or id can be split
    owners = settle(owners, "owners")
    joined = items.join(owners.hint("shuffle_hash"), (F.col("conv_id") == F.col("o_conv")) & (F.col("call_id") == F.col("o_call")), "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    duplicate = is_call & F.col("owner").isNotNull() & ~F.struct("turn", "item").eqNullSafe(F.col("owner"))
    joined = joined.withColumn("duplicate", duplicate).withColumn("linked", F.when(is_call, ~F.col("duplicate") & F.coalesce(F.col("answers") > 0, F.lit(False))).when(is_result, F.col("owner").isNotNull()))
    joined = joined.withColumn("v", F.when(is_call, F.try_parse_json("args")))
    joined = joined.withColumn("errors", F.when(is_call, argument_errors(F.col("name"), F.col("v"), schemas)).otherwise(F.array().cast("array<string>")))
    anchored = is_result & F.col("owner").isNotNull()
    out = joined.select(
        "conv_id", "turn", "role", "kind", "call_id", "linked", "duplicate", "errors",
        F.when(anchored, F.col("owner.turn")).otherwise(F.col("turn")).alias("anchor_turn"),
        F.when(anchored, F.col("owner.item")).when(is_result, LAST).otherwise(F.col("item")).alias("item"),
        F.when(is_call, 1).when(anchored, 2).when(is_result, 3).otherwise(0).alias("step"),
        F.when(is_call, F.to_json(F.struct(F.col("v").alias("arguments"), F.col("call_id").alias("id"), "name", "turn", F.lit("call").alias("type")), WITH_NULLS))
        .when(is_result, F.to_json(F.struct("content", F.col("call_id").alias("id"), "turn", F.lit("result").alias("type")), WITH_NULLS))
        .otherwise(F.to_json(F.struct("content", "role", "turn", F.lit("message").alias("type")), WITH_NULLS))
        .alias("json"),
    )
    return out


def transcript(linked: DataFrame) -> DataFrame:
    """(conv_id, json) in the conversations' order over the ranges of one exchange: written as text, its lines are the transcripts, and a conversation of any length may lie in several files."""
    return linked.orderBy(*ORDER).select("conv_id", "json")


#: The tools of ``replies_as_calls``.
TOOLS = {"reply": {"text": "string", "turn": "integer"}, "note": {"size": "integer", "tag?": "string"}}


def replies_as_calls(conversations: DataFrame) -> DataFrame:
    """Chat turns as tool messages, for tables that hold no calls.

    A user's turn has its text as content and three calls: ``reply`` (id: conv-turn) with the text and the turn; ``note`` (id: conv-n-turn) with the text's length, which is
    written as a string where it is a multiple of 3, left out where it is a multiple of 5, and has an unknown key beside it where it is a multiple of 7; and ``note`` under an id that all
    turns with an equal length, modulo 4, repeat. The assistant's next turn is the result of the turn's ``reply``, so it is an orphan where no user spoke before; other
    roles are the result of the turn's ``note``, if there is one, else of nothing.
    """
    text, size = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    cid = lambda mark, turn: F.concat(conv, F.lit(f"-{mark}-" if mark else "-"), turn.cast("string"))
    call = lambda i, name, args: F.struct(i.alias("id"), F.lit(name).alias("name"), args.alias("arguments"))
    number = F.when(size % 3 == 0, F.concat(F.lit('"'), size.cast("string"), F.lit('"'))).otherwise(size.cast("string"))
    fields = F.array_compact(F.array(F.when(size % 5 != 0, F.concat(F.lit('"size":'), number)), F.when(size % 7 == 0, F.lit('"other":1'))))
    noted = F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))
    calls = F.array(
        call(cid("", F.col("turn")), "reply", F.to_json(F.struct(text.alias("text"), "turn"))),
        call(cid("n", F.col("turn")), "note", noted),
        call(cid("s", size % 4), "note", F.concat(F.lit('{"size":'), size.cast("string"), F.lit("}"))),
    )
    asked = F.to_json(F.struct(text.alias("content"), calls.alias("tool_calls")))
    result = lambda i: F.to_json(F.struct(text.alias("content"), i.alias("tool_call_id")))
    made = F.when(F.col("role") == "user", asked).when(F.col("role") == "assistant", result(cid("", F.col("turn") - 1))).otherwise(result(cid("n", F.col("turn"))))
    return conversations.select("conv_id", "turn", "role", made.alias("text"))
