"""Registered queries that read logged JSON records.

The records are made by Spark from the given tables, in the shapes the clients log, and
read back through the ingest functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnsift.plans import overlay, sql as Q
from turnsift.sources import logs, tables


def _json(**fields: Column) -> Column:
    return F.to_json(
        F.struct(*[value.alias(name) for name, value in fields.items()]),
        {"ignoreNullFields": "false"},
    )


def _half(part: int) -> Column:
    middle = F.floor(F.length("content") / 2).cast("int")
    if part == 0:
        return F.left("content", middle)
    return F.substring("content", middle + 1, F.length("content"))


def _parsed(df: DataFrame) -> DataFrame:
    good, _ = logs.split_records(df, "raw")
    return good


def ingest_chat(spark, sf_dir):
    """Chat records: plain text, a list of two text parts, or null content."""
    conv = overlay.conversations(spark, sf_dir)
    parts = F.array(
        F.struct(F.lit("text").alias("type"), _half(0).alias("text")),
        F.struct(F.lit("text").alias("type"), _half(1).alias("text")),
    )
    raw = (
        F.when(F.col("role") == "tool", _json(role=F.col("role"), content=parts))
        .when(F.col("role") == "system", _json(role=F.col("role"), content=F.lit(None).cast("string")))
        .when(F.col("role") == "user", _json(content=F.col("content")))
        .otherwise(_json(role=F.col("role"), content=F.col("content")))
    )
    message = logs.chat_message(F.col("record"))
    rows = _parsed(conv.select("session_id", "turn_index", raw.alias("raw")))
    return rows.withColumn("message", message).select(
        "session_id", "turn_index", "message.role", "message.content"
    )


CHAT_SQL = f"""WITH {Q.CONV},
h AS (SELECT *, length(content) // 2 AS m FROM conv)
SELECT session_id, turn_index, role,
  CASE role WHEN 'system' THEN ''
    WHEN 'tool' THEN left(content, m) || chr(10) || substr(content, m + 1)
    ELSE content END AS content FROM h"""


def _calls(spark, sf_dir) -> DataFrame:
    """Tool log with its JSON arguments; those of retries are cut off and no longer JSON."""
    props = overlay.table(spark, sf_dir, "events").select("event_id", "props")
    log = props.join(overlay.tool_log(spark, sf_dir), "event_id")
    broken = F.left("props", F.length("props") - 1)
    return log.select(
        "event_id", "session_id", "name",
        F.when(F.col("name") == "run_retry", broken).otherwise(F.col("props")).alias("arguments"),
        F.concat(F.lit("call-"), "event_id").alias("call_id"),
    )


CALLS = f"""{Q.TOOL_LOG},
calls AS (SELECT t.event_id, t.session_id, t.name, 'call-' || t.event_id AS call_id,
  CASE WHEN t.name = 'run_retry' THEN left(e.props, length(e.props) - 1) ELSE e.props END AS arguments
  FROM tools t JOIN events e USING (event_id))"""
_ARGUMENTS = (
    "CASE WHEN name = 'run_retry' THEN '{\"_raw\":' || to_json(arguments) || '}' "
    "ELSE arguments END AS arguments"
)


def _unnested(rows: DataFrame, response: Column) -> DataFrame:
    return (
        rows.withColumn("response", response)
        .select("event_id", "response.message_out", F.explode_outer("response.calls").alias("call"))
        .select(
            "event_id", "message_out.role", "message_out.content",
            F.col("call.id").alias("call_id"), F.col("call.name").alias("name"),
            F.col("call.arguments").alias("arguments"),
        )
    )


def _wire_call() -> Column:
    return F.struct(
        F.col("call_id").alias("id"),
        F.lit("function").alias("type"),
        F.struct("name", "arguments").alias("function"),
    )


def ingest_completions(spark, sf_dir):
    """Completion responses with one tool call each."""
    message = F.struct(
        F.lit("assistant").alias("role"),
        F.lit(None).cast("string").alias("content"),
        F.array(_wire_call()).alias("tool_calls"),
    )
    raw = _json(choices=F.array(F.struct(message.alias("message"))))
    rows = _parsed(_calls(spark, sf_dir).select("event_id", raw.alias("raw")))
    owner = F.col("event_id").cast("string")
    return _unnested(rows, logs.completion_response(F.col("record"), owner))


COMPLETIONS_SQL = f"""WITH {CALLS}
SELECT event_id, 'assistant' AS role, '' AS content, call_id, name, {_ARGUMENTS} FROM calls"""


def ingest_blocks(spark, sf_dir):
    """Content-block responses: text, a tool_use block, and text again; a retry has no
    object as input."""
    none = F.lit(None).cast("string")

    def block(kind: str, text=none, call=none, name=none, value=none) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), text.alias("text"), call.alias("id"),
            name.alias("name"), value.alias("value"),
        )

    blocks = F.array(
        block("text", F.lit("Calling")),
        block("tool_use", none, F.col("call_id"), F.col("name"), F.col("arguments")),
        block("text", F.col("name")),
    )
    quoted = _json(role=F.lit("assistant"), content=blocks)
    # the input of a call is JSON itself, not a quoted string
    as_object = F.regexp_replace(quoted, r'"value":"\{\\"k\\": (\d+)\}"', r'"input":{"k": $1}')
    rows = _parsed(_calls(spark, sf_dir).select("event_id", as_object.alias("raw")))
    return _unnested(rows, logs.block_response(F.col("record")))


BLOCKS_SQL = f"""WITH {CALLS}
SELECT event_id, 'assistant' AS role, 'Calling' || chr(10) || name AS content, call_id, name,
  CASE WHEN name = 'run_retry' THEN '{{}}' ELSE replace(arguments, ' ', '') END AS arguments FROM calls"""


def ingest_langchain(spark, sf_dir):
    """Generations whose tool calls come in the older wire form, by role class names."""
    kwargs = F.struct(F.array(_wire_call()).alias("tool_calls"))
    class_name = (
        F.when(F.col("name") == "search", "HumanMessage")
        .when(F.col("name") == "read_page", "ToolMessage")
        .when(F.col("name") == "run_retry", "OtherMessage")
        .otherwise("AIMessage")
    )
    raw = _json(
        type=class_name, content=F.col("name"), tool_calls=F.array().cast("array<string>"),
        additional_kwargs=kwargs,
    )
    rows = _parsed(_calls(spark, sf_dir).select("event_id", raw.alias("raw")))
    record = F.col("record")
    response = F.struct(
        logs.langchain_message(record).alias("message_out"),
        logs.langchain_calls(record, F.col("event_id").cast("string")).alias("calls"),
    )
    return _unnested(rows, response)


LANGCHAIN_SQL = f"""WITH {CALLS}
SELECT event_id, CASE name WHEN 'search' THEN 'user' WHEN 'read_page' THEN 'tool'
  WHEN 'run_retry' THEN 'user' ELSE 'assistant' END AS role, name AS content, call_id, name,
  {_ARGUMENTS} FROM calls"""


def ingest_autogen(spark, sf_dir):
    """Replies: text for searches, null for page reads, else an object with a tool call."""
    reply = (
        F.when(F.col("name") == "search", F.concat(F.lit('"'), F.col("call_id"), F.lit('"')))
        .when(F.col("name") == "read_page", "null")
        .otherwise(_json(content=F.col("name"), tool_calls=F.array(_wire_call())))
    )
    rows = _parsed(_calls(spark, sf_dir).select("event_id", reply.alias("raw")))
    owner = F.col("event_id").cast("string")
    return _unnested(rows, logs.autogen_reply(F.col("record"), owner))


AUTOGEN_SQL = f"""WITH {CALLS},
c AS (SELECT *, name IN ('search', 'read_page') AS bare FROM calls)
SELECT event_id, 'assistant' AS role, CASE name WHEN 'search' THEN call_id WHEN 'read_page' THEN ''
  ELSE name END AS content, CASE WHEN NOT bare THEN call_id END AS call_id,
  CASE WHEN NOT bare THEN name END AS name, CASE WHEN NOT bare THEN arguments END AS arguments
FROM (SELECT event_id, bare, call_id, name, {_ARGUMENTS} FROM c)"""


def model_names(spark, sf_dir):
    """Model name of every tool call by the order of preference of two log formats."""
    log = _calls(spark, sf_dir)
    name = F.col("name")
    serialized = _json(
        kwargs=F.struct(F.when(name == "search", "ctor-model").alias("model")),
        id=F.when(name != "run_retry", F.array(F.lit("chat"), F.concat(F.lit("Class"), name))),
        name=F.lit("plain-name"),
    )
    kwargs = _json(
        invocation_params=F.struct(
            F.when(name == "read_page", "").otherwise(F.lit(None).cast("string")).alias("model_name"),
            F.when(name == "read_page", "call-model").alias("model"),
        )
    )
    config = _json(
        config_list=F.array(F.struct(F.when(name == "search", "listed").otherwise("").alias("model"))),
        model=F.when(name != "run_retry", "flat"),
    )
    parse = logs.parse_record
    return log.select(
        "event_id",
        logs.langchain_model(parse(serialized), parse(kwargs)).alias("chain_model"),
        logs.autogen_model(parse(config)).alias("agent_model"),
    )


MODEL_NAMES_SQL = f"""WITH {CALLS}
SELECT event_id,
  CASE name WHEN 'read_page' THEN 'call-model' WHEN 'search' THEN 'ctor-model'
    WHEN 'run_retry' THEN 'plain-name' ELSE 'Class' || name END AS chain_model,
  CASE name WHEN 'search' THEN 'listed' WHEN 'run_retry' THEN 'unknown' ELSE 'flat' END AS agent_model
FROM calls"""


def decoded_payloads(spark, sf_dir):
    """Stored JSON payloads of trace events, one in a broken file, back to typed rows."""
    conv = overlay.conversations(spark, sf_dir)
    message = F.struct(
        "role", "content", F.lit(None).cast("string").alias("tool_call_id"),
        F.lit(None).cast("string").alias("tool_calls"),
    )
    payload = _json(
        event_id=F.concat_ws(":", "session_id", F.col("turn_index").cast("string")),
        session_id=F.col("session_id"),
        turn_index=F.col("turn_index"),
        messages_in=F.array(message),
        model=F.lit("m"),
    )
    cut = F.when(F.col("role") == "system", F.left(payload, F.length(payload) - 3)).otherwise(payload)
    good, bad = tables.decode_payloads(conv.select(cut.alias("payload")))
    rows = good.select(
        "event_id", "turn_index", F.col("messages_in")[0]["content"].alias("content"),
        F.lit(True).alias("valid"),
    )
    rejects = bad.select(
        F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("int").alias("turn_index"),
        F.md5("payload").alias("content"), F.lit(False).alias("valid"),
    )
    return rows.unionByName(rejects).groupBy("valid").agg(
        F.count(F.lit(1)).alias("payloads"), F.sum("turn_index").alias("turns"),
        F.sum(F.when(F.col("valid"), F.length("content"))).alias("chars"),
    )


DECODED_SQL = f"""WITH {Q.CONV}
SELECT role <> 'system' AS valid, count(*) AS payloads,
  CAST(sum(turn_index) FILTER (role <> 'system') AS BIGINT) AS turns,
  CAST(sum(length(content)) FILTER (role <> 'system') AS BIGINT) AS chars
FROM conv GROUP BY 1"""


def system_prompts(spark, sf_dir):
    """System prompt in front of the messages of an event when it is not empty."""
    conv = overlay.conversations(spark, sf_dir)
    none = F.lit(None).cast("string")
    messages = F.array(
        F.struct("role", "content", none.alias("tool_call_id"), none.alias("tool_calls"))
    )
    prompt = F.when(F.col("turn_index") == 0, F.concat(F.lit("Be helpful in "), "session_id")).when(
        F.col("turn_index") == 1, ""
    )
    listed = logs.with_system_prompt(prompt, messages)
    return conv.select("session_id", "turn_index", F.posexplode(listed).alias("nth", "m")).select(
        "session_id", "turn_index", "nth", "m.role", "m.content"
    )


PROMPTS_SQL = f"""WITH {Q.CONV}
SELECT session_id, turn_index, CASE WHEN turn_index = 0 THEN 1 ELSE 0 END AS nth, role, content FROM conv
UNION ALL SELECT session_id, turn_index, 0, 'system', 'Be helpful in ' || session_id
FROM conv WHERE turn_index = 0"""


QUERIES = {
    "ingest_chat": (ingest_chat, CHAT_SQL),
    "ingest_completions": (ingest_completions, COMPLETIONS_SQL),
    "ingest_blocks": (ingest_blocks, BLOCKS_SQL),
    "ingest_langchain": (ingest_langchain, LANGCHAIN_SQL),
    "ingest_autogen": (ingest_autogen, AUTOGEN_SQL),
    "model_names": (model_names, MODEL_NAMES_SQL),
    "decoded_payloads": (decoded_payloads, DECODED_SQL),
    "system_prompts": (system_prompts, PROMPTS_SQL),
}
