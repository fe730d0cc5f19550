"""Turning logged client records (JSON text) into messages and tool calls.

Records are parsed once into VARIANT; everything after that is path access on columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values: role names of the log formats ------------------------------------
LANGCHAIN_ROLES = {
    "HumanMessage": "user",
    "AIMessage": "assistant",
    "SystemMessage": "system",
    "ToolMessage": "tool",
    "FunctionMessage": "tool",
    "ChatMessage": "user",
}
AUTOGEN_ROLES = {
    "user": "user",
    "assistant": "assistant",
    "system": "system",
    "tool": "tool",
    "function": "tool",
}
# -------------------------------------------------------------------------------------

_CALL = "struct<id:string,name:string,arguments:string>"
_NO_CALLS = f"array<{_CALL}>"


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _text(value: Column, path: str = "$") -> Column:
    return _at(value, path, "string")


def _items(value: Column, path: str = "$") -> Column:
    return _at(value, path, "array<variant>")


def _kind(value: Column) -> Column:
    """STRING, OBJECT<...>, ARRAY<...>, VOID (JSON null) or a number type; null if absent."""
    return F.schema_of_variant(value)


def _is_object(value: Column) -> Column:
    return _at(value, "$", "map<string,variant>").isNotNull()


def _is_array(value: Column) -> Column:
    return _items(value).isNotNull()


def _is_string(value: Column) -> Column:
    # the type name of a nested value is costly, so only plain values are asked for it
    plain = ~_is_object(value) & ~_is_array(value)
    return F.when(plain, F.coalesce(_kind(value) == "STRING", F.lit(False))).otherwise(False)


def _is_absent(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _json_or_text(value: Column) -> Column:
    """A string as it is, anything else as JSON, nothing as ''."""
    return (
        F.when(_is_absent(value), "")
        .when(_is_string(value), _text(value))
        .otherwise(F.to_json(value))
    )


def parse_record(raw: Column) -> Column:
    """VARIANT of a JSON record, null when it is not JSON."""
    return F.try_parse_json(raw)


def content_text(content: Column) -> Column:
    """Message content as one string: a string as it is, a list as its parts' text (or
    JSON) joined by newlines, null as ''."""
    parts = F.transform(
        _items(content),
        lambda part: F.when(
            _is_object(part), F.coalesce(_text(part, "$.text"), F.to_json(part))
        ).otherwise(_json_or_text(part)),
    )
    return F.when(_is_array(content), F.array_join(parts, "\n")).otherwise(
        _json_or_text(content)
    )


def chat_message(record: Column) -> Column:
    """Chat-style record to a message struct; the role defaults to user."""
    calls = _at(record, "$.tool_calls")
    return F.struct(
        F.coalesce(_text(record, "$.role"), F.lit("user")).alias("role"),
        content_text(_at(record, "$.content")).alias("content"),
        _text(record, "$.tool_call_id").alias("tool_call_id"),
        F.when(~_is_absent(calls), F.to_json(calls)).alias("tool_calls"),
    )


def _arguments(value: Column) -> Column:
    """Call arguments as JSON text; text that is not JSON becomes {"_raw": text}."""
    text = _text(value)
    wrapped = F.to_json(F.struct(text.alias("_raw")))
    parsed = F.when(F.try_parse_json(text).isNotNull(), text).otherwise(wrapped)
    return (
        F.when(_is_string(value), parsed)
        .when(_is_absent(value), "{}")
        .otherwise(F.to_json(value))
    )


def _function_call(call: Column, position: Column, owner: Column) -> Column:
    """Wire-format call {id, function: {name, arguments}}; a missing id is derived."""
    derived = F.sha2(F.concat_ws("\x1f", owner, position.cast("string")), 256)
    return F.struct(
        F.coalesce(_text(call, "$.id"), derived).alias("id"),
        F.coalesce(_text(call, "$.function.name"), F.lit("unknown")).alias("name"),
        _arguments(_at(call, "$.function.arguments")).alias("arguments"),
    )


def _function_calls(calls: Column, owner: Column) -> Column:
    objects = F.filter(F.coalesce(calls, F.array().cast("array<variant>")), _is_object)
    return F.transform(objects, lambda call, i: _function_call(call, i, owner))


def completion_response(response: Column, owner: Column) -> Column:
    """Completion-style response: first choice's message and its tool calls."""
    message = _at(response, "$.choices[0].message")
    calls = _at(message, "$.tool_calls")
    return F.struct(
        F.struct(
            F.coalesce(_text(message, "$.role"), F.lit("assistant")).alias("role"),
            content_text(_at(message, "$.content")).alias("content"),
            F.when(~_is_absent(calls), F.to_json(calls)).alias("tool_calls"),
        ).alias("message_out"),
        _function_calls(_items(calls), owner).alias("calls"),
    )


def block_response(response: Column) -> Column:
    """Content-block response: text blocks joined by newlines, tool_use blocks as calls."""
    content = F.coalesce(_items(response, "$.content"), F.array().cast("array<variant>"))
    texts = F.filter(content, lambda b: _text(b, "$.type") == "text")
    uses = F.filter(content, lambda b: _text(b, "$.type") == "tool_use")
    calls = F.transform(
        uses,
        lambda b: F.struct(
            _text(b, "$.id").alias("id"),
            _text(b, "$.name").alias("name"),
            F.when(_is_object(_at(b, "$.input")), F.to_json(_at(b, "$.input")))
            .otherwise("{}")
            .alias("arguments"),
        ),
    )
    raw = F.transform(uses, lambda b: F.to_json(b))
    return F.struct(
        F.struct(
            F.coalesce(_text(response, "$.role"), F.lit("assistant")).alias("role"),
            F.array_join(F.transform(texts, lambda b: _text(b, "$.text")), "\n").alias("content"),
            F.when(F.size(raw) > 0, F.concat(F.lit("["), F.array_join(raw, ","), F.lit("]"))).alias(
                "tool_calls"
            ),
        ).alias("message_out"),
        calls.alias("calls"),
    )


def with_system_prompt(system: Column, messages: Column) -> Column:
    """Put a non-empty system prompt in front of an array of message structs."""
    none = F.lit(None).cast("string")
    first = F.struct(
        F.lit("system").alias("role"),
        system.alias("content"),
        none.alias("tool_call_id"),
        none.alias("tool_calls"),
    )
    return F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.array(first), messages)).otherwise(
        messages
    )


def _role(name: Column, roles: dict[str, str]) -> Column:
    mapped = F.lit(None).cast("string")
    for key, role in roles.items():
        mapped = F.when(name == key, role).otherwise(mapped)
    return F.coalesce(mapped, F.lit("user"))


def langchain_message(record: Column) -> Column:
    """{type: class name, content, tool_call_id} to a message; unknown classes are users."""
    return F.struct(
        _role(_text(record, "$.type"), LANGCHAIN_ROLES).alias("role"),
        _json_or_text(_at(record, "$.content")).alias("content"),
        _text(record, "$.tool_call_id").alias("tool_call_id"),
    )


def langchain_calls(message: Column, owner: Column) -> Column:
    """Tool calls of a generation's message: the name/args/id list, or the older wire form
    under additional_kwargs when that list is empty."""
    modern = F.coalesce(_items(message, "$.tool_calls"), F.array().cast("array<variant>"))
    legacy = F.coalesce(
        _items(message, "$.additional_kwargs.tool_calls"), F.array().cast("array<variant>")
    )
    chosen = F.when(F.size(modern) > 0, modern).otherwise(legacy)
    usable = F.filter(
        chosen,
        lambda c: _is_object(c)
        & (_at(c, "$.function").isNotNull() | _at(c, "$.name").isNotNull()),
    )

    def named(call: Column, position: Column) -> Column:
        derived = F.sha2(F.concat_ws("\x1f", owner, position.cast("string")), 256)
        args = _at(call, "$.args")
        return F.struct(
            F.coalesce(_text(call, "$.id"), derived).alias("id"),
            _text(call, "$.name").alias("name"),
            F.when(_is_absent(args), "{}").otherwise(F.to_json(args)).alias("arguments"),
        )

    return F.transform(
        usable,
        lambda c, i: F.when(_at(c, "$.function").isNotNull(), _function_call(c, i, owner))
        .otherwise(named(c, i)),
    )


def autogen_message(record: Column) -> Column:
    return F.struct(
        _role(F.coalesce(_text(record, "$.role"), F.lit("user")), AUTOGEN_ROLES).alias("role"),
        _json_or_text(_at(record, "$.content")).alias("content"),
        _text(record, "$.tool_call_id").alias("tool_call_id"),
    )


def autogen_reply(reply: Column, owner: Column) -> Column:
    """A reply that is text, an object with content and tool calls, null, or anything else."""
    content = (
        F.when(_is_object(reply), _json_or_text(_at(reply, "$.content")))
        .otherwise(_json_or_text(reply))
    )
    calls = F.when(_is_object(reply), _function_calls(_items(reply, "$.tool_calls"), owner))
    return F.struct(
        F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message_out"),
        F.coalesce(calls, F.array().cast(_NO_CALLS)).alias("calls"),
    )


def _first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def langchain_model(serialized: Column, kwargs: Column) -> Column:
    """Model name: invocation parameters, then constructor arguments, then the last part of
    the class id, then the name."""
    ids = _items(serialized, "$.id")
    return F.coalesce(
        _first_filled(
            _text(kwargs, "$.invocation_params.model_name"),
            _text(kwargs, "$.invocation_params.model"),
            _text(serialized, "$.kwargs.model_name"),
            _text(serialized, "$.kwargs.model"),
        ),
        F.when(F.size(ids) > 0, _text(F.try_element_at(ids, F.lit(-1)))),
        _text(serialized, "$.name"),
        F.lit("unknown"),
    )


def autogen_model(llm_config: Column) -> Column:
    """Model name: first entry of config_list, then the flat setting."""
    return F.coalesce(
        F.nullif(_text(llm_config, "$.config_list[0].model"), F.lit("")),
        _text(llm_config, "$.model"),
        F.lit("unknown"),
    )


def split_records(df: DataFrame, raw: str, out: str = "record") -> tuple[DataFrame, DataFrame]:
    """(rows whose raw text is JSON, the others)."""
    parsed = df.withColumn(out, parse_record(F.col(raw)))
    return parsed.filter(F.col(out).isNotNull()), parsed.filter(F.col(out).isNull()).drop(out)
