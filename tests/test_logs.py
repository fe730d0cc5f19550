import json

import pytest
from pyspark.sql import functions as F

from turnsift.sources import logs


def one(spark, value, column):
    raw = value if isinstance(value, str) else json.dumps(value)
    df = spark.createDataFrame([(raw,)], "raw string").withColumn("record", logs.parse_record(F.col("raw")))
    return df.select(column.alias("x")).first()["x"]


def record():
    return F.col("record")


def OWNErecord():
    return F.lit("owner")


@pytest.mark.parametrize(
    "content, want",
    [
        ("plain", "plain"),
        (None, ""),
        ([{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "a\nb"),
        ([{"type": "image", "url": "u"}, "bare"], '{"type":"image","url":"u"}\nbare'),
        ([], ""),
        ("[1]", "[1]"),
        (7, "7"),
    ],
)
def test_content(spark, content, want):
    assert one(spark, {"role": "tool", "content": content}, logs.chat_message(record()))["content"] == want


def test_chat_message_defaults(spark):
    got = one(spark, {"tool_calls": [{"id": "1"}], "tool_call_id": "c"}, logs.chat_message(record()))
    assert tuple(got) == ("user", "", "c", '[{"id":"1"}]')


def test_completion(spark):
    response = {"choices": [{"message": {"role": "assistant", "content": None, "tool_calls": [
        {"id": "c1", "type": "function", "function": {"name": "search", "arguments": '{"q": "x"}'}},
        {"id": "c2", "type": "function", "function": {"name": "bad", "arguments": "not json"}},
    ]}}]}
    got = one(spark, response, logs.completion_response(record(), OWNErecord()))
    assert got["message_out"]["content"] == "" and got["message_out"]["role"] == "assistant"
    assert [tuple(c) for c in got["calls"]] == [("c1", "search", '{"q": "x"}'), ("c2", "bad", '{"_raw":"not json"}')]
    plain = one(spark, {"choices": [{"message": {"role": "assistant", "content": "hi"}}]}, logs.completion_response(record(), OWNErecord()))
    assert plain["calls"] == [] and plain["message_out"]["tool_calls"] is None


def test_blocks(spark):
    response = {"content": [
        {"type": "text", "text": "one"}, {"type": "tool_use", "id": "t", "name": "n", "input": {"a": 1}},
        {"type": "tool_use", "id": "u", "name": "m", "input": "text"}, {"type": "text", "text": "two"},
    ]}
    got = one(spark, response, logs.block_response(record()))
    assert tuple(got["message_out"])[:2] == ("assistant", "one\ntwo")
    assert [tuple(c) for c in got["calls"]] == [("t", "n", '{"a":1}'), ("u", "m", "{}")]


@pytest.mark.parametrize(
    "name, role",
    [("HumanMessage", "user"), ("AIMessage", "assistant"), ("SystemMessage", "system"),
     ("ToolMessage", "tool"), ("FunctionMessage", "tool"), ("ChatMessage", "user"), ("Else", "user")],
)
def test_langchain_roles(spark, name, role):
    got = one(spark, {"type": name, "content": {"a": 1}, "tool_call_id": "i"}, logs.langchain_message(record()))
    assert tuple(got) == (role, '{"a":1}', "i")


def test_langchain_calls(spark):
    modern = {"tool_calls": [{"name": "n", "args": {"x": 1}, "id": "1"}, "junk", {"other": 1}, {"name": "m", "args": None}],
              "additional_kwargs": {"tool_calls": [{"id": "z", "function": {"name": "unused"}}]}}
    got = one(spark, modern, logs.langchain_calls(record(), OWNErecord()))
    assert [(c["name"], c["arguments"]) for c in got] == [("n", '{"x":1}'), ("m", "{}")]
    assert got[0]["id"] == "1" and len(got[1]["id"]) == 64
    legacy = {"tool_calls": [], "additional_kwargs": {"tool_calls": [
        {"id": "z", "function": {"name": "f", "arguments": "oops"}}, {"function": {"arguments": {"k": 1}}}]}}
    got = one(spark, legacy, logs.langchain_calls(record(), OWNErecord()))
    assert [(c["name"], c["arguments"]) for c in got] == [("f", '{"_raw":"oops"}'), ("unknown", '{"k":1}')]
    assert one(spark, {"content": "x"}, logs.langchain_calls(record(), OWNErecord())) == []


@pytest.mark.parametrize(
    "reply, content, names",
    [('"text"', "text", []), ("null", "", []), ("12", "12", []), ('{"content": null}', "", []),
     ('{"content": [1]}', "[1]", []),
     ('{"content": "c", "tool_calls": [{"id": "1", "function": {"name": "f"}}, 5, {"id": "2"}]}', "c", ["f", "unknown"])],
)
def test_autogen_reply(spark, reply, content, names):
    got = one(spark, reply, logs.autogen_reply(record(), OWNErecord()))
    assert got["message_out"]["content"] == content
    assert [c["name"] for c in got["calls"]] == names


def test_autogen_message_and_models(spark):
    got = one(spark, {"role": "function", "content": None}, logs.autogen_message(record()))
    assert tuple(got)[:2] == ("tool", "")
    assert one(spark, {"role": "odd", "content": "x"}, logs.autogen_message(record()))["role"] == "user"
    none = F.try_parse_json(F.lit(None).cast("string"))
    for value, want in [
        ({"kwargs": {"model": "k"}, "id": ["a", "B"]}, "k"), ({"id": ["a", "B"], "name": "n"}, "B"),
        ({"name": "n"}, "n"), ({}, "unknown"),
    ]:
        assert one(spark, value, logs.langchain_model(record(), none)) == want
    for value, want in [
        ({"config_list": [{"model": "a"}], "model": "b"}, "a"), ({"config_list": [], "model": "b"}, "b"), ({}, "unknown"),
    ]:
        assert one(spark, value, logs.autogen_model(record())) == want


def test_rejects(spark):
    df = spark.createDataFrame([("{}",), ("{oops",), (None,)], "raw string")
    good, bad = logs.split_records(df, "raw")
    assert (good.count(), bad.count()) == (1, 2)
