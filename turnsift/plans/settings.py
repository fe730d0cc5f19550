"""Registered queries for stored signals, settings, rule tables, models, alerts and record forms
that the other queries do not reach."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnsift import schema as S
from turnsift.config import ScanConfig
from turnsift.functions import scoring
from turnsift.functions.rules import HEURISTIC, RULES, Rule
from turnsift.operators import chain, detect, evaluate, model
from turnsift.operators.durable import durable, ensure_checkpoint_dir, written
from turnsift.plans import overlay, sql as Q
from turnsift.plans.detection import joined, signals
from turnsift.plans.fingerprinting import arrived
from turnsift.plans.ingest import CALLS, _calls, _json, _parsed, _unnested
from turnsift.sources import logs, tables
from turnsift.streaming.outbox import Outbox
from turnsift.streaming.sinks import SignalSink, alert_feed

def _wanted(spark, sf_dir):
    """Sessions to look up, taken from the data: those with a signal of 0.5 or more."""
    return signals(spark, sf_dir).filter("score >= 0.5").select("session_id").distinct()


_WANTED_SQL = "(SELECT session_id FROM sig WHERE score >= 0.5)"


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _signals_read_back(spark, sf_dir):
    folder = _folder(spark, "signals")
    tables.write_signals(signals(spark, sf_dir), folder)
    return tables.read_table(spark, folder, S.SIGNALS)


def _signal_columns(read):
    return read.select("session_id", "turn_index", "msg_index", "stage", "score", joined("matched_heuristics").alias("rules"))


def stored_signals(spark, sf_dir):
    """Signals written to their table and read back for the sessions with a strong one."""
    return _signal_columns(tables.wanted_rows(_signals_read_back(spark, sf_dir), _wanted(spark, sf_dir)))


def stored_signals_whole(spark, sf_dir):
    """Signals written to their table and read back for all sessions."""
    return _signal_columns(_signals_read_back(spark, sf_dir))


STORED_SQL = f"""WITH {Q.ALL_SIGNALS}
SELECT session_id, turn_index, msg_index, stage, score, rules FROM sig WHERE session_id IN {_WANTED_SQL}"""

STORED_WHOLE_SQL = f"""WITH {Q.ALL_SIGNALS}
SELECT session_id, turn_index, msg_index, stage, score, rules FROM sig"""


def _events_read_back(spark, sf_dir):
    folder = _folder(spark, "events")
    conv = overlay.conversations(spark, sf_dir)
    none = F.lit(None).cast("string")
    message = F.struct("role", "content", none.alias("tool_call_id"), none.alias("tool_calls"))
    events = conv.select(
        F.concat_ws(":", "session_id", "turn_index").alias("event_id"), "session_id", "turn_index",
        F.col("ts").alias("timestamp"), F.array(message).alias("messages_in"), message.alias("message_out"),
        F.array().cast(S.TRACE_EVENTS["tool_calls"].dataType).alias("tool_calls"), F.lit("m").alias("model"),
        F.array().cast("array<string>").alias("external_sources"), F.lit("").alias("prev_hash"),
        F.lit("").alias("event_hash"),
    )
    tables.write_events(events, folder)
    return tables.read_table(spark, folder, S.TRACE_EVENTS)


def _event_columns(read):
    return read.select("event_id", "session_id", "turn_index", "timestamp", F.col("message_out.role").alias("role"))


def session_log(spark, sf_dir):
    """Events of the sessions with a strong signal, found by a table of ids."""
    return _event_columns(tables.wanted_rows(_events_read_back(spark, sf_dir), _wanted(spark, sf_dir)))


def session_log_whole(spark, sf_dir):
    """Events of all sessions, read back from the events table."""
    return _event_columns(_events_read_back(spark, sf_dir))


SESSION_LOG_SQL = f"""WITH {Q.ALL_SIGNALS}
SELECT session_id || ':' || turn_index AS event_id, session_id, turn_index, ts AS timestamp, role
FROM conv WHERE session_id IN {_WANTED_SQL}"""


def wanted_sessions(spark, sf_dir):
    """Events of the sessions whose number is divisible by 100, from a table bucketed by session."""
    read = _events_read_back(spark, sf_dir)
    stored = tables.write_bucketed(read, f"events_{uuid.uuid4().hex}", _folder(spark, "bucketed"))
    wanted = overlay.conversations(spark, sf_dir).filter("CAST(session_id AS bigint) % 100 = 0").select("session_id")
    return _event_columns(tables.wanted_rows(stored, wanted))


WANTED_SQL = f"""WITH {Q.CONV}
SELECT session_id || ':' || turn_index AS event_id, session_id, turn_index, ts AS timestamp, role
FROM conv WHERE CAST(session_id AS BIGINT) % 100 = 0"""

SESSION_LOG_WHOLE_SQL = f"""WITH {Q.CONV}
SELECT session_id || ':' || turn_index AS event_id, session_id, turn_index, ts AS timestamp, role FROM conv"""


def _length_model():
    """Stands for a loaded model: a score that depends on the whole text."""
    return lambda texts: [len(text) % 101 / 100 for text in texts]


def model_formulas(spark, sf_dir):
    """Weighted and additive scores with a model, and without one by setting."""
    conv = overlay.conversations(spark, sf_dir)
    scorer = model.python_scorer(lambda: _length_model())
    scored = detect.with_scan(conv, "content", scorer=scorer)
    off = scoring.averaged(F.col("h_points"), F.col("ib_points"))
    unused = detect.with_scan(conv, "content", ScanConfig(use_model=False), scorer=scorer)
    plain = unused.select("session_id", "turn_index", F.col("score").alias("without_model"))
    return scored.select(
        "session_id", "turn_index", F.round("score", 4).alias("score"),
        F.round(scoring.additive(F.col("h_points"), F.col("ib_points"), F.col("ml_score")), 4).alias("additive"),
        off.alias("averaged"),
    ).join(plain, ["session_id", "turn_index"])


MODEL_SQL = f"""WITH {Q.CONV},
{Q.with_rules('conv', 'content', 'ruled')},
m AS (SELECT *, (length(content) % 101) / 100.0 AS ml FROM ruled)
SELECT session_id, turn_index, round(0.3 * hp / 100.0 + 0.4 * ml + 0.3 * ibp / 100.0, 4) AS score,
  round(least(1.0, least(hp + ibp, 100) / 100.0 + 0.4 * ml), 4) AS additive,
  (hp + ibp) / 200.0 AS averaged, (hp + ibp) / 200.0 AS without_model FROM m"""

CHOSEN_RULES = ("H01", "H06", "IB07")


def custom_rules(spark, sf_dir):
    """Scores of a rule table of one's own: three rules with doubled weights."""
    rules = [
        type(r)(r.rule_id, r.family, min(100, 2 * r.points), r.regex, r.label, r.needs)
        for r in RULES if r.rule_id in CHOSEN_RULES
    ]
    scored = detect.text_check(overlay.conversations(spark, sf_dir), "content", rules=rules)
    return scored.select("session_id", "turn_index", "score", "verdict", joined("matched_patterns").alias("rules"))


def _chosen(family: str) -> str:
    terms = [
        f"{min(100, 2 * r.points)} * r_{r.rule_id.lower()}::INT"
        for r in RULES if r.rule_id in CHOSEN_RULES and r.rule_id.startswith(family)
    ]
    return f"least(100, {' + '.join(terms)})"


CUSTOM_SQL = f"""WITH {Q.CONV},
{Q.with_rules('conv', 'content', 'ruled')},
s AS (SELECT session_id, turn_index, ({_chosen('H')} + {_chosen('IB')}) / 200.0 AS score,
  concat_ws(',', {', '.join(f"CASE WHEN r_{i.lower()} THEN '{i}' END" for i in CHOSEN_RULES)}) AS rules FROM ruled)
SELECT session_id, turn_index, score, {Q.three_way('score')} AS verdict, rules FROM s"""


def numbered_rules(count: int = 500) -> list[Rule]:
    """Rule n looks for two letters, a vowel and a letter, all following from n; worth 1 to 4 points."""
    def letter(n: int) -> str:
        return chr(97 + n % 26)

    return [
        Rule(f"M{n:03}", HEURISTIC, n % 4 + 1, f"{letter(n)}{letter(n // 26)}[aeiou]{letter(n * 7)}", f"rule {n}",
             ((letter(n) + letter(n // 26),),))
        for n in range(count)
    ]


def many_rules(spark, sf_dir):
    """Every document against five hundred rules."""
    rules = numbered_rules()
    scanned = detect.text_scan(overlay.table(spark, sf_dir, "documents"), "text", rules)
    return scanned.select("doc_id", "score", F.array_join("matched_heuristics", ",").alias("rules"))


MANY_SQL = """WITH rules AS (SELECT n, 'M' || lpad(CAST(n AS VARCHAR), 3, '0') AS rule_id, n % 4 + 1 AS points,
  chr(CAST(97 + n % 26 AS INTEGER)) || chr(CAST(97 + (n // 26) % 26 AS INTEGER)) || '[aeiou]'
    || chr(CAST(97 + (n * 7) % 26 AS INTEGER)) AS pattern FROM range(500) t(n)),
hits AS (SELECT doc_id, string_agg(rule_id, ',' ORDER BY n) AS rules, sum(points) AS points
  FROM documents, rules WHERE regexp_matches(lower(text), pattern) GROUP BY doc_id)
SELECT d.doc_id, least(100, coalesce(points, 0)) / 100.0 AS score, coalesce(rules, '') AS rules
FROM documents d LEFT JOIN hits USING (doc_id)"""


def configured_signals(spark, sf_dir):
    """Message signals at the threshold a session setting names; a bad setting is ignored."""
    names = {"spark.turnsift.threshold": "0.4", "spark.turnsift.window_turns": "many"}
    for name, value in names.items():
        spark.conf.set(name, value)
    cfg = ScanConfig.from_session(spark)
    for name in names:
        spark.conf.unset(name)
    found = detect.message_signals(detect.with_own_sources(overlay.conversations(spark, sf_dir)), cfg)
    return found.select("session_id", "turn_index", "score", F.lit(cfg.window_turns).alias("window_turns"))


CONFIGURED_SQL = f"""WITH {Q.MESSAGE_SIGNALS}
SELECT session_id, turn_index, score, 3 AS window_turns FROM msg WHERE score >= 0.4"""


def alert_rows(spark, sf_dir):
    """The live view's columns of all alerts that a sink wrote in three batches."""
    sink = SignalSink(_folder(spark, "alerts"))
    found = written(signals(spark, sf_dir), "alert-signals")
    keyed = arrived(found).join(
        found.withColumn("signal_id", F.concat_ws(":", "session_id", F.col("turn_index").cast("string"), "stage"))
        .select("signal_id", "turn_index", "matched_heuristics", "source"), "signal_id",
    )
    part = F.pmod(F.col("session_id").cast("long"), F.lit(3))
    for number in range(3):
        sink(keyed.filter(part == number), number)
    feed = alert_feed(spark.read.parquet(sink.path("alerts")))
    return feed.withColumn("matched_heuristics", joined("matched_heuristics"))


ALERTS_SQL = f"""WITH {Q.ALL_SIGNALS}
SELECT session_id, turn_index, score, rules AS matched_heuristics, source, ev AS evidence_snippet FROM sig"""


def purge_partitions(spark, sf_dir):
    """Events left in the partitioned table after the compromised sessions were purged from it."""
    folder = _folder(spark, "purged")
    tables.write_events(_events_read_back(spark, sf_dir), folder)
    gone = signals(spark, sf_dir).filter("score >= 0.75").select("session_id")
    tables.purge_stored(spark, folder, gone)
    return tables.read_table(spark, folder, S.TRACE_EVENTS).select("event_id", "session_id", "turn_index")


PURGED_SQL = f"""WITH {Q.ALL_SIGNALS}
SELECT session_id || ':' || turn_index AS event_id, session_id, turn_index FROM conv
WHERE session_id NOT IN (SELECT session_id FROM sig WHERE score >= 0.75)"""


def _takes(alert, event) -> None:
    pass


def _refuses_tools(alert, event) -> None:
    if event.role == "tool":
        raise ValueError(f"refused {len(event.content)}")


def alert_deliveries(spark, sf_dir):
    """The delivery log of all alerts for two handlers, one of which refuses the messages of tools; the
    batch runs twice."""
    found = durable(signals(spark, sf_dir))
    alerts = durable(arrived(found).join(
        found.withColumn("signal_id", F.concat_ws(":", "session_id", F.col("turn_index").cast("string"), "stage"))
        .select("signal_id", "turn_index"), "signal_id",
    ))
    events = overlay.conversations(spark, sf_dir).select("session_id", "turn_index", "role", "content")
    box = Outbox(_folder(spark, "outbox"), {"log": _takes, "strict": _refuses_tools})
    for _ in range(2):
        box.deliver(alerts, 0, events)
    return box.log(spark).select("handler", "signal_id", "status", "attempts", "error")


DELIVERIES_SQL = f"""WITH {Q.ALL_SIGNALS},
a AS (SELECT sig.session_id || ':' || sig.turn_index || ':' || stage AS signal_id, role = 'tool' AS refused,
  length(content) AS chars FROM sig JOIN conv USING (session_id, turn_index))
SELECT 'log' AS handler, signal_id, 'delivered' AS status, 1 AS attempts, CAST(NULL AS VARCHAR) AS error FROM a
UNION ALL SELECT 'strict', signal_id, CASE WHEN refused THEN 'dead' ELSE 'delivered' END,
  CASE WHEN refused THEN 2 ELSE 1 END, CASE WHEN refused THEN 'ValueError: refused ' || chars END FROM a"""


def imported_hashes(spark, sf_dir):
    """Verified imported traces; every seventh was changed after it was hashed."""
    conv = overlay.conversations(spark, sf_dir)
    body = F.concat(
        F.lit('{"prev_hash": "p", "role": "'), "role", F.lit('", "session_id": "'), "session_id",
        F.lit('", "turn_index": '), F.col("turn_index").cast("string"), F.lit("}"),
    )
    changed = F.col("turn_index") % 7 == 3
    events = conv.select(
        "session_id", "turn_index", F.lit("p").alias("prev_hash"),
        F.sha2(F.concat(F.lit("p"), body), 256).alias("event_hash"),
        F.concat(
            F.lit('{"turn_index": '), F.col("turn_index").cast("string"), F.lit(', "event_hash": "x", "session_id": "'),
            "session_id", F.lit('", "role": "'), F.when(changed, "forged").otherwise(F.col("role")), F.lit('"}'),
        ).alias("payload"),
    )
    return chain.with_imported_hash_check(events).select("session_id", "turn_index", "event_hash", "hash_ok")


IMPORTED_SQL = f"""WITH {Q.CONV}
SELECT session_id, turn_index, sha256('p' || '{{"prev_hash": "p", "role": "' || role || '", "session_id": "' ||
  session_id || '", "turn_index": ' || turn_index || '}}') AS event_hash, turn_index % 7 <> 3 AS hash_ok FROM conv"""


def stage_timings(spark, sf_dir):
    """Runs, mean and deviation; the event values stand for measured seconds."""
    timed = overlay.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"), F.col("value").alias("seconds")
    )
    return evaluate.stage_times(timed).select(
        "stage", "runs", F.round("mean_seconds", 6).alias("mean_seconds"), F.round("sd_seconds", 6).alias("sd_seconds")
    )


TIMINGS_SQL = """SELECT event_type AS stage, count(value) AS runs, round(avg(value), 6) AS mean_seconds,
  round(stddev_samp(value), 6) AS sd_seconds FROM events GROUP BY 1"""


def ingest_modern_calls(spark, sf_dir):
    """Generations whose tool calls come as name, arguments object and id."""
    call = F.struct(F.col("name").alias("name"), F.struct(F.col("event_id").alias("n")).alias("args"), F.col("call_id").alias("id"))
    raw = _json(type=F.lit("AIMessage"), content=F.lit(""), tool_calls=F.array(call))
    rows = _parsed(_calls(spark, sf_dir).select("event_id", raw.alias("raw")))
    record = F.col("record")
    response = F.struct(
        logs.langchain_message(record).alias("message_out"),
        logs.langchain_calls(record, F.col("event_id").cast("string")).alias("calls"),
    )
    return _unnested(rows, response)


MODERN_SQL = f"""WITH {CALLS}
SELECT event_id, 'assistant' AS role, '' AS content, call_id, name, '{{"n":' || event_id || '}}' AS arguments
FROM calls"""


def ingest_autogen_messages(spark, sf_dir):
    """Chat records with a function role, one without a role, and null content."""
    conv = overlay.conversations(spark, sf_dir)
    role = F.when(F.col("role") == "tool", "function").when(F.col("role") != "user", F.col("role"))
    raw = (
        F.when(F.col("role") == "user", _json(content=F.col("content")))
        .when(F.col("role") == "system", _json(role=role, content=F.lit(None).cast("string")))
        .otherwise(_json(role=role, content=F.col("content"), tool_call_id=F.col("session_id")))
    )
    rows = _parsed(conv.select("session_id", "turn_index", raw.alias("raw")))
    return rows.withColumn("message", logs.autogen_message(F.col("record"))).select(
        "session_id", "turn_index", "message.role", "message.content", "message.tool_call_id"
    )


AUTOGEN_MESSAGES_SQL = f"""WITH {Q.CONV}
SELECT session_id, turn_index, role, CASE role WHEN 'system' THEN '' ELSE content END AS content,
  CASE WHEN role NOT IN ('user', 'system') THEN session_id END AS tool_call_id FROM conv"""

QUERIES = {
    "stored_signals": (stored_signals, STORED_SQL),
    "stored_signals_whole": (stored_signals_whole, STORED_WHOLE_SQL),
    "session_log": (session_log, SESSION_LOG_SQL),
    "wanted_sessions": (wanted_sessions, WANTED_SQL),
    "session_log_whole": (session_log_whole, SESSION_LOG_WHOLE_SQL),
    "model_formulas": (model_formulas, MODEL_SQL),
    "custom_rules": (custom_rules, CUSTOM_SQL),
    "many_rules": (many_rules, MANY_SQL),
    "configured_signals": (configured_signals, CONFIGURED_SQL),
    "purge_partitions": (purge_partitions, PURGED_SQL),
    "alert_deliveries": (alert_deliveries, DELIVERIES_SQL),
    "alert_rows": (alert_rows, ALERTS_SQL),
    "imported_hashes": (imported_hashes, IMPORTED_SQL),
    "stage_timings": (stage_timings, TIMINGS_SQL),
    "ingest_modern_calls": (ingest_modern_calls, MODERN_SQL),
    "ingest_autogen_messages": (ingest_autogen_messages, AUTOGEN_MESSAGES_SQL),
}
