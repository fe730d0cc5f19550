"""Registered queries over sessions, chains and the signals tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from turnsift.functions import text as X
from turnsift.operators import chain, pairing, sessions
from turnsift.operators.durable import durable, ensure_checkpoint_dir
from turnsift.plans import overlay, sql as Q
from turnsift.plans.detection import signals
from turnsift.sources import tables


def events(spark, sf_dir) -> DataFrame:
    """Planted conversations as stored events."""
    return overlay.conversations(spark, sf_dir).select(
        F.concat_ws(":", "session_id", F.col("turn_index").cast("string")).alias("event_id"),
        "session_id",
        "turn_index",
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("model-"), F.length("content") % 3).alias("model"),
        F.concat(F.lit("agent-"), F.col("role")).alias("agent_name"),
        "role",
        "content",
    )


EVENTS = f"""{Q.CONV},
ev AS (SELECT session_id || ':' || turn_index AS event_id, session_id, turn_index, ts AS timestamp,
  'model-' || (length(content) % 3) AS model, 'agent-' || role AS agent_name, role, content FROM conv)"""
EVENTS_AND_SIGNALS = f"""{Q.ALL_SIGNALS},
ev AS (SELECT session_id || ':' || turn_index AS event_id, session_id, turn_index, ts AS timestamp,
  'model-' || (length(content) % 3) AS model, 'agent-' || role AS agent_name, role, content FROM conv)"""


def session_list(spark, sf_dir):
    return sessions.list_sessions(events(spark, sf_dir), signals(spark, sf_dir))


SESSION_LIST_SQL = f"""WITH {EVENTS_AND_SIGNALS},
first AS (SELECT session_id, min(timestamp) AS started_at, arg_min(model, timestamp) AS model,
  arg_min(agent_name, timestamp) AS agent_name, count(*) AS turn_count FROM ev GROUP BY 1),
top AS (SELECT session_id, score, source, row_number() OVER (PARTITION BY session_id
  ORDER BY score DESC, turn_index) AS rn FROM sig)
SELECT f.*, t.score AS max_signal_score, t.source AS top_source,
  {Q.three_way('coalesce(t.score, 0.0)')} AS verdict
FROM first f LEFT JOIN top t ON f.session_id = t.session_id AND t.rn = 1"""


def session_status(spark, sf_dir):
    return sessions.session_status(events(spark, sf_dir), signals(spark, sf_dir))


SESSION_STATUS_SQL = f"""WITH {EVENTS_AND_SIGNALS},
n AS (SELECT session_id, count(*) AS turn_count FROM ev GROUP BY 1),
m AS (SELECT session_id, max(score) AS m, count(*) AS k FROM sig GROUP BY 1)
SELECT session_id, {Q.three_way('coalesce(m, 0.0)')} AS verdict, round(coalesce(m, 0.0), 3) AS score,
  turn_count, coalesce(k, 0) AS signal_count FROM n LEFT JOIN m USING (session_id)"""


def timeline(spark, sf_dir):
    turns = events(spark, sf_dir).select(
        "session_id", "turn_index", "model",
        F.array(F.struct("role", "content")).alias("messages"),
        F.array().cast("array<string>").alias("tools"),
    )
    shown = sessions.timeline(turns, signals(spark, sf_dir))
    return shown.select(
        "session_id", "turn_index", "model", F.array_join("previews", "\n").alias("preview"),
        F.size("tools").alias("n_tools"), "score", "highlight",
    )


TIMELINE_SQL = f"""WITH {EVENTS_AND_SIGNALS},
best AS (SELECT session_id, turn_index, max(score) AS score FROM sig GROUP BY ALL)
SELECT session_id, turn_index, model,
  '[' || role || '] ' || left(content, 200) || CASE WHEN length(content) > 200 THEN '…' ELSE '' END
    AS preview,
  0 AS n_tools, score,
  CASE WHEN score >= 0.65 THEN 'red' WHEN score IS NOT NULL THEN 'amber' ELSE 'none' END AS highlight
FROM ev LEFT JOIN best USING (session_id, turn_index)"""


def running_max_score(spark, sf_dir):
    return sessions.running_max(durable(signals(spark, sf_dir)))


RUNNING_SQL = f"""WITH {Q.ALL_SIGNALS},
t AS (SELECT session_id, turn_index, max(score) AS score FROM sig GROUP BY ALL)
SELECT session_id, turn_index, score,
  max(score) OVER (PARTITION BY session_id ORDER BY turn_index) AS max_so_far FROM t"""


def purge_sessions(spark, sf_dir):
    """Events left after deleting every compromised session."""
    listed = sessions.list_sessions(events(spark, sf_dir), signals(spark, sf_dir))
    gone = listed.filter("verdict = 'compromised'")
    left = sessions.purge_sessions(events(spark, sf_dir), gone)
    return left.select("event_id", "session_id", "turn_index")


PURGE_SQL = f"""WITH {EVENTS_AND_SIGNALS},
bad AS (SELECT session_id FROM sig GROUP BY 1 HAVING max(score) >= 0.75)
SELECT event_id, session_id, turn_index FROM ev WHERE session_id NOT IN (SELECT session_id FROM bad)"""


def append_events(spark, sf_dir):
    """The tool log arrives twice while its error rows are stored already."""
    incoming = overlay.tool_log(spark, sf_dir).select(
        "event_id", "session_id", F.lit(0).alias("turn_index"), F.col("ts").alias("timestamp"), "name"
    )
    stored = incoming.filter("name = 'run_retry'")
    marked = sessions.with_rejections(stored, incoming.union(incoming))
    outcome = F.when(F.col("rejected"), "rejected").otherwise("accepted")
    return marked.select("event_id", "session_id", "name", outcome.alias("outcome"), "copies")


APPEND_SQL = f"""WITH {Q.TOOL_LOG}
SELECT event_id, session_id, name, 'accepted' AS outcome, 1 AS copies FROM tools
WHERE name <> 'run_retry'
UNION ALL SELECT event_id, session_id, name, 'rejected',
  CASE WHEN name = 'run_retry' THEN 2 ELSE 1 END FROM tools"""


def load_session_events(spark, sf_dir):
    """Events of all sessions in turn order, with sanitised session ids."""
    named = events(spark, sf_dir).withColumn(
        "session_id", F.concat(F.lit("conv/"), "session_id", F.lit("@x y"))
    )
    good, _ = tables.with_safe_session_id(named)
    return good.orderBy("session_id", "turn_index", "timestamp", "event_id").select(
        "session_id", "turn_index", "event_id", "timestamp", "model", "role"
    )


LOAD_SQL = f"""WITH {EVENTS}
SELECT regexp_replace('conv/' || session_id || '@x y', '[^a-zA-Z0-9_\\-]', '_', 'g') AS session_id,
  turn_index, event_id, timestamp, model, role FROM ev ORDER BY 1, 2"""


def turn_numbering(spark, sf_dir):
    """Turn numbers of the tool log, continuing after ten stored turns per session."""
    log = overlay.tool_log(spark, sf_dir)
    stored = log.select("session_id").distinct().withColumn("last_turn", F.lit(9))
    return pairing.number_turns(log, stored).select("session_id", "event_id", "turn_index")


TURN_NUMBERING_SQL = f"""WITH {Q.TOOL_LOG}
SELECT session_id, event_id, turn_index + 10 AS turn_index FROM tools"""


def start_end_pairs(spark, sf_dir):
    """User turns as start records, the next assistant turn as end, the next tool turn as error."""
    conv = overlay.conversations(spark, sf_dir)
    run = F.concat_ws(":", "session_id", F.col("turn_index").cast("string"))
    before = F.concat_ws(":", "session_id", (F.col("turn_index") - 1).cast("string"))
    starts = conv.filter("role = 'user'").select(
        run.alias("run_id"), "session_id", "ts", F.length("content").alias("request")
    )
    ends = conv.filter("role <> 'user'").select(
        before.alias("run_id"), "ts", F.length("content").alias("response")
    )
    errors = conv.filter("role = 'tool'").select(before.alias("run_id"))
    return pairing.pair_by_run(starts, ends, errors)


PAIRS_SQL = f"""WITH {Q.CONV}
SELECT a.session_id || ':' || a.turn_index AS run_id, a.session_id, a.ts AS started_at,
  CAST(length(a.content) AS INTEGER) AS request, b.ts AS ended_at,
  CAST(length(b.content) AS INTEGER) AS response
FROM conv a JOIN conv b ON a.session_id = b.session_id AND b.turn_index = a.turn_index + 1
WHERE a.role = 'user' AND b.role NOT IN ('user', 'tool')"""


def session_pairs(spark, sf_dir):
    """The tool log as start (view), end (purchase) and error records paired per session."""
    kind = (
        F.when(F.col("name") == "read_page", "start")
        .when(F.col("name") == "post_order", "end")
        .when(F.col("name") == "run_retry", "error")
    )
    log = overlay.tool_log(spark, sf_dir).select(
        "session_id", F.col("ts"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.concat(F.lit("e"), "event_id").alias("text"),
    )
    return pairing.pair_in_session(log.filter(F.col("kind").isNotNull()))


SESSION_PAIRS_SQL = f"""WITH {Q.TOOL_LOG},
k AS (SELECT *, CASE name WHEN 'read_page' THEN 'start' WHEN 'post_order' THEN 'end'
  WHEN 'run_retry' THEN 'error' END AS kind FROM tools),
p AS (SELECT *, lag(kind) OVER w AS before, lag(ts) OVER w AS before_ts,
  lag(event_id) OVER w AS before_id FROM k WHERE kind IS NOT NULL
  WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id))
SELECT session_id, CASE WHEN before = 'start' THEN before_ts END AS started_at, ts AS ended_at,
  event_id AS seq, CASE WHEN before = 'start' THEN 'e' || before_id ELSE '' END AS request,
  'e' || event_id AS response, coalesce(before = 'start', false) AS matched
FROM p WHERE kind = 'end'"""

def exported_events(spark, sf_dir):
    """Events written as JSON lines and read back with a declared schema."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/export-{uuid.uuid4().hex}"
    trace = events(spark, sf_dir)
    tables.export_json(trace, folder)
    return spark.read.schema(trace.schema).json(folder)


EXPORT_SQL = f"WITH {EVENTS} SELECT * FROM ev"

_CONTENT = ["session_id", "turn_index", "role", "content"]


def _base_events(spark, sf_dir) -> DataFrame:
    """Conversations as they were recorded, before anything was planted."""
    return overlay.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").cast("int").alias("turn_index"),
        F.concat_ws(":", "conv_id", "turn").alias("event_id"),
        "role",
        F.col("text").alias("content"),
    )


def chain_build(spark, sf_dir):
    """Hash chain of every recorded conversation."""
    recorded = _base_events(spark, sf_dir)
    return chain.build_chain(recorded.withColumn("digest", chain.content_digest(_CONTENT)))


_DIGEST = (
    "sha256(to_json({{content: {content}, role: {role}, session_id: {sid}, turn_index: {turn}}}))"
)
CHAIN_CTE = f"""dig AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS turn_index,
  {_DIGEST.format(content='text', role='role', sid='CAST(conv_id AS VARCHAR)', turn='CAST(turn AS INTEGER)')}
    AS digest FROM conversations),
num AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) AS n FROM dig),
ch AS (SELECT session_id, turn_index, n, '' AS prev_hash, sha256(digest) AS event_hash
    FROM num WHERE n = 1
  UNION ALL SELECT d.session_id, d.turn_index, d.n, c.event_hash, sha256(c.event_hash || d.digest)
    FROM ch c JOIN num d ON c.session_id = d.session_id AND d.n = c.n + 1)"""
CHAIN_BUILD_SQL = f"""WITH RECURSIVE {CHAIN_CTE}
SELECT session_id, turn_index, session_id || ':' || turn_index AS event_id, prev_hash, event_hash
FROM ch"""


def chain_checks(spark, sf_dir) -> DataFrame:
    """The recorded chain against the planted content: planted sessions were tampered with."""
    stored = durable(chain_build(spark, sf_dir))
    now = overlay.conversations(spark, sf_dir).select(
        "session_id", "turn_index", "role", "content"
    ).withColumn("digest", chain.content_digest(_CONTENT))
    both = stored.join(now.select("session_id", "turn_index", "digest"), ["session_id", "turn_index"])
    return chain.with_hash_check(chain.with_link_check(both), F.col("digest"))


def chain_verify(spark, sf_dir):
    return chain.chain_validity(chain_checks(spark, sf_dir))


CHAIN_VERIFY_CTE = f"""now AS (SELECT session_id, turn_index,
  {_DIGEST.format(content='content', role='role', sid='session_id', turn='turn_index')} AS digest FROM conv),
chk AS (SELECT c.session_id, sha256(c.prev_hash || w.digest) = c.event_hash AS hash_ok
  FROM ch c JOIN now w USING (session_id, turn_index)),
chains AS (SELECT session_id, bool_and(hash_ok) AS chain_valid, count(*) AS total_turns
  FROM chk GROUP BY 1)"""
CHAIN_VERIFY_SQL = f"""WITH RECURSIVE {Q.CONV},
{CHAIN_CTE},
{CHAIN_VERIFY_CTE}
SELECT session_id, chain_valid, total_turns FROM chains"""


def chain_increment(spark, sf_dir):
    """The same verdicts from a ledger over the first two turns and the turns behind them."""
    stored = durable(chain_build(spark, sf_dir))
    now = overlay.conversations(spark, sf_dir).select(
        "session_id", "turn_index", "role", "content"
    ).withColumn("digest", chain.content_digest(_CONTENT))
    events = stored.join(now.select("session_id", "turn_index", "digest"), ["session_id", "turn_index"])
    digest = F.col("digest")
    first = chain.with_hash_check(chain.with_link_check(events.filter("turn_index < 2")), digest)
    ledger = durable(chain.chain_ledger(first))
    return chain.extended_ledger(ledger, events, digest).select("session_id", "chain_valid", "total_turns")


def chain_links(spark, sf_dir):
    """Link check on a chain with its odd-length messages' events removed."""
    stored = durable(chain_build(spark, sf_dir))
    lengths = _base_events(spark, sf_dir).select("event_id", F.length("content").alias("n"))
    kept = stored.join(lengths, "event_id").filter("n % 2 = 0")
    return chain.with_link_check(kept).select("session_id", "turn_index", "link_ok")


CHAIN_LINKS_SQL = f"""WITH RECURSIVE {CHAIN_CTE},
kept AS (SELECT ch.* FROM ch JOIN conversations c ON ch.session_id = CAST(c.conv_id AS VARCHAR)
  AND ch.turn_index = c.turn WHERE length(c.text) % 2 = 0)
SELECT session_id, turn_index, prev_hash = coalesce(lag(event_hash) OVER
  (PARTITION BY session_id ORDER BY turn_index), '') AS link_ok FROM kept"""


def evidence_lines(spark, sf_dir):
    """Line of every message signal inside its message."""
    conv = overlay.conversations(spark, sf_dir).select("session_id", "turn_index", "content")
    own = signals(spark, sf_dir).filter("stage = 'message'")
    return own.join(conv, ["session_id", "turn_index"]).select(
        "session_id", "turn_index",
        X.line_of(F.col("content"), F.col("evidence_snippet")).alias("line"),
    )


EVIDENCE_LINES_SQL = f"""WITH {Q.MESSAGE_SIGNALS},
h AS (SELECT session_id, turn_index, content, {Q.strip('left(ev, 60)')} AS head FROM msg)
SELECT session_id, turn_index, CAST(greatest(coalesce(CASE WHEN length(head) > 0 THEN
  list_position(list_transform(regexp_split_to_array(content, '\\r\\n|\\n|\\r'),
  lambda x: contains(x, head)), true) END, 0) - 1, 0) AS INTEGER) AS line FROM h"""


QUERIES = {
    "session_list": (session_list, SESSION_LIST_SQL),
    "session_status": (session_status, SESSION_STATUS_SQL),
    "timeline": (timeline, TIMELINE_SQL),
    "running_max_score": (running_max_score, RUNNING_SQL),
    "purge_sessions": (purge_sessions, PURGE_SQL),
    "append_events": (append_events, APPEND_SQL),
    "load_session_events": (load_session_events, LOAD_SQL),
    "turn_numbering": (turn_numbering, TURN_NUMBERING_SQL),
    "start_end_pairs": (start_end_pairs, PAIRS_SQL),
    "session_pairs": (session_pairs, SESSION_PAIRS_SQL),
    "exported_events": (exported_events, EXPORT_SQL),
    "chain_build": (chain_build, CHAIN_BUILD_SQL),
    "chain_verify": (chain_verify, CHAIN_VERIFY_SQL),
    "chain_increment": (chain_increment, CHAIN_VERIFY_SQL),
    "chain_links": (chain_links, CHAIN_LINKS_SQL),
    "evidence_lines": (evidence_lines, EVIDENCE_LINES_SQL),
}
