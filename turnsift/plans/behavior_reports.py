"""Registered queries over tool behaviour and session reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnsift.operators import behavior, fingerprints as fp, pairing, reports
from turnsift.operators.durable import durable
from turnsift.plans import fingerprinting, overlay, sql as Q
from turnsift.plans.detection import signals
from turnsift.plans.session_tables import CHAIN_CTE, CHAIN_VERIFY_CTE, chain_verify


def tool_turns(spark, sf_dir) -> DataFrame:
    """One tool call per turn: the tool log with numbered turns."""
    numbered = pairing.number_turns(overlay.tool_log(spark, sf_dir))
    return numbered.select("session_id", "turn_index", F.array("name").alias("names"))


def daily_turns(spark, sf_dir) -> DataFrame:
    """One turn per active day; searches count as plain turns without a tool call."""
    log = overlay.tool_log(spark, sf_dir)
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("turn_index")
    call = F.when(F.col("name") != "search", F.struct("ts", "event_id", "name"))
    turns = log.groupBy("session_id", day).agg(F.array_sort(F.collect_list(call)).alias("_calls"))
    names = F.transform("_calls", lambda c: c["name"])
    return turns.select("session_id", "turn_index", names.alias("names"))


DAILY = f"""{Q.TOOL_LOG},
days AS (SELECT session_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER)
    AS turn_index, ts, event_id, name FROM tools),
turns AS (SELECT session_id, turn_index, dense_rank() OVER (PARTITION BY session_id
    ORDER BY turn_index) AS nth FROM (SELECT DISTINCT session_id, turn_index FROM days)),
calls AS (SELECT d.session_id, d.turn_index, t.nth, d.name, CAST(row_number() OVER (PARTITION BY
    d.session_id, d.turn_index ORDER BY ts, event_id) - 1 AS INTEGER) AS call_no
  FROM days d JOIN turns t USING (session_id, turn_index) WHERE d.name <> 'search')"""


def tool_distribution(spark, sf_dir):
    return behavior.tool_distribution(daily_turns(spark, sf_dir))


DISTRIBUTION_SQL = f"""WITH {DAILY},
n AS (SELECT session_id, name, count(*) AS calls FROM calls WHERE nth <= 5 GROUP BY ALL)
SELECT session_id, name, calls,
  round(calls / CAST(sum(calls) OVER (PARTITION BY session_id) AS DOUBLE), 4) AS share FROM n"""


def tools_per_turn(spark, sf_dir):
    return behavior.tools_per_turn(daily_turns(spark, sf_dir))


PER_TURN_SQL = f"""WITH {DAILY},
t AS (SELECT session_id, count(*) AS turns FROM turns WHERE nth <= 5 GROUP BY 1),
c AS (SELECT session_id, count(*) AS calls FROM calls WHERE nth <= 5 GROUP BY 1)
SELECT session_id, turns, coalesce(calls, 0) AS calls,
  round(coalesce(calls, 0) / CAST(turns AS DOUBLE), 4) AS avg_tools_per_turn
FROM t LEFT JOIN c USING (session_id)"""

PAIRS = """linked AS (SELECT *, lag(nth) OVER w AS p_nth, lag(name) OVER w AS p_name FROM calls
  WINDOW w AS (PARTITION BY session_id ORDER BY nth, call_no)),
pairs AS (SELECT session_id, nth, call_no, p_name AS first, name AS second FROM linked
  WHERE p_nth = nth OR p_nth = nth - 1)"""


def tool_transitions(spark, sf_dir):
    """All consecutive tool pairs of every session, counted."""
    pairs = behavior.sequential_pairs(daily_turns(spark, sf_dir))
    return pairs.groupBy("session_id", "first", "second").agg(F.count(F.lit(1)).alias("n"))


TRANSITIONS_SQL = f"""WITH {DAILY},
{PAIRS}
SELECT session_id, first, second, count(*) AS n FROM pairs GROUP BY ALL"""


def tool_pairs_top5(spark, sf_dir):
    return behavior.common_pairs(daily_turns(spark, sf_dir))


TOP_PAIRS_SQL = f"""WITH {DAILY},
{PAIRS},
n AS (SELECT session_id, first, second, count(*) AS n, min((nth, call_no)) AS seen
  FROM pairs WHERE nth <= 5 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY n DESC, seen) AS INTEGER)
  AS rank FROM n)
SELECT session_id, first, second, n, rank FROM r WHERE rank <= 5"""


def pivot_diffs(spark, sf_dir):
    """Every retry turn is a pivot of its session."""
    calls = behavior.tool_calls(durable(tool_turns(spark, sf_dir)))
    pivots = calls.filter("name = 'run_retry'").select(
        "session_id", F.col("turn_index").alias("pivot_turn")
    )
    return behavior.behavior_diffs(pivots, calls)


PIVOT_DIFFS_SQL = f"""WITH {Q.TOOL_LOG},
piv AS (SELECT session_id, turn_index AS pivot_turn FROM tools WHERE name = 'run_retry'),
uses AS (SELECT session_id, name, min(turn_index) AS first_turn FROM tools GROUP BY ALL),
n AS (SELECT p.session_id, p.pivot_turn, count(*) FILTER (t.turn_index < p.pivot_turn) AS before_calls,
    count(*) FILTER (t.turn_index >= p.pivot_turn) AS after_calls
  FROM piv p JOIN tools t USING (session_id) GROUP BY ALL),
f AS (SELECT p.session_id, p.pivot_turn, count(*) FILTER (u.first_turn >= p.pivot_turn) AS n_new,
    bool_or(u.first_turn >= p.pivot_turn AND regexp_matches(u.name,
      'send|email|post|write|delete|execute|run|upload|forward')) AS sensitive
  FROM piv p JOIN uses u USING (session_id) GROUP BY ALL)
SELECT session_id, pivot_turn, before_calls, after_calls, n_new, sensitive,
  round(least(1.0, n_new / CAST(greatest(before_calls, 1) AS DOUBLE)
    * CASE WHEN sensitive THEN 1.5 ELSE 1 END), 4) AS anomaly_score
FROM n JOIN f USING (session_id, pivot_turn)"""


def pivot_new_actions(spark, sf_dir):
    """Tools first called at or after turn 5 of a session."""
    calls = behavior.tool_calls(tool_turns(spark, sf_dir))
    pivots = calls.select("session_id").distinct().withColumn("pivot_turn", F.lit(5))
    return behavior.new_actions(pivots, calls)


NEW_ACTIONS_SQL = f"""WITH {Q.TOOL_LOG}
SELECT session_id, 5 AS pivot_turn, name, min(turn_index) AS first_turn, 0 AS first_call
FROM tools GROUP BY session_id, name HAVING min(turn_index) >= 5"""


def session_reports(spark, sf_dir):
    """Chain, signals, tool diffs, fingerprints, verdict and summary of every session. The
    tools of session n are those of user n in the tool log."""
    raised = durable(signals(spark, sf_dir))
    sessions = chain_verify(spark, sf_dir)
    calls = behavior.tool_calls(durable(tool_turns(spark, sf_dir)))
    diffs = durable(behavior.behavior_diffs(behavior.pivots(raised), calls))
    links = fp.session_links(fp.assign_fingerprints(fingerprinting.arrived(raised)))
    return reports.session_reports(sessions, raised, diffs, calls, links)


SESSION_REPORTS_SQL = f"""WITH RECURSIVE {fingerprinting.ASSIGNED},
{CHAIN_CTE},
{CHAIN_VERIFY_CTE},
{Q.TOOL_LOG},
top AS (SELECT session_id, score, source, turn_index AS top_turn,
    count(*) OVER (PARTITION BY session_id) AS signal_count,
    row_number() OVER (PARTITION BY session_id ORDER BY score DESC, turn_index) AS rn FROM sig),
piv AS (SELECT DISTINCT session_id, turn_index AS pivot_turn FROM sig WHERE score >= 0.5),
uses AS (SELECT session_id, name, min(turn_index) AS first_turn FROM tools GROUP BY ALL),
n AS (SELECT p.session_id, p.pivot_turn, count(t.name) FILTER (t.turn_index < p.pivot_turn)
    AS before_calls FROM piv p LEFT JOIN tools t USING (session_id) GROUP BY ALL),
f AS (SELECT p.session_id, p.pivot_turn, count(u.name) FILTER (u.first_turn >= p.pivot_turn) AS n_new,
    coalesce(bool_or(u.first_turn >= p.pivot_turn AND regexp_matches(u.name,
      'send|email|post|write|delete|execute|run|upload|forward')), false) AS sensitive,
    coalesce(list(u.name ORDER BY u.first_turn) FILTER (u.first_turn >= p.pivot_turn), []) AS names
  FROM piv p LEFT JOIN uses u USING (session_id) GROUP BY ALL),
d AS (SELECT session_id, pivot_turn, n_new, names,
    round(least(1.0, n_new / CAST(greatest(before_calls, 1) AS DOUBLE)
      * CASE WHEN sensitive THEN 1.5 ELSE 1 END), 4) AS anomaly
  FROM n JOIN f USING (session_id, pivot_turn)),
best AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS diff_count,
    row_number() OVER (PARTITION BY session_id ORDER BY anomaly DESC, pivot_turn) AS rn FROM d),
seen AS (SELECT session_id, count(DISTINCT fingerprint_id) AS k FROM assigned GROUP BY 1),
r AS (SELECT c.session_id, c.total_turns, c.chain_valid, coalesce(t.signal_count, 0) AS signal_count,
    coalesce(b.diff_count, 0) AS diff_count, t.score AS max_signal_score, b.anomaly AS max_anomaly,
    CASE WHEN t.score IS NULL THEN 'clean'
      WHEN t.score >= 0.65 AND coalesce(b.anomaly, 0) >= 0.5 THEN 'compromised'
      ELSE 'suspicious' END AS verdict,
    CASE WHEN c.chain_valid AND t.score IS NOT NULL THEN round(t.score, 4) ELSE 0.0 END AS confidence,
    coalesce(s.k, 0) AS fingerprint_matches, t.top_turn, t.source, b.n_new, b.names,
    CASE WHEN c.chain_valid THEN 'Hash chain verified.' ELSE 'WARNING: hash chain integrity check failed - trace may have been tampered with.' END AS note
  FROM chains c LEFT JOIN top t ON t.session_id = c.session_id AND t.rn = 1
  LEFT JOIN best b ON b.session_id = c.session_id AND b.rn = 1
  LEFT JOIN seen s ON s.session_id = c.session_id)
SELECT session_id, total_turns, chain_valid, signal_count, diff_count, max_signal_score, max_anomaly,
  verdict, confidence, fingerprint_matches,
  CASE verdict
  WHEN 'clean' THEN 'Session ' || left(session_id, 12) || '… completed ' || total_turns ||
    ' turn(s) with no injection signals above threshold. ' || note
  WHEN 'suspicious' THEN 'Session ' || left(session_id, 12) || '… shows ' || signal_count ||
    ' potential injection signal(s) across ' || total_turns || ' turn(s). Highest signal score ' ||
    printf('%.2f', max_signal_score) || ' at turn ' || top_turn ||
    CASE WHEN source IS NOT NULL THEN ' from source ''' || source || '''' ELSE '' END || '. ' ||
    CASE WHEN diff_count = 0 THEN 'Behaviour analysis did not confirm a significant action pivot.'
      ELSE 'Behaviour anomaly score: ' || printf('%.2f', max_anomaly) || '.' END || ' ' || note
  ELSE 'Session ' || left(session_id, 12) || '… appears compromised. Injection signal score ' ||
    printf('%.2f', max_signal_score) || ' detected at turn ' || top_turn ||
    CASE WHEN source IS NOT NULL THEN ' from ''' || source || '''' ELSE '' END ||
    '. After the pivot, ' || n_new || ' new action(s) appeared (' ||
    CASE WHEN n_new = 0 THEN 'none' ELSE array_to_string(names[1:5], ', ') END ||
    CASE WHEN n_new > 5 THEN ' (+' || (n_new - 5) || ' more)' ELSE '' END ||
    ') with anomaly score ' || printf('%.2f', max_anomaly) || '. ' || note
  END AS summary
FROM r"""


def report_verdicts(spark, sf_dir):
    return session_reports(spark, sf_dir).groupBy("verdict", "chain_valid").agg(
        F.count(F.lit(1)).alias("sessions"), F.max("confidence").alias("max_confidence")
    )


REPORT_VERDICTS_SQL = (
    f"SELECT verdict, chain_valid, count(*) AS sessions, max(confidence) AS max_confidence "
    f"FROM ({SESSION_REPORTS_SQL}) GROUP BY ALL"
)

QUERIES = {
    "tool_distribution": (tool_distribution, DISTRIBUTION_SQL),
    "tools_per_turn": (tools_per_turn, PER_TURN_SQL),
    "tool_transitions": (tool_transitions, TRANSITIONS_SQL),
    "tool_pairs_top5": (tool_pairs_top5, TOP_PAIRS_SQL),
    "pivot_diffs": (pivot_diffs, PIVOT_DIFFS_SQL),
    "pivot_new_actions": (pivot_new_actions, NEW_ACTIONS_SQL),
    "session_reports": (session_reports, SESSION_REPORTS_SQL),
    "report_verdicts": (report_verdicts, REPORT_VERDICTS_SQL),
}
