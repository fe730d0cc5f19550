"""Registered queries over event-shaped input with all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnsift.config import ScanConfig
from turnsift.functions import grams
from turnsift.operators import sessions
from turnsift.operators.classify import classify
from turnsift.operators.durable import written
from turnsift.plans import overlay, sql as Q
from turnsift.plans.detection import _shown, context_events
from turnsift.plans.fingerprinting import vectors_sql

#: Answers in the given tables are close to their questions, so the floor is high.
CONFIG = ScanConfig(drift_floor=1.5)
#: Messages of these sessions count as approved false alarms.
APPROVED_EVERY = 24


def answered_events(spark, sf_dir) -> DataFrame:
    """Context events with the next turn as their output."""
    answers = overlay.conversations(spark, sf_dir).select(
        "session_id", (F.col("turn_index") - 1).alias("turn_index"), F.struct("role", "content").alias("message_out")
    )
    return context_events(spark, sf_dir).join(answers, ["session_id", "turn_index"], "left")


def approved_messages(spark, sf_dir) -> DataFrame:
    chosen = overlay.conversations(spark, sf_dir).filter(
        (F.col("session_id").cast("long") % APPROVED_EVERY == 1) & (F.col("role") == "tool")
    )
    return chosen.select(
        F.concat_ws(":", "session_id", "turn_index").alias("fingerprint_id"),
        grams.gram_embedding("content").alias("vector"),
    )


def _classified(spark, sf_dir) -> DataFrame:
    events = written(answered_events(spark, sf_dir), "events")
    return classify(events, CONFIG, approved=approved_messages(spark, sf_dir))


def classified_events(spark, sf_dir):
    """Message, drift and window signals of every event behind the false-alarm gate."""
    return _shown(_classified(spark, sf_dir)).drop("evidence_snippet").withColumn("score", F.round("score", 3))


def classified_verdicts(spark, sf_dir):
    """Verdict of every session from all kinds of signals."""
    found = written(_classified(spark, sf_dir), "classified")
    verdicts = sessions.session_verdicts(overlay.conversations(spark, sf_dir), found)
    return verdicts.withColumn("max_score", F.round("max_score", 3))


CLASSIFIED = f"""{Q.CONV},
own AS (SELECT *, CASE WHEN role IN ('user', 'tool') THEN {Q.sources('content')}
  ELSE []::VARCHAR[] END AS raw FROM conv),
ev AS (SELECT a.session_id, a.turn_index, b.role AS b_role, b.content AS b_content, a.role, a.content,
  c.content AS answer, list_concat(coalesce(b.raw, []::VARCHAR[]), a.raw) AS raw
  FROM own a LEFT JOIN own b ON a.session_id = b.session_id AND a.turn_index = b.turn_index + 1
  LEFT JOIN own c ON a.session_id = c.session_id AND a.turn_index = c.turn_index - 1),
flat AS (SELECT session_id, turn_index, 0 AS msg_index, b_role AS role, b_content AS content, raw
  FROM ev WHERE b_role IS NOT NULL
  UNION ALL SELECT session_id, turn_index, CASE WHEN b_role IS NULL THEN 0 ELSE 1 END, role, content, raw
  FROM ev),
ext AS (SELECT * FROM flat WHERE content <> '' AND {Q.external()}),
{Q.with_rules('ext', 'content', 'ruled')},
scored AS (SELECT session_id || ':' || turn_index || ':' || msg_index AS k, *, {Q.AVERAGED} AS score,
  {Q.distinct_in_order('raw')} AS src FROM ruled WHERE {Q.AVERAGED} >= 0.25),
fine AS (SELECT session_id || ':' || turn_index AS id, content FROM conv
  WHERE CAST(session_id AS BIGINT) % {APPROVED_EVERY} = 1 AND role = 'tool'),
band AS (SELECT k, content FROM scored WHERE score < 0.70),
{vectors_sql('fine', 'id', 'content', 'fvec')},
{vectors_sql('band', 'k', 'content', 'bvec')},
alike AS (SELECT DISTINCT k FROM (SELECT k, id FROM bvec b JOIN fvec f USING (bucket)
  GROUP BY ALL HAVING round(sum(b.w * f.w), 12) >= 0.70)),
msg AS (SELECT * FROM scored WHERE k NOT IN (SELECT k FROM alike)),
asked AS (SELECT session_id || ':' || turn_index AS e, session_id, turn_index,
  CASE WHEN role = 'user' THEN content WHEN b_role = 'user' THEN b_content END AS question, answer FROM ev),
pairs AS (SELECT * FROM asked WHERE regexp_matches(question, '\\S') AND regexp_matches(answer, '\\S')),
{vectors_sql('pairs', 'e', 'question', 'qvec')},
{vectors_sql('pairs', 'e', 'answer', 'avec')},
cosine AS (SELECT e, sum(q.w * a.w) AS cos FROM qvec q JOIN avec a USING (e, bucket) GROUP BY e),
drifted AS (SELECT session_id, turn_index, round(0.5 * (1 - coalesce(cos, 0) / {CONFIG.drift_floor}), 4) AS score
  FROM pairs LEFT JOIN cosine USING (e) WHERE coalesce(cos, 0) < {CONFIG.drift_floor}),
stray AS (SELECT * FROM drifted WHERE score >= 0.25),
raised AS (SELECT session_id, turn_index FROM msg UNION SELECT session_id, turn_index FROM stray),
texts AS (SELECT session_id, turn_index, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10)
  ORDER BY msg_index) AS text FROM ext GROUP BY ALL),
laid AS (SELECT e.session_id, e.turn_index, t.text, {Q.distinct_in_order('e.raw')} AS src,
    r.session_id IS NOT NULL AS flagged
  FROM ev e LEFT JOIN texts t USING (session_id, turn_index) LEFT JOIN raised r USING (session_id, turn_index)),
framed AS (SELECT session_id, turn_index, flagged,
    string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10)) OVER w AS block,
    flatten(list(src) OVER w) AS src, count(*) OVER w AS n
  FROM laid WINDOW w AS (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
blocks AS (SELECT * FROM framed WHERE NOT flagged AND n >= 2 AND block IS NOT NULL),
{Q.with_rules('blocks', 'block', 'wruled')},
sig AS (SELECT session_id, turn_index, msg_index, 'message' AS stage, round(score, 3) AS score, rules,
    {Q.first_source('content', 'src')} AS source FROM msg
  UNION ALL SELECT session_id, turn_index, NULL, 'drift', round(score, 3), 'SEM01', NULL FROM stray
  UNION ALL SELECT session_id, turn_index, NULL, 'window', round({Q.AVERAGED}, 3), rules || ',WIN01',
    {Q.first_source('block', Q.distinct_in_order('src'))} FROM wruled WHERE {Q.AVERAGED} >= 0.25)"""

CLASSIFIED_SQL = f"WITH {CLASSIFIED}\nSELECT * FROM sig"

CLASSIFIED_VERDICTS_SQL = f"""WITH {CLASSIFIED},
best AS (SELECT session_id, max(score) AS m FROM sig GROUP BY 1)
SELECT c.session_id, coalesce(m, 0.0) AS max_score, {Q.three_way('coalesce(m, 0.0)')} AS verdict
FROM (SELECT DISTINCT session_id FROM conv) c LEFT JOIN best USING (session_id)"""

QUERIES = {
    "classified_events": (classified_events, CLASSIFIED_SQL),
    "classified_verdicts": (classified_verdicts, CLASSIFIED_VERDICTS_SQL),
}
