"""Registered detection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnsift.functions import rules as R
from turnsift.functions import scoring, text as X
from turnsift.operators import detect, evaluate, sessions
from turnsift.operators.windows import flat_signals
from turnsift.plans import overlay, sql as Q


def joined(column: str):
    return F.array_join(column, ",")


def signals(spark, sf_dir) -> DataFrame:
    return flat_signals(overlay.conversations(spark, sf_dir))


def rule_hits(spark, sf_dir):
    """How often every rule matches an external message, with its label."""
    ext = detect.external_only(overlay.conversations(spark, sf_dir))
    hits = R.with_rule_mask(ext, "content").select(R.rule_ids().alias("rules"))
    counts = evaluate.rule_frequency(hits, "rules")
    labels = R.rule_labels(spark)
    return counts.join(F.broadcast(labels), "rule_id").select("rule_id", "hits", "weight", "label")


_LABELS = ", ".join(
    f"('{r.rule_id}', {r.points / 100.0}, {Q.quoted(r.label)})" for r in R.RULES
)
RULE_HITS_SQL = f"""WITH {Q.CONV},
{Q.EXTERNAL},
{Q.with_rules('ext', 'content', 'ruled')},
each AS (SELECT unnest(string_split(rules, ',')) AS rule_id FROM ruled WHERE rules <> ''),
lab(rule_id, weight, label) AS (VALUES {_LABELS})
SELECT rule_id, count(*) AS hits, CAST(any_value(weight) AS DOUBLE) AS weight,
  any_value(label) AS label
FROM each JOIN lab USING (rule_id) GROUP BY rule_id"""


def doc_scan(spark, sf_dir):
    """Additive scan of every document with verdict, rules, evidence and severity."""
    scanned = detect.text_scan(overlay.documents(spark, sf_dir), "text")
    return scanned.select(
        "doc_id", "score", "verdict",
        joined("matched_heuristics").alias("rules"),
        "evidence_snippet",
        scoring.editor_severity(F.col("score")).alias("severity"),
        X.line_of(F.col("text"), F.col("evidence_snippet")).alias("line"),
    )


_LINE = (
    "coalesce(CASE WHEN length(head) > 0 THEN list_position(list_transform("
    "regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: contains(x, head)), true) END, 0)"
)
DOC_SCAN_SQL = f"""WITH {Q.DOCS},
ok AS (SELECT * FROM docs),
{Q.with_rules('ok', 'text', 'ruled')},
scored AS (SELECT doc_id, text, rules, {Q.ADDITIVE} AS score, {Q.evidence('text')} AS ev FROM ruled),
headed AS (SELECT *, {Q.strip('left(ev, 60)')} AS head FROM scored)
SELECT doc_id, score, {Q.three_way('score')} AS verdict, rules, ev AS evidence_snippet,
  CASE WHEN score < 0.20 THEN 'cleared' WHEN score >= 0.75 THEN 'error' ELSE 'warning' END
    AS severity,
  CAST(greatest({_LINE} - 1, 0) AS INTEGER) AS line
FROM headed"""


def page_scan(spark, sf_dir):
    checked = detect.page_scan(overlay.pages(spark, sf_dir))
    return checked.select(
        "page_id", "url", "page_title", "score", "verdict", "injection_detected",
        joined("matched_patterns").alias("rules"), "evidence",
    )


PAGE_SCAN_SQL = f"""WITH {Q.PAGES},
{Q.with_rules('web', 'html', 'ruled')},
scored AS (SELECT *, {Q.AVERAGED} AS score FROM ruled)
SELECT page_id, url,
  {Q.strip("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')")}
    AS page_title,
  score, {Q.three_way('score')} AS verdict, score >= 0.25 AS injection_detected, rules,
  left({Q.evidence('html')}, 300) AS evidence
FROM scored"""


def text_check(spark, sf_dir):
    checked = detect.text_check(overlay.conversations(spark, sf_dir), "content")
    return checked.select(
        "session_id", "turn_index", "score", "verdict", "injection_detected",
        "heuristic_score", "ml_score", "boundary_score",
        joined("matched_patterns").alias("rules"), "evidence",
    )


TEXT_CHECK_SQL = f"""WITH {Q.CONV},
{Q.with_rules('conv', 'content', 'ruled')},
scored AS (SELECT *, {Q.AVERAGED} AS score FROM ruled)
SELECT session_id, turn_index, score, {Q.three_way('score')} AS verdict,
  score >= 0.25 AS injection_detected, hp / 100.0 AS heuristic_score,
  CAST(NULL AS DOUBLE) AS ml_score, ibp / 100.0 AS boundary_score, rules,
  left({Q.evidence('content')}, 300) AS evidence
FROM scored"""


def evidence_snippets(spark, sf_dir):
    """Evidence of every external message that matches any rule."""
    ext = detect.external_only(overlay.conversations(spark, sf_dir))
    hits = R.with_rule_mask(ext, "content").filter(F.col("rule_mask") != 0)
    return hits.select(
        "session_id", "turn_index", joined_ids().alias("rules"),
        R.evidence("content").alias("evidence_snippet"),
    )


def joined_ids():
    return F.array_join(R.rule_ids(), ",")


EVIDENCE_SQL = f"""WITH {Q.CONV},
{Q.EXTERNAL},
{Q.with_rules('ext', 'content', 'ruled')}
SELECT session_id, turn_index, rules, {Q.evidence('content')} AS evidence_snippet
FROM ruled WHERE rules <> ''"""


def mixed_script(spark, sf_dir):
    docs = overlay.documents(spark, sf_dir)
    return docs.select("doc_id", R.mixed_script("text").alias("mixed")).groupBy("mixed").agg(
        F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"),
        F.sum("doc_id").alias("id_sum"),
    )


MIXED_SQL = f"""WITH {Q.DOCS},
n AS (SELECT doc_id, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS a,
  length(regexp_replace(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), '[\\x00-\\x{{024F}}]', '', 'g'))
    AS b FROM docs)
SELECT (a >= 20 AND b * 100 >= a * 5 AND b * 100 <= a * 95) AS mixed, count(*) AS docs,
  min(doc_id) AS first_doc, CAST(sum(doc_id) AS BIGINT) AS id_sum
FROM n GROUP BY 1"""


def external_sources(spark, sf_dir):
    """Sources of every page read as tool output."""
    pages = overlay.pages(spark, sf_dir)
    found = X.external_sources(F.array("html"))
    return pages.select("page_id", F.posexplode(found).alias("nth", "source"))


EXTERNAL_SOURCES_SQL = f"""WITH {Q.PAGES},
s AS (SELECT page_id, {Q.sources('html')} AS src FROM web),
d AS (SELECT page_id, {Q.distinct_in_order('src')} AS src FROM s)
SELECT page_id, CAST(i - 1 AS INTEGER) AS nth, src[i] AS source
FROM (SELECT page_id, src, unnest(range(1, len(src) + 1)) AS i FROM d)"""


def source_attribution(spark, sf_dir):
    ext = detect.external_only(detect.with_own_sources(overlay.conversations(spark, sf_dir)))
    return ext.select(
        "session_id", "turn_index", "role",
        X.first_source(F.col("content"), F.col("sources")).alias("source"),
        F.size("sources").alias("n_sources"),
    )


SOURCE_SQL = f"""WITH {Q.CONV},
{Q.EXTERNAL},
s AS (SELECT *, {Q.sources('content')} AS raw FROM ext),
d AS (SELECT *, {Q.distinct_in_order('raw')} AS src FROM s)
SELECT session_id, turn_index, role, {Q.first_source('content', 'src')} AS source,
  CAST(len(src) AS INTEGER) AS n_sources FROM d"""


def _shown(df):
    return df.select(
        "session_id", "turn_index", "msg_index", "stage", "score",
        joined("matched_heuristics").alias("rules"), "source", "evidence_snippet",
    )


def turn_signals(spark, sf_dir):
    messages = detect.with_own_sources(overlay.conversations(spark, sf_dir))
    return _shown(detect.message_signals(messages))


TURN_SIGNALS_SQL = f"""WITH {Q.MESSAGE_SIGNALS}
SELECT session_id, turn_index, 0 AS msg_index, 'message' AS stage, score, rules,
  {Q.first_source('content', 'src')} AS source, ev AS evidence_snippet FROM msg"""


def context_events(spark, sf_dir) -> DataFrame:
    """Events that carry the message before as context: (previous, current)."""
    conv = overlay.conversations(spark, sf_dir)
    body = conv.select(
        "session_id", "turn_index", F.struct("role", "content").alias("message")
    )
    before = body.select(
        "session_id",
        (F.col("turn_index") + 1).alias("turn_index"),
        F.col("message").alias("_before"),
    )
    both = body.join(before, ["session_id", "turn_index"], "left")
    events = both.select(
        "session_id",
        "turn_index",
        F.array_compact(F.array("_before", "message")).alias("messages_in"),
    )
    return events.withColumn("external_sources", X.event_sources(F.col("messages_in")))


def event_signals(spark, sf_dir):
    """Signals of events whose context repeats the message before."""
    return _shown(detect.message_signals(detect.explode_events(context_events(spark, sf_dir))))


EVENT_SIGNALS_SQL = f"""WITH {Q.CONV},
own AS (SELECT *, CASE WHEN role IN ('user', 'tool') THEN {Q.sources('content')}
  ELSE []::VARCHAR[] END AS raw FROM conv),
ev AS (SELECT a.session_id, a.turn_index, b.role AS b_role, b.content AS b_content, a.role, a.content,
  list_concat(coalesce(b.raw, []::VARCHAR[]), a.raw) AS raw
  FROM own a LEFT JOIN own b ON a.session_id = b.session_id AND a.turn_index = b.turn_index + 1),
flat AS (SELECT session_id, turn_index, 0 AS msg_index, b_role AS role, b_content AS content, raw
  FROM ev WHERE b_role IS NOT NULL
  UNION ALL SELECT session_id, turn_index, CASE WHEN b_role IS NULL THEN 0 ELSE 1 END, role, content, raw
  FROM ev),
ext AS (SELECT * FROM flat WHERE content <> '' AND {Q.external()}),
{Q.with_rules('ext', 'content', 'ruled')},
kept AS (SELECT *, {Q.AVERAGED} AS score, {Q.distinct_in_order('raw')} AS src FROM ruled)
SELECT session_id, turn_index, msg_index, 'message' AS stage, score, rules,
  {Q.first_source('content', 'src')} AS source, {Q.evidence('content')} AS evidence_snippet
FROM kept WHERE score >= 0.25"""


def window_signals(spark, sf_dir):
    return _shown(signals(spark, sf_dir).filter("stage = 'window'"))


WINDOW_SQL = f"""WITH {Q.ALL_SIGNALS}
SELECT session_id, turn_index, msg_index, stage, score, rules, source, ev AS evidence_snippet
FROM sig WHERE stage = 'window'"""


def session_verdicts(spark, sf_dir):
    """Flagship: verdict of every session from message and window signals."""
    conv = overlay.conversations(spark, sf_dir)
    return sessions.session_verdicts(conv, flat_signals(conv))


SESSION_VERDICTS_SQL = f"""WITH {Q.ALL_SIGNALS},
best AS (SELECT session_id, max(score) AS m FROM sig GROUP BY 1)
SELECT c.session_id, coalesce(m, 0.0) AS max_score, {Q.three_way('coalesce(m, 0.0)')} AS verdict
FROM (SELECT DISTINCT session_id FROM conv) c LEFT JOIN best USING (session_id)"""


def score_bands(spark, sf_dir):
    """Signals per colour band of the report."""
    bands = signals(spark, sf_dir).select(scoring.score_band(F.col("score")).alias("band"), "score")
    return bands.groupBy("band").agg(
        F.count(F.lit(1)).alias("signals"), F.max("score").alias("max_score"),
        F.count_if(F.col("score") >= 0.65).alias("highlighted"),
    )


SCORE_BANDS_SQL = f"""WITH {Q.ALL_SIGNALS}
SELECT CASE WHEN score < 0.35 THEN 'green' WHEN score < 0.65 THEN 'amber' ELSE 'red' END AS band,
  count(*) AS signals, max(score) AS max_score, count(*) FILTER (score >= 0.65) AS highlighted
FROM sig GROUP BY 1"""


def scan_gate(spark, sf_dir):
    """Documents let through by the scan gate, by language (the language column stands in
    for the language id)."""
    docs = overlay.documents(spark, sf_dir)
    passes = detect.is_scannable(F.col("text"), F.col("lang"))
    return docs.groupBy("lang").agg(
        F.count_if(passes).alias("scanned"), F.count_if(~passes).alias("skipped")
    )


SCAN_GATE_SQL = f"""WITH {Q.DOCS},
g AS (SELECT lang, (length(text) <= 500000 AND regexp_matches(text, '\\S') AND lang NOT IN
  ('binary', 'image', 'pdf', 'notebook', 'git-commit', 'git-rebase')) AS ok FROM docs)
SELECT lang, count(*) FILTER (ok) AS scanned, count(*) FILTER (NOT ok) AS skipped
FROM g GROUP BY lang"""


def scan_sessions(spark, sf_dir):
    """Non-clean document scans as signals of sessions of their own."""
    docs = overlay.documents(spark, sf_dir).withColumn("name", F.concat(F.lit("doc/"), "doc_id"))
    scanned = detect.text_scan(docs, "text")
    rows = detect.scan_signals(scanned, "name", "evidence_snippet", "matched_heuristics")
    return _shown(rows)


SCAN_SESSIONS_SQL = f"""WITH {Q.DOCS},
{Q.with_rules('docs', 'text', 'ruled')},
s AS (SELECT 'doc/' || doc_id AS source, rules, {Q.ADDITIVE} AS score, {Q.evidence('text')} AS ev
  FROM ruled WHERE {Q.ADDITIVE} >= 0.25)
SELECT sha256('scan' || chr(31) || source || chr(31) || ev) AS session_id, 0 AS turn_index,
  0 AS msg_index, 'scan' AS stage, score, rules, source, ev AS evidence_snippet FROM s"""


QUERIES = {
    "session_verdicts": (session_verdicts, SESSION_VERDICTS_SQL),
    "rule_hits": (rule_hits, RULE_HITS_SQL),
    "doc_scan": (doc_scan, DOC_SCAN_SQL),
    "page_scan": (page_scan, PAGE_SCAN_SQL),
    "text_check": (text_check, TEXT_CHECK_SQL),
    "evidence_snippets": (evidence_snippets, EVIDENCE_SQL),
    "mixed_script": (mixed_script, MIXED_SQL),
    "external_sources": (external_sources, EXTERNAL_SOURCES_SQL),
    "source_attribution": (source_attribution, SOURCE_SQL),
    "turn_signals": (turn_signals, TURN_SIGNALS_SQL),
    "event_signals": (event_signals, EVENT_SIGNALS_SQL),
    "window_signals": (window_signals, WINDOW_SQL),
    "score_bands": (score_bands, SCORE_BANDS_SQL),
    "scan_gate": (scan_gate, SCAN_GATE_SQL),
    "scan_sessions": (scan_sessions, SCAN_SESSIONS_SQL),
}
