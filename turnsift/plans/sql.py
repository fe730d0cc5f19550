"""SQL text for the comparison engine, put together from named CTEs.

The patterns below are the rules again, written for RE2, so that the comparison does not
share code with the Spark side.
"""

from __future__ import annotations

from turnsift.plans import overlay

# Rule id, weight in hundredths, RE2 pattern.
HEURISTICS = (
    ("H01", 35, r"ignore\s+(previous|all|prior)\s+instructions"),
    ("H02", 30, r"(you\s+are\s+now\b|your\s+new\s+(role|persona|instructions)\b)"),
    ("H03", 25, r"do\s+not\s+(tell|inform|mention)\s+the\s+user"),
    ("H04", 15, r"(\[\[.{0,200}?\]\]|<\|[a-zA-Z_]{1,30}\|>|\[INST\]|</?(s|INST|SYS)>)"),
    ("H06", 20,
     r"(?m)^(send|forward|email|post|upload|exfiltrate|leak|steal|ignore|disregard|pretend|"
     r"act\s+as|respond\s+as|output|print|reveal|expose|dump|return)\s+\w"),
    ("H07", 25,
     r"(system\s+prompt|context\s+window|your\s+instructions|initial\s+(instructions?|prompt)|"
     r"original\s+(instructions?|prompt)|base\s+(instructions?|prompt)|hidden\s+instructions?)"),
    ("H08", 40,
     r"(send|forward|email|post|upload)\b.{0,80}"
     r"(secret|password|passwd|token|api[_\s]?key|private[_\s]?key|credential)"),
)
MIXED_POINTS = 20
BOUNDARIES = (
    ("IB01", 25, r"from\s+this\s+point\s+(forward|on)\b"),
    ("IB02", 30,
     r"your\s+(only\s+)?(task|job|purpose|goal|objective|instructions?)\s+(is|are|must|should)\b"),
    ("IB03", 30, r"respond\s+only\s+with\b"),
    ("IB04", 25,
     r"(you\s+must|you\s+will|you\s+should)\s+(now\s+)?"
     r"(only|always|never|ignore|forget|disregard)\b"),
    ("IB05", 35,
     r"(forget|disregard|override|bypass)\s+(everything|all|any|the)\s+"
     r"(above|previous|prior|before|instructions?|context)"),
    ("IB06", 20, r"(do\s+not|don'?t|never)\s+(reveal|mention|say|tell|show|discuss)\b"),
    ("IB07", 25, r"(act\s+as|pretend\s+(to\s+be|you\s+are)|roleplay\s+as|you\s+are\s+now)\b"),
    ("IB08", 30,
     r"(output|print|return|reply|respond|answer)\s+(only|just|exactly|the\s+word|the\s+phrase)\b"),
    ("IB09", 25, r"new\s+(directive|instruction|command|order|rule)\b"),
    ("IB10", 30,
     r"(greet|welcome|say\s+hello|introduce\s+yourself)\s+"
     r"(the\s+user\s+with|with\s+the\s+word)\b"),
)
URL = r"https?://[^\s<>\"{}|\\^`\[\]]+"
URL_SOURCES = r"https?://[^\s<>\"{}|\\^'\[\]]+"
PATH = (
    r"(?:^|[\s(\"'])(/[a-zA-Z0-9_./ \-]{3,}|[A-Za-z]:\\[^\s]{2,}|\./[^\s]{2,})"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _regex(pattern: str) -> str:
    flags = "(?is)"
    return quoted(flags + pattern)


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def _column(rule_id: str) -> str:
    return "r_" + rule_id.lower()


def rules_expr() -> str:
    ids = [r[0] for r in HEURISTICS] + ["H05"] + [r[0] for r in BOUNDARIES]
    return "concat_ws(',', {})".format(
        ", ".join(f"CASE WHEN {_column(i)} THEN '{i}' END" for i in ids)
    )


def with_rules(source: str, text: str, name: str) -> str:
    """CTEs ``<name>``: all columns of source, a flag per rule, hp, ibp, rules."""
    flags = [
        f"regexp_matches({text}, {_regex(pattern)}) AS {_column(rule_id)}"
        for rule_id, _, pattern in HEURISTICS + BOUNDARIES
    ]
    letters = f"length(regexp_replace({text}, '[^\\p{{L}}]', '', 'g'))"
    beyond = (
        f"length(regexp_replace(regexp_replace({text}, '[^\\p{{L}}]', '', 'g'), "
        f"'[\\x00-\\x{{024F}}]', '', 'g'))"
    )
    mixed = (
        f"({letters} >= 20 AND {beyond} * 100 >= {letters} * 5 "
        f"AND {beyond} * 100 <= {letters} * 95) AS r_h05"
    )
    h_points = " + ".join(f"{w} * r_{i.lower()}::INT" for i, w, _ in HEURISTICS)
    ib_points = " + ".join(f"{w} * r_{i.lower()}::INT" for i, w, _ in BOUNDARIES)
    return (
        f"{name}_flags AS (SELECT *, {', '.join(flags)}, {mixed} FROM {source}),\n"
        f"{name} AS (SELECT *, least(100, {h_points} + {MIXED_POINTS} * r_h05::INT) AS hp, "
        f"least(100, {ib_points}) AS ibp, {rules_expr()} AS rules FROM {name}_flags)"
    )


AVERAGED = "(hp + ibp) / 200.0"
ADDITIVE = "least(hp + ibp, 100) / 100.0"


def _around(text: str, pattern: str) -> str:
    plain = pattern
    multi = plain.startswith("(?m)")
    body = plain[4:] if multi else plain
    inner = f"(?m:{body})" if multi else f"(?:{body})"
    start = f"length(regexp_extract({text}, {quoted('(?is)' + chr(92) + 'A(.*?)' + inner)}, 1))"
    size = f"length(regexp_extract({text}, {_regex(pattern)}, 0))"
    first = f"greatest({start} - 40, 0)"
    last = f"least({start} + {size} + 40, length({text}))"
    return strip(f"substr({text}, {first} + 1, {last} - {first})")


def evidence(text: str) -> str:
    h = [
        f"CASE WHEN r_{i.lower()} THEN {_around(text, p)} END" for i, _, p in HEURISTICS
    ] + [f"CASE WHEN r_h05 THEN {strip(f'left({text}, 100)')} END"]
    ib = [f"CASE WHEN r_{i.lower()} THEN {_around(text, p)} END" for i, _, p in BOUNDARIES]
    joined_h = f"left(concat_ws(' … ', {', '.join(h)}), 500)"
    joined_ib = f"left(concat_ws(' … ', {', '.join(ib)}), 500)"
    return f"coalesce(nullif({joined_h}, ''), {joined_ib})"


def external(role: str = "role", content: str = "content") -> str:
    return (
        f"({role} = 'tool' OR ({role} = 'user' AND (regexp_matches({content}, {quoted(URL)}) "
        f"OR regexp_matches({content}, {quoted(PATH)}))))"
    )


def sources(content: str) -> str:
    found = (
        f"list_concat(regexp_extract_all({content}, {quoted(URL_SOURCES)}), "
        f"list_transform(regexp_extract_all({content}, {quoted(PATH)}, 1), "
        f"lambda x: {strip('x')}))"
    )
    return found


def distinct_in_order(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def first_source(text: str, items: str) -> str:
    return (
        f"coalesce(list_filter({items}, lambda x: contains({text}, x))[1], "
        f"nullif(regexp_extract({text}, {quoted(URL)}), ''))"
    )


def three_way(score: str, low: str = "0.25") -> str:
    return (
        f"CASE WHEN {score} >= 0.75 THEN 'compromised' WHEN {score} >= {low} "
        f"THEN 'suspicious' ELSE 'clean' END"
    )


PAY = overlay.pay_sql()
CONV = f"{PAY},\nconv AS ({overlay.CONVERSATIONS_SQL_BODY})"
DOCS = f"{PAY},\ndocs AS ({overlay.DOCUMENTS_SQL_BODY})"
PAGES = f"{PAY},\nweb AS ({overlay.PAGES_SQL_BODY})"
TOOL_LOG = f"tools AS ({overlay.TOOL_LOG_SQL_BODY})"

EXTERNAL = f"ext AS (SELECT * FROM conv WHERE content <> '' AND {external()})"

# Message signals of the planted conversations.
MESSAGE_SIGNALS = f"""{CONV},
{EXTERNAL},
{with_rules('ext', 'content', 'ruled')},
msg AS (SELECT session_id, turn_index, msg_index, content, ts, rules, {AVERAGED} AS score,
  {distinct_in_order('src')} AS src, ev
  FROM (SELECT *, {sources('content')} AS src, {evidence('content')} AS ev FROM ruled)
  WHERE {AVERAGED} >= 0.25)"""

# Window signals on top of them.
WINDOW_SIGNALS = f"""{MESSAGE_SIGNALS},
laid AS (SELECT c.session_id, c.turn_index, e.content AS ext_text,
    CASE WHEN c.role IN ('user', 'tool') THEN {sources('c.content')}
      ELSE []::VARCHAR[] END AS src,
    s.score IS NOT NULL AS flagged
  FROM conv c LEFT JOIN ext e USING (session_id, turn_index)
  LEFT JOIN msg s USING (session_id, turn_index)),
framed AS (SELECT session_id, turn_index, flagged,
    string_agg(ext_text, chr(10) || chr(10) || '---' || chr(10) || chr(10)) OVER w AS block,
    flatten(list(src) OVER w) AS src, count(*) OVER w AS n
  FROM laid WINDOW w AS (PARTITION BY session_id ORDER BY turn_index
    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
blocks AS (SELECT * FROM framed WHERE NOT flagged AND n >= 2 AND block IS NOT NULL),
{with_rules('blocks', 'block', 'wruled')},
win AS (SELECT session_id, turn_index, {AVERAGED} AS score, rules || ',WIN01' AS rules,
  {distinct_in_order('src')} AS src, block,
  '[Window ' || n || ' turns] ' || left({evidence('block')}, 460) AS ev
  FROM wruled WHERE {AVERAGED} >= 0.25)"""

ALL_SIGNALS = f"""{WINDOW_SIGNALS},
sig AS (SELECT session_id, turn_index, 0 AS msg_index, 'message' AS stage, score, rules,
    {first_source('content', 'src')} AS source, ev FROM msg
  UNION ALL SELECT session_id, turn_index, NULL, 'window', score, rules,
    {first_source('block', 'src')}, ev FROM win)"""
