"""Detection rules as data and the columns that apply them.

A text is folded to lower case once; every rule then looks for the plain words it
cannot match without before its regex runs, so almost all text is rejected by byte
search. The hits of up to ``MASK_BITS`` rules travel as one BIGINT bit mask, those of more rules as
a list of rule numbers (``many_rules``); ``has_hit`` reads both.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from turnsift.functions import many_rules
from turnsift.functions.text import (
    SPACE,
    SPACE_CHARS,
    WORD,
    fold_case,
    fold_case_sql,
    literal,
    quote_name,
    strip_sql,
)

HEURISTIC = "heuristic"
BOUNDARY = "boundary"
MIXED_SCRIPT = "mixed_script"

MASK_BITS = 62
EVIDENCE_REACH = 40
EVIDENCE_CHARS = 500
EVIDENCE_JOIN = " … "


@dataclass(frozen=True)
class Rule:
    """``regex`` is matched against lower-cased text; ``needs`` lists groups of words,
    one word of every group must occur in any text the regex can match."""

    rule_id: str
    family: str
    points: int
    regex: str
    label: str
    needs: tuple[tuple[str, ...], ...] = ()

    def __post_init__(self):
        if re.search(r"(?<!\\)[A-Z]", self.regex):
            raise ValueError(f"rule {self.rule_id}: write the pattern in lower case")
        if not 0 <= self.points <= 100:
            raise ValueError(f"rule {self.rule_id}: points must be 0..100")


# ---- fixed values: rule ids, weights in hundredths, patterns and labels -------------
RULES: tuple[Rule, ...] = (
    Rule("H01", HEURISTIC, 35,
         r"ignore\s+(previous|all|prior)\s+instructions",
         "Classic instruction override - 'ignore previous instructions'",
         (("instructions",), ("ignore",))),
    Rule("H02", HEURISTIC, 30,
         r"(you\s+are\s+now\b|your\s+new\s+(role|persona|instructions)\b)",
         "Role or persona hijack attempt",
         (("you",), ("now", "new"))),
    Rule("H03", HEURISTIC, 25,
         r"do\s+not\s+(tell|inform|mention)\s+the\s+user",
         "Concealment directive - telling the AI to hide information from the user",
         (("user",), ("not",))),
    Rule("H04", HEURISTIC, 15,
         r"(\[\[.{0,200}?\]\]|<\|[a-z_]{1,30}\|>|\[inst\]|</?(s|inst|sys)>)",
         "Encoded / token-based injection markers",
         (("[", "<"), ("[[", "<|", "[inst]", "inst>", "sys>", "<s>", "</s>"))),
    Rule("H06", HEURISTIC, 20,
         r"(?m)^(send|forward|email|post|upload|exfiltrate|leak|steal|"
         r"ignore|disregard|pretend|act\s+as|respond\s+as|output|print|"
         r"reveal|expose|dump|return)\s+\w",
         "Imperative command embedded in tool or external content output"),
    Rule("H07", HEURISTIC, 25,
         r"(system\s+prompt|context\s+window|your\s+instructions|"
         r"initial\s+(instructions?|prompt)|original\s+(instructions?|prompt)|"
         r"base\s+(instructions?|prompt)|hidden\s+instructions?)",
         "Reference to system prompt or context window",
         (("prompt", "window", "instruction"),)),
    Rule("H08", HEURISTIC, 40,
         r"(send|forward|email|post|upload)\b.{0,80}"
         r"(secret|password|passwd|token|api[_\s]?key|private[_\s]?key|credential)",
         "Credential or secret exfiltration setup",
         (("secret", "passw", "token", "key", "credential"),
          ("send", "forward", "email", "post", "upload"))),
    Rule("H05", MIXED_SCRIPT, 20, "",
         "Language-switch evasion - instructions embedded in a second script/language"),
    Rule("IB01", BOUNDARY, 25,
         r"from\s+this\s+point\s+(forward|on)\b",
         "Temporal override marker - 'from this point forward …'",
         (("point",), ("this",))),
    Rule("IB02", BOUNDARY, 30,
         r"your\s+(only\s+)?(task|job|purpose|goal|objective|instructions?)\s+"
         r"(is|are|must|should)\b",
         "Task redefinition - injected content attempts to rewrite the AI's purpose",
         (("your",), ("task", "job", "purpose", "goal", "objective", "instruction"))),
    Rule("IB03", BOUNDARY, 30,
         r"respond\s+only\s+with\b",
         "Response constraint - forcing the AI to reply in a specific restricted way",
         (("respond",), ("only",))),
    Rule("IB04", BOUNDARY, 25,
         r"(you\s+must|you\s+will|you\s+should)\s+(now\s+)?"
         r"(only|always|never|ignore|forget|disregard)\b",
         "Directive override - 'you must / will / should … ignore / forget'",
         (("you",), ("must", "will", "should"),
          ("only", "always", "never", "ignore", "forget", "disregard"))),
    Rule("IB05", BOUNDARY, 35,
         r"(forget|disregard|override|bypass)\s+(everything|all|any|the)\s+"
         r"(above|previous|prior|before|instructions?|context)",
         "Context wipe - 'forget / disregard everything above'",
         (("forget", "disregard", "override", "bypass"),)),
    Rule("IB06", BOUNDARY, 20,
         r"(do\s+not|don'?t|never)\s+(reveal|mention|say|tell|show|discuss)\b",
         "Concealment instruction - telling the AI not to reveal something",
         (("reveal", "mention", "say", "tell", "show", "discuss"),
          ("not", "don", "never"))),
    Rule("IB07", BOUNDARY, 25,
         r"(act\s+as|pretend\s+(to\s+be|you\s+are)|roleplay\s+as|you\s+are\s+now)\b",
         "Persona hijack - 'act as / pretend to be / you are now'",
         (("act", "pretend", "roleplay", "now"),)),
    Rule("IB08", BOUNDARY, 30,
         r"(output|print|return|reply|respond|answer)\s+"
         r"(only|just|exactly|the\s+word|the\s+phrase)\b",
         "Output constraint - 'output only / reply with exactly'",
         (("only", "just", "exactly", "word", "phrase"),
          ("output", "print", "return", "reply", "respond", "answer"))),
    Rule("IB09", BOUNDARY, 25,
         r"new\s+(directive|instruction|command|order|rule)\b",
         "New directive injection - explicit 'new instruction / command / rule'",
         (("new",), ("directive", "instruction", "command", "order", "rule"))),
    Rule("IB10", BOUNDARY, 30,
         r"(greet|welcome|say\s+hello|introduce\s+yourself)\s+"
         r"(the\s+user\s+with|with\s+the\s+word)\b",
         "Greeting-behaviour hijack - manipulating how the AI introduces itself",
         (("with",), ("greet", "welcome", "say", "introduce"))),
)

MARKER_LABELS = {
    "SEM01": "Semantic anomaly - AI response diverged significantly from the expected topic",
    "ML only": "ML classifier detected an injection pattern (no specific heuristic matched)",
    "WIN01": "Sliding window - several turns read as one block",
    "WIN_ML": "Sliding window - flagged by the model only",
    "scan": "Text scan - flagged by the model only",
}
# ------------------------------------------------------------------------------------


def rule_labels(spark, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rule id, weight and label, to broadcast against rule hits."""
    rows = [(r.rule_id, r.points / 100.0, r.label) for r in rules]
    rows += [(marker, None, label) for marker, label in MARKER_LABELS.items()]
    return spark.createDataFrame(rows, "rule_id string, weight double, label string")


def jvm_regex(rule: Rule) -> str:
    """The rule's pattern for the JVM: dot matches newline, ^ breaks on \\n only."""
    inside = rule.regex.replace(r"[_\s]", f"[_{SPACE_CHARS}]")
    spelled = (
        inside.replace(r"\s", SPACE).replace(r"\w", WORD).replace(r"\b", f"(?!{WORD})")
    )
    return f"(?sd){spelled}"


def mixed_script_sql(text: str) -> str:
    """At least 20 letters, 5 to 95 percent of them beyond extended Latin."""
    letters = f"length(regexp_replace({text}, {literal(_NO_LETTERS)}, ''))"
    beyond = f"length(regexp_replace({text}, {literal(_NOT_BEYOND)}, ''))"
    return (
        f"(octet_length({text}) > length({text}) AND rlike({text}, {literal(_FAR_CHARS)}) "
        f"AND {letters} >= 20 AND {beyond} * 100 BETWEEN {letters} * 5 AND {letters} * 95)"
    )


_NO_LETTERS = r"[^\p{L}]+"
_NOT_BEYOND = r"[^\p{L}&&[^\x00-\x{24f}]]+"
_FAR_CHARS = r"[\x{250}-\x{10ffff}]"


def mixed_script(text: str) -> Column:
    return F.expr(mixed_script_sql(quote_name(text)))


def _hit_sql(rule: Rule, text: str, folded: str) -> str:
    if rule.family == MIXED_SCRIPT:
        return mixed_script_sql(text)
    checks = [
        "(" + " OR ".join(f"contains({folded}, {literal(word)})" for word in group) + ")"
        for group in rule.needs
    ]
    return " AND ".join([*checks, f"rlike({folded}, {literal(jvm_regex(rule))})"])


def _bit_sql(mask: str, position: int) -> str:
    return f"{mask} & {1 << position}L != 0"


def with_rule_mask(
    df: DataFrame, text: str, rules: Sequence[Rule] = RULES, out: str = "rule_mask"
) -> DataFrame:
    """Add the bit mask of matching rules, or for a longer table the list of their numbers.

    The mask leaves through a one-element generator: a later filter on it or on a score
    then stays above the regexes instead of being pushed down as a second copy of them.
    """
    if len(rules) > MASK_BITS:
        mixed = mixed_script(text) if any(r.family == MIXED_SCRIPT for r in rules) else None
        return many_rules.with_hits(df, text, rules, fold_case(text), jvm_regex, mixed, MIXED_SCRIPT, out)
    bits = [
        f"IF({_hit_sql(rule, quote_name(text), '_folded')}, {1 << i}L, 0L)"
        for i, rule in enumerate(rules)
    ]
    return (
        df.withColumn("_folded", fold_case(text))
        .select("*", F.expr(f"explode(array({' | '.join(bits)}))").alias(out))
        .drop("_folded")
    )


def has_hit(mask: str = "rule_mask", rules: Sequence[Rule] = RULES) -> Column:
    """Whether any rule matched."""
    return F.size(mask) > 0 if len(rules) > MASK_BITS else F.col(mask) != 0


def rule_ids(mask: str = "rule_mask", rules: Sequence[Rule] = RULES) -> Column:
    """Matched rule ids in table order."""
    if len(rules) > MASK_BITS:
        return many_rules.ids(mask, rules)
    name = quote_name(mask)
    ids = [f"IF({_bit_sql(name, i)}, {literal(r.rule_id)}, NULL)" for i, r in enumerate(rules)]
    return F.expr(f"array_compact(array({', '.join(ids)}))")


def points(
    families: Sequence[str], mask: str = "rule_mask", rules: Sequence[Rule] = RULES
) -> Column:
    """Capped sum of the weights, in hundredths so that no float noise builds up."""
    if len(rules) > MASK_BITS:
        return many_rules.points(families, mask, rules)
    name = quote_name(mask)
    parts = [
        f"IF({_bit_sql(name, i)}, {r.points}, 0)"
        for i, r in enumerate(rules)
        if r.family in families
    ]
    return F.expr(f"least(100, {' + '.join(parts) or '0'})")


def heuristic_points(mask: str = "rule_mask", rules: Sequence[Rule] = RULES) -> Column:
    return points((HEURISTIC, MIXED_SCRIPT), mask, rules)


def boundary_points(mask: str = "rule_mask", rules: Sequence[Rule] = RULES) -> Column:
    return points((BOUNDARY,), mask, rules)


def _found_sql(folded: str, regexes: str) -> str:
    """Start and size in characters of the first match of every regex; the text is folded once."""
    return (
        f"transform(array({folded}), f -> transform({regexes}, x -> "
        "named_struct('s', length(split(f, x, 2)[0]), 'm', length(regexp_substr(f, x)))))[0]"
    )


def _around_sql(text: str, found: str) -> str:
    """The surroundings of every match."""
    first = f"greatest(p.s - {EVIDENCE_REACH}, 0)"
    last = f"least(p.s + p.m + {EVIDENCE_REACH}, length({text}))"
    around = f"substring({text}, {first} + 1, {last} - {first})"
    return f"transform({found}, p -> {strip_sql(around)})"


def _family_evidence_sql(text: str, folded: str, mask: str, families, rules) -> str:
    regexes = ", ".join(
        f"IF({_bit_sql(mask, i)}, {literal(jvm_regex(r))}, NULL)"
        for i, r in enumerate(rules)
        if r.family in families and r.family != MIXED_SCRIPT
    )
    parts = _around_sql(text, _found_sql(folded, f"array_compact(array({regexes}))"))
    for i, rule in enumerate(rules):
        if rule.family == MIXED_SCRIPT and rule.family in families:
            parts = _with_head_sql(parts, text, _bit_sql(mask, i))
    return f"left(array_join({parts}, {literal(EVIDENCE_JOIN)}), {EVIDENCE_CHARS})"


def _with_head_sql(parts: str, text: str, hit: str) -> str:
    """The head of the text for a mixed-script hit."""
    head = strip_sql(f"left({text}, 100)")
    return f"concat({parts}, IF({hit}, array({head}), CAST(array() AS array<string>)))"


def _listed_evidence_sql(text: str, folded: str, hits: str, families, rules) -> str:
    """The same for a list of rule numbers."""
    patterns = ", ".join(
        literal(jvm_regex(r)) if r.family in families and r.family != MIXED_SCRIPT else "NULL" for r in rules
    )
    chosen = f"array_compact(transform({hits}, i -> get(array({patterns}), i)))"
    parts = _around_sql(text, _found_sql(folded, chosen))
    for i, rule in enumerate(rules):
        if rule.family == MIXED_SCRIPT and rule.family in families:
            parts = _with_head_sql(parts, text, f"array_contains({hits}, {i})")
    return f"left(array_join({parts}, {literal(EVIDENCE_JOIN)}), {EVIDENCE_CHARS})"


def evidence(text: str, mask: str = "rule_mask", rules: Sequence[Rule] = RULES) -> Column:
    """Context of every match; boundary context only if the heuristics gave none.

    Meant for rows that already passed the threshold: it runs the matching regexes again.
    """
    body, bits = quote_name(text), quote_name(mask)
    folded = fold_case_sql(body)
    family = _listed_evidence_sql if len(rules) > MASK_BITS else _family_evidence_sql
    heuristic = family(body, folded, bits, (HEURISTIC, MIXED_SCRIPT), rules)
    boundary = family(body, folded, bits, (BOUNDARY,), rules)
    return F.expr(f"coalesce(nullif({heuristic}, ''), {boundary})")
