"""Text column helpers whose meaning does not change with the regex engine.

Character classes are spelled out so that whitespace and word characters are the
Unicode ones (str.isspace / str.isalnum), whatever the flags of the JVM regex.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE_CHARS = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD_CHARS = r"\p{L}\p{N}_"
SPACE = f"[{SPACE_CHARS}]"
WORD = f"[{WORD_CHARS}]"

_STRIP = rf"\A{SPACE}+|{SPACE}+\z"

# URL and path shapes are fixed values. The two URL classes differ on purpose: the
# predicate stops at a backtick, source extraction stops at an apostrophe.
URL_IN_PREDICATE = rf'https?://[^{SPACE_CHARS}<>"{{}}|\\^`\[\]]+'
URL_IN_SOURCES = rf"https?://[^{SPACE_CHARS}<>\"{{}}|\\^'\[\]]+"
PATH = (
    rf"(?:^|[{SPACE_CHARS}(\"'])"
    rf"(/[a-zA-Z0-9_./ \-]{{3,}}|[A-Za-z]:\\[^{SPACE_CHARS}]{{2,}}|\./[^{SPACE_CHARS}]{{2,}})"
)

TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def literal(text: str) -> str:
    """SQL string literal that takes backslashes as they are."""
    if "'" not in text:
        return f"r'{text}'"
    if '"' in text:
        raise ValueError(f"both kinds of quotes in {text!r}; write one as \\x27")
    return f'r"{text}"'


def quote_name(column: str) -> str:
    return ".".join(f"`{part}`" for part in column.split("."))


def strip_sql(expression: str) -> str:
    return f"regexp_replace({expression}, {literal(_STRIP)}, '')"


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace of any kind (trim() drops spaces only)."""
    return F.regexp_replace(text, _STRIP, "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(f"[^{SPACE_CHARS}]")


def fold_case_sql(text: str) -> str:
    """Lower case with the letters that case-insensitive ASCII matching also accepts.

    One output character per input character, so offsets stay valid in the original.
    """
    plain = f"replace(replace(replace({text}, 'ſ', 's'), 'ı', 'i'), 'İ', 'i')"
    return f"lower({plain})"


def fold_case(text: str) -> Column:
    return F.expr(fold_case_sql(quote_name(text)))


def page_title(html: Column) -> Column:
    inner = F.regexp_extract(html, TITLE, 1)
    return strip(F.regexp_replace(inner, "<[^>]+>", ""))


def external_sources(texts: Column) -> Column:
    """Every URL, then every path, text by text; distinct in first-seen order."""

    def from_one(text: Column) -> Column:
        urls = F.regexp_extract_all(text, F.lit(URL_IN_SOURCES), F.lit(0))
        paths = F.regexp_extract_all(text, F.lit(PATH), F.lit(1))
        return F.concat(urls, F.transform(paths, strip))

    return F.array_distinct(F.flatten(F.transform(texts, from_one)))


def event_sources(messages: Column) -> Column:
    """Sources of an event: those of its user and tool messages, message by message."""
    heard = F.filter(
        messages,
        lambda m: m["role"].isin("user", "tool") & (F.coalesce(m["content"], F.lit("")) != ""),
    )
    return external_sources(F.transform(heard, lambda m: m["content"]))


def is_external(role: Column, content: Column) -> Column:
    """Tool output always; user text only when it carries a URL or a path."""
    return (role == "tool") | (
        (role == "user") & (content.rlike(URL_IN_PREDICATE) | content.rlike(PATH))
    )


def first_source(text: Column, sources: Column) -> Column:
    """First listed source that occurs in the text, else its first URL, else null."""
    listed = F.get(F.filter(sources, lambda s: F.contains(text, s)), F.lit(0))
    return F.coalesce(listed, F.nullif(F.regexp_extract(text, URL_IN_PREDICATE, 0), F.lit("")))


def line_of(text: Column, evidence: Column) -> Column:
    """0-based number of the first line holding the head of the evidence, else 0."""
    head = strip(F.left(evidence, F.lit(60)))
    hits = F.transform(
        F.split(text, r"\r\n|\n|\r"), lambda line: F.contains(line, head)
    )
    found = F.array_position(hits, F.lit(True)).cast("int")
    return F.when((F.length(head) > 0) & (found > 0), found - 1).otherwise(F.lit(0))


def preview(text: Column, size: int) -> Column:
    cut = F.left(text, F.lit(size))
    return F.when(F.length(text) > size, F.concat(cut, F.lit("…"))).otherwise(cut)


def safe_session_id(session_id: Column) -> Column:
    return F.regexp_replace(session_id, r"[^a-zA-Z0-9_\-]", "_")
