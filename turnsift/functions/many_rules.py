"""Rule tables of any size: the hits of a text are a list of rule numbers.

One search over the folded text looks for the plain words of all rules at once (an Aho-Corasick
automaton in Arrow batches) and names the few rules that can match; only their patterns run, JVM-side.
The expressions hold the rule table as array literals, so their size does not grow into a branch
per rule. The list stands wherever a mask of few rules stands.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

_FOLDED, _NAMED = "_folded", "_named"
#: Words that one pattern is spelled out to at most.
_SPELLINGS = 32
_PLAIN = re.compile(r"(?:[a-z0-9 ]|\[[a-z0-9 ]+\])+")


def _spelled(regex: str) -> tuple[str, ...]:
    """All texts a pattern of plain characters and short classes matches; none for any other pattern."""
    if not _PLAIN.fullmatch(regex):
        return ()
    choices = [part.strip("[]") for part in re.findall(r"\[[^]]+\]|.", regex)]
    if np.prod([len(part) for part in choices], dtype=float) > _SPELLINGS:
        return ()
    return tuple(sorted({"".join(letters) for letters in product(*choices)}))


def _needs(rule) -> tuple[tuple[str, ...], ...]:
    """Groups of words of which a match has one each: the rule's own, or where its pattern is a few plain
    texts, those, which are rarer."""
    spelled = _spelled(rule.regex) if rule.needs else ()
    implied = all(any(word in text for word in group) for text in spelled for group in rule.needs)
    return (spelled,) if spelled and implied else rule.needs


class _Search:
    """Which rules have all their words in a text."""

    def __init__(self, needs: tuple[tuple[tuple[str, ...], ...], ...]):
        import ahocorasick

        self.free = [i for i, groups in enumerate(needs) if not groups]
        self.groups = np.array([len(groups) for groups in needs])
        members: dict[str, list[tuple[int, int]]] = {}
        for i, groups in enumerate(needs):
            for g, group in enumerate(groups):
                for word in group:
                    members.setdefault(word, []).append((i, g))
        self.automaton = ahocorasick.Automaton() if members else None
        for word, entries in members.items():
            self.automaton.add_word(word, entries)
        if members:
            self.automaton.make_automaton()

    def named(self, text: str) -> list[int]:
        met = set()
        if self.automaton is not None:
            for _, entries in self.automaton.iter(text):
                met.update(entries)
        count = np.bincount([i for i, _ in met], minlength=len(self.groups)) if met else 0 * self.groups
        return sorted([*self.free, *np.flatnonzero((count == self.groups) & (self.groups > 0)).tolist()])


@cache
def _search(needs: tuple) -> _Search:
    return _Search(needs)


def _naming(rules: Sequence):
    needs = tuple(_needs(rule) for rule in rules)

    @F.pandas_udf(ArrayType(IntegerType()))
    def named(texts: pd.Series) -> pd.Series:
        search = _search(needs)
        return pd.Series([None if text is None else search.named(text) for text in texts], dtype=object)

    return named


def _at(values: Column, number: Column) -> Column:
    return F.get(values, number)


def _literals(values: Sequence) -> Column:
    return F.array(*(F.lit(v) for v in values))


def with_hits(
    df: DataFrame, text: str, rules: Sequence, folded: Column, pattern: Callable, mixed: Column | None, special: str, out: str
) -> DataFrame:
    """Add the ascending numbers of the matching rules; null texts match none. ``pattern`` gives the JVM
    regex of a rule, ``mixed`` is the condition of the rules of family ``special``."""
    patterns = _literals(["" if rule.family == special else pattern(rule) for rule in rules])
    plain = _literals([rule.family != special for rule in rules])
    other = F.coalesce(mixed, F.lit(False)) if mixed is not None else F.lit(False)

    def matches(i: Column) -> Column:
        return F.when(_at(plain, i), F.rlike(F.col(_FOLDED), _at(patterns, i))).otherwise(other)

    hits = F.coalesce(F.filter(_NAMED, matches), F.array().cast("array<int>"))
    # through a generator, so that no later filter copies the search below itself
    return (
        df.withColumn(_FOLDED, folded)
        .withColumn(_NAMED, _naming(rules)(_FOLDED))
        .select("*", F.explode(F.array(hits)).alias(out))
        .drop(_FOLDED, _NAMED)
    )


def ids(hits: str, rules: Sequence) -> Column:
    names = _literals([rule.rule_id for rule in rules])
    return F.transform(F.col(hits), lambda i: _at(names, i))


def points(families: Sequence[str], hits: str, rules: Sequence) -> Column:
    worth = _literals([rule.points if rule.family in families else 0 for rule in rules])
    return F.least(F.lit(100), F.aggregate(F.col(hits), F.lit(0), lambda total, i: total + _at(worth, i)))

