"""Rule tables as Columns.

A rule table is an ordered list of ``(label, patterns)``. Each label becomes one alternation
regex, so a table of N labels costs N regex tests per row and no UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Sequence[str]]]


def _alternatives(pattern: str) -> list[str]:
    """Split a regex at its top-level bars."""
    parts, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            i += 2
            continue
        if in_class:
            in_class = char != "]"
        elif char == "[":
            in_class = True
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def _first_letters(pattern: str) -> str | None:
    """The letters a match of ``pattern`` can begin with; None where they are not plain to see."""
    if pattern.startswith("(?:"):
        depth, i = 0, 0
        while i < len(pattern):
            if pattern[i] in "\\[":
                return None
            depth += {"(": 1, ")": -1}.get(pattern[i], 0)
            if depth == 0:
                break
            i += 1
        if i + 1 < len(pattern) and pattern[i + 1] in "?*{":
            return None
        letters = [_first_letters(part) for part in _alternatives(pattern[3:i])]
        return None if None in letters else "".join(letters)
    plain = pattern[:1].isascii() and pattern[:1].isalnum()
    return pattern[0] if plain and pattern[1:2] not in tuple("?*{") else None


def one_of(patterns: Iterable[str]) -> str:
    """One alternation. Word-start alternatives share their ``\\b``, so the regex engine
    rejects a position inside a word once instead of once per alternative; where their first
    letters are known, a look at the letter comes before the costlier ``\\b``."""
    parts = [part for p in patterns for part in _alternatives(p)]
    starts = [p[2:] for p in parts if p.startswith(r"\b")]
    others = [p for p in parts if not p.startswith(r"\b")]
    if starts:
        letters = [_first_letters(p) for p in starts]
        known = "" if None in letters else f"(?=[{''.join(sorted(set(''.join(letters))))}])"
        others.insert(0, known + r"\b(?:" + "|".join(f"(?:{p})" for p in starts) + ")")
    return "|".join(f"(?:{p})" for p in others)


def matches(text: Column, patterns: Iterable[str]) -> Column:
    """True when any pattern occurs in ``text``; NULL text never matches."""
    return F.coalesce(text.rlike(one_of(patterns)), F.lit(False))


def _any_rule(text: Column, rules: Rules) -> Column:
    return matches(text, [p for _, patterns in rules for p in patterns])


def first_label(text: Column, rules: Rules, default: str | None = None) -> Column:
    """Label of the first matching rule in table order.

    Most texts match no rule at all, so one test of the whole table comes first.
    """
    cases = [F.when(matches(text, patterns), F.lit(label)) for label, patterns in rules]
    found = F.coalesce(*cases)
    if len(rules) > 2:
        found = F.when(_any_rule(text, rules), found)
    return F.coalesce(found, F.lit(default).cast("string"))


def all_labels(text: Column, rules: Rules) -> Column:
    """Array of every matching label, in table order, each at most once."""
    cases = [F.when(matches(text, patterns), F.lit(label)) for label, patterns in rules]
    found = F.array_compact(F.array(*cases))
    if len({label for label, _ in rules}) < len(rules):
        found = F.array_distinct(found)
    if len(rules) > 2:
        none = F.array().cast("array<string>")
        found = F.when(_any_rule(text, rules), found).otherwise(none)
    return found


def capture(text: Column, pattern: str, group: int = 0) -> Column:
    """One regex group, NULL when absent or empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row, however often ``body`` names it.

    A Column named twice is otherwise evaluated twice, and a chain of such Columns doubles with
    each link. Branches of ``body`` that are not taken are not evaluated.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(key: Column, table: Iterable[tuple[str, str]]) -> Column:
    """Small literal map lookup; NULL when the key is absent."""
    flat = [F.lit(x) for pair in table for x in pair]
    return F.try_element_at(F.create_map(*flat), key)


def text_or_empty(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def joined(array: Column) -> Column:
    return F.array_join(array, "|")


def settled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Compute the named columns once, in a one-row generate.

    A later filter or join on a derived column is otherwise pushed below it with the whole
    derivation copied into the predicate, and join keys are expanded through every projection
    while Spark looks for prunable partitions; both can cost more than the query.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names))))


def by_distinct(df: DataFrame, keys: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """Add ``columns`` that depend on ``keys`` alone, worked out once per distinct key.

    For rules on texts that repeat in very many rows. The distinct keys are usually few, and
    Spark then broadcasts them by their measured size; else a frequent key's rows can be split.
    """
    names = {f"_key_{k}": F.col(k) for k in keys}
    built = df.select(*keys).distinct().select(
        *[c.alias(n) for n, c in names.items()], *[c.alias(n) for n, c in columns.items()]
    )
    same = [F.col(k).eqNullSafe(F.col(n)) for n, k in zip(names, keys)]
    return df.drop(*columns).join(built, same, "left").drop(*names)
