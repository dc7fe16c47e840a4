"""Folding and name normalisation as native Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from valora.functions import lexicon as lx
from valora.functions.rules import lookup, one_of

# Blocks whose characters decompose: Latin, Greek, Cyrillic, punctuation, letterlike, full width.
_BLOCKS = (
    (0x00A0, 0x0250),
    (0x0370, 0x0530),
    (0x1E00, 0x20A0),
    (0x2116, 0x2127),
    (0x3000, 0x3001),
    (0xFB00, 0xFB07),
    (0xFF01, 0xFF5F),
)


def _decomposed(char: str, form: str) -> str:
    return "".join(c for c in unicodedata.normalize(form, char) if not unicodedata.combining(c))


@lru_cache(maxsize=None)
def _fold_table(form: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, their one-character folds, characters with longer folds), by rule."""
    source, target, long = [], [], []
    for start, stop in _BLOCKS:
        for code in range(start, stop):
            char = chr(code)
            folded = _decomposed(char, form)
            if folded == char or unicodedata.combining(char):
                continue
            if len(folded) == 1:
                source.append(char)
                target.append(folded)
            elif folded:
                long.append((char, folded))
    return "".join(source), "".join(target), tuple(long)


def strip_accents(text: Column, form: str = "NFKD") -> Column:
    """Drop accents (and with NFKD also compatibility forms) without a UDF."""
    source, target, long = _fold_table(form)
    ascii_only = F.octet_length(text) == F.char_length(text)
    plain = F.regexp_replace(F.translate(text, source, target), r"\p{Mn}+", "")
    if not long:
        return F.when(ascii_only, text).otherwise(plain)
    # Long folds (ligatures, fractions, ellipsis) are rare: only rows that hold one pay for them.
    wide = F.create_map(*[F.lit(x) for pair in long for x in pair])
    chars = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(wide, c), c))
    expanded = F.translate(F.array_join(chars, ""), source, target)
    present = "[" + "".join(c for c, _ in long) + "]"
    return (
        F.when(ascii_only, text)
        .when(text.rlike(present), F.regexp_replace(expanded, r"\p{Mn}+", ""))
        .otherwise(plain)
    )


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def fold(
    text: Column, *, form: str = "NFKD", collapse: bool = True, drop_punctuation: bool = False
) -> Column:
    """Accent-free lower case. NULL folds to the empty string."""
    out = F.lower(strip_accents(F.coalesce(text, F.lit("")), form))
    if drop_punctuation:
        out = F.regexp_replace(out, r"(?U)[^\w\s]", "")
        out = F.regexp_replace(out, r"(?U)^\s+|\s+$", "")
    return collapse_spaces(out) if collapse else out


def fold_plain(text: Column) -> Column:
    """The fold used for service identity: NFD, punctuation dropped, inner spaces kept."""
    return fold(text, form="NFD", collapse=False, drop_punctuation=True)


def without_badges(text: Column) -> Column:
    """Folded text without presentation badges; the raw text is left alone."""
    return collapse_spaces(F.regexp_replace(fold(text, collapse=False), lx.BADGE, " "))


# --- names -------------------------------------------------------------------------------


def _capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def _cased(word: Column) -> Column:
    """ALLCAPS and lower words get a capital; CamelCase stays."""
    return F.when(
        (F.upper(word) == word) | (F.lower(word) == word), _capitalised(word)
    ).otherwise(word)


def company_name(name: Column) -> Column:
    """Comparable company name: legal suffixes and punctuation out, casing repaired.

    An acronym keeps its capitals unless it ends a name that lost a legal suffix.
    """
    given = F.trim(F.coalesce(name, F.lit("")))
    had_suffix = given.rlike("(?i)" + one_of(lx.LEGAL_SUFFIXES))
    bare = given
    for suffix in lx.LEGAL_SUFFIXES:
        bare = F.regexp_replace(bare, f"(?i){suffix}", "")
    bare = F.when(had_suffix, bare).otherwise(given)
    bare = collapse_spaces(F.regexp_replace(bare, r"(?U)[^\w\s]", ""))

    def is_acronym(word: Column) -> Column:
        return F.upper(strip_accents(word, "NFD")).isin(*lx.ACRONYMS)

    def repair(word: Column) -> Column:
        key = F.lower(strip_accents(word, "NFD"))
        return F.coalesce(
            lookup(key, lx.NAME_EXCEPTIONS),
            F.when(is_acronym(word), F.upper(key)),
            _cased(word),
        )

    # The lambda sees only its word: an outer expression would be evaluated once per word.
    repaired = F.array_join(F.transform(F.split(bare, " "), repair), " ")
    last = F.substring_index(bare, " ", -1)
    return F.when(
        had_suffix & is_acronym(last),
        F.concat(F.regexp_replace(repaired, r"\S+$", ""), _cased(last)),
    ).otherwise(repaired)


def province_name(province: Column) -> Column:
    return F.coalesce(lookup(F.trim(F.lower(province)), lx.PROVINCE_ALIASES), F.trim(province))


def city_name(city: Column) -> Column:
    return F.coalesce(lookup(F.trim(F.lower(city)), lx.CITY_ALIASES), F.trim(city))


# --- service catalog ---------------------------------------------------------------------


def _catalog_hit(text: Column, display: str, synonyms: tuple[str, ...]) -> Column:
    plain = F.trim(F.lower(text))
    hit = plain == F.lit(display.lower())
    for synonym in synonyms:
        hit = hit | plain.contains(synonym)
    return hit


def catalog_service(text: Column, catalog=lx.SERVICE_CATALOG) -> Column:
    """First catalog service named by, or with a synonym inside, the text."""
    cases = [F.when(_catalog_hit(text, d, s), F.lit(i)) for i, d, s in catalog]
    return F.coalesce(*cases, F.lit(lx.UNKNOWN_SERVICE))


def catalog_detail(text: Column, catalog=lx.SERVICE_CATALOG) -> Column:
    service = catalog_service(text, catalog)
    known = service != lx.UNKNOWN_SERVICE
    names = [(i, d) for i, d, _ in catalog]
    return F.struct(
        F.when(known, F.lit("soporte_tecnico")).otherwise("desconocido").alias("category"),
        F.when(known, service).otherwise("desconocido").alias("subcategory"),
        F.when(known, lookup(service, names)).otherwise(text).alias("name"),
        F.when(known, F.lit(0.95)).otherwise(0.0).alias("confidence"),
    )


def same_service(left: Column, right: Column, catalog=lx.SERVICE_CATALOG) -> Column:
    a, b = fold_plain(left), fold_plain(right)
    service_a, service_b = catalog_service(a, catalog), catalog_service(b, catalog)
    return (a == b) | ((service_a != lx.UNKNOWN_SERVICE) & (service_a == service_b))
