"""Price literals, amounts and cadence as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions import lexicon as lx
from valora.functions.rules import capture, first_label, matches, once
from valora.functions.text import collapse_spaces


def _edge_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _has(text: Column, piece: str) -> Column:
    return F.contains(text, F.lit(piece))


# --- guarded list-price literals -----------------------------------------------------------


#: Digits that a whole amount can have; longer ones are rejected with a reason.
MOST_DIGITS = 18


def literal_reject_reason(raw: Column) -> Column:
    """Why a literal is not one exact price; NULL when it is."""
    return once(F.upper(_edge_trim(F.coalesce(raw.cast("string"), F.lit("")))), _literal_reason)


def _literal_reason(text: Column) -> Column:
    def by_digits(digits: Column) -> Column:
        all_zero = digits.rlike("^0*$")
        return (
            F.when(text.rlike(lx.SHORT_LITERAL) & all_zero, "PRECIO_CERO_LITERAL")
            .when(text.rlike(lx.SHORT_LITERAL), "PRECIO_AMBIGUO")
            .when(~text.rlike(lx.EXACT_LITERAL), "PRECIO_NO_REPRESENTABLE")
            .when(all_zero, "PRECIO_CERO_LITERAL")
            .when(F.length(F.ltrim(digits, F.lit("0"))) > MOST_DIGITS, "PRECIO_FUERA_DE_RANGO")
        )

    return F.when(text == "", "PRECIO_AUSENTE").otherwise(once(_digits(text), by_digits))


def literal_price(raw: Column, reason: Column | None = None) -> Column:
    """struct(value, currency, period) of an exact (or zero) literal.

    All digits are glued, so ``$ 42.120,00`` reads 4212000, and ``U$S`` counts as ARS.
    ``reason`` is the reject reason where it is already a column.
    """
    reason = literal_reject_reason(raw) if reason is None else reason
    text = F.upper(raw.cast("string"))
    value = F.struct(
        F.coalesce(_digits(text).try_cast("bigint"), F.lit(0).cast("bigint")).alias("value"),
        F.when(_has(text, "USD") | _has(text, "US$"), "USD").otherwise("ARS").alias("currency"),
        F.when(_has(text, "MES"), F.lit("mensual")).alias("period"),
    )
    return F.when(reason.isNull() | (reason == "PRECIO_CERO_LITERAL"), value)


# --- amounts inside sentences ----------------------------------------------------------------


def money_amount(text: Column) -> Column:
    """A full amount with either decimal convention, as double (NULL if unreadable)."""
    s = F.replace(F.trim(F.lower(text)), F.lit(" "), F.lit(""))
    no_dots = F.replace(s, F.lit("."), F.lit(""))
    no_commas = F.replace(s, F.lit(","), F.lit(""))
    comma_is_last = s.rlike(r",[^.]*$")
    canonical = (
        F.when(
            _has(s, ".") & _has(s, ","),
            F.when(comma_is_last, F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas),
        )
        .when(s.rlike(r"^\d{1,3}(?:\.\d{3})+$"), no_dots)
        .when(s.rlike(r"^\d{1,3}(?:,\d{3})+$"), no_commas)
        .otherwise(F.replace(s, F.lit(","), F.lit(".")))
    )
    return canonical.try_cast("double")


def scalar_amount(text: Column) -> Column:
    """The number in front of a magnitude word: one decimal mark, later ones dropped."""
    s = F.replace(F.trim(F.lower(text)), F.lit(" "), F.lit(""))
    s = F.replace(s, F.lit(","), F.lit("."))
    head = F.substring_index(s, ".", 1)
    tail = F.replace(F.regexp_replace(s, r"^[^.]*\.", ""), F.lit("."), F.lit(""))
    several = s.rlike(r"\..*\.")
    return F.when(several, F.concat(head, F.lit("."), tail)).otherwise(s).try_cast("double")


# --- web prices ----------------------------------------------------------------------------

_WEB_PRICE = rf"(?i)(?:\$|ARS)\s*(?:{lx.WEB_AMOUNT})|(?:{lx.WEB_AMOUNT})\s*ARS"


def web_amount(number: Column) -> Column:
    """Whole-peso reading of a matched web number; real decimals and zero are NULL."""
    no_dots = F.replace(number, F.lit("."), F.lit(""))
    whole = (
        F.when(number.rlike(r"^\d+(?:\.\d+)+,0*$"), F.substring_index(no_dots, ",", 1))
        .when(number.rlike(r"^\d+(?:,\d{3})+$"), F.replace(number, F.lit(","), F.lit("")))
        .when(number.rlike(r"^\d+,00$"), F.substring_index(number, ",", 1))
        .when(number.rlike(r"^\d+(?:\.\d{3})+$"), no_dots)
        .when(number.rlike(r"^\d+$"), number)
    ).try_cast("bigint")
    return F.when(whole > 0, whole)


def web_price_text(text: Column) -> Column:
    """First peso price in a text as written, NULL if there is none."""
    return _edge_trim(capture(_edge_trim(text), _WEB_PRICE))


def web_number(price: Column) -> Column:
    return F.regexp_extract(price, lx.WEB_AMOUNT, 0)


def with_web_price(df: DataFrame, text: str, name: str = "web_price") -> DataFrame:
    """Add struct(raw, value, currency) of the first peso price in a text, else NULL.

    Staged as columns so that the match and the number are computed once per row.
    """
    match, number, value = F.col("_match"), F.col("_number"), F.col("_value")
    price = F.struct(
        _edge_trim(match).alias("raw"), value.alias("value"), F.lit("ARS").alias("currency")
    )
    digits = F.regexp_extract(match, lx.WEB_AMOUNT, 0)
    return (
        df.withColumn("_match", capture(_edge_trim(F.col(text)), _WEB_PRICE))
        .withColumn("_number", digits)
        .withColumn("_value", web_amount(number))
        .withColumn(name, F.when(value.isNotNull(), price))
        .drop("_match", "_number", "_value")
    )


def possible_number(text: Column) -> Column:
    """Loose numeric reading of any monetary text, for diagnosis only."""
    n = F.replace(capture(text.cast("string"), r"\d[\d.,\s]*"), F.lit(" "), F.lit(""))
    no_dots = F.replace(n, F.lit("."), F.lit(""))
    no_commas = F.replace(n, F.lit(","), F.lit(""))
    dotted = F.replace(n, F.lit(","), F.lit("."))
    canonical = (
        F.when(
            _has(n, ".") & _has(n, ","),
            F.when(n.rlike(r",[^.]*$"), F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(
                no_commas
            ),
        )
        .when(_has(n, ","), F.when(n.rlike(r",[^,]{0,2}$"), dotted).otherwise(no_commas))
        .when(n.rlike(r"\..*\.|\.[^.]{3}$"), no_dots)
        .otherwise(n)
    )
    return canonical.try_cast("double")


# --- meaning of a price literal ----------------------------------------------------------------

_PESOS = rf"\$\s*{lx.THOUSANDS}"


def _plain_pesos(text: Column) -> Column:
    return F.when(text.rlike(rf"^(?:{_PESOS}|\$\s*\d{{4,}})$"), _digits(text).try_cast("bigint"))


def _meaning(kind, value=None, low=None, high=None, is_floor=False, evidence=None) -> Column:
    def amount(x):
        return (F.lit(None) if x is None else x).cast("bigint")

    return F.struct(
        F.lit(kind).alias("kind"),
        amount(value).alias("value"),
        amount(low).alias("low"),
        amount(high).alias("high"),
        F.lit(is_floor).alias("is_floor"),
        (F.lit(evidence) if not isinstance(evidence, Column) else evidence)
        .cast("string")
        .alias("evidence"),
    )


def _catalog_meaning(raw: Column) -> Column:
    text = collapse_spaces(F.coalesce(raw, F.lit("")))
    why = dict(lx.CATALOG_PRICE_EVIDENCE)
    floor_price = rf"(?i)^Desde\s+({_PESOS})(?:\s+.*)?$"
    price_range = rf"^({_PESOS})\s*[–-]\s*({_PESOS})$"
    low = _plain_pesos(capture(text, floor_price, 1))
    special = "texto_especial"
    return (
        F.when(text == "", _meaning("sin_precio", evidence=why["absent"]))
        .when(
            _plain_pesos(text).isNotNull(),
            _meaning("numerico_inequivoco", _plain_pesos(text), evidence=why["exact"]),
        )
        .when(text.rlike(floor_price), _meaning(special, low, low, None, True, why["from"]))
        .when(
            text.rlike(price_range),
            _meaning(
                special,
                None,
                _plain_pesos(capture(text, price_range, 1)),
                _plain_pesos(capture(text, price_range, 2)),
                False,
                why["range"],
            ),
        )
        .when(text.rlike(f"(?i){lx.CONSULT}"), _meaning(special, evidence=why["consult"]))
        .when(
            text.rlike(r"(?i)^\$\s*\d{1,3}(?:\s*[–-]\s*\d{1,3}k)?$"),
            _meaning("numerico_potencialmente_ambiguo", evidence=why["ambiguous"]),
        )
        .otherwise(_meaning("invalido", evidence=why["other"]))
    )


def _product_meaning(raw: Column) -> Column:
    return once(
        collapse_spaces(F.coalesce(raw, F.lit(""))),
        lambda text: once(literal_reject_reason(text), lambda reason: _product_kind(text, reason)),
    )


def _product_kind(text: Column, reason: Column) -> Column:
    why = dict(lx.PRODUCT_PRICE_EVIDENCE)
    steps = (
        ("ausencia", text == ""),
        ("desde", text.rlike(r"(?i)\bdesde\b")),
        ("rango", text.rlike(r"\$\s*\d[\d.]*\s*[-–]\s*\$?\s*\d")),
        ("consultar", text.rlike(f"(?i){lx.CONSULT}")),
        ("cero", reason == "PRECIO_CERO_LITERAL"),
        ("ambiguo", reason == "PRECIO_AMBIGUO"),
    )
    out = [F.when(test, _meaning(kind, evidence=why[kind])) for kind, test in steps]
    exact = _meaning("exacto", literal_price(text, reason)["value"], evidence=why["exacto"])
    other = _meaning(
        "otro",
        evidence=F.concat(F.lit("El guard central rechazo el literal: "), reason, F.lit(".")),
    )
    return F.coalesce(*out, F.when(reason.isNull(), exact), other)


def _list_meaning(raw: Column) -> Column:
    return once(
        _edge_trim(F.coalesce(raw, F.lit(""))),
        lambda text: once(
            literal_reject_reason(raw), lambda reason: _list_kind(raw, text, reason)
        ),
    )


def _list_kind(raw: Column, text: Column, reason: Column) -> Column:
    steps = (
        ("sin_precio", reason == "PRECIO_AUSENTE"),
        ("desde", text.rlike(r"(?i)\bdesde\b")),
        ("rango", text.rlike(r"\d\s*[–-]\s*\$?\s*\d")),
        ("consultar", text.rlike(f"(?i){lx.CONSULT}")),
        ("ambiguo", reason == "PRECIO_AMBIGUO"),
    )
    exact = F.when(reason.isNull(), _meaning("exacto", literal_price(raw, reason)["value"]))
    out = [F.when(test, _meaning(kind, evidence=reason)) for kind, test in steps]
    return F.coalesce(exact, *out, _meaning("otro", evidence=reason))


def price_meaning(raw: Column, mode: str = "product") -> Column:
    """Exact, floor, range, consult, ambiguous, zero, absent or other, with the evidence.

    ``mode`` picks the reading: ``catalog`` (also returns bounds), ``product`` or ``list``.
    """
    readers = {"catalog": _catalog_meaning, "product": _product_meaning, "list": _list_meaning}
    return readers[mode](raw)


# --- cadence, context, keys, rendering ---------------------------------------------------------


def offer_cadence(folded: Column, rules=lx.OFFER_CADENCE) -> Column:
    """Explicit cadence in a folded text (see ``fold``); conservative, else UNKNOWN."""
    return first_label(folded, rules, "UNKNOWN")


def commercial_context(folded: Column, patterns=lx.URGENCY) -> Column:
    return F.when(matches(folded, patterns), F.lit("URGENCY")).otherwise("STANDARD")


def question_cadence(folded: Column, mention_type: Column) -> Column:
    """Cadence of the parsed price first, else an explicit cadence in the folded question."""
    parsed = F.when(mention_type.isin(*[c for c, _ in lx.MENTION_CADENCE]), mention_type)
    return F.coalesce(parsed, first_label(folded, lx.QUESTION_CADENCE, "UNKNOWN"))


def number_key(value: Column) -> Column:
    """Canonical text of a number for keys: ``35000.0`` and ``35000`` agree."""
    text = value.cast("string")
    number = text.try_cast("double")
    exact = F.regexp_replace(number.cast("decimal(38,12)").cast("string"), r"0+$", "")
    return (
        F.when(text.isNull(), "")
        .when(number.isNull(), text)
        .when(number == F.floor(number), number.try_cast("bigint").cast("string"))
        .otherwise(exact)
    )


def observation_slug(ordinal: Column, text: Column, price: Column) -> Column:
    slug = F.regexp_replace(F.lower(text), r"(?U)\s+", "-")
    slug = F.regexp_replace(slug, r"^-+|-+$", "")
    slug = F.regexp_replace(slug, r"[^a-z0-9áéíóúüñ\-]+", "")
    return F.concat_ws(
        ":", F.lit("generic"), ordinal.cast("string"), slug, price.cast("string")
    )


def pesos(value: Column) -> Column:
    """``$1.234`` rendering; a missing amount is a dash."""
    rounded = F.bround(value.cast("double"), 0)
    return F.coalesce(
        F.concat(F.lit("$"), F.translate(F.format_number(rounded, 0), ",", ".")), F.lit("-")
    )

