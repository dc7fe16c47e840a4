"""Price questions as a table: one row per question in, typed columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions import lexicon as lx
from valora.functions import question_lexicon as q
from valora.functions.price import money_amount, scalar_amount
from valora.functions.rules import all_labels, first_label, joined, lookup, matches, once
from valora.functions.text import fold

PRICE_TYPE = (
    "struct<type:string,value:double,min:double,max:double,currency:string,"
    "raw_expression:string,is_approximate:boolean>"
)


def _raw(pattern: str) -> str:
    """Patterns on unfolded text need Unicode word characters."""
    return f"(?U){pattern}"


def _mention(kind, value=None, low=None, high=None, currency="UNKNOWN", raw=None, approx=None):
    def column(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        column(kind).cast("string").alias("type"),
        column(value).cast("double").alias("value"),
        column(low).cast("double").alias("min"),
        column(high).cast("double").alias("max"),
        column(currency).cast("string").alias("currency"),
        column(raw).cast("string").alias("raw_expression"),
        (F.lit(False) if approx is None else approx).alias("is_approximate"),
    )


def _multiplier(unit: Column) -> Column:
    return (
        F.when(unit.startswith("palo"), 1_000_000)
        .when(unit.isin("k", "mil", "luca", "lucas"), 1000)
        .otherwise(1)
    )


def _captured(text: Column, pattern: str, form) -> Column:
    """``form`` of the first match; NULL where there is none."""
    return once(
        F.regexp_extract(text, _raw(pattern), 0), lambda raw: F.when(raw != "", form(raw))
    )


def price_mention(text: Column) -> Column:
    """First price expression by form: range, magnitude, million, dollars, pesos, bare number.

    Every form is matched once per text, and only where no earlier form has matched.
    """
    return once(F.lower(text), _first_mention)


def _first_mention(x: Column) -> Column:
    cadence = first_label(x, [(c, [_raw(p) for p in ps]) for c, ps in lx.MENTION_CADENCE], "EXACT")

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(x, _raw(pattern), group)

    def in_range(raw: Column) -> Column:
        unit = part(q.AMOUNT_RANGE, 3)
        return _mention(
            "RANGE",
            None,
            scalar_amount(part(q.AMOUNT_RANGE, 1)) * _multiplier(unit),
            scalar_amount(part(q.AMOUNT_RANGE, 2)) * _multiplier(unit),
            F.when(unit.isin("usd", "dolares", "dólares"), "USD").otherwise("ARS"),
            raw,
        )

    def in_words(raw: Column) -> Column:
        return _mention(
            cadence,
            scalar_amount(part(q.AMOUNT_MAGNITUDE, 2)) * _multiplier(part(q.AMOUNT_MAGNITUDE, 3)),
            currency="ARS",
            raw=raw,
            approx=part(q.AMOUNT_MAGNITUDE, 1) != "",
        )

    def dollars(raw: Column) -> Column:
        return _mention(cadence, money_amount(part(q.AMOUNT_USD, 1)), currency="USD", raw=raw)

    def pesos(raw: Column) -> Column:
        return _mention("EXACT", money_amount(part(q.AMOUNT_PESO, 1)), currency="ARS", raw=raw)

    # Only the first bare number is considered, with the text on both sides of it.
    # The word before and the word after decide what it counts, so the match ends with them.
    # It begins where a word begins: tried inside words, the same match would be sought again.
    around = rf"(?<!\S)(\S*?\s*){q.AMOUNT_NAKED}(\s*\S*)"

    def bare(match: Column) -> Column:
        naked = F.regexp_extract(match, _raw(around), 2)
        after = fold(F.regexp_extract(match, _raw(around), 3), form="NFD")
        before = fold(F.regexp_extract(match, _raw(around), 1), form="NFD")
        is_context = once(
            after, lambda t: t.rlike(q.TIME_UNIT_AFTER) | t.rlike(q.QUANTITY_AFTER)
        ) | before.rlike(q.MODEL_BEFORE)
        return F.when(
            ~is_context, once(naked, lambda n: _mention("EXACT", money_amount(n), raw=n))
        )

    forms = [
        _captured(x, pattern, form)
        for pattern, form in (
            (q.AMOUNT_RANGE, in_range),
            (q.AMOUNT_MAGNITUDE, in_words),
            (q.AMOUNT_MILLION, lambda _: _mention("EXACT", 1_000_000, currency="ARS", raw="un palo")),
            (q.AMOUNT_USD, dollars),
            (q.AMOUNT_PESO, pesos),
            (around, bare),
        )
    ]
    return F.coalesce(*forms, _mention("UNKNOWN"))


def several_amounts(text: Column) -> Column:
    """More than one monetary mention. A range is one; earlier forms hide later ones.

    Each counted form is replaced by a word character, so an overlapping later form cannot
    match while text around it keeps its boundaries.
    """
    x = F.regexp_replace(F.lower(text), _raw(q.AMOUNT_RANGE_ANY), " RANGE_PRICE ")
    total = F.lit(0)
    for pattern in (
        q.AMOUNT_MAGNITUDE_BARE,
        q.AMOUNT_USD_BARE,
        q.AMOUNT_PESO_BARE,
        q.AMOUNT_MILLION,
    ):
        total = total + F.regexp_count(x, F.lit(_raw(pattern)))
        x = F.regexp_replace(x, _raw(pattern), "x")
    return total > 1


def question_services(folded: Column) -> Column:
    """Named services in rule order; a home visit is only delivery next to another service."""

    def without_delivery(found: Column) -> Column:
        return F.when(F.size(found) > 1, F.array_remove(found, q.HOME_VISIT)).otherwise(found)

    return once(all_labels(folded, q.SERVICES), without_delivery)


def _first_listed(folded: Column, table: list[tuple]) -> Column:
    """Row of the table entry mentioned in the text that comes first in table order."""
    names = [row[0] for row in table]
    mentioned = F.regexp_extract_all(folded, F.lit(rf"\b({'|'.join(names)})\b"), F.lit(1))
    places = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i + 1)])
    first = F.array_min(F.transform(mentioned, lambda name: F.try_element_at(places, name)))
    rows = F.array(
        *[
            F.struct(
                F.lit(raw).alias("raw_location"),
                F.lit(province).alias("province"),
                F.lit(city).cast("string").alias("city"),
            )
            for raw, province, city in table
        ]
    )
    return F.when(first.isNotNull(), F.try_element_at(rows, first))


def question_place(folded: Column) -> Column:
    """struct(raw_location, province, city): cities first, then provinces, in table order."""
    nowhere = F.struct(
        *[F.lit(None).cast("string").alias(f) for f in ("raw_location", "province", "city")]
    )
    provinces = [(raw, province, None) for raw, province in q.PROVINCES]
    return F.coalesce(
        _first_listed(folded, list(q.CITIES)), _first_listed(folded, provinces), nowhere
    )


def _fields(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in pairs]))


def parse_questions(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the full parse of ``text``. Three projections, no shuffle, no UDF."""
    raw = F.col(text)
    folded = F.col("folded")
    price = F.col("price")
    has_price = price["value"].isNotNull() | price["min"].isNotNull()

    stage1 = df.withColumn("folded", fold(raw, form="NFD"))
    stage2 = stage1.withColumns(
        {
            "price": price_mention(raw),
            "geography": question_place(folded),
            "canonical_services": question_services(folded),
            "device_type": first_label(folded, q.DEVICES),
            "parts_scope": first_label(folded, q.PARTS, "UNKNOWN"),
            "condition": first_label(folded, q.CONDITION, "UNKNOWN"),
            "_buy": matches(folded, q.BUY),
            "_sell": matches(folded, q.SELL),
            "_judge": matches(folded, q.JUDGE),
            "_several": several_amounts(raw),
            "_install": folded.rlike(q.INSTALLING_WINDOWS)
            & folded.rlike(q.STUCK)
            & (folded.rlike(q.PROGRESS) | folded.rlike(q.ASKS_CAUSE)),
        }
    )
    services = F.col("canonical_services")
    n_services = F.size(services)
    goods = (n_services == 0) & matches(folded, q.GOODS)
    remote = (n_services > 0) & (
        F.size(F.array_except(services, F.array(*[F.lit(s) for s in q.REMOTE_SERVICES]))) == 0
    )
    side = (
        F.when(F.col("_sell"), F.lit("SELL"))
        .when(F.col("_buy") | (has_price & folded.rlike(q.ASKED_OF_ME)), "BUY")
        .otherwise("UNKNOWN")
    )
    stage3 = stage2.withColumns(
        {
            "_need": F.col("_install")
            & ~(
                F.col("_buy")
                | F.col("_sell")
                | F.col("_judge")
                | folded.rlike(q.ECONOMIC_WORDS)
            ),
            "intent_side": side,
            "economic_object_kind": F.when(goods, F.lit("HARDWARE"))
            .when(n_services > 1, "BUNDLE")
            .when(n_services == 1, "SERVICE")
            .otherwise("UNKNOWN"),
            "market_scope": F.when(goods, F.lit("GOODS"))
            .when(remote, "REMOTE_NATIONAL")
            .when(n_services > 0, "LOCAL")
            .otherwise("UNKNOWN"),
        }
    )
    market = F.col("market_scope")
    kind = F.col("economic_object_kind")
    known_side = F.col("intent_side") != "UNKNOWN"
    action = (
        F.when(F.col("_judge") & has_price, F.lit("EVALUATE_PRICE"))
        .when((F.col("intent_side") == "SELL") & ~has_price, "SUGGEST_PRICE")
        .when(folded.rlike(q.COMPARE), "COMPARE")
        .when(matches(folded, q.MARKET_REFERENCE), "MARKET_REFERENCE")
        .when(has_price & known_side, "EVALUATE_PRICE")
        .otherwise("UNKNOWN")
    )
    modality = (
        F.when(market == "REMOTE_NATIONAL", F.lit("REMOTE"))
        .when(market == "LOCAL", first_label(folded, q.MODALITY, "UNKNOWN"))
        .otherwise("UNKNOWN")
    )
    reasons = _fields(
        (F.col("_several"), "MULTIPLE_MONETARY_MENTIONS"),
        ((market == "LOCAL") & F.col("geography.province").isNull(), "MISSING_PROVINCE"),
        (kind == "UNKNOWN", "UNKNOWN_ECONOMIC_OBJECT"),
        ((price["currency"] == "UNKNOWN") & has_price, "UNKNOWN_CURRENCY"),
        (kind == "BUNDLE", "BUNDLE_REQUIRES_COMPARABLE_SCOPE"),
        (
            folded.rlike(q.PART_SWAP) & (F.col("parts_scope") == "UNKNOWN"),
            "UNKNOWN_PARTS_SCOPE",
        ),
    )
    stage4 = stage3.withColumns(
        {"intent_action": action, "modality": modality, "_reasons": reasons}
    )
    return _finished(stage4, raw, has_price)


def _finished(df: DataFrame, raw: Column, has_price: Column) -> DataFrame:
    """Metadata of the parse, and the technical-need reading where it applies."""
    need = F.col("_need")
    market = F.col("market_scope")
    blocking = F.array_intersect("_reasons", F.array(*[F.lit(r) for r in q.BLOCKING]))
    blocked = F.size(blocking) > 0
    doubt = (
        F.when(blocked, 0.25).otherwise(0.0)
        + F.when(F.col("intent_action") == "UNKNOWN", 0.15).otherwise(0.0)
        + F.when(F.col("economic_object_kind") == "UNKNOWN", 0.20).otherwise(0.0)
    )
    hinted = F.lower(raw).rlike(_raw(q.LOCAL_CURRENCY_HINT))
    place = F.col("geography")
    no_fields = F.array().cast("array<string>")

    def unless_need(value: Column, otherwise: Column) -> Column:
        return F.when(need, otherwise).otherwise(value)

    unknown = F.lit("UNKNOWN")
    technical = F.struct(
        F.lit("PC").alias("domain"),
        F.lit(q.NEED_PROBLEM).alias("technical_problem"),
        F.array(*[F.lit(r) for r in q.NEED_ROUTES]).alias("candidate_routes"),
        F.lit("NONE_YET").alias("product_purchase_recommendation"),
    )
    out = df.withColumns(
        {
            "query_kind": F.when(need, F.lit("TECHNICAL_NEED")).otherwise("ECONOMIC_QUERY"),
            "is_bundle": unless_need(
                F.col("economic_object_kind") == "BUNDLE", F.lit(False)
            ),
            "clarification_required": need | blocked,
            "clarification_reason": unless_need(
                F.nullif(joined(F.col("_reasons")), F.lit("")), F.lit(q.NEED_REASON)
            ),
            "clarification_question": unless_need(
                lookup(F.try_element_at(blocking, F.lit(1)), q.QUESTIONS), F.lit(q.NEED_QUESTION)
            ),
            "confidence": unless_need(
                F.greatest(F.lit(0.0), F.round(F.lit(0.95) - doubt, 2)), F.lit(0.8)
            ),
            "explicit_fields": unless_need(
                _fields(
                    (has_price, "price"),
                    (place["raw_location"].isNotNull(), "geography.raw_location"),
                    (F.col("device_type").isNotNull(), "device_type"),
                    ((market == "LOCAL") & (F.col("modality") != "UNKNOWN"), "modality"),
                ),
                F.array(F.lit("technical_need.raw_problem")),
            ),
            "inferred_fields": unless_need(
                _fields(
                    ((F.col("price.currency") == "ARS") & hinted, "price.currency"),
                    (place["city"].isNotNull(), "geography.province"),
                ),
                no_fields,
            ),
            "derived_fields": unless_need(
                _fields(
                    (F.size("canonical_services") > 0, "canonical_services"),
                    (market.isin("LOCAL", "REMOTE_NATIONAL"), "market_scope"),
                    (market == "REMOTE_NATIONAL", "modality"),
                ),
                F.array(F.lit("technical_need.candidate_routes")),
            ),
            "technical_need": F.when(need, technical),
        }
    )
    return out.withColumns(
        {
            **{
                name: unless_need(F.col(name), unknown)
                for name in (
                    "intent_action",
                    "intent_side",
                    "economic_object_kind",
                    "market_scope",
                    "modality",
                    "condition",
                    "parts_scope",
                )
            },
            "price": unless_need(F.col("price"), _mention("UNKNOWN")),
            "canonical_services": unless_need(F.col("canonical_services"), no_fields),
            "device_type": unless_need(F.col("device_type"), F.lit("PC")),
        }
    ).drop("_buy", "_sell", "_judge", "_several", "_install", "_need", "_reasons")
