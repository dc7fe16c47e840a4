"""Web pages as a table: price observations, page signals, structured data, captures compared."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.functions.price import (
    observation_slug,
    possible_number,
    web_amount,
    web_number,
    web_price_text,
)
from valora.functions.rules import joined
from valora.functions.text import collapse_spaces
from valora.session import ship_package
from valora.operators.page_tree import NODES, node_text, read_nodes

# --- price observations ------------------------------------------------------------------------

PRICE_TAGS = ("td", "span", "strong", "b", "p", "div", "li")
#: What a page must hold to show a peso price at all; other pages are not parsed.
_MAY_HAVE_PRICE = r"(?i)\$|ARS|&#|&dollar"


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _glued(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def priced_elements(
    pages: DataFrame, max_words: int | None = 40, max_chars: int | None = 320
) -> DataFrame:
    """Innermost elements with a price: what is priced, or why it is not an observation.

    The object is the text around the price: of its table row, else of the siblings, else of
    up to three ancestors; the first one that is not empty and within ``max_words`` and
    ``max_chars`` (None: no limit). ``reject_reason`` is SPLIT_DECIMAL where the next element
    goes on with the decimals, CONTEXT_TOO_LONG where only longer texts are around, and
    NO_CONTEXT where there is none.
    """
    ship_package(pages.sparkSession)
    trees = (
        pages.select("page_id", "html")
        .filter(F.col("html").rlike(_MAY_HAVE_PRICE))
        .mapInPandas(read_nodes, NODES)
    )
    strings, nodes = F.col("strings"), F.col("nodes")

    def found(node: Column) -> Column:
        text = F.when(node["tag"].isin(*PRICE_TAGS), web_price_text(node_text(strings, node)))
        return F.struct(*[node[k].alias(k) for k in ("at", "parent", "row", "end")], text.alias("raw"))

    priced = F.filter(
        F.transform(nodes, found),
        lambda p: p["raw"].isNotNull() & web_amount(web_number(p["raw"])).isNotNull(),
    )
    inner = F.filter(
        F.col("priced"),
        lambda p: ~F.exists("priced", lambda o: (o["at"] > p["at"]) & (o["at"] <= p["end"])),
    )

    def texts(p: Column, chosen: Column, cut: bool) -> Column:
        def one(n: Column) -> Column:
            text = node_text(strings, n)
            return _spaced(F.replace(text, p["raw"], F.lit(" ")) if cut else text)

        return F.array_join(F.filter(F.transform(chosen, one), lambda t: t != ""), " ")

    def above(p: Column, steps: int) -> Column:
        at = p["parent"]
        for _ in range(steps):
            at = F.when(at >= 0, F.get(nodes, at)["parent"])
        return F.filter(nodes, lambda n: n["at"] == at)

    def judged(p: Column) -> Column:
        cells = F.filter(nodes, lambda n: (n["parent"] == p["row"]) & n["tag"].isin("td", "th"))
        beside = F.filter(nodes, lambda n: (n["parent"] == p["parent"]) & (n["at"] != p["at"]))
        around = F.array(
            F.when(p["row"] >= 0, texts(p, cells, True)).otherwise(""),
            texts(p, beside, False),
            *[texts(p, above(p, k), True) for k in range(3)],
        )
        parent = F.get(nodes, p["parent"])
        line = _glued(node_text(strings, parent, ""))
        price = _glued(p["raw"])
        rest = F.when(F.contains(line, price), F.substr(line, F.instr(line, price) + F.length(price)))
        return F.struct(
            p["at"].alias("position"),
            p["raw"].alias("price_raw"),
            F.filter(around, lambda t: t != "").alias("around"),
            F.coalesce(rest.rlike(r"^[.,]\d{2,3}(?!\d)"), F.lit(False)).alias("split"),
        )

    rows = (
        trees.withColumn("priced", priced)
        .withColumn("inner", inner)
        .select("page_id", F.explode(F.transform("inner", judged)).alias("e"))
        .select("page_id", "e.*")
    )

    def short(text: Column) -> Column:
        fits = F.lit(True)
        if max_words is not None:
            fits = fits & (F.size(F.split(text, " ")) <= max_words)
        if max_chars is not None:
            fits = fits & (F.length(text) <= max_chars)
        return fits

    context = F.get(F.filter("around", short), F.lit(0))
    return rows.withColumn("context", context).select(
        "page_id",
        F.col("position").cast("bigint").alias("position"),
        "price_raw",
        web_number(F.col("price_raw")).alias("number"),
        "context",
        F.when(F.col("split"), "SPLIT_DECIMAL")
        .when(F.size("around") == 0, "NO_CONTEXT")
        .when(F.col("context").isNull(), "CONTEXT_TOO_LONG")
        .alias("reject_reason"),
    )


def page_prices(
    pages: DataFrame, max_words: int | None = 40, max_chars: int | None = 320
) -> DataFrame:
    """Priced objects of each page (page_id, html), first of equal (object, price) kept."""
    found = (
        priced_elements(pages, max_words, max_chars)
        .filter(F.col("reject_reason").isNull())
        .withColumn("price_value", web_amount(F.col("number")))
    )
    first = found.groupBy("page_id", "context", "price_value").agg(
        F.min(F.struct("position", "price_raw")).alias("_f")
    )
    in_page = Window.partitionBy("page_id").orderBy("_f.position")
    return first.select(
        "page_id",
        (F.row_number().over(in_page) - 1).alias("ordinal"),
        F.col("context").alias("economic_object_raw"),
        F.col("_f.price_raw").alias("price_raw"),
        "price_value",
        F.lit("ARS").alias("currency_raw"),
        F.lit("INDETERMINATE").alias("comparable_status"),
    ).withColumn(
        "source_record_id",
        observation_slug(F.col("ordinal"), F.col("economic_object_raw"), F.col("price_value")),
    )


# --- structured data ------------------------------------------------------------------------------



def attribute(name: str, value: str | None = None, whole: bool = False) -> str:
    """Pattern of an attribute as browsers accept it: in double, single or no quotes.

    ``value``: pattern that the value holds, or is if ``whole``.
    """
    if value is None:
        return rf"\b{name}\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    kinds = (('"', '[^"]*'), ("'", "[^']*"), ("", "[^\\s\"'>]*"))
    parts = [f"{q}(?:{value}){q}" if whole else f"{q}{c}(?:{value}){c}{q}" for q, c in kinds]
    if whole:
        parts[2] += r"(?=[\s>/])"
    return rf"\b{name}\s*=\s*(?:{'|'.join(parts)})"


def attribute_values(text: Column, before: str, name: str) -> Column:
    """All values of an attribute in tags that match ``before`` up to it."""
    pattern = before + rf"\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.transform(found, lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))


_LD_TYPE = attribute("type", r"application/ld\+json", whole=True)
_LD_BODY = rf"(?is)<script\b(?=[^>]*{_LD_TYPE})[^>]*>(.*?)</script>"
_LD_SCHEMA = (
    "page_id bigint, block int, node int, types string, name_raw string, price_raw string, "
    "currency string, detail_url string, external_id string"
)
# Fixed values of the vocabulary: kinds of nodes, and where each fact stands, first one first.
_LD_TYPES = ("Product", "Service", "Offer", "ListItem")
_LD_FACTS = {
    "name_raw": ("name", "title", "item.name"),
    "price_raw": ("price", "offers.price", "offers.lowPrice"),
    "currency": ("priceCurrency", "offers.priceCurrency"),
    "detail_url": ("url", "offers.url"),
    "external_id": ("sku", "productID"),
}


def json_ld_blocks(pages: DataFrame) -> DataFrame:
    """One row per readable JSON-LD script of a page."""
    bodies = F.regexp_extract_all("html", F.lit(_LD_BODY), F.lit(1))
    return (
        pages.filter(F.col("html").contains("ld+json"))
        .select("page_id", F.posexplode(bodies).alias("block", "body"))
        .filter(F.try_parse_json("body").isNotNull())
    )


def _nodes(body: str) -> Iterator[dict]:
    """Every object of a JSON text, outermost first."""
    waiting = [json.loads(body)]
    while waiting:
        value = waiting.pop(0)
        if isinstance(value, dict):
            yield value
        inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
        waiting[:0] = [v for v in inner if isinstance(v, (dict, list))]


def _fact(node: dict, path: str) -> str | None:
    """Text of a value one or two names deep; other JSON stays JSON, empty values are none."""
    for name in path.split("."):
        node = node.get(name) if isinstance(node, dict) else None
    if not node:
        return None
    return node if isinstance(node, str) else json.dumps(node, ensure_ascii=False)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _LD_SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for page, block, body in zip(batch["page_id"], batch["block"], batch["body"]):
            for index, node in enumerate(_nodes(body)):
                given = node.get("@type")
                kinds = {k for k in (given if isinstance(given, list) else [given]) if isinstance(k, str)}
                if kinds.isdisjoint(_LD_TYPES):
                    continue
                facts = [
                    next(filter(None, (_fact(node, path) for path in paths)), None)
                    for paths in _LD_FACTS.values()
                ]
                rows.append((page, block, index, "|".join(sorted(kinds)), *facts))
        yield pd.DataFrame(rows, columns=columns)


def json_ld_candidates(pages: DataFrame) -> DataFrame:
    """Products, services, offers and list items at any depth of the JSON-LD of a page."""
    ship_package(pages.sparkSession)
    return json_ld_blocks(pages).mapInPandas(_walk, _LD_SCHEMA).withColumn(
        "possible_price", possible_number(F.col("price_raw"))
    )


def offer_catalogs(pages: DataFrame) -> DataFrame:
    """Units in the offer catalog of each page's first LocalBusiness node, one row per unit."""
    graph = F.from_json("body", "`@graph` ARRAY<STRING>")["@graph"]
    nodes = F.when(F.size(graph) > 0, graph).otherwise(F.array("body"))
    business = (
        json_ld_blocks(pages)
        .select("page_id", "block", F.posexplode(nodes).alias("node", "_n"))
        .withColumn(
            "_b", F.from_json("_n", "`@type` STRING, name STRING, hasOfferCatalog STRING")
        )
        .filter(F.col("_b.@type").rlike('(?:^|")LocalBusiness(?:$|")'))
    )
    first = business.groupBy("page_id").agg(
        F.min(F.struct("block", "node", F.col("_b.name").alias("name"), F.col("_b.hasOfferCatalog").alias("catalog"))).alias("_f")
    )
    listed = F.from_json("_f.catalog", "name STRING, itemListElement ARRAY<STRING>")
    unit = F.from_json(
        "_u", "`@type` STRING, price STRING, priceCurrency STRING, url STRING, itemOffered STRING"
    )
    item = F.from_json("_unit.itemOffered", "`@type` STRING, name STRING, description STRING, url STRING")
    return (
        first.withColumn("_c", listed)
        .select(
            "page_id",
            F.col("_f.name").alias("provider_raw"),
            F.col("_c.name").alias("catalog_raw"),
            F.posexplode("_c.itemListElement").alias("unit_index", "_u"),
        )
        .withColumn("_unit", unit)
        .withColumn("_item", item)
        .select(
            "page_id",
            "provider_raw",
            "catalog_raw",
            "unit_index",
            F.col("_unit.@type").alias("offer_type"),
            F.col("_item.@type").alias("item_type"),
            F.col("_item.name").alias("name_raw"),
            F.col("_unit.price").alias("price_raw"),
            F.col("_unit.priceCurrency").alias("currency_raw"),
            F.coalesce("_item.url", "_unit.url").alias("url_raw"),
        )
    )


def catalog_counts(units: DataFrame) -> DataFrame:
    priced = F.col("price_raw").isNotNull()
    return units.groupBy("page_id", "provider_raw").agg(
        F.count(F.lit(1)).alias("units_n"),
        F.count_if(priced).alias("prices_n"),
        F.count_if((F.col("offer_type") == "Offer") & ~priced).alias("offers_without_price_n"),
    )


# --- page signals -----------------------------------------------------------------------------

# Markers of prices, blocking, client-side apps and places.
TEXT_PRICE = r"(?i)(?<!\w)(?:AR\$|ARS|US\$|USD|U\$S|\$)\s*\d[\d.\s]*(?:,\d{1,2})?"
CHALLENGES = (
    ("captcha_component", r"(?i)captcha|recaptcha|hcaptcha"),
    ("cloudflare_challenge", r"(?i)cf-chl|cloudflare.*(?:challenge|ray id)|just a moment"),
    (
        "access_denied",
        r"(?i)access denied|acceso denegado|verify you are human|verifica que eres humano",
    ),
    (
        "traffic_verification",
        r"(?i)account-verification|negative[_ -]traffic|verificaci[oó]n de cuenta",
    ),
)
APP_MARKS = ("__next_data__", "__nuxt__", "webpack", "data-reactroot", "ng-version")
SCRIPT_MARKS = "app|main|chunk|next|nuxt|woocommerce|webpack"
DETAIL_MARKS = "servicio|repar|product|producto|item|detalle|tienda"
PLACES = (
    "Buenos Aires",
    "Córdoba",
    "Rosario",
    "Santa Fe",
    "Mendoza",
    "Tucumán",
    "Salta",
    "Paraná",
    "Neuquén",
    "Argentina",
)
_ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
)
_ITEM_TAG = (
    r"(?i)<article\b|<(?!article\b)[a-z][a-z0-9]*\b(?=[^>]*?(?:"
    + attribute("itemtype", "Product|Service")
    + "|"
    + attribute("class", "product|producto|service|servicio|item")
    + "))"
)


def visible_text(html: Column) -> Column:
    """Text of a page: scripts, styles, templates, comments and tags out, entities read."""
    text = F.regexp_replace(html, r"(?is)<(script|style|template)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return collapse_spaces(text)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _flags(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in pairs]))


def _distinct_spaced(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, collapse_spaces), lambda v: v != ""))


def shortened(values: Column, most: int | None) -> Column:
    """The first ``most`` of a list, all of it by default."""
    return values if most is None else F.slice(values, 1, most)


_LD_OBJECT = r"\{[^{}]*\}"
#: Objects in objects are read this deep with their currency, any deeper ones without.
_LD_LEVELS = 6


def _ld_prices(body: Column) -> Column:
    """Prices in JSON-LD text, with the currency of the same object in front."""
    price, rest = [], body
    for _ in range(_LD_LEVELS):
        price.append(
            F.transform(
                F.regexp_extract_all(rest, F.lit(_LD_OBJECT), F.lit(0)),
                lambda o: F.when(
                    F.regexp_extract(o, _LD_PRICE, 1) != "",
                    F.trim(
                        F.concat_ws(
                            " ",
                            F.regexp_extract(o, r'"priceCurrency"\s*:\s*"([^"]*)"', 1),
                            F.regexp_extract(o, _LD_PRICE, 1),
                        )
                    ),
                ),
            )
        )
        rest = F.regexp_replace(rest, _LD_OBJECT, " ")
    return F.array_compact(F.concat(*price, F.regexp_extract_all(rest, F.lit(_LD_PRICE), F.lit(1))))


_LD_PRICE = r'"(?:price|lowPrice)"\s*:\s*"?([0-9][^",}\s]*)'


def absolute_url(base: Column, href: Column) -> Column:
    """A link seen from its page."""
    origin = F.regexp_extract(base, r"^(\w+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(\w+://[^?#]*/)", 1)
    return (
        F.when(href.rlike(r"^\w+:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^(\w+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#") | href.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href))
        .otherwise(F.concat(F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder), href))
    )


def page_signals(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Signals of each page (page_id, url, html), a suggested way to acquire it and its difficulty.

    Lists are whole unless ``most`` shortens them; counts are always of the whole. Built from regular expressions on the page text, so it runs without leaving the JVM.
    """
    html = F.col("html")
    ld = F.array_join(_all(html, _LD_BODY, 1), "\n")
    link = r"(?is)<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)[^>]*>(.*?)</a>"
    stage1 = pages.withColumns(
        {
            "_text": visible_text(html),
            "_low": F.lower(html),
            "title": collapse_spaces(
                F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
            ),
            "bytes_n": F.octet_length(html),
            "tables_n": _count(html, r"(?i)<table\b"),
            "items_n": _count(html, _ITEM_TAG),
            "microdata_n": _count(html, r"(?i)<[a-z][^>]*\s(?:itemscope|itemprop)\b"),
            "json_ld_n": _count(html, rf"(?i)<script\b[^>]*{_LD_TYPE}"),
            "embedded_json_n": _count(
                html,
                rf"(?i)<script\b(?=[^>]*(?:{attribute('type', 'application/json', True)}"
                rf"|{attribute('id', '__NEXT_DATA__', True)}|\bdata-state\b))",
            ),
            "scripts_n": _count(html, r"(?i)<script\b"),
            "relevant_scripts_n": _count(
                html, rf"(?i)<script\b(?=[^>]*{attribute('(?:src|id)', SCRIPT_MARKS)})"
            ),
            "_ld": ld,
            "_links": F.arrays_zip(
                F.transform(
                    _all(html, link, 1), lambda v: F.regexp_replace(v, "^[\"']|[\"']$", "")
                ).alias("href"),
                _all(html, link, 2).alias("label"),
            ),
        }
    )
    text = F.col("_text")
    price_tag = rf"(?i)<[a-z](?=[^>]*{attribute('itemprop', 'price', True)})[^>]*?"
    meta_tag = rf"(?i)<meta(?=[^>]*{attribute('property', 'product:price:amount', True)})[^>]*?"
    # an element that names itself the price, and has no value of its own, shows it as its text
    shown_price = (
        rf"(?is)<([a-z][a-z0-9]*)\b(?=[^>]*{attribute('itemprop', 'price', True)})"
        rf"(?![^>]*\b(?:content|data-price)\s*=)[^>]*>(.*?)</\1\s*>"
    )
    marked_prices = F.concat(
        attribute_values(html, price_tag, "content"),
        attribute_values(html, r"(?i)<[a-z][^>]*?", "data-price"),
        attribute_values(html, meta_tag, "content"),
        F.transform(_all(html, shown_price, 2), visible_text),
        _ld_prices(F.col("_ld")),
    )
    links = F.filter(
        F.transform(
            "_links",
            lambda x: F.struct(
                absolute_url(F.col("url"), x["href"]).alias("href"), x["label"].alias("label")
            ),
        ),
        lambda x: F.lower(F.concat_ws(" ", x["href"], x["label"])).rlike(DETAIL_MARKS),
    )
    stage2 = stage1.withColumns(
        {
            "prices": _distinct_spaced(F.concat(_all(text, TEXT_PRICE), marked_prices)),
            "detail_links": _distinct_spaced(F.transform(links, lambda x: x["href"])),
            "places": _flags(*[(F.lower(text).contains(p.lower()), p) for p in PLACES]),
            "challenges": _flags(*[(html.rlike(p), name) for name, p in CHALLENGES]),
            "js_hints": _flags(
                *[(F.col("_low").contains(m), m) for m in APP_MARKS],
                (
                    html.rlike(rf"(?i)<[a-z][^>]*{attribute('id', 'root|app|__next', True)}"),
                    "contenedor_app",
                ),
                ((F.col("scripts_n") >= 15) & (F.length(text) < 1500), "muchos_scripts_poco_texto"),
            ),
            "has_pagination": html.rlike(
                rf"(?i)<a\b[^>]*{attribute('rel', 'next', True)}"
                rf"|{attribute('class', r'pagination|\bpaginacion\b')}"
            )
            | text.rlike(r"(?i)\b(siguiente|next|página\s+\d+)\b"),
        }
    )
    structured = (
        F.col("_ld").rlike(r'"@type"\s*:\s*\[?\s*(?:"[^"]*"\s*,\s*)*"(?:Product|Service|Offer)"')
        | html.rlike(
            rf"(?i){attribute('itemprop', 'price|offers', True)}|{attribute('itemtype', 'Product|Service')}"
        )
        | ((F.col("embedded_json_n") > 0) & (F.col("items_n") > 0))
    )
    blocked = F.size(F.array_remove("challenges", "captcha_component")) > 0
    no_price = F.size("prices") == 0
    needs_browser = (
        (F.size("js_hints") > 0) & no_price & (F.col("json_ld_n") == 0) & (F.col("items_n") < 2)
    )
    visible = ~no_price | (F.col("items_n") > 0) | (F.col("tables_n") > 0)
    kind = (
        F.when(blocked, F.lit("blocked"))
        .when(structured, "structured")
        .when(needs_browser, "browser")
        .when(visible, "static")
        .otherwise("unclear")
    )
    stage3 = stage2.withColumn("_kind", kind)
    case = F.col("_kind")
    shown = F.upper(F.array_join("prices", " "))
    return stage3.withColumns(
        {
            "prices_n": F.size("prices"),
            "strategy": F.when(case == "blocked", F.lit("BLOCKED"))
            .when(case == "structured", "WEB_STRUCTURED")
            .when(case == "browser", "WEB_BROWSER")
            .otherwise("HTTP_STATIC"),
            "difficulty": F.when(case == "blocked", F.lit("E"))
            .when(case == "structured", "C")
            .when(case == "browser", "D")
            .when(
                (case == "static") & (F.col("items_n") <= 10) & (F.col("tables_n") <= 1), "A"
            )
            .otherwise("B"),
            "problems": _flags(
                (case == "blocked", "challenge o bloqueo anti-bot"),
                (case == "browser", "contenido comercial no visible sin render"),
                (case == "unclear", "sin candidatos comerciales claros"),
                (~no_price & ~shown.rlike(r"\$|ARS|USD"), "precio sin moneda explícita"),
                (no_price, "sin precios detectables"),
                (
                    F.array_contains("challenges", "captcha_component") & ~blocked,
                    "CAPTCHA presente en componente no bloqueante",
                ),
            ),
            "prices": shortened(F.col("prices"), most),
            "detail_links": shortened(F.col("detail_links"), most),
            "currencies": _flags((shown.rlike(r"ARS|\$"), "ARS/$"), (shown.rlike(r"USD|US\$|U\$S"), "USD")),
        }
    ).drop("_text", "_low", "_ld", "_links", "_kind", "html")


def compare_captures(
    plain: DataFrame, rendered: DataFrame, on: str | list[str] = "url", most: int | None = None
) -> DataFrame:
    """What a rendered capture shows beyond the plain one, per page; ``most`` shortens lists.

    ``on`` must name a capture once on either side; where pages share a URL it needs more columns.
    """
    both = rendered.alias("r").join(plain.alias("p"), on, "left")

    def extra(name: str) -> Column:
        return F.greatest(
            F.lit(0), F.col(f"r.{name}") - F.coalesce(F.col(f"p.{name}"), F.lit(0))
        )

    def fresh(name: str) -> Column:
        none = F.array().cast("array<string>")
        seen = F.coalesce(F.col(f"p.{name}"), none)
        new = F.filter(F.col(f"r.{name}"), lambda v: ~F.array_contains(seen, v))
        return shortened(new, most)

    return both.select(
        *([on] if isinstance(on, str) else on),
        extra("bytes_n").alias("bytes_extra"),
        extra("items_n").alias("items_extra"),
        extra("prices_n").alias("prices_extra"),
        extra("json_ld_n").alias("json_ld_extra"),
        joined(fresh("detail_links")).alias("detail_links_extra"),
        joined(fresh("prices")).alias("new_prices"),
    )
