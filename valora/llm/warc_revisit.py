"""Not-modified revisits of a web archive find the response that they confirm.

A revisit with status 304 has no body. It belongs to the latest earlier full response of its
canonical URL, if the validators agree; its headers then update those of the response, but for
the ones that describe the body or the connection.

The as-of join never brings all captures of a URL into one task: captures are matched inside
(URL, span of time), and each span gets the last response of the spans before it, of which
there is one row per span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a 304 that never replace those of the stored response: they belong to the
#: message or to the connection, not to the stored body.
NOT_MERGED = (
    "content-length", "content-encoding", "content-range", "content-type", "content-md5",
    "transfer-encoding", "connection", "keep-alive", "proxy-connection", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "te", "trailer", "upgrade",
)

#: Successes without a body, or with a part of one.
NOT_FULL = (204, 205, 206)

_URL = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?]*)([^?]*)\??(.*)$"


def canonical_url(url: Column) -> Column:
    """Host, path and sorted query: without scheme, user, default port, ``www.``, fragment and
    ``utm_`` parameters. What is no absolute URL stays as it is, trimmed; null stays null."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    host = F.lower(F.regexp_extract(bare, _URL, 2))
    host = F.regexp_replace(host, r"^[^@]*@", "")
    host = F.regexp_replace(host, r":(80|443)?$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_extract(bare, _URL, 3)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    params = F.filter(
        F.split(F.regexp_extract(bare, _URL, 4), "&"),
        lambda p: (p != "") & ~F.lower(p).startswith("utm_"),
    )
    query = F.array_join(F.array_sort(params), "&")
    whole = F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(bare.rlike(_URL), whole).otherwise(bare)


def header(headers: Column, name: str) -> Column:
    """The first value of a header, null if there is none."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.when(F.size(found) > 0, F.element_at(found, 1)["value"])


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def validators_agree(stored: Column, fresh: Column) -> Column:
    """Entity tags are compared (a weak one by its value) if the revisit has one, else the
    dates of change; a revisit without validators confirms only a response without."""
    tag, date = header(fresh, "etag"), header(fresh, "last-modified")
    old_tag, old_date = header(stored, "etag"), header(stored, "last-modified")
    agree = (
        F.when(tag.isNotNull(), _strong(tag) == _strong(old_tag))
        .when(date.isNotNull(), date == old_date)
        .otherwise(old_tag.isNull() & old_date.isNull())
    )
    return F.coalesce(agree, F.lit(False))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers that the revisit does not replace, then its permitted headers: none that
    belong to the message, or that a ``Connection`` header of the revisit names."""
    connection = F.filter(fresh, lambda h: (F.lower(h["name"]) == "connection") & h["value"].isNotNull())
    lists = F.transform(connection, lambda h: F.split(F.lower(h["value"]), ","))
    hops = F.transform(F.flatten(lists), lambda name: F.trim(name))
    allowed = F.filter(
        fresh,
        lambda h: ~F.lower(h["name"]).isin(*NOT_MERGED) & ~F.array_contains(hops, F.lower(h["name"])),
    )
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    kept = F.filter(stored, lambda h: ~F.array_contains(names, F.lower(h["name"])))
    return F.concat(kept, allowed)


def resolve_revisits(records: DataFrame, span: int = 86_400) -> DataFrame:
    """One row per record: ``record_id``, ``outcome``, ``refers_to``, ``headers``, ``digest``.

    ``records``: ``record_id`` string, ``url``, ``at`` (seconds), ``status``, ``headers`` array
    of (name, value), ``digest`` of the body. Outcomes: ``response`` (status 200 to 299 but
    204, 205 and 206: with a whole body of its own), ``resolved``, ``validator_mismatch`` and ``no_response`` for
    status 304, ``other`` for the rest. A resolved revisit has the merged headers and the
    digest of the response it refers to; a mismatch names the response but takes nothing.

    Earlier means a smaller time; of responses at one time the largest record id counts. A
    revisit with a null URL or time finds no response, and such a response is found by none.
    Null headers count as none, headers with a null name are left out. Repeated records give
    repeated rows; other columns are not read; an empty table gives no rows. ``span`` only
    sets how finely the captures of one URL are dealt out.
    """
    empty = F.array().cast("array<struct<name:string,value:string>>")
    rows = records.select(
        F.col("record_id").cast("string").alias("record_id"),
        canonical_url(F.col("url")).alias("key"),
        F.col("at").cast("long").alias("at"),
        F.coalesce(F.col("status").cast("int"), F.lit(0)).alias("status"),
        F.filter(F.coalesce(F.col("headers"), empty), lambda h: h["name"].isNotNull()).alias("headers"),
        F.col("digest").cast("string").alias("digest"),
    ).withColumn("span", F.floor(F.col("at") / span))
    full = F.col("status").between(200, 299) & ~F.col("status").isin(*NOT_FULL)
    placed = F.col("key").isNotNull() & F.col("at").isNotNull()
    response = F.struct("at", "record_id", "headers", "digest")

    last = (
        rows.where(full & placed)
        .groupBy("key", "span")
        .agg(F.max_by(response, F.struct("at", "record_id")).alias("here"))
    )
    asked = rows.where((F.col("status") == 304) & placed).select("key", "span").distinct()
    spans = asked.join(last, ["key", "span"], "full_outer")
    order = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("before", F.last("here", True).over(order)).select(
        "key", "span", "before"
    )

    inside = (
        Window.partitionBy("key", "span")
        .orderBy("at", full.cast("int"), "record_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    near = rows.where(placed & (full | (F.col("status") == 304))).withColumn(
        "found", F.last(F.when(full, response), True).over(inside)
    )
    revisits = (
        near.where(F.col("status") == 304)
        .join(carried, ["key", "span"], "left")
        .withColumn("found", F.coalesce("found", "before"))
    )
    agree = validators_agree(F.col("found.headers"), F.col("headers"))
    judged = revisits.select(
        "record_id",
        F.when(F.col("found").isNull(), "no_response")
        .when(agree, "resolved")
        .otherwise("validator_mismatch")
        .alias("outcome"),
        F.col("found.record_id").alias("refers_to"),
        F.when(agree & F.col("found").isNotNull(), merged_headers(F.col("found.headers"), F.col("headers")))
        .otherwise(F.col("headers"))
        .alias("headers"),
        F.when(agree, F.col("found.digest")).alias("digest"),
    )
    lost = (F.col("status") == 304) & ~placed
    others = rows.where((F.col("status") != 304) | lost).select(
        "record_id",
        F.when(full, "response").when(lost, "no_response").otherwise("other").alias("outcome"),
        F.lit(None).cast("string").alias("refers_to"),
        "headers",
        F.when(~lost, F.col("digest")).alias("digest"),
    )
    return judged.union(others)


# --- query ------------------------------------------------------------------------------------

_ID = "CAST(page_id AS STRING)"
_AT = "CAST(1000000 + page_id % 1000 * 3600 AS BIGINT)"
_BODY = "coalesce(html, '')"
_TAG = f"'\"' || substr(md5({_BODY}), 1, 16) || '\"'"
_NEXT = "'\"' || substr(md5(coalesce(url, '')), 1, 16) || '\"'"
_DAY = "'day ' || CAST(page_id % 28 AS STRING)"
_NONE = "CAST(NULL AS STRING)"
_NAMES = ("etag", "modified", "cache", "size")

#: Captures of each page: a response, for some a changed one, and 304 revisits under other
#: spellings of the URL: confirmed by tag or by date, stale, too early, or without validators.
CAPTURES = f"""
SELECT 'a' || {_ID} AS record_id, 200 AS status, url, {_AT} AS at, md5({_BODY}) AS digest,
  {_TAG} AS etag, {_DAY} AS modified, {_NONE} AS cache, CAST(length({_BODY}) AS STRING) AS size FROM pages
UNION ALL SELECT 'b' || {_ID}, 203, url, {_AT} + 86400, md5(coalesce(url, '')),
  'W/' || {_NEXT}, {_DAY}, 'no-cache', '9' FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT 'c' || {_ID}, 304, replace(url, '://', '://WWW.') || '#again', {_AT} + 172800 + page_id % 5 * 3600, {_NONE},
  CASE WHEN page_id % 4 = 0 THEN '"other"' WHEN page_id % 4 = 1 THEN NULL
       WHEN page_id % 3 = 0 THEN {_NEXT} ELSE {_TAG} END,
  CASE WHEN page_id % 8 = 1 THEN 'day 99' ELSE {_DAY} END, 'max-age=60', '0' FROM pages
UNION ALL SELECT 'd' || {_ID}, 304, url, {_AT} - 7200, {_NONE}, {_TAG}, {_DAY}, {_NONE}, '0'
  FROM pages WHERE page_id % 7 = 0
UNION ALL SELECT 'e' || {_ID}, 304, url, {_AT} + 300000, {_NONE}, {_NONE}, {_NONE}, {_NONE}, {_NONE}
  FROM pages WHERE page_id % 11 = 0
UNION ALL SELECT 'f' || {_ID}, 404, url, {_AT} + 100, md5(''), {_NONE}, {_NONE}, {_NONE}, '0'
  FROM pages WHERE page_id % 13 = 0"""

_HEADER_NAMES = {"etag": "ETag", "modified": "Last-Modified", "cache": "Cache-Control", "size": "Content-Length"}


def revisit_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = spark.sql(CAPTURES.replace("FROM pages", "FROM {pages}"), pages=pages)
    every = F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for c, n in _HEADER_NAMES.items()]
    )
    records = captures.withColumn("headers", F.filter(every, lambda h: h["value"].isNotNull()))
    out = resolve_revisits(records)
    lines = F.transform(out["headers"], lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return out.select(
        "record_id", "outcome", "refers_to", F.array_join(F.array_sort(lines), "\n").alias("headers"), "digest"
    )


_BARE = "regexp_replace(trim(url), '(?s)#.*$', '')"
_PART = "regexp_extract({}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?]*)([^?]*)\\??(.*)$', {}, 's')"
_HOST = (
    "regexp_replace(regexp_replace(regexp_replace(lower("
    + _PART.format("bare", 2)
    + "), '^[^@]*@', ''), ':(80|443)?$', ''), '^www\\.', '')"
)
_MERGED = ", ".join(
    f"CASE WHEN outcome = 'resolved' THEN {'coalesce(old_' + c + ', ' + c + ')' if c == 'size' else 'coalesce(' + c + ', old_' + c + ')'} ELSE {c} END AS new_{c}"
    for c in _NAMES
)
SQL = f"""WITH captures AS ({CAPTURES}), bared AS (SELECT *, {_BARE} AS bare FROM captures),
split AS (SELECT *, {_HOST} AS host, {_PART.format("bare", 3)} AS path,
  array_to_string(list_sort(list_filter(string_split({_PART.format("bare", 4)}, '&'),
    lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_'))), '&') AS query FROM bared),
keyed AS (SELECT *, CASE WHEN host = '' AND path = '' THEN bare ELSE host || CASE WHEN path = '' THEN '/' ELSE path END
  || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS url_key FROM split),
matched AS (SELECT v.record_id, max_by(r.record_id, (r.at, r.record_id)) AS refers_to
  FROM keyed v JOIN keyed r ON v.url_key = r.url_key AND r.at < v.at AND r.status IN (200, 203)
  WHERE v.status = 304 GROUP BY v.record_id),
joined AS (SELECT v.*, m.refers_to, r.etag AS old_etag, r.modified AS old_modified, r.cache AS old_cache,
    r.size AS old_size, r.digest AS old_digest
  FROM keyed v LEFT JOIN matched m ON v.record_id = m.record_id LEFT JOIN keyed r ON r.record_id = m.refers_to),
judged AS (SELECT *, CASE WHEN status IN (200, 203) THEN 'response' WHEN status <> 304 THEN 'other'
  WHEN refers_to IS NULL THEN 'no_response'
  WHEN coalesce(CASE WHEN etag IS NOT NULL THEN replace(etag, 'W/', '') = replace(old_etag, 'W/', '')
    WHEN modified IS NOT NULL THEN modified = old_modified
    ELSE old_etag IS NULL AND old_modified IS NULL END, FALSE) THEN 'resolved'
  ELSE 'validator_mismatch' END AS outcome FROM joined),
merged AS (SELECT *, {_MERGED} FROM judged)
SELECT record_id, outcome, refers_to,
  array_to_string(list_sort(list_filter([{", ".join(f"'{n}: ' || new_{c}" for c, n in _HEADER_NAMES.items())}],
    lambda x: x IS NOT NULL)), chr(10)) AS headers,
  CASE WHEN outcome = 'resolved' THEN old_digest WHEN status <> 304 THEN digest END AS digest FROM merged"""
