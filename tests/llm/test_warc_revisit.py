import pytest

from valora.llm.warc_revisit import canonical_url, resolve_revisits

SCHEMA = "record_id string, url string, at long, status int, headers array<struct<name:string,value:string>>, digest string"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://User:pw@WWW.Example.com:80/a?b=2&a=1&utm_source=x#frag", "example.com/a?a=1&b=2"),
        ("https://example.com:443", "example.com/"), ("https://example.com:8443/", "example.com:8443/"),
        ("https://example.com/A/b?", "example.com/A/b"), ("/relative#x", "/relative"), (" x ", "x"), ("", ""), (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(canonical_url(df.url)).first()[0] == want


def test_cases(spark):
    u, day = "http://e.com/x", 86_400
    tag, weak, other = [("ETag", '"1"')], [("etag", 'W/"1"')], [("ETag", '"2"')]
    dated, long = [("Last-Modified", "d1")], [("X", "y" * 100_000)]
    rows = [
        ("a", u, 10, 200, [*tag, ("Content-Length", "5"), ("Cache-Control", "old"), *dated], "A"),
        ("b", u + "#f", 10, 304, weak, None),  # not earlier
        ("c", u, 11, 304, [*weak, ("CONTENT-LENGTH", "0"), ("cache-control", "new"), ("Cache-Control", "more")], None),
        ("d", u, 10 + 50 * day, 304, other, None), ("e", u, 12, 304, dated, None), ("f", u, 13, 304, [], None),
        ("g", u, 14, 206, tag, "part"), ("h", u, 14, 404, None, "gone"), ("i", u, 15, 304, tag, None),
        ("j", None, 20, 200, tag, "N"), ("k", None, 21, 304, tag, None), ("l", u, None, 304, tag, None),
        ("m", "http://e.com/y", 5, 200, None, "M1"), ("n", "http://e.com/y", 5, 200, [], "M2"), ("o", "https://www.e.com/y", 6 + 3 * day, 304, None, "ignored"),
        ("p", u, 9, 304, tag, None), ("q", u, 16, None, long, "q"), ("r", u, 17, 304, [(None, "x"), *tag], None), ("r", u, 17, 304, [(None, "x"), *tag], None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS outcome", "1 AS key", "2 AS found", "3 AS span")
    for span in (1, 7, day, 1000 * day):
        out = resolve_revisits(df, span).collect()
        got = {r.record_id: (r.outcome, r.refers_to, r.digest) for r in out}
        assert len(out) == len(rows)
        assert got["a"] == ("response", None, "A") and got["b"][0] == "no_response" and got["p"][0] == "no_response"
        assert got["c"] == ("resolved", "a", "A") and got["d"] == ("validator_mismatch", "a", None)
        assert got["e"] == ("resolved", "a", "A") and got["f"][0] == "validator_mismatch"
        assert got["g"] == ("other", None, "part") and got["h"] == ("other", None, "gone") and got["i"][:2] == ("resolved", "a")
        assert got["j"][0] == "response" and got["k"][0] == "no_response" and got["l"][0] == "no_response"
        assert got["o"] == ("resolved", "n", "M2") and got["q"] == ("other", None, "q") and got["r"] == ("resolved", "a", "A")
        merged = {r.record_id: [tuple(h) for h in r.headers] for r in out}
        assert merged["c"] == [("Content-Length", "5"), ("Last-Modified", "d1"), ("etag", 'W/"1"'), ("cache-control", "new"), ("Cache-Control", "more")]
        assert merged["d"] == other and merged["h"] == []


def test_connection_and_empty_successes(spark):
    u = "http://e.com/x"
    stored = [("ETag", '"1"'), ("X-Tag", "old"), ("X-Other", "old"), ("X-Third", "old")]
    fresh = [("etag", '"1"'), ("Connection", "close, X-Tag"), ("connection", " x-other "), ("Connection", None),
             ("x-tag", "new"), ("X-OTHER", "new"), ("X-Third", "new")]
    rows = [("a", u, 1, 200, stored, "A"), ("b", u, 2, 204, [("ETag", '"1"')], "none"), ("c", u, 3, 205, [("ETag", '"1"')], "none"),
            ("d", u, 4, 304, fresh, None)]
    out = {r.record_id: r for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (out["d"].outcome, out["d"].refers_to, out["d"].digest) == ("resolved", "a", "A")
    assert [tuple(h) for h in out["d"].headers] == [("X-Tag", "old"), ("X-Other", "old"), ("etag", '"1"'), ("X-Third", "new")]
    assert out["b"].outcome == out["c"].outcome == "other"


def test_empty(spark):
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
