"""Captures of a page compared where pages share a URL."""

from valora.operators.pages import compare_captures, page_signals


def test_pages_of_one_url_are_compared_each_with_its_own(spark):
    plain = spark.createDataFrame(
        [(i, "http://a.example/x", f"<p>{'y' * i}</p>") for i in (1, 2)], "page_id long, url string, html string"
    )
    rendered = spark.createDataFrame(
        [(i, "http://a.example/x", f"<p>{'y' * i}</p><b>$ {i}</b>") for i in (1, 2)],
        "page_id long, url string, html string",
    )
    out = compare_captures(page_signals(plain), page_signals(rendered), ["page_id", "url"])
    rows = sorted((r["page_id"], r["bytes_extra"], r["new_prices"]) for r in out.collect())
    assert rows == [(1, 10, "$ 1"), (2, 10, "$ 2")]
