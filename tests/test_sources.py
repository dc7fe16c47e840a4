"""Files, pages, jobs and streams."""

import pytest
from pyspark.sql import functions as F

from valora.operators.pages import json_ld_candidates, page_prices, page_signals, priced_elements
from valora.plans.pricing_job import live_pricing
from valora.plans.understanding import write_sidecar
from valora.sources import evidence as ev
from valora.sources import files as fi
from valora.sources import registry as rg
from valora.streaming.evidence_stream import classify_stream, stream_raw_documents


def test_row_numbers_follow_the_file(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("\n".join(f"l{i}" for i in range(500)), encoding="utf-8")
    rows = fi.with_row_numbers(spark.read.text(str(path))).orderBy("row_number").collect()
    assert [(r.value, r.row_number) for r in rows] == [(f"l{i}", i + 1) for i in range(500)]


@pytest.mark.parametrize(
    "encoding, delimiter", [("utf-8-sig", ","), ("utf-8", ";"), ("cp1252", "|"), ("utf-8", "\t")]
)
def test_bulk_csv(spark, tmp_path, encoding, delimiter):
    rows = [
        ["Numero_Proceso", "Documento_Contractual", "CUIT", "Rubros"],
        ["P1", "D1", "C1", "INFORMÁTICA; “x”" if encoding == "cp1252" else "INFORMÁTICA; x"],
        ["", "", "", "sin id"],
        ["", "", "", ""],
        ["P2", "", "C2", "ñ", "extra"],
        ["P3", "", "", "ok"],
    ]
    text = "\n".join(delimiter.join(f'"{c}"' if delimiter in c else c for c in r) for r in rows) + "\n"
    path = tmp_path / "bulk.csv"
    path.write_bytes(text.encode(encoding))
    out = fi.read_bulk(spark, str(path), "R", "Adjudicaciones 2016 - 2026", multiline=True).orderBy("row_number").collect()
    assert [(r.row_number, r.stable_id, r.reject_reason) for r in out] == [
        (2, "P1|D1|C1", None),
        (3, "UNKNOWN", "missing stable row identity"),
        (5, "P2||C2", "extra columns beyond header"),
        (6, "P3", None),
    ]
    assert out[0].row_raw["Rubros"].startswith("INFORMÁTICA") and out[0].value_class == "P0_ECONOMIC"


def test_registry_file(spark, tmp_path):
    head = "source,provider,url,province,city,discovery_status,price_visibility,source_kind,notes\n"
    good = "a,A,u,Salta,Salta,verified,price_visible,provider,\n"
    path = tmp_path / "r.csv"
    path.write_text("﻿" + head + good + ",,,,,,,,\n" + "b,B,u,Salta,Salta,VERIFIED,UNKNOWN,PROVIDER,n\n", encoding="utf-8")
    assert rg.read_registry(spark, str(path)).count() == 2
    assert [r.source for r in rg.select_sources(rg.read_registry(spark, str(path))).collect()] == ["a"]
    path.write_text(head + good + good, encoding="utf-8")
    bad = rg.read_registry(spark, str(path), strict=False).filter("reject_reason IS NOT NULL").collect()
    assert [r.reject_reason for r in bad] == ["source duplicado: a"]
    with pytest.raises(Exception):
        rg.read_registry(spark, str(path)).collect()
    path.write_text("source,provider\nx,y\n", encoding="utf-8")
    with pytest.raises(ValueError):
        rg.read_registry(spark, str(path))


def test_json_lines_twice(spark, tmp_path):
    path = tmp_path / "l.jsonl"
    line = '{"source": "s", "source_url": "u", "raw_text": "t", "language": "es", "observed_at": "2024-01-02T03:04:05Z"}'
    path.write_text("\n".join(["﻿" + line, "", line, "{bad", line.replace('"t"', '""')]), encoding="utf-8")
    first = ev.import_language(ev.read_json_lines(spark, str(path))).orderBy("line_number").collect()
    assert [r.outcome for r in first] == ["ACCEPTED", "DUPLICATE", "REJECTED", "REJECTED"]
    stored = spark.createDataFrame([(r.source, r.source_id) for r in first if r.outcome == "ACCEPTED"], "source string, source_id string")
    again = ev.import_language(ev.read_json_lines(spark, str(path)), stored)
    assert again.filter("outcome = 'ACCEPTED'").count() == 0


def test_cohort_file(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(
        "market,canonical_service,observations_n,providers_n,min_ars,q1_ars,median_ars,q3_ars,max_ars,spread_ratio,"
        "evidence_confidence,decision_ready,range_ready\nCABA,X,5,4,1,2,3,4,5.5,2.5,MEDIUM,YES,yes\nCABA,X,9,9,1,1,1,1,1,1,LOW,NO,NO\n",
        encoding="utf-8",
    )
    (row,) = fi.read_cohorts(spark, str(path)).collect()
    assert (row.observations_n, row.price_scope, row.commercial_context, row.decision_ready) == (5, "UNKNOWN", "STANDARD", True)


PAGE = """<html><body><!-- note --><table><tr><td>Formateo</td><td><b>$ 12.000</b></td></tr></table>
<p>Mantenimiento <span>$ 1.500</span></p><div class="c"><p>Soporte</p><p>$ 900<sup>,50</sup></p></div>
<script>var x = "$ 5.000";</script><div>Formateo <span>$ 12.000</span></div></body></html>"""


def test_page_prices(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page_id bigint, html string")
    found = priced_elements(df).orderBy("position").collect()
    assert [(e.price_raw, e.context, e.reject_reason) for e in found] == [
        ("$ 12.000", "Formateo", None),
        ("$ 1.500", "Mantenimiento", None),
        ("$ 900", "Soporte", "SPLIT_DECIMAL"),
        ("$ 12.000", "Formateo", None),
    ]
    long = spark.createDataFrame([(1, "<div>" + "x" * 400 + "<b>$ 100</b></div>"), (2, "<b>$ 7</b>")], "page_id bigint, html string")
    assert {r.page_id: r.reject_reason for r in priced_elements(long).collect()} == {1: "CONTEXT_TOO_LONG", 2: "NO_CONTEXT"}
    assert page_prices(long, None, None).first().economic_object_raw == "x" * 400
    out = page_prices(df).orderBy("ordinal").collect()
    assert [(r.ordinal, r.price_value, r.source_record_id) for r in out] == [
        (0, 12000, "generic:0:formateo:12000"),
        (1, 1500, "generic:1:mantenimiento:1500"),
    ]


def test_page_signals_and_json_ld(spark):
    ld = '<script type="application/ld+json">{"@type": "Product", "name": "X", "offers": {"@type": "Offer", "price": "10"}}</script>'
    blocked = "<html><title>Just a moment</title><body>cf-chl</body></html>"
    df = spark.createDataFrame(
        [(1, "http://a.b/c/", PAGE + ld), (2, "http://a.b", blocked), (3, "http://a.b", "<p>hola</p>")],
        "page_id bigint, url string, html string",
    )
    rows = {r.page_id: r for r in page_signals(df).collect()}
    assert (rows[1].strategy, rows[1].difficulty, rows[1].json_ld_n) == ("WEB_STRUCTURED", "C", 1)
    assert rows[2].strategy == "BLOCKED" and rows[3].difficulty == "B"
    assert sorted(r.types for r in json_ld_candidates(df).collect()) == ["Offer", "Product"]


def test_any_quoting_and_all_prices(spark):
    ld = "<script type={0}application/ld+json{0}>" + '{{"@type": "Product", "name": "X", "offers": {{"price": "10", "priceCurrency": "USD"}}}}</script>'
    pages = [
        f"<html>{ld.format(q)}<div itemtype={q}http://schema.org/Product{q}><b itemprop={q}price{q}>99</b><i itemprop={q}price{q} content={q}77{q}>x</i>"
        f"<meta property={q}product:price:amount{q} content={q}55{q}><a href={q}/producto/1{q}>v</a></div></html>"
        for q in ('"', "'", "")
    ]
    many = "".join(f"<p>$ {k}00</p><a href='/item/{k}'>i</a>" for k in range(1, 31))
    rows = [(k, "http://a.b/c", html) for k, html in enumerate([*pages, many])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in page_signals(df).collect()}
    for k in range(3):
        assert (got[k].json_ld_n, got[k].strategy, got[k].items_n) == (1, "WEB_STRUCTURED", 1)
        assert sorted(got[k].prices) == ["55", "77", "99", "USD 10"] and got[k].detail_links == ["http://a.b/producto/1"]
        assert "precio sin moneda explícita" not in got[k].problems
    assert got[3].prices_n == 30 and len(got[3].prices) == 30 and len(got[3].detail_links) == 30
    assert len(page_signals(df, most=5).where("page_id = 3").first().prices) == 5
    assert json_ld_candidates(df).where("types = 'Product'").count() == 3


def test_live_job_needs_a_source(spark, tmp_path):
    fetched = spark.createDataFrame(
        [(1, "s", "u", "Salta", "", PAGE, "timeout")],
        "arrival bigint, source string, source_record_id string, province string, city string, raw_content string, error string",
    )
    base = "source string, economic_object_raw string, price_value string, currency string, row_number bigint, observation_id string, "
    base += "province string, city string, semantic_role string, market_scope string, matched_services string, canonical_service string, "
    base += "comparability_key string, original_comparable_status string, extractor_version string"
    job = live_pricing(fetched, spark.createDataFrame([], base))
    for name in ("run", "documents", "rows", "cohorts"):
        with pytest.raises(Exception, match="no source succeeded"):
            job[name].collect()
    fetched.limit(0).write.parquet(str(tmp_path / "empty"))
    none = live_pricing(spark.read.schema(fetched.schema).parquet(str(tmp_path / "empty")), spark.createDataFrame([], base))
    with pytest.raises(Exception, match="no source succeeded"):
        none["cohorts"].collect()
    ok = live_pricing(fetched.withColumn("error", F.lit(None).cast("string")), spark.createDataFrame([], base))
    assert ok["rows"].count() == 2


def test_sidecar(spark, tmp_path):
    row = ("1", "s", "Salta", "Desde", "1", "ARS", "NON_OBJECT", "UNKNOWN", "", "", "v")
    names = "observation_id source province economic_object_raw price_value currency semantic_role market_scope matched_services canonical_service extractor_version"
    df = spark.createDataFrame([row], ", ".join(f"{n} string" for n in names.split()))
    out = write_sidecar(df, str(tmp_path / "side"), "x.csv")
    assert [(r[0], r[1]) for r in out.collect()] == [("PARTIALLY_UNDERSTOOD", 1)]
    with pytest.raises(ValueError):
        write_sidecar(df.union(df), str(tmp_path / "side2"), "x.csv")


def test_streams_equal_batch(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("arrival"), "source", F.col("lang").alias("source_record_id"), F.col("text").alias("raw_content")
    )
    batch = ev.append_raw_documents(docs, None, "arrival").filter("outcome = 'ACQUIRED'")
    landing, store = str(tmp_path / "in"), str(tmp_path / "store")
    docs.repartition(3).write.parquet(landing)
    schema = "arrival bigint, source string, source_record_id string, raw_content string, content_hash string"
    for attempt in ("a", "b"):
        incoming = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        stream_raw_documents(incoming, store, str(tmp_path / attempt), schema).awaitTermination()
        stored = spark.read.parquet(store)
        assert stored.select("content_hash").distinct().count() == batch.select("content_hash").distinct().count()
        assert stored.count() == batch.count()
    texts = docs.select(F.col("raw_content").alias("economic_object_raw"), F.lit("Salta").alias("province"))
    texts.write.parquet(str(tmp_path / "texts"))
    live = classify_stream(spark.readStream.schema(texts.schema).parquet(str(tmp_path / "texts")))
    query = live.writeStream.format("memory").queryName("classified").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("classified").count() == texts.count()


def test_quoted_line_breaks_are_not_split(spark, tmp_path):
    """A quoted field over two lines is an error unless the file is read as a whole."""
    cases = {
        'a,b\n1,"x\ny"\n2,z\n': True, 'a|b\n"x|y|\nz"|2\n': True, 'a;"b\nc"\n1;2\n': True,
        'a,b\n5" pipe,x\n1,"q ""r"", s"\n2,""\n': False, 'a,b\n1,x"\n': False, 'a\n"x\ny"\n': True,
    }
    for k, (text, broken) in enumerate(cases.items()):
        path = tmp_path / f"{k}.csv"
        path.write_text(text)
        if broken:
            with pytest.raises(ValueError, match="line breaks"):
                fi.read_bulk(spark, str(path), "R", "x")
        else:
            assert fi.read_bulk(spark, str(path), "R", "x").count() == text.count("\n") - 1
        assert fi.read_bulk(spark, str(path), "R", "x", multiline=True).count() >= 1
