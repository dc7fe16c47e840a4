from valora.plans.pricing_job import live_pricing

PAGE = "<table><tr><td>Formateo</td><td>$ 12.000</td></tr><tr><td>Limpieza</td><td>$ 9.000</td></tr></table>"
BASE = "source economic_object_raw price_value currency observation_id province city semantic_role market_scope matched_services "
BASE += "canonical_service comparability_key original_comparable_status extractor_version"


def test_known_observations_are_not_stored_again(spark):
    """a price that an earlier fetch, or the store, has under either identity is not new."""
    names = "arrival bigint, source string, source_record_id string, province string, city string, raw_content string, error string"
    rows = [
        (1, "s", "u", "Salta", "", PAGE, None),
        (2, "s", "u", "Salta", "", PAGE + "<p>nuevo pie</p>", None),  # other contents, same prices
        (3, "t", "u", "Jujuy", "", PAGE, None),
        (4, "t", "v", "Jujuy", "", PAGE.replace("9.000", "9.500"), None),
    ]
    frozen = [
        (source, "Formateo", "12000", "ARS", "0", place, "", "SINGLE_SERVICE", "LOCAL_SERVICE", "FORMATEO", "FORMATEO", "k", "X", "v0", 1)
        for source, place in (("s", "Salta"), ("t", "Jujuy"))
    ]
    base = spark.createDataFrame(frozen, ", ".join(f"{n} string" for n in BASE.split()) + ", row_number bigint")
    job = live_pricing(spark.createDataFrame(rows, names), base)
    first = [("1:0", "12000"), ("1:1", "9000"), ("3:0", "12000"), ("3:1", "9000"), ("4:1", "9500")]
    assert sorted((r.observation_id, r.price_value) for r in job["observations"].collect()) == first
    assert sorted((r.observation_id, r.price_value) for r in job["rows"].collect()) == first
    cohorts = job["cohorts"].where("canonical_service = 'FORMATEO'").collect()
    assert sorted((r.market, r.observations_n) for r in cohorts) == [("Jujuy", 1), ("Salta", 1)]

    docs = job["documents"].where("arrival < 3").withColumnRenamed("arrival", "raw_document_id")
    known = job["observations"].where("raw_document_id < 3")
    again = live_pricing(spark.createDataFrame(rows, names), base, docs, stored_observations=known)
    assert sorted(r.observation_id for r in again["observations"].collect()) == ["3:0", "3:1", "4:1"]
    assert sorted((r.observation_id, r.price_value) for r in again["rows"].collect()) == first
