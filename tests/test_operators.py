"""Set-level operators against brute force and literal cases."""

import random
import statistics

import pandas as pd
from pyspark.sql import functions as F

from valora.functions.price import commercial_context, offer_cadence
from valora.functions.text import fold
from valora.operators import cohorts as co
from valora.operators import comparability as cm
from valora.operators import decisions as de
from valora.operators import dedup
from valora.operators.quantiles import exact_quantiles


def _sequential(rows):
    a_used, b_used, kept = set(), set(), []
    for order, a, b in rows:
        if a in a_used or b in b_used:
            continue
        a_used.add(a)
        b_used.add(b)
        kept.append(order)
    return kept


def _arrivals(seed, n, a, b):
    rng = random.Random(seed)
    return [(i, f"a{rng.randrange(a)}", f"b{rng.randrange(b)}") for i in range(n)]


def test_two_keys_equal_sequential_rule(spark):
    # The last case is one chain, and the hot case puts a third of the rows on one key.
    chain = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(40)]
    hot = [(i, "hot" if i % 3 == 0 else f"a{i % 17}", f"b{i % 29}") for i in range(300)]
    for rows in (_arrivals(1, 200, 40, 40), _arrivals(2, 100, 3, 90), hot, chain):
        df = spark.createDataFrame([(*r, "g") for r in rows], "o bigint, a string, b string, g string")
        got = dedup.accept_two_keys(df, ["a"], ["b"], "o")
        assert sorted(r.o for r in got.collect()) == _sequential(rows)


def test_ties_leave_one_row_per_key(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 1, "y"), ("k", 1, "y"), ("k", 2, "x")], "k string, o bigint, v string")
    assert dedup.only_new(df, ["k"], "o").count() == 1
    assert dedup.accept_two_keys(df, ["k"], ["v"], "o").count() == 1


def test_two_keys_named_cases_and_store(spark):
    rows = [(1, "doc1", "p1"), (2, "doc1", "p2"), (3, "doc2", "p2")]
    df = spark.createDataFrame(rows, "o bigint, a string, b string")
    assert sorted(r.o for r in dedup.accept_two_keys(df, ["a"], ["b"], "o").collect()) == [1, 3]
    stored = spark.createDataFrame([("doc1", "p9"), ("doc9", "p2")], "a string, b string")
    assert dedup.accept_two_keys(df, ["a"], ["b"], "o", stored).count() == 0


def test_mark_new_is_idempotent(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "")], "o bigint, k string")
    first = dedup.only_new(df, ["k"], "o")
    assert sorted(r.o for r in first.collect()) == [1, 3, 4]
    assert dedup.only_new(df, ["k"], "o", first).count() == 0


def test_quantiles_match_sorting(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"g{i % 5}", round(rng.uniform(-50, 9000), rng.choice([0, 2]))) for i in range(3000)]
    got = exact_quantiles(
        spark.createDataFrame(rows, "g string, v double"), ["g"], "v", (("a", 0.1), ("m", 0.5), ("z", 0.99))
    ).toPandas()
    want = pd.DataFrame(rows, columns=["g", "v"]).groupby("g")["v"].quantile([0.1, 0.5, 0.99]).unstack()
    for row in got.itertuples():
        for name, q in (("a", 0.1), ("m", 0.5), ("z", 0.99)):
            assert abs(getattr(row, name) - want.loc[row.g, q]) < 1e-9


def test_cohort_cadence_case(spark):
    texts = [
        ("Soporte remoto", 35000, "s1"),
        ("Soporte x 1 HS", 30000, "s2"),
        ("Soporte Hora de servicio", 28000, "s3"),
        ("Urgencias soporte la Hora", 48000, "s3"),
        ("Soporte por hora", 40000, "s4"),
    ]
    rows = [
        (t, str(p), s, "ARS", "SINGLE_SERVICE", "REMOTE_NATIONAL_SERVICE", "SOPORTE_REMOTO", "")
        for t, p, s in texts
    ]
    df = spark.createDataFrame(
        rows,
        "economic_object_raw string, price_value string, source string, currency string, semantic_role string, "
        "market_scope string, canonical_service string, province string",
    )
    out = {(r.price_scope, r.commercial_context): r for r in co.cohort_statistics(df).collect()}
    hour = out["PER_HOUR", "STANDARD"]
    assert (hour.observations_n, hour.providers_n, hour.evidence_confidence) == (3, 3, "LOW")
    assert (hour.min_ars, hour.q1_ars, hour.median_ars, hour.q3_ars, hour.max_ars) == (
        28000, 29000, 30000, 35000, 40000,
    )
    assert out["UNKNOWN", "STANDARD"].evidence_confidence == "INSUFFICIENT"
    assert out["PER_HOUR", "URGENCY"].observations_n == 1


def test_cadence_is_conservative(spark):
    df = spark.createDataFrame([("Disco 100GB Windows 11",), ("Abono mensual",), ("ahora mismo",)], "t string")
    folded = df.withColumn("f", fold(F.col("t"), collapse=False))
    assert [r[0] for r in folded.select(offer_cadence(F.col("f"))).collect()] == ["UNKNOWN", "PER_MONTH", "UNKNOWN"]
    assert folded.select(commercial_context(F.col("f"))).distinct().count() == 1


def test_price_limits_are_inclusive(spark):
    cohort = [("m", "s", "UNKNOWN", "STANDARD", 5, 3, 10.0, 20.0, 30.0, 40.0, 50.0, "MEDIUM", True, True)]
    schema = "market string, canonical_service string, price_scope string, commercial_context string, observations_n int, "
    schema += "providers_n int, min_ars double, q1_ars double, median_ars double, q3_ars double, max_ars double, "
    schema += "evidence_confidence string, decision_ready boolean, range_ready boolean"
    asks = [("m", "s", "UNKNOWN", "STANDARD", float(p)) for p in (9, 10, 20, 40, 41, 51)]
    df = spark.createDataFrame(
        asks, "market string, canonical_service string, price_scope string, commercial_context string, proposed_price double"
    )
    out = de.evaluate_prices(df, spark.createDataFrame(cohort, schema)).orderBy("proposed_price").collect()
    assert [r.decision_label for r in out] == ["BAJO", "BAJO", "RAZONABLE", "RAZONABLE", "ALTO", "ALTO"]
    assert [r.price_position.split("_")[0] for r in out] == ["BELOW", "WITHIN", "WITHIN", "WITHIN", "WITHIN", "ABOVE"]


def test_pair_counts_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [
        (i, f"b{i % 3}", f"s{i % 4}", rng.choice(["a", "equipo", "insumo"]), rng.choice([None, "mensual"]), rng.random() < 0.7,
         rng.choice(["$ 1", "orientativo"]))
        for i in range(60)
    ]
    df = spark.createDataFrame(
        rows, "offer_id int, b string, source string, service_raw string, period string, period_known boolean, price_raw string"
    )
    counts = cm.pair_verdict_counts(df, ["b"], ("s1",))
    got = {(r.b, r.state, r.cause, r.warning): r.pairs for r in counts.collect()}
    pairs = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1]]
    listed = cm.compare_pairs(df, spark.createDataFrame(pairs, "left_id int, right_id int"), ("s1",))
    blocks = {r[0]: r[1] for r in rows}
    want = {}
    for r in listed.collect():
        key = (blocks[r.left_id], r.state, r.cause, r.warning)
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_median_reference():
    assert statistics.median([1, 2, 3, 10]) == 2.5
