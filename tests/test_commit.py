"""Tables written as one, and the canonical text of landed JSON."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from valora.functions.json_text import canonical_text
from valora.sources import commit as cm
from valora.sources import evidence as ev

ORDERS = "raw_document_id bigint, extractor_version string, arrival bigint"
LINES = "raw_document_id bigint, line int"


def delivery(spark, first, last, arrival=0):
    orders = spark.createDataFrame([(i, "v", arrival + i) for i in range(first, last)], ORDERS)
    lines = spark.createDataFrame([(i, k) for i in range(first, last) for k in range(i % 3)], LINES)
    return orders, lines


def stored(spark, root):
    tables = [cm.read_committed(spark, root, n) for n in ("orders", "lines")]
    return [None if t is None else sorted(r.raw_document_id for r in t.collect()) for t in tables]


def test_orders_and_lines_are_committed_as_one(spark, tmp_path):
    root = str(tmp_path / "set")
    assert stored(spark, root) == [None, None] and cm.latest_version(spark, root) == 0
    assert cm.commit_orders(spark, root, *delivery(spark, 0, 6), "arrival") == 1
    first = stored(spark, root)
    assert first == [list(range(6)), [1, 2, 2, 4, 5, 5]]
    assert cm.commit_orders(spark, root, *delivery(spark, 3, 9, 100), "arrival") == 2
    assert stored(spark, root) == [list(range(9)), [1, 2, 2, 4, 5, 5, 7, 8, 8]]
    assert cm.read_committed(spark, root, "orders", 1).count() == 6
    assert cm.commit_orders(spark, root, *delivery(spark, 0, 0), "arrival") == 3
    assert len(stored(spark, root)[0]) == 9


@pytest.mark.parametrize("lost", ["lines", "manifest"])
def test_a_lost_writer_leaves_nothing(spark, tmp_path, monkeypatch, lost):
    root = str(tmp_path / "set")
    cm.commit_orders(spark, root, *delivery(spark, 0, 3), "arrival")
    before = stored(spark, root)
    orders, lines = delivery(spark, 3, 6)
    with monkeypatch.context() as patch:
        if lost == "lines":  # the task that writes lines dies after the orders were written
            lines = lines.withColumn("line", F.raise_error(F.lit("lost")).cast("int"))
        else:  # the driver dies between data and manifest

            def killed(*_):
                raise RuntimeError("lost")

            patch.setattr(cm, "_place_manifest", killed)
        with pytest.raises(Exception, match="lost"):
            cm.commit_orders(spark, root, orders, lines, "arrival")
    assert stored(spark, root) == before and len(os.listdir(f"{root}/data")) == 2
    assert cm.sweep_orphans(spark, root, 3600) == []
    assert len(cm.sweep_orphans(spark, root, -60)) == 1
    assert stored(spark, root) == before and len(os.listdir(f"{root}/data")) == 1
    cm.commit_orders(spark, root, *delivery(spark, 3, 6), "arrival")
    assert stored(spark, root)[0] == list(range(6))


def test_two_writers_and_changed_columns(spark, tmp_path):
    root = str(tmp_path / "set")
    one = spark.range(3)
    assert cm.commit_tables(spark, root, {"t": one}) == 1
    assert cm.commit_tables(spark, root, {"t": one}, base=1) == 2
    with pytest.raises(cm.CommitConflict):
        cm.commit_tables(spark, root, {"t": one}, base=1)
    assert cm.read_committed(spark, root, "t").count() == 6
    with pytest.raises(ValueError, match="t.id"):
        cm.commit_tables(spark, root, {"t": one.select(F.col("id").cast("string"))})
    cm.commit_tables(spark, root, {"t": one.withColumn("more", F.lit("x"))})
    assert cm.read_committed(spark, root, "t").where("more IS NULL").count() == 6
    cm.commit_tables(spark, root, {"t": one, "u": one}, replace=("t",))
    assert cm.read_committed(spark, root, "t").count() == 3
    assert [n for n in os.listdir(f"{root}/manifests") if n.endswith(".draft")] == []
    assert len(cm.sweep_orphans(spark, root, -60, keep_versions=1)) == 4
    assert cm.versions(spark, root) == [4] and cm.read_committed(spark, root, "u").count() == 3


def test_documents_and_outcomes_are_committed_as_one(spark, tmp_path):
    root = str(tmp_path / "set")
    docs = spark.createDataFrame([(i, "s", f"r{i % 3}", "same") for i in range(6)], "arrival bigint, source string, source_record_id string, raw_content string")
    for _ in range(2):
        cm.commit_raw_documents(spark, root, docs, "arrival")
    assert cm.read_committed(spark, root, "documents").count() == 3
    outcomes = cm.read_committed(spark, root, "outcomes").groupBy("outcome").count()
    assert {r.outcome: r["count"] for r in outcomes.collect()} == {"ACQUIRED": 3, "DUPLICATE": 9}


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"b":1,"a":[ ]}', '{"a": [], "b": 1}'),
        ('{"a":1,"a":2}', '{"a": 2}'),
        ('{"x":1.50,"y":1e3,"z":12345678901234567890,"w":-0}', '{"w": 0, "x": 1.5, "y": 1000.0, "z": 12345678901234567890}'),
        ('{"x":1e-7,"y":1e16,"z":123456789012345680.0}', '{"x": 1e-07, "y": 1e+16, "z": 1.2345678901234568e+17}'),
        ('{"t":"\\u00e1\\/\\u0001\\u007f\\n\\"\\ud83d\\ude00"}', '{"t": "á/\\u0001\x7f\\n\\"😀"}'),
        ('{"é":null,"z":true,"Z":false,"😀":0,"￮":1}', '{"Z": false, "z": true, "é": null, "￮": 1, "😀": 0}'),
        ('{"t":"\\ud83d"}', None),
        ("oops", None),
        ("", None),
        ("[" * 100000, None),
        (None, None),
    ],
)
def test_canonical_text(text, want):
    assert canonical_text(text) == want


def test_landed_content(spark):
    rows = [(1, '{"publication-number":"7","b":"ñ"}'), (2, None), (3, "oops"), (4, '{"publication-number":"8","t":"\\ud83d"}')]
    got = ev.notice_documents(spark.createDataFrame(rows, "arrival bigint, payload string"), "n/%s").orderBy("arrival").collect()
    want = '{"b": "ñ", "publication-number": "7"}'
    assert (got[0].raw_content, got[0].content_hash) == (want, hashlib.sha256(want.encode()).hexdigest())
    assert [r.reject_reason for r in got] == [None, "invalid raw JSON", "invalid raw JSON", "invalid raw JSON"]
