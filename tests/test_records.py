"""Records of delimited files against Python's csv reader, cut at any place."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from valora.sources import files as fi
from valora.sources.records import ends_inside, quoted_records, record_cells


def drawn(pick, d, size):
    text = "".join(pick.choice(['"', '"', d, "a", "\n", "\n", "ñ ", "\r\n", '""']) for _ in range(size))
    return text + '"' if quotes_open(text, d) else text


def quotes_open(text, d):
    """Whether the last field is never closed: one more letter goes into the same record."""
    count = lambda t: sum(len(r) for r in csv.reader(io.StringIO(t, newline="\n"), delimiter=d))
    try:
        return count(text + "\n" + d + "\n") == count(text)
    except csv.Error:
        return False


def rows_of(text, d):
    return [r for r in csv.reader(io.StringIO(text, newline="\n"), delimiter=d) if r]


@pytest.mark.parametrize("bits", [0, 2, 13])
def test_random_texts(spark, bits):
    pick = random.Random(bits)
    texts = {}
    while len(texts) < 60:
        d = pick.choice(",;\t|")
        text = drawn(pick, d, pick.randrange(300))
        try:
            texts[str(len(texts))] = text, d, rows_of(text, d)
        except csv.Error:
            continue  # a carriage return in the middle of a line
    lines = []
    for name, (text, d, _) in texts.items():
        parts = text.split("\n")
        parts = parts[:-1] if parts[-1] == "" else parts
        lines += [(name, (int(name) << 20) + k, x, d) for k, x in enumerate(parts)]
    df = spark.createDataFrame(lines, "file string, _id long, value string, delimiter string").repartition(5)
    got = {}
    for r in record_cells(quoted_records(df, bits)).collect():
        got.setdefault(r.file, []).append((r.record_no, r.cells))
    for name, (_, _, want) in texts.items():
        found = sorted(got.get(name, []))
        assert found == list(enumerate(want)), texts[name]


def test_many_quotes_in_a_line(spark):
    """No recursion over the quotes of a line, and linear time."""
    line = '"' + '""' * 200_000 + "x" * 200_000
    df = spark.createDataFrame([(line, ","), (line + '"', ",")], "line string, d string")
    out = df.select(*[ends_inside(F.col("line"), F.col("d"), s).alias(str(s)) for s in (False, True)]).collect()
    assert [(r["False"], r["True"]) for r in out] == [(True, False), (False, False)]


def test_files_in_pieces(spark, tmp_path):
    """A folder of files of three encodings and delimiters, scanned 64 bytes at a time."""
    pick = random.Random(9)
    want = []
    for k, (encoding, d) in enumerate((("utf-8-sig", ","), ("cp1252", ";"), ("utf-8", "|"))):
        rows = [["Numero_Proceso", "Otro", "Otro"]]
        for n in range(40):
            rows.append([f"P{n}", pick.choice(["plain", f"two\nlines {d}", 'q"uo"te', "ñandú €", "\r\n\n"]), f"last {n}"])
        out = io.StringIO(newline="\n")
        csv.writer(out, delimiter=d, lineterminator=pick.choice(["\n", "\r\n"])).writerows(rows)
        (tmp_path / f"{k}.csv").write_bytes(out.getvalue().encode(encoding))
        want += [(n, {"Numero_Proceso": r[0], "Otro": r[2]}) for n, r in enumerate(rows[1:], 2)]
        want_second = rows[5][1]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        got = fi.read_bulk(spark, str(tmp_path), "R", "Convocatorias 2015", multiline=True)
        assert got.rdd.getNumPartitions() >= 1
        found = [(r.row_number, r.row_raw) for r in got.collect()]
        one = fi.bulk_records(
            spark.read.option("lineSep", "\n").text(str(tmp_path / "2.csv")).select(
                F.input_file_name().alias("file"), "value", F.monotonically_increasing_id().alias("_id")
            ),
            1,
        )
        assert one.where("row_number = 6").first().cells[1] == want_second
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    key = lambda x: (x[0], sorted(x[1].items()))
    assert sorted(found, key=key) == sorted(want, key=key)


def test_malformed_record(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes(b"Numero_Proceso,b\nP1,x\nP2,a\rb\nP3,\n")
    out = fi.read_bulk(spark, str(path), "R", "Convocatorias 2015").orderBy("row_number").collect()
    assert [(r.row_number, r.stable_id, r.reject_reason) for r in out] == [
        (2, "P1", None), (3, "UNKNOWN", "malformed record"), (4, "P3", None),
    ]
