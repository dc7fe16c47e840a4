import random

from pyspark.sql import functions as F

from valora.llm.line_dedup import LineRuns, dedup_lines

LONG = "A line that is long enough "
STRIP = " \t\n\x0b\x0c\r"


def want(rows, least=20, min_docs=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(STRIP).translate(lower)
    docs = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= least:
                    docs.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(docs.get(key(x), ())) < min_docs or max(docs[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


CASES = [
    (1, None), (2, ""), (3, "\n\n"), (4, LONG + "\nshort\n" + LONG), (5, " " + LONG.upper() + "\r\nx"), (6, LONG),
    (7, "É" * 20 + "\n" + "é" * 20), (8, "É" * 20), (9, "é" * 20), (10, "é" * 20), (11, "é" * 19 + "\n" + "x" * 300_000),
    (12, "é" * 19), (13, "é" * 19), (None, LONG), (14, "only two of these lines"), (15, "only two of these lines"),
    (16, "three of these in all rows"), (16, "three of these in all rows"), (17, "three of these in all rows"),
    (18, " three of these in all rows"), (19, "three of these in all rows\x0b"),
]


def test_cases(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string").selectExpr("*", "'clash' AS n_lines", "1 AS line")
    out = dedup_lines(docs.repartition(3))
    assert got(out) == want(CASES)
    assert set(out.columns) == {"doc_id", "text", "line", "n_lines", "n_dropped"}


def test_random_batches(spark):
    rng = random.Random(5)
    lines = [f"Line number {k} of the random corpus" for k in range(60)]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for batches in (1, 3, 7):
        assert got(dedup_lines(docs, batches=batches)) == want(rows)


def test_empty_and_hot(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(empty).count() == 0
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(LONG).alias("text"))
    assert dedup_lines(hot).where("text != ''").collect()[0].doc_id == 3999


def test_runs_are_compacted(spark):
    runs = LineRuns(spark, min_docs=2, fanout=2)
    for ids in ([9, 8], [7, 6], [5, 4], [3, 2]):
        keys = spark.createDataFrame([(bytes([k]), i) for k in (1, 2) for i in ids[:k]], "line binary, doc_id long")
        runs.add(keys)
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    rows = {bytes(r.line): (r.n, r.top) for r in spark.read.parquet(runs.compact()).collect()}
    # key 2 was settled by the first batch and not stored again, key 1 by the second
    assert rows == {b"\x01": (2, 9), b"\x02": (2, 9)}
