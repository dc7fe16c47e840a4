"""Line dedup: lines that many documents hold stay in one of them.

Line keys are kept in sorted runs on levels, like the tables of a log-structured store. A batch
of documents merge-anti-joins the runs, so that keys that are settled there are not stored
again, and adds its own keys as a new run of the lowest level. When a level is full, its runs
are compacted into one run of the next. Batches come from the largest document ids down: the
first batch that holds a key holds the document that keeps it.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.llm.common import in_parts, new_folder, ship_package

_STRIP = b" \t\n\x0b\x0c\r"
RUN_SCHEMA = "line binary, n long, top long"


def line_key(line: bytes, least: int) -> bytes | None:
    """128-bit hash of a stripped line in lower ASCII case, None if it is too short."""
    key = line.strip(_STRIP).lower()  # bytes: only A-Z change
    if len(key) < least:
        return None
    if not key.isascii() and sum(b & 0xC0 != 0x80 for b in key) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """``line`` and ``doc_id`` for each distinct long key of each document."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in in_parts(batches, 1):
            keys, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = {line_key(x, least) for x in (text.as_py() or b"").split(b"\n")}
                found.discard(None)
                keys += found
                ids += [doc] * len(found)
                if len(keys) > 100_000:
                    yield _keys(keys, ids)
                    keys, ids = [], []
            if keys:
                yield _keys(keys, ids)

    def _keys(keys, ids):
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["line", "doc_id"]
        )

    narrow = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "line binary, doc_id long")


class LineRuns:
    """Sorted runs of line keys on levels, in files of the shared folder.

    A row says in how many documents of a batch a key was, and the largest of their ids. A key
    may be in several runs until they are compacted. ``fanout`` runs of a level become one.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2) -> None:
        self.spark = spark
        self.min_docs = min_docs
        self.fanout = fanout
        self.levels: list[list[str]] = [[]]

    def _read(self, paths: list[str]) -> DataFrame:
        empty = self.spark.createDataFrame([], RUN_SCHEMA)
        runs = (self.spark.read.schema(RUN_SCHEMA).parquet(p) for p in paths)
        return reduce(DataFrame.unionByName, runs, empty)

    def _merged(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy("line").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def _write(self, rows: DataFrame, level: int) -> None:
        path = new_folder(self.spark, f"line-run-{level}")
        rows.select("line", "n", "top").sortWithinPartitions("line").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def all_runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def settled(self) -> DataFrame:
        """Keys that are known to be in enough documents."""
        return self._merged(self.all_runs()).where(F.col("n") >= self.min_docs)

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (line, doc_id), whose ids are below those of all earlier batches."""
        own = keys.groupBy("line").agg(
            F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")
        )
        if self.all_runs():
            own = own.join(self.settled().select("line").hint("merge"), "line", "left_anti")
        self._write(own, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            level += 1

    def compact(self) -> str:
        """Make all runs one, with the whole counts; returns its path."""
        paths = self.all_runs()
        self.levels = [[] for _ in self.levels]
        self._write(self._merged(paths), len(self.levels))
        return self.levels[-1][0]


def dedup_lines(
    docs: DataFrame,
    least: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``text`` after the dedup, and ``n_lines`` before it and ``n_dropped``.

    A key of at least ``least`` code points that is in at least ``min_docs`` documents loses
    its lines in all of them but the one of the largest id, where all its lines stay. Null and
    empty texts are one empty line and become the empty text. Rows of one id are one document.
    Rows with a null id count in no document and keep all lines. Other columns are kept; those
    named ``n_lines`` or ``n_dropped`` are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop("n_lines", "n_dropped")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = keyed.where(F.col("doc_id").isNotNull())

    shares = [k / batches for k in range(1, batches)]
    cuts = sorted(set(keyed.approxQuantile("doc_id", shares, 0.01))) if shares else []
    edges = [None, *[int(c) for c in cuts], None]
    runs = LineRuns(spark, min_docs)
    for low, high in reversed(list(zip(edges, edges[1:]))):
        part = keyed
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        runs.add(line_keys(part, least).distinct())
    path = runs.compact()

    repeated = spark.read.schema(RUN_SCHEMA).parquet(path).where(F.col("n") >= min_docs)
    lost = (
        line_keys(keyed, least)
        .join(repeated.select("line", "top"), "line")
        .where(F.col("doc_id") < F.col("top"))
        .groupBy("doc_id")
        .agg(F.collect_set("line").alias("_lost"))
        .withColumnRenamed("doc_id", "_lost_id")
    )
    joined = docs.join(lost, docs[id_col].cast("long") == F.col("_lost_id"), "left").drop("_lost_id")
    at = joined.columns.index(text_col)

    def run(batches):
        for batch in in_parts(batches, at):
            texts, totals, drops = [], [], []
            for text, gone in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                lines = (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                totals.append(len(lines))
                if gone.is_valid:
                    keys = set(gone.as_py())
                    lines = [x for x in lines if line_key(x, least) not in keys]
                drops.append(totals[-1] - len(lines))
                texts.append(b"\n".join(lines).decode("utf-8", "surrogatepass"))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(totals, pa.int64()), pa.array(drops, pa.int64())],
                [*batch.schema.names[:-1], "n_lines", "n_dropped"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{schema}, n_lines long, n_dropped long")


def line_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM parts),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  '{_UPPER}', '{_LOWER}') AS line_key FROM lines),
repeated AS (SELECT line_key, max(doc_id) AS top FROM keyed WHERE length(line_key) >= 20
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, coalesce(k.doc_id < r.top, FALSE) AS gone FROM keyed k LEFT JOIN repeated r USING (line_key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
