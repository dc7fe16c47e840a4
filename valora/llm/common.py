"""What the operators of this package share: the shared folder, staged tables, skew-safe joins."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, else beside the warehouse.

    Both are shared by the executors of a cluster; a machine-local folder is never used.
    """
    context = spark.sparkContext
    named = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_staged").rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The rows are computed once, later plans start at the files, and a lost executor loses
    nothing that has been written.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete tables that `staged` wrote, once nothing that is still to run reads them."""
    for table in tables:
        session = table.sparkSession
        shared = shared_folder(session)
        for file in table.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if folder.rsplit("/", 2)[-2] == shared.rsplit("/", 1)[-1]:
                path = session._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salt_of(column: Column | str, salts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def keyed_join(
    left: DataFrame, right: DataFrame, keys: list[str], salt_by: str, how: str = "inner"
) -> DataFrame:
    """Join many rows of ``left`` to the one row per key of ``right`` without a hot task.

    The rows of a key are salted by ``salt_by``. The distinct (key, salt) pairs meet the
    right side first, at most one row per salt for each key, and what they fetch meets the
    rows of the same key and salt. Keys must not be null.
    """
    spark = left.sparkSession
    salted = left.withColumn("_salt", salt_of(salt_by, partitions(spark)))
    pairs = salted.select(*keys, "_salt").distinct()
    fetched = pairs.join(right, keys, "inner")
    return salted.join(fetched, [*keys, "_salt"], how).drop("_salt")


#: Text bytes that a Python task works on at once; a longer text is a part by itself.
PART_BYTES = 4 << 20


def in_parts(batches, column: int, most: int = PART_BYTES):
    """Arrow batches cut into parts of at most ``most`` bytes of a text column, order kept."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def ship_package(spark: SparkSession) -> None:
    """Let Python tasks import this package even where it is not installed on the workers."""
    context = spark.sparkContext
    if getattr(context, "_valora_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="valora-code-")  # Spark serves the file until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "valora_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(path)
    context._valora_shipped = True


#: Bits of a membership filter: 8 MB, whatever the size of the tables.
FILTER_BITS = 1 << 26


def membership_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A one-hash Bloom filter of a column of hashes as 64-bit words, at most ``bits`` / 64.

    The low bits of a hash are its place in the filter. It only spares later shuffles: it has no false negatives, and the rows that it lets pass
    by mistake are removed by the join that follows. Its size is fixed, so it may be sent to
    every executor; when the keys outgrow it, it passes more and more rows.
    """
    place = F.col(column).bitwiseAND(bits - 1)
    words = (
        keys.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("mask"))
    )
    found = words.toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[found["word"].to_numpy()] = found["mask"].to_numpy()
    return out


def passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``hashes`` (as signed integers) may be in the filter."""
    places = hashes & (64 * len(words) - 1)
    return (words[places >> 6] >> (places & 63)) & 1 == 1


_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, for arrays of unsigned integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))
