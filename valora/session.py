"""Session defaults, the shared checkpoint folder, and the package on the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Runtime settings the rule-heavy projections need. A generated method above 8000 bytes is never
# JIT-compiled by HotSpot, so letting such a stage run as smaller compiled pieces is faster.
RUNTIME = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


#: Partitions to deal a scanned table out to before its rules run. Only for tables that are one
#: small file, which a single task would read; unset, scans are used as they are.
SCAN_PARTITIONS = "spark.valora.scanPartitions"


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that the caller made."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("valora")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config(SCAN_PARTITIONS, cores if cores.isdigit() else "8")
    )
    for key, value in {**SETTINGS, **RUNTIME}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, it lies in the warehouse, which all executors share as well.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and return it with a short plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Let Python tasks import this package where it is not installed on the workers."""
    context = spark.sparkContext
    if getattr(context, "_valora_on_workers", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="valora-package-")  # Spark serves the file until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "valora_core.zip")
    with zipfile.ZipFile(path, "w") as out:
        for here, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(here, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._valora_on_workers = True
