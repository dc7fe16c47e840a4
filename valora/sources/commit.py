"""Several tables written as one: data files first, then one manifest that names them.

Under a root folder lie ``data/<commit>/<table>/`` with Parquet files and ``manifests/<version>.json``.
Readers see only what the newest manifest names, so a task, driver or cluster lost before the manifest is
in place leaves nothing of the commit, and after it everything. The manifest is put in place by a rename that
refuses an existing name: the file system must do that atomically, as HDFS does. Of two writers that started
from the same version one gets `CommitConflict` and starts again from the new version, since which of its
rows are new depends on what is stored. A manifest holds a folder name per commit, never data.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from valora.operators.dedup import only_new, with_children
from valora.sources.evidence import append_raw_documents

Written = dict[str, DataFrame]


class CommitConflict(RuntimeError):
    """Another writer committed the version that this one was about to."""


# --- folders --------------------------------------------------------------------------------------


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.makeQualified(path)


def _entries(spark: SparkSession, *parts: str) -> list:
    files, path = _path(spark, *parts)
    return list(files.listStatus(path)) if files.exists(path) else []


def _manifest_name(version: int) -> str:
    return f"{version:020d}.json"


def _place_manifest(spark: SparkSession, root: str, version: int, text: str) -> None:
    files, draft = _path(spark, root, "manifests", f".{uuid.uuid4().hex}.draft")
    _, final = _path(spark, root, "manifests", _manifest_name(version))
    out = files.create(draft, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    rename_options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        context.rename(draft, final, rename_options)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if files.exists(final):
            raise CommitConflict(f"version {version} of {root} is taken") from error
        raise


# --- reading --------------------------------------------------------------------------------------


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, oldest first."""
    names = [entry.getPath().getName() for entry in _entries(spark, root, "manifests")]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def latest_version(spark: SparkSession, root: str) -> int:
    """The newest committed version; 0 before the first."""
    return max(versions(spark, root), default=0)


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    """Tables of a version: name -> ``schema`` and ``folders``."""
    if version == 0:
        return {}
    _, path = _path(spark, root, "manifests", _manifest_name(version))
    return json.loads(spark.read.text(path.toString(), wholetext=True).head()[0])["tables"]


def read_committed(
    spark: SparkSession, root: str, table: str, version: int | None = None
) -> DataFrame | None:
    """A table as of a version, the newest by default; None if that version has no such table."""
    at = latest_version(spark, root) if version is None else version
    entry = manifest(spark, root, at).get(table)
    if entry is None:
        return None
    schema = StructType.fromJson(entry["schema"])
    return spark.read.schema(schema).parquet(*[f"{root}/data/{f}" for f in entry["folders"]])


# --- writing --------------------------------------------------------------------------------------


def commit_tables(
    spark: SparkSession,
    root: str,
    tables: Mapping[str, DataFrame | Callable[[Written], DataFrame]],
    base: int | None = None,
    replace: Sequence[str] = (),
) -> int:
    """Append ``tables`` to those of version ``base`` (the newest) and return the new version.

    A table may be a function of the tables that this commit has already written: what follows from
    another table then follows from its rows as stored. Tables named in ``replace`` lose their earlier
    rows. Columns may be added; a column that changes its type is refused before anything is written.
    """
    at = latest_version(spark, root) if base is None else base
    entries = manifest(spark, root, at)
    commit = uuid.uuid4().hex
    written: Written = {}
    for name, table in tables.items():
        df = table if isinstance(table, DataFrame) else table(written)
        before = entries.get(name) if name not in replace else None
        schema = _widened(name, before, df.schema)
        folder = f"{commit}/{name}"
        df.write.parquet(f"{root}/data/{folder}")
        written[name] = spark.read.schema(df.schema).parquet(f"{root}/data/{folder}")
        folders = [*(before["folders"] if before else []), folder]
        entries[name] = {"schema": schema.jsonValue(), "folders": folders}
    text = json.dumps({"version": at + 1, "tables": entries}, sort_keys=True)
    _place_manifest(spark, root, at + 1, text)
    return at + 1


def _widened(name: str, before: dict | None, new: StructType) -> StructType:
    known = {f.name: f for f in StructType.fromJson(before["schema"])} if before else {}
    for field in new:
        old = known.setdefault(field.name, field)
        if old.dataType != field.dataType:
            raise ValueError(f"{name}.{field.name}: {old.dataType} is stored, got {field.dataType}")
    return StructType(list(known.values()))


def sweep_orphans(
    spark: SparkSession, root: str, older_than_seconds: float, keep_versions: int = 0
) -> list[str]:
    """Delete what no manifest names and return its names.

    ``keep_versions`` > 0 first drops all manifests but that many of the newest. Folders and drafts
    younger than ``older_than_seconds`` may belong to a running writer and stay.
    """
    known = versions(spark, root)
    dropped = known[:-keep_versions] if keep_versions > 0 else []
    named: set[str] = set()
    for version in known[len(dropped) :]:
        for entry in manifest(spark, root, version).values():
            named.update(entry["folders"])
    limit = (time.time() - older_than_seconds) * 1000
    commits = _entries(spark, root, "data")
    drafts = [e for e in _entries(spark, root, "manifests") if e.getPath().getName().endswith(".draft")]
    orphans = [e for e in drafts if e.getModificationTime() < limit]
    for commit in commits:
        name = commit.getPath().getName()
        tables = _entries(spark, root, "data", name)
        unnamed = [t for t in tables if f"{name}/{t.getPath().getName()}" not in named]
        youngest = max([commit.getModificationTime(), *[t.getModificationTime() for t in tables]])
        if youngest < limit:
            orphans += [commit] if len(unnamed) == len(tables) else unnamed
    for version in dropped:
        files, path = _path(spark, root, "manifests", _manifest_name(version))
        files.delete(path, False)
    for entry in orphans:
        files, path = _path(spark, entry.getPath().toString())
        files.delete(path, True)
    return sorted(e.getPath().getName() for e in orphans)


# --- evidence -------------------------------------------------------------------------------------


def commit_orders(
    spark: SparkSession,
    root: str,
    orders: DataFrame,
    lines: DataFrame,
    order: str,
    key: Sequence[str] = ("raw_document_id", "extractor_version"),
    lines_on: Sequence[str] = ("raw_document_id",),
) -> int:
    """New orders and their lines, both or neither; a duplicate order drops its lines too."""
    base = latest_version(spark, root)
    stored = read_committed(spark, root, "orders", base)
    return commit_tables(
        spark,
        root,
        {
            "orders": only_new(orders, key, order, stored),
            "lines": lambda written: with_children(written["orders"], lines, lines_on),
        },
        base,
    )


def commit_raw_documents(spark: SparkSession, root: str, incoming: DataFrame, order: str) -> int:
    """New documents and the outcome of every arrival, written as one."""
    base = latest_version(spark, root)
    stored = read_committed(spark, root, "documents", base)
    marked = append_raw_documents(incoming, stored, order)
    new = marked.filter("outcome = 'ACQUIRED'").drop("outcome")
    outcomes = marked.select(order, "source", "source_record_id", "content_hash", "outcome")
    return commit_tables(spark, root, {"documents": new, "outcomes": outcomes}, base)
