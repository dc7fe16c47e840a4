"""Records of delimited files whose quoted fields may go on over line ends.

Where a record ends depends on all quotes before it. Each line is a function of the state at its
begin (outside or inside a quoted field) to the state at its end. Lines are taken in chunks; a
chunk's function, composed of its lines', is one small row, and a scan over these rows gives the
state in which each chunk begins. Then all chunks are cut into records at the same time. A
record that lies in one line goes on as it is; only the parts of the others are brought together.
"""

from __future__ import annotations

import csv
import io
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.session import ship_package

#: Lines of a chunk, as a power of two.
CHUNK_BITS = 13

# States while a line is read: at the begin of a field, within an unquoted field, within a
# quoted field, behind a quote in a quoted field.
_BEGIN, _PLAIN, _QUOTED, _CLOSED = range(4)


def ends_inside(line: Column, delimiter: Column, begins_inside: bool) -> Column:
    """Whether a quoted field is open at the end of a line, given whether one is at its begin.

    The text between two quotes moves the state, and so does each quote; a quote within an
    unquoted field is an ordinary character, and two within a quoted one are a character of it.
    """

    def text(state: Column, part: Column) -> Column:
        moved = F.when(F.endswith(part, delimiter), _BEGIN).otherwise(_PLAIN)
        return F.when((part == "") | (state == _QUOTED), state).otherwise(moved)

    def quote(state: Column) -> Column:
        return (
            F.when(state == _BEGIN, _QUOTED)
            .when(state == _QUOTED, _CLOSED)
            .when(state == _CLOSED, _QUOTED)
            .otherwise(_PLAIN)
        )

    parts = F.split(line, '"')
    start = text(F.lit(_QUOTED if begins_inside else _BEGIN), F.get(parts, F.lit(0)))
    state = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), start, lambda s, p: text(quote(s), p)
    )
    return F.when(F.contains(line, F.lit('"')), state == _QUOTED).otherwise(F.lit(begins_inside))


def _after(when_outside: Column, when_inside: Column, window) -> tuple[Column, Column]:
    """States after the functions of a window's rows, for both states at its begin.

    The last constant function decides, and the flips behind it turn its value.
    """
    constant = when_outside == when_inside
    flips = F.count_if(when_outside & ~when_inside).over(window)
    seen = F.struct(when_outside.alias("value"), F.col("_flips_here").alias("flips"))
    last = F.last(F.when(constant, seen), ignorenulls=True).over(window)
    turned = (flips - F.coalesce(last["flips"], F.lit(0))) % 2 == 1
    return tuple(F.coalesce(last["value"], F.lit(start)) != turned for start in (False, True))


def _scanned(rows: DataFrame, keys: list[str], order: str, out: tuple[str, str]) -> DataFrame:
    """Add the states before each row, if outside or inside before the first row of its keys."""
    whole = Window.partitionBy(*keys).orderBy(order)
    flip = F.count_if(F.col("when_outside") & ~F.col("when_inside"))
    here = rows.withColumn("_flips_here", flip.over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    outside, inside = _after(F.col("when_outside"), F.col("when_inside"), before)
    return here.withColumns({out[0]: outside, out[1]: inside}).drop("_flips_here")


def quoted_records(lines: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """``file``, ``record_no`` (from 0), ``delimiter`` and ``record`` of all records.

    Input: ``file``, ``_id`` in line order, ``value`` without its line feed, ``delimiter`` of the
    file. Line ends within quotes are kept, blank records are left out and not numbered; a field
    that is never closed ends with the file, without its last line feed. Lines are
    shuffled once; no task holds more than a chunk of 2 ** ``chunk_bits`` lines, the parts of a
    record, or the chunks' rows of a file.
    """
    at = ["file", "_chunk"]
    marked = lines.select(
        "file", "_id", "value", "delimiter", F.shiftright("_id", chunk_bits).alias("_chunk"),
        ends_inside(F.col("value"), F.col("delimiter"), False).alias("when_outside"),
        ends_inside(F.col("value"), F.col("delimiter"), True).alias("when_inside"),
        (F.rtrim("value", F.lit("\r")) == "").alias("_blank"),
    )
    marked = _scanned(marked, at, "_id", ("_if_outside", "_if_inside"))

    def after(state: str) -> Column:
        return F.when(F.col(state), F.col("when_inside")).otherwise(F.col("when_outside"))

    def starts(state: str) -> Column:
        return ~F.col(state) & ~F.col("_blank")

    chunks = marked.groupBy(*at).agg(
        *(F.max_by(after(s), F.col("_id")).alias(f"_end{s}") for s in ("_if_outside", "_if_inside")),
        *(F.count_if(starts(s)).alias(f"_n{s}") for s in ("_if_outside", "_if_inside")),
        *(F.max(F.when(starts(s), F.col("_id"))).alias(f"_last{s}") for s in ("_if_outside", "_if_inside")),
    )
    named = chunks.withColumnsRenamed({"_end_if_outside": "when_outside", "_end_if_inside": "when_inside"})
    begun = _scanned(named, ["file"], "_chunk", ("_inside", "_unused"))

    def chosen(name: str) -> Column:
        return F.when(F.col("_inside"), F.col(f"{name}_if_inside")).otherwise(F.col(f"{name}_if_outside"))

    before = Window.partitionBy("file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.withColumns({"_n": chosen("_n"), "_last": chosen("_last")}).select(
        *at,
        "_inside",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.last("_last", ignorenulls=True).over(before).alias("_open"),
    )
    # The state before each line is known now; a record is known by its first line.
    here = marked.join(begun, at).withColumn(
        "_state", F.when(F.col("_inside"), F.col("_if_inside")).otherwise(F.col("_if_outside"))
    )
    up_to = Window.partitionBy(*at).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    here = here.where(F.col("_state") | ~F.col("_blank")).withColumns(
        {
            "_first": F.coalesce(
                F.last(F.when(~F.col("_state"), F.col("_id")), ignorenulls=True).over(up_to), F.col("_open")
            ),
            "_no": F.col("_before") + F.count_if(~F.col("_state")).over(up_to) - 1,
            "_goes_on": after("_state"),
        }
    )
    alone = ~F.col("_state") & ~F.col("_goes_on")
    single = here.where(alone).select("file", F.col("_no").alias("record_no"), "delimiter", F.col("value").alias("record"))
    parts = F.sort_array(F.collect_list(F.struct("_id", "value")))
    joined = (
        here.where(~alone)
        .groupBy("file", "_first")
        .agg(
            F.min("_no").alias("record_no"),
            F.first("delimiter").alias("delimiter"),
            F.array_join(parts["value"], "\n").alias("record"),
        )
        .drop("_first")
    )
    return single.unionByName(joined)


def record_cells(records: DataFrame) -> DataFrame:
    """Add ``cells``, the fields of ``record`` as a csv reader gives them; null if it cannot be read."""
    ship_package(records.sparkSession)
    names = records.columns
    record, delimiter = names.index("record"), names.index("delimiter")

    def run(batches):
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            cells = []
            for text, mark in zip(batch.column(record).to_pylist(), batch.column(delimiter).to_pylist()):
                try:
                    cells.append(next(csv.reader(io.StringIO(text, newline="\n"), delimiter=mark), []))
                except csv.Error:
                    cells.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.string()))], [*names, "cells"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    return records.mapInArrow(run, f"{schema}, cells array<string>")
