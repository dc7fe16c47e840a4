"""Embedding near-dedup: all pairs of vectors with a high cosine, by a subspace pigeonhole join.

For unit vectors, cosine >= t means squared distance <= 2 - 2t. The vectors are rotated, which
spreads their energy evenly, and split into blocks of few dimensions. Each block gets a share
of the squared distance in proportion to its dimensions. If two vectors exceed their share in
every block, they exceed the sum; so a pair within the threshold is within the share of at
least one block.

Each block is a range join: a grid over its first dimensions brings together what may be in
range, and the distance in the block decides. A pair is taken in the first block that admits
it, and is verified there from the original components in double precision, so the union over
the blocks has each pair once. A task gives back, for each vector, the number of its links and
the least vector that they connect it with: rows in proportion to the vectors, not to the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.llm.common import keyed_join, ship_package, staged
from valora.llm.components import components

#: Allowance for rounding in squared distances; candidates are verified afterwards.
_SLACK = 1e-9
#: The same for the first look in single precision, whose error is below 1e-6 here.
_COARSE = 1e-5


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, made once on the driver so that all tasks use the same."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


class Blocks:
    """The blocks of rotated vectors of one dimension, with their shares and grids."""

    def __init__(self, dims: int, turn: np.ndarray, threshold: float, block: int, keys: int) -> None:
        self.turn = turn
        parts = np.array_split(np.arange(dims), max(1, round(dims / block)))
        self.starts = np.array([p[0] for p in parts])
        self.ends = np.array([p[-1] + 1 for p in parts])
        self.shares = (2 - 2 * threshold) * (self.ends - self.starts) / dims + _SLACK
        self.keys = keys
        self.width = max(2 / np.sqrt(dims), float(np.sqrt(self.shares.max())))

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / norms(vectors)[:, None]
        return np.einsum("ij,jk->ik", unit, self.turn, optimize=False)

    def cells(self, turned: np.ndarray, block: int):
        """Home cells of all vectors, and (row, cell) of the later cells in their range."""
        at = self.starts[block]
        keys = min(self.keys, self.ends[block] - at)
        x = turned[:, at : at + keys] / self.width
        home = np.floor(x).astype(np.int64)
        reach = self.shares[block] / self.width**2
        rows, cells = [], []
        for step in np.ndindex(*(3,) * keys):
            move = np.array(step) - 1
            if tuple(move) <= (0,) * keys:
                continue  # the earlier cell of a pair looks into the later one
            gap = np.where(move > 0, home + 1 - x, np.where(move < 0, x - home, 0))
            near = np.nonzero((gap**2).sum(axis=1) <= reach + _SLACK)[0]
            rows.append(near)
            cells.append(home[near] + move)
        return home, np.concatenate(rows), np.concatenate(cells)


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths in double precision; scaled first, so that no square over- or underflows."""
    top = np.abs(vectors).max(axis=1)
    return top * np.sqrt(((vectors / top[:, None]) ** 2).sum(axis=1))


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    fine = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    return F.coalesce(
        vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def _cell_code(block: int, cells: np.ndarray) -> np.ndarray:
    code = np.full(len(cells), block, dtype=np.int64)
    for k in range(cells.shape[1]):
        code = code * 65536 + cells[:, k] + 32768
    return code


def _block_rows(classes: DataFrame, blocks: dict[int, Blocks]) -> DataFrame:
    """Each vector in its home cell of each block, and in the later cells in its range."""

    def run(batches):
        for whole in batches:
            for part in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                dims_of = np.array([len(v) for v in part.column(2)])
                for dims in np.unique(dims_of):
                    rows = np.nonzero(dims_of == dims)[0]
                    some = part.take(pa.array(rows))
                    flat = some.column(2).flatten().to_numpy(zero_copy_only=False)
                    raw = flat.reshape(-1, dims)
                    shape = blocks[int(dims)]
                    turned = shape.rotated(raw.astype(np.float64))
                    data = np.array([raw[k].tobytes() for k in range(len(raw))], dtype=object)
                    reps = some.column(0).to_numpy()
                    copies = some.column(1).to_numpy()
                    for b in range(len(shape.starts)):
                        home, near, cells = shape.cells(turned, b)
                        at = np.concatenate([np.arange(len(raw)), near])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(at), dims), pa.int32()),
                                pa.array(np.full(len(at), b), pa.int32()),
                                pa.array(_cell_code(b, np.concatenate([home, cells])), pa.int64()),
                                pa.array(np.arange(len(at)) < len(raw), pa.bool_()),
                                pa.array(reps[at], pa.int64()),
                                pa.array(copies[at], pa.int64()),
                                pa.array(data[at], pa.binary()),
                            ],
                            ["dims", "block", "cell", "home", "rep", "copies", "data"],
                        )

    return classes.select("rep", "copies", "vector").mapInArrow(
        run,
        "dims int, block int, cell long, home boolean, rep long, copies long, data binary",
    )


def _joined(
    home: np.ndarray, other: np.ndarray, both: np.ndarray, reps, shape: Blocks, block: int,
    vectors: np.ndarray, threshold: float, cells: int = 1 << 20,
):
    """Pairs (row of ``other``, row of ``home``) that this block takes and that are links.

    ``both`` marks rows that are at home in this cell: of two such rows each pair counts once.
    All pairs are first looked at in single precision, with an allowance far above its error:
    |x - y|^2 <= s means x.y - |y|^2 / 2 >= (|x|^2 - s) / 2, one product and one comparison.
    """
    turned = shape.rotated(vectors)
    length = norms(vectors)
    lo, hi = shape.starts[block], shape.ends[block]
    sub = turned[:, lo:hi]
    square = (sub**2).sum(axis=1)
    left = np.c_[sub[other], np.ones(len(other))].astype(np.float32)
    right = np.c_[sub[home], -square[home] / 2].T.astype(np.float32)
    least = ((square[other] - shape.shares[block]) / 2 - _COARSE).astype(np.float32)[:, None]
    chunk = max(1, cells // max(1, len(home)))
    for k in range(0, len(other), chunk):
        rows = other[k : k + chunk]
        i, j = np.nonzero(left[k : k + chunk] @ right >= least[k : k + chunk])
        i, j = rows[i], home[j]
        once = ~both[i] | (reps[i] < reps[j])
        i, j = i[once], j[once]
        for m in range(0, len(i), 20_000):
            a, b = i[m : m + 20_000], j[m : m + 20_000]
            each = np.add.reduceat((turned[a] - turned[b]) ** 2, shape.starts, axis=1)
            admits = each <= shape.shares
            mine = admits[:, block] & ~admits[:, :block].any(axis=1)
            a, b = a[mine], b[mine]
            cosine = np.einsum("ij,ij->i", vectors[a] / length[a][:, None], vectors[b] / length[b][:, None])
            linked = cosine >= threshold
            yield a[linked], b[linked]


def _fold(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of the pairs (a, b); ``parent`` has the root of each node."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _links_and_roots(found, reps: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row how many documents it links with, and the least ``reps`` that it is
    connected with. The pairs of ``found`` are folded in as they come; none is kept."""
    links = np.zeros(len(reps), dtype=np.int64)
    parent = np.arange(len(reps))
    for a, b in found:
        np.add.at(links, a, many[b])
        np.add.at(links, b, many[a])
        _fold(parent, a, b)
    least = reps.copy()
    np.minimum.at(least, parent, reps)
    return links, least[parent]


def cosine_components(
    vectors: DataFrame,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    block: int = 8,
    keys: int = 2,
    tile: int = 1 << 20,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of each row of ``vectors``.

    Rows link when the cosine, in double precision, is at least ``threshold``; only vectors of
    the same number of dimensions are compared. A vector that is null, empty or zero, or holds
    null or non-finite components, links with nothing. Equal vectors are compared once and
    counted as often as they occur, repeated rows of one id too. A row with a null id links
    with nothing, has a null component and is not kept. Other columns are not read; an empty
    table gives no rows.

    ``block``: dimensions of a block; ``keys``: dimensions of a block's grid; ``tile``: vectors
    times dimensions of a cell that are compared in one task with as many others. Larger cells
    are split into tiles, and all pairs of tiles are joined. The grid has a number of cells that depends on
    the dimensions only, so the table of cell sizes may be broadcast.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    dtype = "<f4" if element == "float" else "<f8"
    kind = "float" if element == "float" else "double"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vector")
    )
    good = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    live = rows.where(good)
    classes = staged(
        live.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")),
        "cosine-classes",
    )
    sizes = [r[0] for r in classes.select(F.size("vector")).distinct().collect()]
    blocks = {d: Blocks(d, rotation(d), threshold, block, keys) for d in sizes}

    placed = staged(_block_rows(classes, blocks), "cosine-cells")
    cell = ["dims", "block", "cell"]
    size = F.greatest(F.lit(1), F.floor(F.lit(tile) / F.col("dims")))
    counts = placed.groupBy(*cell).agg(
        F.sum(F.col("home").cast("int")).alias("th"), F.count(F.lit(1)).alias("tp")
    )
    tiles = counts.where("th > 0").select(
        *cell, *[F.ceil(F.col(c) / size).cast("int").alias(c) for c in ("th", "tp")]
    )
    dealt = placed.join(F.broadcast(tiles), cell)
    h = F.pmod(F.xxhash64("rep"), F.col("th")).cast("int")
    p = F.when(F.col("home"), h).otherwise(F.pmod(F.xxhash64("rep"), F.col("tp")).cast("int"))
    own = F.struct(h.alias("h"), p.alias("p"), F.col("home").alias("is_home"), F.lit(True).alias("is_other"))
    seen = F.transform(
        F.sequence(F.lit(0), F.col("th") - 1),
        lambda k: F.struct(
            k.alias("h"), p.alias("p"), (F.col("home") & (k == h)).alias("is_home"), F.lit(True).alias("is_other")
        ),
    )
    shown = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.col("tp") - 1),
            lambda k: F.struct(h.alias("h"), k.alias("p"), F.lit(True).alias("is_home"), F.lit(False).alias("is_other")),
        ),
        lambda s: s["p"] != p,
    )
    copies = F.when(F.col("tp") == 1, F.array(own)).when(F.col("home"), F.concat(seen, shown)).otherwise(seen)
    spread = dealt.withColumn("to", F.explode(copies)).select(
        *cell, "home", "rep", "copies", "data", "to.h", "to.p", "to.is_home", "to.is_other"
    )

    def run(key, table):
        dims, at = key[0].as_py(), key[1].as_py()
        table = table.combine_chunks()
        raw = np.frombuffer(b"".join(table["data"].to_pylist()), dtype=dtype).reshape(-1, dims)
        reps = table["rep"].to_numpy()
        many = table["copies"].to_numpy()
        both = table["home"].to_numpy(zero_copy_only=False)
        home = np.nonzero(table["is_home"].to_numpy(zero_copy_only=False) & both)[0]
        other = np.nonzero(table["is_other"].to_numpy(zero_copy_only=False))[0]
        found = _joined(
            home, other, both, reps, blocks[dims], at, raw.astype(np.float64), threshold
        )
        links, roots = _links_and_roots(found, reps, many)
        some = links > 0
        return pa.table(
            {"rep": reps[some], "links": links[some], "root": roots[some]},
            pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]),
        )

    partial = staged(
        spread.groupBy(*cell, "h", "p").applyInArrow(run, "rep long, links long, root long"),
        "cosine-links",
    )
    degrees = partial.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(partial.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    named = (
        classes.join(degrees, "rep", "left")
        .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    out = keyed_join(live, named, ["vector"], "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return out.union(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )


def embedding_query(spark, sf_dir: str) -> DataFrame:
    return cosine_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
