"""Near-duplicate vectors by a range join on subspaces, exact for any data."""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.groups import in_blocks, map_groups, star
from epispark.llm.links import components, whole_numbers
from epispark.llm.store import saved

#: Vectors of a cell that one task compares with as many others.
BLOCK = 2048
#: Added to every bound, far above what rounding can do.
SLACK = 1e-6
#: Rotated coordinates are counted in steps, so that every task has the same ones.
STEPS = 1 << 22


def rotation(size: int) -> np.ndarray:
    """The same random orthogonal matrix in every task."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _budgets(size: int, width: int, least: float) -> tuple[list[slice], np.ndarray]:
    """Blocks of ``width`` dimensions, and the share of the squared distance that each may use."""
    blocks = [slice(a, min(a + width, size)) for a in range(0, size, width)]
    whole = 2 * (1 - least)
    return blocks, np.array([whole * (b.stop - b.start) / size for b in blocks]) + SLACK


def _keyed(batches):
    """A key for equal vectors of one label; none for vectors that link with nothing."""
    for batch in batches:
        keys, sizes = [], []
        for label, vector in zip(batch.column("label").to_pylist(), batch.column("vector")):
            held = vector.values if vector.is_valid else None
            x = None if held is None or held.null_count or not len(held) else held.to_numpy(zero_copy_only=False)
            good = label is not None and x is not None and np.isfinite(x).all() and (x != 0).any()
            keys.append(hashlib.md5(f"{label}|".encode() + (x + 0.0).tobytes()).digest() if good else None)
            sizes.append(len(x) if good else None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(keys, pa.binary()), pa.array(sizes, pa.int32())], [*batch.schema.names, "key", "size"])


def _turned(unit: np.ndarray) -> np.ndarray:
    """Rotated vectors in whole steps of 2^-22."""
    return np.rint(unit @ rotation(unit.shape[1]) * STEPS)


def _close(x: np.ndarray, budget: float) -> np.ndarray:
    """Which rows of ``x`` (in steps) are within the squared distance of each other."""
    x = x / STEPS
    square = (x * x).sum(axis=1)
    return square[:, None] + square - 2 * (x @ x.T) <= budget


def _able(x: np.ndarray, budget: float, home: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which pairs of a cell are to be verified there."""
    able = _close(x, budget) & (home[:, None] | home)
    if side.any():
        able &= side[:, None] != side
    np.fill_diagonal(able, False)
    return able


def _placed(least: float, width: int, grid: int):
    """Every vector in its home cell of each block, and in the cells before it that it can reach
    into: its key and the coordinates of the block, not the vector."""

    def place(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                turned = _turned(_matrix(part.column("vector")))
                part = part.select(["key", "label", "size"])
                blocks, budgets = _budgets(int(size), width, least)
                for number, (block, budget) in enumerate(zip(blocks, budgets)):
                    reach = np.sqrt(budget) + SLACK
                    step = 3 * reach
                    held = turned[:, block].astype(np.int32)
                    x = held[:, :grid] / STEPS
                    home = np.floor(x / step).astype(np.int64)
                    weights = np.array([1_000_003**k % (1 << 61) for k in range(home.shape[1])], dtype=np.int64)
                    own = home @ weights
                    for shift in product((-1, 0, 1), repeat=home.shape[1]):
                        cell = home + np.array(shift)
                        near = ((x >= cell * step - reach) & (x <= (cell + 1) * step + reach)).all(axis=1)
                        other = cell @ weights
                        here = not any(shift)
                        take = np.flatnonzero(near & (here | (other < own)))
                        if not len(take):
                            continue
                        picked = part.take(pa.array(take))
                        yield pa.RecordBatch.from_arrays(
                            [*picked.columns, pa.array(np.full(len(take), number, np.int32)), pa.array(other[take]),
                             pa.array(np.full(len(take), here)),
                             pa.ListArray.from_arrays(
                                 pa.array(np.arange(len(take) + 1, dtype=np.int32) * held.shape[1]),
                                 pa.array(held[take].ravel()))],
                            [*picked.schema.names, "block", "cell", "home", "part_of"])

    return place


def _surviving(least: float, width: int):
    """Vectors of a cell that another one of it is close to in the cell's block."""

    def survive(table: pa.Table, bounds: np.ndarray):
        sizes, numbers, homes, sides = (table.column(c).to_numpy() for c in ("size", "block", "home", "side"))
        kept = np.zeros(table.num_rows, dtype=bool)
        for a, b in zip(bounds, bounds[1:]):
            if b - a < 2:
                continue
            budget = _budgets(int(sizes[a]), width, least)[1][int(numbers[a])]
            x = table.column("part_of").slice(a, b - a).combine_chunks().flatten().to_numpy().reshape(b - a, -1)
            kept[a:b] = _able(x, budget + SLACK, homes[a:b], sides[a:b]).any(axis=1)
        if kept.any():
            yield table.select(["key", "label", "size", "block", "cell", "home"]).filter(pa.array(kept))

    return survive


def _linked(least: float, width: int):
    """Links inside a cell: for each vector how many vectors it is linked with and the first
    one that it hangs together with. A link is counted in the first block that can tell it."""

    def link(table: pa.Table, bounds: np.ndarray):
        sizes, numbers = table.column("size").to_numpy(), table.column("block").to_numpy()
        homes, sides, times = (table.column(c).to_numpy() for c in ("home", "side", "times"))
        keys, nodes = table.column("key"), table.column("node").to_numpy()
        for a, b in zip(bounds, bounds[1:]):
            unit = _matrix(table.column("vector").slice(a, b - a))
            blocks, budgets = _budgets(int(sizes[a]), width, least)
            turned, number = _turned(unit), int(numbers[a])
            able = _able(turned[:, blocks[number]], budgets[number], homes[a:b], sides[a:b])
            rows = np.flatnonzero(able.any(axis=1))
            if not len(rows):
                continue
            able = able[np.ix_(rows, rows)] & (unit[rows] @ unit[rows].T >= least)
            for k in range(number):
                able &= ~_close(turned[rows][:, blocks[k]], budgets[k])
            links = able @ times[a:b][rows]
            held = np.flatnonzero(links)
            if not len(held):
                continue
            rows, able = rows[held], able[np.ix_(held, held)]
            member, first = star(np.arange(len(rows)), able)
            root = np.arange(len(rows))
            root[member] = first
            yield pa.table({
                "key": keys.take(pa.array(a + rows)), "links": pa.array(links[held]),
                "a": pa.array(nodes[a + rows]), "b": pa.array(nodes[a + rows[root]]),
            })

    return link


def link_vectors(
    vectors: DataFrame, least: float = 0.98, width: int = 8, vec_id: str = "vec_id", vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Vectors of one label with cosine ``least`` or more, and the groups they form.

    1. Equal vectors of a label become one that counts as often.
    2. Unit vectors are rotated and cut into blocks of ``width`` dimensions. Two with cosine
       ``least`` differ by 2 * (1 - least) squared, and so in one block at least by no more
       than the block's share of that, which is proportional to its dimensions.
    3. Each block is a range join: cells three times as wide as the block's reach over its
       first coordinates (the more vectors a label has, the more coordinates); a vector goes
       to its own cell and to those before it that it reaches into, so two in reach meet once.
    4. Cells hold a vector's key and its coordinates in the block. Those that another one of the
       cell is close to are joined with their whole vectors and placed in the cell again.
    5. There, pairs within the block's budget are verified on the whole vectors. Pairs are
       counted, in the first block that can tell them, and leave the task as a number per
       vector and a star over what hangs together. A large cell is compared in pairs of blocks.

    Nothing is approximate: rounding moves neither side of a bound by what ``SLACK`` adds.

    Returns one row per row of ``vectors``: its id, ``n_links`` (other rows linked with it),
    ``component_id`` (smallest id reachable) and ``kept`` (whether that is its own). A null
    label, a null, empty or zero vector, or one with a null or non-finite number links with
    nothing; vectors of different lengths do not link. Rows that share an id each count; in
    components the id stands for all of them. A null id has a null ``component_id`` and is
    kept. Ids are whole numbers; a column of another type is an error. Other columns are ignored.
    """
    whole_numbers(vectors, vec_id)
    picked = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector")
    )
    kind = dict(picked.dtypes)["vector"]
    keyed = saved(
        picked.mapInArrow(_keyed, f"vec_id long, label string, vector {kind}, key binary, size int"), "keyed"
    )
    classes = saved(
        keyed.filter("key is not null").groupBy("key", "label", "size", "vector")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("times")),
        "classes",
    )
    most = classes.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    grid = min(width, max(1, int(np.ceil(np.log(max(most, 1) / BLOCK) / np.log(2))) + 1))
    at = ("label", "size", "block", "cell")
    cells = "key binary, label string, size int, block int, cell long, home boolean"
    placed = saved(classes.mapInArrow(_placed(least, width, grid), f"{cells}, part_of array<int>"), "placed")
    surviving = map_groups(
        in_blocks(placed, at, BLOCK, "key"), (*at, "part"), _surviving(least, width), cells
    ).dropDuplicates(["key", "block", "cell"])
    near = saved(surviving.join(classes.select("key", "vector", "node", "times"), "key"), "near")
    found = saved(
        map_groups(
            in_blocks(near, at, BLOCK, "key"), (*at, "part"), _linked(least, width),
            "key binary, links long, a long, b long",
        ),
        "links",
    )
    counted = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = saved(
        classes.select("key", "node", "times").join(counted, "key", "left")
        .join(components(found).withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"),
                F.coalesce("component", "node").alias("component")),
        "named",
    )
    return keyed.select("vec_id", "key").join(named, "key", "left").select(
        F.col("vec_id").alias(vec_id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"),
        F.coalesce(F.col("component").isNull() | (F.col("vec_id") == F.col("component")), F.lit(True)).alias("kept"),
    )
