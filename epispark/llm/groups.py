"""Arrow functions over groups of rows, many groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _starts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    fresh = np.zeros(table.num_rows, dtype=bool)
    if len(fresh):
        fresh[0] = True
        for key in keys:
            column = table.column(key)
            fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(fresh) - 1)).to_numpy()
    return np.flatnonzero(fresh)


def map_groups(
    rows: DataFrame, keys: tuple[str, ...], make: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], schema: str
) -> DataFrame:
    """Apply ``make`` to runs of whole groups of ``rows`` with equal ``keys`` (never null).

    ``make`` gets a table and the bounds of its groups. A task holds one Arrow batch and
    the group that is being read, so callers see to it that no group is large.
    """

    def stream(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            starts = _starts(held, keys)
            if len(starts) > 1:
                for out in make(held.slice(0, int(starts[-1])).combine_chunks(), starts):
                    yield from out.to_batches()
                held = held.slice(int(starts[-1]))
        if held is not None:
            for out in make(held.combine_chunks(), np.array([0, held.num_rows])):
                yield from out.to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def in_blocks(rows: DataFrame, keys: tuple[str, ...], size: int, row: str = "doc_id") -> DataFrame:
    """``rows`` with a ``part`` for each pair of blocks of their ``keys``, and the ``side`` of the
    pair that the row is on: any two rows of a key meet in one part, on two sides or as one
    block with itself (all on side 0), and no part has more than a few times ``size`` rows."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("_blocks")).filter("_blocks > 1")
    own = F.pmod(F.xxhash64(row), F.col("_blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda other: F.struct(
            F.concat_ws("-", F.least(own, other), F.greatest(own, other)).alias("part"),
            (own > other).cast("int").alias("side"),
        ),
    )
    alone = F.array(F.struct(F.lit("").alias("part"), F.lit(0).alias("side")))
    key = F.struct(*keys).alias("_key")  # of its own, so that Spark can split a frequent one
    return rows.select("*", key).join(sizes.select("_blocks", key), "_key", "left").select(
        *rows.columns, F.explode(F.coalesce(pairs, alone)).alias("_pair")
    ).select(*rows.columns, "_pair.part", "_pair.side")


def _roots(links: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the first member reachable from each."""
    label = np.arange(len(links))
    while True:
        low = np.where(links, label, len(label)).min(axis=1, initial=len(label))
        low = np.minimum(low, label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def star(ids: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member that hangs together with one of a smaller id: its id, and the smallest.

    Groups that share members then mostly agree on the smallest, so few edges differ."""
    order = np.argsort(ids, kind="stable")
    ids, links = ids[order], links[np.ix_(order, order)]
    root = _roots(links)
    held = root != np.arange(len(root))
    return ids[held], ids[root[held]]
