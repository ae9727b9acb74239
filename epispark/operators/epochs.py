"""Rows of an epoch in the order a training run reads them: shards shuffled, rows through a bounded buffer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.operators.shards import shard_order


def draws(seed: int, start: int, n: int) -> np.ndarray:
    """Random 64-bit numbers of a stream at the places from ``start`` on, however it is cut into batches."""
    begin = np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = np.arange(start, start + n, dtype=np.uint64) + begin
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def through_buffer(tables: Iterator[pa.Table], size: int, seed: int) -> Iterator[pa.Table]:
    """The rows in random order: each new row takes a random place in a full buffer of ``size``
    rows and the row that was there leaves; at the end the rest leaves in random order."""
    held, read = None, 0
    for table in tables:
        if held is None or held.num_rows < size:
            missing = size - (held.num_rows if held is not None else 0)
            first, table = table.slice(0, missing), table.slice(missing)
            held = first if held is None else pa.concat_tables([held, first])
            read += first.num_rows
        n = table.num_rows
        if not n:
            continue
        slots = (draws(seed, read, n) % np.uint64(size)).astype(np.int64)
        read += n
        # A row that leaves came before in this batch, if its place was drawn before, or waited there.
        order = np.argsort(slots, kind="stable")
        again = np.concatenate([[False], slots[order][1:] == slots[order][:-1]])
        left = slots.copy()
        left[order[again]] = size + order[np.flatnonzero(again) - 1]
        stay = np.arange(size)
        stay[slots[order]] = size + order  # the last one drawn for a place stays
        both = pa.concat_tables([held, table]).combine_chunks()
        yield both.take(pa.array(left))
        held = both.take(pa.array(stay)).combine_chunks()
    if held is not None and held.num_rows:
        yield held.take(pa.array(np.argsort(draws(seed, read, held.num_rows), kind="stable")))


def buffered_epoch(
    rows: DataFrame, order_by: Sequence[str], seed: int, epoch: int, workers: int = 1, buffer_rows: int = 10_000
) -> DataFrame:
    """``rows`` (with ``split`` and ``shard_index``) with ``worker`` and ``position``, the place in what it reads.

    Shards are shuffled by seed and epoch and dealt to workers; a worker is a partition that
    streams its shards in turn, their rows in the order ``order_by`` (which must be total
    inside a shard), through a buffer of ``buffer_rows``. So memory does not depend on the
    rows, and seed and epoch give the same order again. Splits follow each other.
    """
    manifest = rows.select("split", "shard_index").distinct()
    placed = rows.join(shard_order(manifest, seed, epoch, workers), ["split", "shard_index"])
    dealt = placed.repartitionById(workers, F.col("worker").cast("int")).sortWithinPartitions("split", "place", *order_by)
    kept = [c for c in placed.columns if c not in ("place", "worker")]
    schema = rows.select(*kept, F.lit(0).cast("bigint").alias("worker"), F.lit(0).cast("bigint").alias("position")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for worker, split, own in _runs(batches):
            mixed = seed + epoch + 7919 * worker
            for table in through_buffer(own, buffer_rows, mixed):
                n = table.num_rows
                table = table.select(kept).append_column("worker", pa.array(np.full(n, worker)))
                yield from table.append_column("position", pa.array(np.arange(place, place + n))).to_batches()
                place += n

    return dealt.select(*kept, "worker").mapInArrow(read, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, Iterator[pa.Table]]]:
    """Each split of a worker with a stream of its rows, which must be read before the next one is asked for."""
    waiting: list[pa.RecordBatch] = []

    def pull() -> pa.RecordBatch | None:
        if waiting:
            return waiting.pop()
        return next((b for b in batches if b.num_rows), None)

    while (batch := pull()) is not None:
        waiting.append(batch)
        split = batch.column("split")[0].as_py()

        def own(split=split):
            while (part := pull()) is not None:
                names = part.column("split").to_numpy(zero_copy_only=False)
                n = int(np.argmax(names != split)) if (names != split).any() else len(names)
                if n:
                    yield pa.Table.from_batches([part.slice(0, n)])
                if n < len(names):
                    waiting.append(part.slice(n))
                    return

        yield batch.column("worker")[0].as_py(), split, own()
