"""The buffered order of an epoch against a buffer kept row by row."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epispark.operators import epochs
from epispark.operators.shards import shard_order


def plain(values, size, seed):
    held, out, numbers = [], [], [int(x) for x in epochs.draws(seed, 0, 2 * len(values) + 1)]
    for t, v in enumerate(values):
        if len(held) < size:
            held.append(v)
        else:
            slot = numbers[t] % size
            out.append(held[slot])
            held[slot] = v
    rest = [numbers[len(values) + i] for i in range(len(held))]
    return out + [v for _, v in sorted(zip(rest, held))]


@pytest.mark.parametrize("size", [1, 3, 50, 1000])
def test_buffer_against_rows_one_by_one(size):
    rng = np.random.default_rng(size)
    for seed in (1, 9):
        cuts = np.sort(rng.integers(0, 400, 7))
        tables = [pa.table({"v": part}) for part in np.split(np.arange(400), cuts)]
        found = [v for t in epochs.through_buffer(iter(tables), size, seed) for v in t["v"].to_pylist()]
        assert found == plain(list(range(400)), size, seed) and sorted(found) == list(range(400))
    assert list(epochs.through_buffer(iter([]), size, 1)) == []


def shards(spark, n):
    return spark.range(n).select(
        F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"), F.floor(F.col("id") / 20).alias("shard_index"), "id",
    )


def test_epochs(spark):
    rows, workers = shards(spark, 1000), 3

    def order(epoch, partitions=4, size=30):
        found = epochs.buffered_epoch(rows.repartition(partitions), ["id"], 7, epoch, workers, size).collect()
        assert sorted(r.id for r in found) == list(range(1000))
        return sorted((r.worker, r.position, r.split, r.shard_index, r.id) for r in found)

    first = order(1)
    assert first == order(1, partitions=7) and first != order(2)
    dealt = {(r.split, r.shard_index): (r.place, r.worker) for r in shard_order(rows.select("split", "shard_index").distinct(), 7, 1, workers).collect()}
    for worker in range(workers):
        own = [r for r in first if r[0] == worker]
        assert [r[1] for r in own] == list(range(len(own)))
        for split in ("test", "train"):
            ids = sorted((r[4] for r in own if r[2] == split), key=lambda i: (dealt[split, i // 20][0], i))
            assert [r[4] for r in own if r[2] == split] == plain(ids, 30, 7 + 1 + 7919 * worker)
            assert all(dealt[split, i // 20][1] == worker for i in ids)


def test_no_rows(spark):
    assert epochs.buffered_epoch(shards(spark, 0), ["id"], 1, 1, 2).count() == 0
