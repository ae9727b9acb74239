"""Vector linking against all pairs."""

import numpy as np
import pytest

from epispark.llm import vectors


def brute(rows, least=0.98):
    def good(label, x):
        return label is not None and x is not None and len(x) and None not in x and np.isfinite(x).all() and any(x)

    n, root, count = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if good(a, x) and good(b, y) and a == b and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    count[i] += 1
                    count[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i, (v, _, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), v), v)
    return sorted((v, count[i], low[find(i)], low[find(i)] == v) for i, (v, _, _) in enumerate(rows))


def found(spark, rows, **more):
    schema = "vec_id long, label int, embedding array<double>, key int, times string"
    frame = spark.createDataFrame([(v, a, None if x is None else list(map(float, x)) if None not in x else x, 1, "x") for v, a, x in rows], schema)
    return sorted((tuple(r) for r in vectors.link_vectors(frame, **more).collect()), key=repr)


@pytest.mark.parametrize("size", [3, 20, 64])
def test_all_pairs(spark, size, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 15)
    rng, rows = np.random.default_rng(size), []
    for label in (1, 2):
        for _ in range(12):
            centre = rng.standard_normal(size)
            for _ in range(rng.choice([1, 2, 9])):
                rows.append(centre + rng.standard_normal(size) * rng.choice([0, 0.1, 0.14, 0.2]))
            rows.append(centre * 3)
    ids = rng.permutation(len(rows))
    given = [(int(v), 1 + k * 2 // len(rows), x.tolist()) for k, (v, x) in enumerate(zip(ids, rows))]
    expected = brute(given)
    assert sum(r[1] for r in expected) > 30
    assert found(spark, given) == sorted(expected, key=repr)


def test_one_dense_group_counts_every_link(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 20)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(k, 0, (base + 0.01 * rng.standard_normal(16)).tolist()) for k in range(150)]
    assert found(spark, rows) == sorted(((k, 149, 0, k == 0) for k in range(150)), key=repr)


def test_corner_cases(spark):
    one = [1.0, 2.0, 0.0]
    rows = [
        (5, 1, one), (3, 1, one), (3, 1, one), (4, 2, one), (6, None, one), (7, 1, None), (8, 1, []), (9, 1, [0.0, 0.0, 0.0]),
        (10, 1, [1.0, None, 2.0]), (11, 1, [float("nan"), 1.0, 1.0]), (12, 1, [float("inf"), 1.0, 1.0]), (13, 1, [1.0, 2.0]),
        (14, 1, [1e-200, 2e-200, 0.0]), (15, 1, [1e200, 2e200, -0.0]), (16, 1, [-1.0, -2.0, 0.0]),
    ]
    got = {r[0]: r[1:] for r in found(spark, rows)}
    assert got[5] == (4, 3, False) and got[3] == (4, 3, True) and got[14] == (4, 3, False) and got[15] == (4, 3, False)
    assert all(got[k] == (0, k, True) for k in (4, 6, 7, 8, 9, 10, 11, 12, 13, 16))
    assert found(spark, [(None, 1, one), (2, 1, one)]) == [(2, 1, 2, True), (None, 1, None, True)]
    assert found(spark, []) == []


def test_ids_are_whole_numbers(spark):
    with pytest.raises(TypeError, match="vec_id"):
        vectors.link_vectors(spark.createDataFrame([("a", 1, [1.0])], "vec_id string, label int, embedding array<double>"))


def test_cells_hold_coordinates_of_their_block(spark):
    rng = np.random.default_rng(4)
    keyed = spark.createDataFrame(
        [(bytes([k]), "1", 20, rng.standard_normal(20).tolist()) for k in range(30)],
        "key binary, label string, size int, vector array<double>")
    placed = keyed.mapInArrow(vectors._placed(0.98, 8, 1), (
        "key binary, label string, size int, block int, cell long, home boolean, part_of array<int>")).collect()
    assert {(r.block, len(r.part_of)) for r in placed} == {(0, 8), (1, 8), (2, 4)}
    assert sum(r.home for r in placed) == 90
