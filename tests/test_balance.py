"""Balancing of contacts against a dense matrix."""

import math
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest

from epispark.operators.balance import balance_contacts, bin_biases, contact_matrix
from epispark.params import RRBS_HG19
from epispark.plans import graph

SCHEMA = "chrom string, bin_x bigint, bin_y bigint, count double, note string"


def dense(rows, n):
    a = np.zeros((n, n))
    for _, x, y, c, _ in rows:
        if c is not None and math.isfinite(c) and c > 0:
            a[x, y] += c
            if x != y:
                a[y, x] += c
    return a


def random_rows(seed, chrom, n, k):
    rng = np.random.default_rng(seed)
    rows = [(chrom, int(a), int(b), float(w), "n") for a, b, w in zip(rng.integers(0, n, k), rng.integers(0, n, k), rng.integers(1, 90, k))]
    return rows + [(chrom, i, i, 5.0, "n") for i in range(n)]


@pytest.mark.parametrize("most_sent", [1 << 20, 1])
def test_rows_add_up_to_one(spark, most_sent):
    rows = random_rows(1, "chr1", 30, 700) + random_rows(2, "chr2", 12, 60)
    rows += [("chr1", 3, 4, float("nan"), "a"), ("chr1", 4, 3, float("inf"), "b"), ("chr2", 0, 1, None, "c"), ("chr2", 1, 2, 0.0, "d"),
             ("chr3", 0, 1, float("nan"), "e")]
    contacts = spark.createDataFrame(rows, SCHEMA).repartition(4)
    matrix = contact_matrix(contacts)
    found = bin_biases(matrix, steps=40, tolerance=1e-4, most_sent=most_sent).collect()
    bias = {(r.chrom, r.bin): r.bias for r in found}
    for chrom, n in (("chr1", 30), ("chr2", 12)):
        a = dense([r for r in rows if r[0] == chrom], n)
        x = np.array([bias[chrom, i] for i in range(n)])
        assert np.allclose(x * (a @ x), 1, atol=1.1e-4)
    out = balance_contacts(contacts, steps=40, tolerance=1e-4, most_sent=most_sent)
    assert out.columns == contacts.columns
    made = out.collect()
    assert len(made) == len(rows)
    kept = defaultdict(float)
    for r in made:
        if r.note == "n":
            kept[r.chrom] += r["count"]
        else:
            assert (r.note == "d" and r["count"] == 0) or math.isnan(r["count"])
    for chrom in ("chr1", "chr2"):
        assert kept[chrom] == pytest.approx(sum(r[3] for r in rows if r[0] == chrom and r[4] == "n"))


def test_a_bin_that_cannot_converge_gets_nan(spark):
    """Without a contact to itself or among themselves three leaves of a star cannot all add up to what the centre does."""
    rows = [("chr1", 0, k, 1.0, "star") for k in (1, 2, 3)] + [("chr2", 0, 0, 4.0, "ok"), ("chr2", 1, 1, 9.0, "ok")]
    out = balance_contacts(spark.createDataFrame(rows, SCHEMA), steps=6, tolerance=1e-3).collect()
    assert all(math.isnan(r["count"]) for r in out if r.note == "star")
    assert sorted(r["count"] for r in out if r.note == "ok") == pytest.approx([6.5, 6.5])


def test_bins_with_few_partners_are_left_out(spark):
    rows = random_rows(3, "chr1", 10, 200) + [("chr1", 4, 50, 7.0, "few")]
    contacts = spark.createDataFrame(rows, SCHEMA)
    out = balance_contacts(contacts, steps=40, tolerance=1e-3, min_partners=2).collect()
    assert all(math.isnan(r["count"]) == (r.note == "few") for r in out)
    matrix = {(r.bin, r.other) for r in contact_matrix(contacts, 2).collect()}
    assert matrix == {(b, a) for a, b in matrix} and all(50 not in pair for pair in matrix)


def test_empty(spark):
    contacts = spark.createDataFrame([], SCHEMA)
    assert balance_contacts(contacts).count() == 0


def test_graph_of_raw_counts(spark, tmp_path):
    params = replace(RRBS_HG19, bin_width=100, max_contact_distance=1_000, top_k=3, chroms=("chr1",), balance_steps=20, balance_tolerance=0.01)
    rows = [r[:4] for r in random_rows(5, "1", 20, 300)]
    contacts = spark.createDataFrame(rows, "chrom string, bin_x bigint, bin_y bigint, count double")
    sizes = spark.createDataFrame([("1", 2000)], "raw_name string, length bigint")
    made = graph.build_graph(sizes, contacts, params, f"{tmp_path}/balanced").edges
    plain = graph.build_graph(sizes, contacts, replace(params, balance_steps=0), f"{tmp_path}/raw").edges
    key = lambda df: sorted(map(tuple, df.select("src", "dst", "log_count").collect()))
    assert key(made) != key(plain) and made.count() > 20
