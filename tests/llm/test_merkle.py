"""The Merkle manifest against SQL on the given tables and a plain tree on odd rows."""

import hashlib
import zlib
from itertools import groupby

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from epispark.llm import merkle, workload

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return hashed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The root and each node's siblings, level by level."""
    steps, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        upper, owners = [], []
        for lo in range(0, len(nodes), 16):
            run = nodes[lo:lo + 16]
            for k in range(len(run)):
                for i in members[lo + k]:
                    steps[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            upper.append(hashed(*run))
            owners.append([i for part in members[lo:lo + 16] for i in part])
        nodes, members = upper, owners
    return nodes[0], steps


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in groupby(rows, key=lambda r: r[1])]
    built = [tree([leaf(r) for r in g]) for g in groups]
    root, tops = tree([b[0] for b in built])
    out = []
    for group, (subroot, steps), top in zip(groups, built, tops):
        for row, step in zip(group, steps):
            path = step + top
            doc, *middle, text = row
            if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 and text is not None:
                text = text.translate(LOWER)
            node = leaf((doc, *middle, text))
            for left, right in path:
                node = hashed(left, node, right)
            proof = hashed(*(left + right for left, right in path))
            out.append((doc, leaf(row), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def made(docs):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.merkle_manifest(docs, {"text": lower}, changed).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"), "folded_root", "verified"
    )
    return sorted(map(tuple, found.collect()), key=repr)


def test_matches_sql(spark):
    found = workload.op13_merkle_manifest(spark, FOLDER)
    assert difference(found, connect(FOLDER), workload.ORACLES["op13_merkle_manifest"]) is None


@pytest.mark.parametrize("sources", [["a"], [None, "", "a", "é", "b", *map(str, range(14))]])
def test_sizes_nulls_ties_and_repeats(spark, sources):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (7, "a", "en", 1, ""), (7, "a", "en", 1, "B"),
            (7, "a", "en", 1, "B"), (8, "a", None, None, "Long " * 30_000)]
    for k, source in enumerate(sources):
        rows += [(100 * k + i, source, "en", i, f"Text {i}") for i in range((17, 1, 16, 32, 33)[k % 5])]
    rows += [(10_000 + i, "hot", "x", None, "Á Z") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("key", "pos", "size", "node", "path", "_row", "id", "leaf")])
    found = made(clash)
    assert found == plain(rows)
    assert {v for *_, v in found} == {True, False}


def test_one_leaf_and_none(spark):
    one = [(5, "a", "en", 3, "abc")]
    (row,) = made(spark.createDataFrame(one, SCHEMA))
    assert row[1] == row[2] == row[3] == leaf(one[0]) and row[4] == hashed() and row[6]
    assert made(spark.createDataFrame([], SCHEMA)) == []


def test_windows_hold_whole_runs_only(spark):
    assert merkle.SPAN % merkle.FANOUT == 0
    rows = [(i, "hot", "en", i, "t") for i in range(merkle.SPAN + 3)]
    assert made(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
