"""Two-bit genome files: tiles equal those cut from the text they were packed from."""

import numpy as np
import pytest

from epispark.operators import genome as G
from epispark.sources import twobit


def packed(genome, order):
    """A file as the format describes it: header, index, and a record per sequence."""
    u4 = lambda *n: np.array(n, f"{order}u4").tobytes()
    index = sum(len(c) + 5 for c in genome)
    out, body, at = u4(0x1A412743, 0, len(genome), 0), b"", 16 + index
    for chrom, text in genome.items():
        out += bytes([len(chrom)]) + chrom.encode() + u4(at + len(body))
        upper = text.upper()

        def runs(flags):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])))
            return edges[::2], edges[1::2] - edges[::2]

        unknown, masked = runs(np.array([c == "N" for c in upper], int)), runs(np.array([c.islower() for c in text], int))
        codes = np.array(["TCAG".find(c) if c != "N" else 0 for c in upper] + [0] * (-len(text) % 4), np.uint8).reshape(-1, 4)
        body += u4(len(text)) + u4(len(unknown[0]), *unknown[0], *unknown[1]) + u4(len(masked[0]), *masked[0], *masked[1])
        body += u4(0) + (codes @ np.array([64, 16, 4, 1])).astype(np.uint8).tobytes()
    return out + body


@pytest.fixture(scope="module")
def genome():
    rng = np.random.default_rng(6)
    text = {c: "".join(rng.choice(list("ACGTacgt"), n)) for c, n in (("chr1", 1003), ("chr2", 40), ("chrX", 7), ("chrM", 400))}
    text["chr1"] = "NNN" + text["chr1"][3:90] + "N" * 130 + text["chr1"][220:1002] + "n"
    return text


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tiles", [1, 3, 100])
def test_tiles_equal_those_of_the_text(spark, tmp_path, genome, order, tiles):
    path = f"{tmp_path}/genome.2bit"
    with open(path, "wb") as file:
        file.write(packed(genome, order))
    contigs = spark.createDataFrame([(c, t.upper()) for c, t in genome.items()], "chrom string, seq string")
    want = G.tile_contigs(contigs, 50, 12)
    found = twobit.read_twobit_tiles(spark, path, 50, 12, tiles)
    key = lambda df: sorted(map(tuple, df.select(*twobit.TILES.fieldNames()).collect()))
    assert key(found) == key(want)


def test_only_the_chromosomes_asked_for_are_planned(spark, tmp_path, genome):
    path = f"{tmp_path}/genome.2bit"
    with open(path, "wb") as file:
        file.write(packed(genome, "<"))
    reader = twobit._FilteredReader({"path": path, "tile_width": "50", "flank": "5", "tiles": "4"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([In(("chrom",), ("chr2", "chrM")), GreaterThan(("tile_no",), 1), EqualTo(("chrom",), "chrM")]))
    assert left == [GreaterThan(("tile_no",), 1)] and {p.record.chrom for p in reader.partitions()} == {"chrM"}
    listed = twobit.read_twobit_tiles(spark, path, 50, 5, chroms=["chr2"])
    assert {r.chrom for r in listed.collect()} == {"chr2"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        tiles = twobit.read_twobit_tiles(spark, path, 50, 5, 4).filter("chrom = 'chr1' and tile_no < 6")
        assert {(r.chrom, r.tile_no) for r in tiles.collect()} == {("chr1", k) for k in range(6)}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_other_files_are_refused(tmp_path):
    with open(f"{tmp_path}/x", "wb") as file:
        file.write(b">chr1\nACGTACGTACGTACGT\n")
    with pytest.raises(ValueError, match="two-bit"):
        twobit.read_records(f"{tmp_path}/x")
