"""Readers and sinks on real files."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from epispark.operators import audit
from epispark.operators import genome as G
from epispark.sources import calls, contacts, files, genome, properties, tables


def write(path, text, opener=open):
    with opener(path, "wt") as handle:
        handle.write(text)
    return str(path)


def bed(chrom, start, strand, coverage, percent):
    return "\t".join(map(str, [chrom, start, start + 1, ".", 0, strand, start, start + 1, "0,0,0", coverage, percent]))


def test_gzip_calls_of_two_replicates(spark, tmp_path):
    one = write(tmp_path / "a.bed.gz", bed("chr1", 9, "+", 12, 50) + "\n", gzip.open)
    two = write(tmp_path / "b.bed.gz", "#comment\n" + bed("chr2", 4, "-", 7, 12.5) + "\n", gzip.open)
    rows = {tuple(r) for r in calls.read_calls(spark, {1: one, 2: two}).collect()}
    assert rows == {(1, "chr1", 9, "+", 12, 50.0), (2, "chr2", 4, "-", 7, 12.5)}


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(F.concat(F.lit("chr"), F.col("id")).alias("chrom"), "id", F.lit(1).alias("x")).write.parquet(path)
    found = tables.read_chrom(spark, path, ["id"], "chr3")
    plan = found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "EqualTo(chrom,chr3)" in plan and "x:int" not in plan
    assert [r["id"] for r in found.collect()] == [3]


def fasta(tmp_path, contigs, width, newline="\n"):
    text, index, offset = "", "", 0
    for name, seq in contigs:
        head = f">{name}{newline}"
        offset = len(text) + len(head)
        lines = [seq[i : i + width] for i in range(0, len(seq), width)]
        text += head + "".join(line + newline for line in lines)
        index += f"{name}\t{len(seq)}\t{offset}\t{width}\t{width + len(newline)}\n"
    path = tmp_path / "g.fa"
    with open(path, "w", newline="") as handle:
        handle.write(text)
    return str(path), write(tmp_path / "g.fa.fai", index)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_fasta_tiles_equal_contig_tiles(spark, tmp_path, newline):
    contigs = [("c1", "ACGTNacgtACGCGTTAGC"), ("c2", "CG"), ("c3", "A" * 16), ("c4", "")]
    path, index = fasta(tmp_path, contigs, 5, newline)
    read = genome.read_fasta_tiles(spark, path, genome.read_fasta_index(spark, index), 4, 2, 3)
    whole = G.tile_contigs(spark.createDataFrame(contigs, "chrom string, seq string"), 4, 2)
    columns = ["chrom", "chrom_length", "tile_no", "tile_start", "seq_start", "seq"]
    assert sorted(map(tuple, read.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))


def test_contacts_from_text(spark, tmp_path):
    path = write(tmp_path / "c.tsv", "chr1\t0\t20000\t3.5\nchr1\t10000\t10000\tNaN\n")
    rows = contacts.read_contacts(spark, path, "csv").orderBy("pos_x").collect()
    assert rows[0]["count"] == 3.5 and rows[1]["count"] != rows[1]["count"]


def property_rows(spark, extra=()):
    rows = [(i, d, [float(i)] * 12) for i, d in enumerate(properties.DINUCLEOTIDES)] + list(extra)
    return spark.createDataFrame(rows, "row_number bigint, dinucleotide string, properties array<float>")


def test_property_table(spark):
    table = properties.load_properties(property_rows(spark, [(99, " ac\n", [7.0] * 12)]))
    assert len(table) == 16 and table[1] == [7.0] * 12 and table[15] == [15.0] * 12
    for bad, message in (("AN", "invalid dinucleotide"), (None, "invalid dinucleotide")):
        with pytest.raises(ValueError, match=message):
            properties.load_properties(property_rows(spark, [(99, bad, [7.0] * 12)]))
    with pytest.raises(ValueError, match="wrong number"):
        properties.load_properties(property_rows(spark, [(99, "AC", [7.0])]))
    with pytest.raises(ValueError, match="non-finite"):
        properties.load_properties(property_rows(spark, [(99, "AC", [float("inf")] * 12)]))
    with pytest.raises(ValueError, match="missing dinucleotides: TT"):
        properties.load_properties(property_rows(spark).filter("dinucleotide <> 'TT'"))


def test_property_csv(spark, tmp_path):
    lines = ["name," + ",".join(f"p{i}" for i in range(12))]
    lines += [f"{d}," + ",".join(str(i + j) for j in range(12)) for i, d in enumerate(properties.DINUCLEOTIDES)]
    path = write(tmp_path / "p.csv", "\n".join(lines))
    assert properties.load_properties(properties.read_property_csv(spark, path))[2][:2] == [2.0, 3.0]


def test_file_sizes_and_sums(spark, tmp_path):
    (tmp_path / "d").mkdir()
    body = b"x" * (files.CHUNK + 5)
    (tmp_path / "d" / "f.bin").write_bytes(body)
    measured = files.hash_files(files.list_files(spark, str(tmp_path / "d")))
    row = measured.first()
    assert (row["size"], row["md5"]) == (len(body), hashlib.md5(body).hexdigest())
    expectations = measured.select(
        "size", "md5", F.lit(None).cast("bigint").alias("expected_size"), F.lit("0").alias("expected_md5")
    )
    outcome = audit.integrity(expectations).first()
    assert (outcome["outcome"], outcome["can_skip_fetch"]) == ("md5 mismatch", True)


def test_manifest_files(spark, tmp_path):
    from epispark.operators.shards import explode_manifest

    shards = [{"shard_index": i, "file": f"s{i}", "row_count": 5 - i, "codes_width": 3, "dtype": "smallint"} for i in range(2)]
    body = {"split": "train", "shard_size": 5, "total_rows": 9, "shard_count": 2, "shards": shards}
    write(tmp_path / "m.json", json.dumps(body, indent=2))
    rows = explode_manifest(files.read_manifests(spark, str(tmp_path / "m.json"))).orderBy("shard_index").collect()
    assert [(r["split"], r["total_rows"], r["shard_index"], r["row_count"]) for r in rows] == [("train", 9, 0, 5), ("train", 9, 1, 4)]


def test_sinks(spark, tmp_path):
    sites = spark.range(6).select(
        F.when(F.col("id") < 2, "test").otherwise("train").alias("split"),
        F.concat(F.lit("chr"), F.col("id") % 2).alias("chrom"), F.col("id").alias("canonical_position"),
    )
    tables.write_splits(sites, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(map(tuple, back.select(sites.columns).collect())) == sorted(map(tuple, sites.collect()))
    tables.write_summary(sites.groupBy("split").count(), f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 2
    for epoch in (0, 1):
        tables.write_json(spark.createDataFrame([(epoch, 0.5)], "epoch int, loss double"), f"{tmp_path}/h", "append")
    assert spark.read.json(f"{tmp_path}/h").count() == 2


def test_training_history(spark, tmp_path):
    from epispark.operators.metrics import early_stopping
    from epispark.schemas import HISTORY

    for epoch, loss in enumerate((0.5, 0.4, 0.45)):
        row = ("r", epoch, "unfrozen", (0.3, None, None, None), (loss, 0.1, None, None))
        tables.write_history(spark.createDataFrame([row], HISTORY), f"{tmp_path}/h")
    back = tables.read_history(spark, f"{tmp_path}/h")
    best = early_stopping(tables.history_values(back, "loss"), 5, 1e-5).first()
    assert (best["epoch_count"], best["best_epoch"], best["best_loss"]) == (3, 1, 0.4)


def test_only_pending_partitions_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/p"
    tables.write_pending(spark.createDataFrame([("a", 1), ("b", 1)], "chrom string, v int"), path)
    tables.write_pending(spark.createDataFrame([("b", 2)], "chrom string, v int"), path)
    assert sorted(map(tuple, spark.read.parquet(path).select("chrom", "v").collect())) == [("a", 1), ("b", 2)]
