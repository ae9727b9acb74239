"""Schemas of the tables the flows read."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per strand and position; ``chrom_start`` is 0-based.
CALLS = T.StructType([
    T.StructField("chrom", T.StringType()),
    T.StructField("chrom_start", T.LongType()),
    T.StructField("strand", T.StringType()),
    T.StructField("coverage", T.LongType()),
    T.StructField("percent_methylated", T.DoubleType()),
])

# The eleven columns of the public bedMethyl format, in file order.
BED_METHYL = T.StructType([
    T.StructField("chrom", T.StringType()),
    T.StructField("chrom_start", T.LongType()),
    T.StructField("chrom_end", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("score", T.StringType()),
    T.StructField("strand", T.StringType()),
    T.StructField("thick_start", T.LongType()),
    T.StructField("thick_end", T.LongType()),
    T.StructField("color", T.StringType()),
    T.StructField("coverage", T.LongType()),
    T.StructField("percent_methylated", T.DoubleType()),
])

# Contacts in base coordinates; ``count`` may be NaN where balancing failed.
CONTACTS = T.StructType([
    T.StructField("chrom", T.StringType()),
    T.StructField("pos_x", T.LongType()),
    T.StructField("pos_y", T.LongType()),
    T.StructField("count", T.DoubleType()),
])

# The public faidx index of a FASTA file.
FASTA_INDEX = T.StructType([
    T.StructField("chrom", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("line_bases", T.IntegerType()),
    T.StructField("line_width", T.IntegerType()),
])

TILES = T.StructType([
    T.StructField("chrom", T.StringType()),
    T.StructField("chrom_length", T.LongType()),
    T.StructField("tile_no", T.LongType()),
    T.StructField("tile_start", T.LongType()),
    T.StructField("seq_start", T.LongType()),
    T.StructField("seq", T.StringType()),
])

SHARD = T.StructType([
    T.StructField("shard_index", T.LongType()),
    T.StructField("file", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("codes_width", T.IntegerType()),
    T.StructField("dtype", T.StringType()),
])

# Figures of one epoch on one split.
_FIGURES = T.StructType([T.StructField(name, T.DoubleType()) for name in ("loss", "mcc", "roc_auc", "average_precision")])

HISTORY = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("phase", T.StringType()),
    T.StructField("train", _FIGURES),
    T.StructField("validation", _FIGURES),
])

NODE_EMBEDDINGS = T.StructType([
    T.StructField("bin_start", T.LongType()),
    T.StructField("sample_count", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("chrom", T.StringType()),
])

MANIFEST = T.StructType([
    T.StructField("split", T.StringType()),
    T.StructField("shard_size", T.LongType()),
    T.StructField("total_rows", T.LongType()),
    T.StructField("shard_count", T.LongType()),
    T.StructField("shards", T.ArrayType(SHARD)),
])
