"""Windows to coded shards, and the checks and figures of training."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.operators import audit
from epispark.operators import metrics as M
from epispark.operators import nodes as N
from epispark.operators import quality as Q
from epispark.operators import shards as D
from epispark.params import Params
from epispark.sources import files, tables, versions
from epispark.sources.shard_files import write_shard_files
from epispark.sources.staging import staged


@dataclass(frozen=True)
class Shards:
    rows: DataFrame
    manifest: DataFrame
    summary: DataFrame


def build_shards(sites: DataFrame, params: Params, path: str) -> Shards:
    """Write ``shards`` with both encodings, one file each, ``manifest`` (objects per split that list
    its shards by file inside ``shards``) and ``extraction_summary``.

    Both encodings stay in one row, so they cannot fall out of step. The manifest comes from
    what the tasks have written; the shards are not read for it.
    """
    rows = sites.select("split", "chrom", "canonical_position", "label", "sequence")
    audit.require_empty(Q.invalid_windows(rows, params.window), "windows of a wrong length or alphabet")
    coded = D.encode_windows(D.assign_shards(rows, params.shard_size)).drop("sequence", "row_index")
    write_shard_files(coded, f"{path}/shards", f"{path}/manifest", "pair_codes", params.shard_size)
    spark = sites.sparkSession
    written = spark.read.parquet(f"{path}/shards")
    manifest = D.explode_manifest(files.read_manifests(spark, f"{path}/manifest")).select(*D.MANIFEST_COLUMNS)
    summary = D.extraction_summary(manifest)
    tables.write_json(summary, f"{path}/extraction_summary")
    return Shards(written, manifest, summary)


def publish_shards(sites: DataFrame, params: Params, path: str) -> Shards:
    """``build_shards`` as a new version of ``path``, current once its checks have passed."""
    return versions.publish(sites.sparkSession, path, lambda folder: build_shards(sites, params, folder))


def check_alignment(
    shards: DataFrame, other: DataFrame, site_nodes: DataFrame, nodes: DataFrame, params: Params
) -> None:
    """Fail unless both sets hold the same labelled sites, linked to the right nodes."""
    key = ["chrom", "canonical_position"]
    first = shards.select(*key, "label").join(site_nodes.select(*key, "node_index"), key, "left")
    computed = N.join_nodes(shards.select(*key), nodes, params.bin_width)
    compared = audit.alignment(first, other.select(*key, "label"), computed)
    audit.require_empty(compared.filter(F.col("outcome") != "aligned"), "the sets are not aligned")


def check_layout(left: DataFrame, right: DataFrame, params: Params) -> None:
    """Fail if two manifests cut their shards differently; only where the preset asks for it."""
    if params.check_shard_layout:
        audit.require_empty(D.compare_layouts(left, right).filter(~F.col("agrees")), "shards differ")


def _as_rows(figures: DataFrame) -> DataFrame:
    """A one-row table of figures as one row per figure."""
    pairs = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in figures.columns
    ]
    return figures.select(F.inline(F.array(*pairs)))


def evaluate(predictions: DataFrame, params: Params) -> DataFrame:
    """All figures of one set of predictions (``label, score, logit``), one row each.

    The predictions are read once: their counts and losses per distinct score are written and
    hold all that the figures need.
    """
    scores = staged(M.score_losses(predictions), "evaluated")
    whole = _as_rows(M.loss_of_scores(scores))
    for figures in (
        M.confusion_of_scores(scores, params.decision_threshold),
        M.ranking_areas(M.running_counts(scores)),
        M.best_of_curve(M.curve_of_scores(scores)),
    ):
        whole = whole.unionByName(_as_rows(figures))
    return whole
