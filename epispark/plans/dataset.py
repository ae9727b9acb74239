"""Calls of two replicates to labelled windows, split by chromosome."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.functions import sequence as S
from epispark.operators import audit
from epispark.operators import calls as C
from epispark.operators import genome as G
from epispark.operators import quality as Q
from epispark.operators import splits as X
from epispark.params import Params
from epispark.sources import tables, versions
from epispark.sources.staging import written


@dataclass(frozen=True)
class Dataset:
    sites: DataFrame
    summary: DataFrame
    dropped: DataFrame


def checked_pairs(calls: DataFrame, params: Params, path: str) -> DataFrame:
    """Counts of both replicates per site, after the two-strand guard, whose figures are taken
    while the pairs are written: the calls are read once and the pairs not again."""

    def sites(rep: int, least: int) -> Column:
        return F.count_if(F.col(f"strand_row_count_rep{rep}") >= least)

    pairs, seen = written(
        C.pair_replicates(C.stranded_counts(calls, params.chroms)), f"{path}/stages/pairs",
        **{f"rep{rep}_{n}": sites(rep, n) for rep in (1, 2) for n in (1, 2)},
    )
    for rep in (1, 2):
        audit.require_share(
            seen[f"rep{rep}_2"], seen[f"rep{rep}_1"], params.min_two_strand_fraction,
            f"too few sites of replicate {rep} are supported by both strands",
        )
    return pairs


def build_dataset(calls: DataFrame, tiles: DataFrame, params: Params, path: str) -> Dataset:
    """Write ``sites`` (partitioned by split and chromosome) and ``split_summary``; ``stages``
    holds what was read more than once on the way."""
    pairs = checked_pairs(calls, params, path)
    consensus = C.label_sites(C.concordant(C.in_both(pairs, params), params)).select(
        *C.SITE_KEY, "count_m", "count_u", "coverage", "replicate_ratio_difference", "label",
        "consensus_methylation_ratio",
    )
    found = G.site_windows(consensus, tiles, params.tile_width, params.window)
    status = S.window_status(F.col("sequence"), params.window, params.max_unknown_fraction)
    windows, seen = written(
        found, f"{path}/stages/windows", **{f"status_{k}": F.count_if(status == s) for k, s in enumerate(S.FAILURES)}
    )
    valid = Q.valid_windows(windows, params.window, params.max_unknown_fraction)
    split = X.split_sites(valid)
    tables.write_splits(split, f"{path}/sites")
    sites = calls.sparkSession.read.parquet(f"{path}/sites")
    summary = X.split_summary(sites)
    tables.write_summary(summary, f"{path}/split_summary")
    audit.require_empty(X.shared_groups(sites), "a chromosome is in two splits")
    counted = [(s, seen[f"status_{k}"]) for k, s in enumerate(S.FAILURES) if seen[f"status_{k}"]]
    dropped = calls.sparkSession.createDataFrame(counted, Q.status_counts(Q.window_status(windows, params.window, 0.0)).schema)
    return Dataset(sites, summary, dropped)


def publish_dataset(calls: DataFrame, tiles: DataFrame, params: Params, path: str) -> Dataset:
    """``build_dataset`` as a new version of ``path``, current once its guards have passed."""
    return versions.publish(calls.sparkSession, path, lambda folder: build_dataset(calls, tiles, params, folder))
