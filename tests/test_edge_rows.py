"""Hand-worked rows for the corners of each operator."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from epispark.functions import coordinates as K
from epispark.functions import sequence as S
from epispark.operators import audit
from epispark.operators import calls as C
from epispark.operators import genome as G
from epispark.operators import graph as H
from epispark.operators import indexing as I
from epispark.operators import metrics as M
from epispark.operators import nodes as N
from epispark.operators import quality as Q
from epispark.operators import shards as D
from epispark.operators import splits as X
from epispark.params import RRBS_HG19, WGBS_GRCH38

PARAMS = replace(WGBS_GRCH38, window=5, tile_width=4, bin_width=10, top_k=2)


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# -- calls -------------------------------------------------------------------


def test_counts_round_half_to_even(spark):
    rows = spark.createDataFrame([(5, 50.0), (15, 50.0), (7, 50.0)], "coverage bigint, percent_methylated double")
    assert values(C.add_read_counts(rows), "coverage", "count_m", "count_u") == [(5, 2, 3), (7, 4, 3), (15, 8, 7)]


def test_reverse_strand_at_zero_and_bin_edges(spark):
    rows = spark.createDataFrame([(0, "-"), (9, "+"), (10, "+"), (4, "x")], "chrom_start bigint, strand string")
    placed = C.add_canonical_position(rows).withColumn("b", K.bin_start(F.col("canonical_position"), 10))
    assert values(placed, "chrom_start", "canonical_position", "b") == [(0, 0, -10), (4, 4, 0), (9, 10, 0), (10, 11, 10)]


def call(rep, start, strand, coverage, percent, chrom="chr1"):
    return (rep, chrom, start, strand, coverage, percent)


CALLS = "rep int, chrom string, chrom_start bigint, strand string, coverage bigint, percent_methylated double"


def test_tie_is_unmethylated_and_strands_merge(spark):
    rows = [call(1, 9, "+", 5, 100.0), call(1, 10, "-", 5, 0.0), call(2, 9, "+", 10, 50.0)]
    sites = C.consensus_sites(spark.createDataFrame(rows, CALLS), PARAMS).collect()
    assert [(r["canonical_position"], r["count_m"], r["count_u"], r["label"]) for r in sites] == [(10, 10, 10, 0)]


def test_site_in_one_replicate_or_other_chromosome_is_dropped(spark):
    rows = [call(1, 9, "+", 50, 10.0), call(1, 19, "+", 50, 10.0, "chrY"), call(2, 19, "+", 50, 10.0, "chrY")]
    assert C.consensus_sites(spark.createDataFrame(rows, CALLS), PARAMS).count() == 0


def test_zero_coverage_gives_null_ratio_not_a_match(spark):
    rows = spark.createDataFrame([call(r, 9, "+", 0, 0.0) for r in (1, 2)], CALLS)
    free = replace(PARAMS, min_replicate_coverage=0, min_total_coverage=0)
    assert C.consensus_sites(rows, free).count() == 0


def test_discordant_replicates_are_dropped(spark):
    rows = spark.createDataFrame([call(1, 9, "+", 10, 100.0), call(2, 9, "+", 10, 70.0)], CALLS)
    assert C.consensus_sites(rows, PARAMS).count() == 0


# -- names -------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw, wanted",
    [("1", "chr1"), ("CHR2", "chr2"), (" x ", "chrX"), ("chrY\t", "chrY"), ("mt", "chrM"), ("chrM", "chrM"), ("chrUn_1", "chrUn_1")],
)
def test_normalize_chrom(spark, raw, wanted):
    assert one(spark, K.normalize_chrom(F.lit(raw))) == wanted


# -- genome ------------------------------------------------------------------


def tiles_of(spark, width, flank, *contigs):
    rows = spark.createDataFrame([(f"c{i}", s) for i, s in enumerate(contigs)], "chrom string, seq string")
    return G.tile_contigs(rows, width, flank)


def test_windows_at_both_ends_and_across_tiles(spark):
    text = "ACGTACGTAC"
    sites = spark.createDataFrame([("c0", p) for p in range(0, 13)] + [("zz", 5)], "chrom string, canonical_position bigint")
    found = values(G.site_windows(sites, tiles_of(spark, 4, 2, text), 4, 5), "chrom", "canonical_position", "sequence")
    wanted = [("c0", p, text[p - 3 : p + 2] if 3 <= p <= 8 else None) for p in range(0, 13)] + [("zz", 5, None)]
    assert found == wanted


def test_lower_case_is_raised(spark):
    sites = spark.createDataFrame([("c0", 3)], "chrom string, canonical_position bigint")
    assert values(G.site_windows(sites, tiles_of(spark, 4, 2, "acgta"), 4, 5), "sequence") == [("ACGTA",)]


@pytest.mark.parametrize("width", [2, 3, 4, 7, 50])
def test_cg_scan_counts_each_hit_once(spark, width):
    texts = ["AACGCGTTCG", "CG", "C", "", "GGGG", "CGCGCGCGC", "ACCGGC"]
    found = values(G.cg_sites(tiles_of(spark, width, 1, *texts), width), "chrom", "canonical_position")
    wanted = [(f"c{i}", p + 1) for i, s in enumerate(texts) for p in range(len(s)) if s[p : p + 2] == "CG"]
    assert found == sorted(wanted)


def test_scan_with_windows_equals_lookup(spark):
    texts = ["ACGTTACGCGCGTACGTAACG", "CGACG"]
    tiles = tiles_of(spark, 4, 2, *texts)
    fused = values(G.cg_sites(tiles, 4, 5).na.fill("-"), "chrom", "canonical_position", "sequence")
    joined = G.site_windows(G.cg_sites(tiles, 4), tiles, 4, 5).na.fill("-")
    assert fused == values(joined, "chrom", "canonical_position", "sequence")


@pytest.mark.parametrize("length, bins", [(0, []), (10, [(0, 10)]), (20, [(0, 10), (10, 20)]), (21, [(0, 10), (10, 20), (20, 21)])])
def test_genome_bins(spark, length, bins):
    rows = spark.createDataFrame([("c", length)], "chrom string, length bigint")
    assert values(G.genome_bins(rows, 10), "bin_start", "bin_end") == bins


def test_bins_of_one_chromosome_are_dealt_out(spark):
    length = 10 * (16 * G.STRETCH) + 3
    sizes = spark.createDataFrame([("chr1", "chr1", length)], "chrom string, raw_name string, length bigint").coalesce(1)
    nodes = H.node_index(sizes, 10, ["chr1"])
    assert values(nodes, "node_index", "bin_start", "bin_end") == [
        (i, 10 * i, min(10 * i + 10, length)) for i in range(16 * G.STRETCH + 1)
    ]
    per_task = [r["count"] for r in nodes.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) == 8 and max(per_task) <= 3 * G.STRETCH


# -- window quality ----------------------------------------------------------


def status(spark, text, window=501):
    rows = spark.createDataFrame([(text,)], "sequence string")
    return Q.window_status(rows, window, 0.10).first()["sequence_status"]


def around_cg(left, right):
    return left.ljust(250, "A") + "CG" + right.ljust(249, "T")


def test_window_status(spark):
    assert status(spark, around_cg("N" * 50, "")) == S.VALID
    assert status(spark, around_cg("N" * 51, "")) == S.TOO_UNKNOWN
    assert status(spark, around_cg("N" * 60 + "Y", "")) == S.UNSUPPORTED
    assert status(spark, "A" * 501) == S.BAD_CENTER
    assert status(spark, "A" * 500) == S.BAD_LENGTH
    assert status(spark, None) == S.MISSING


def test_candidates_allow_other_letters_up_to_the_share(spark):
    rows = spark.createDataFrame([("ACYGTACGTA",), ("AYYGTACGTA",), (None,)], "sequence string")
    assert values(Q.candidate_windows(rows, 10, 0.10), "sequence") == [("ACYGTACGTA",)]


# -- codes -------------------------------------------------------------------


def test_codes(spark):
    text = F.lit(" acgtNY")
    assert one(spark, S.base_codes(text)) == [0, 1, 2, 3, 4, 4]
    assert one(spark, S.dinucleotide_codes(text)) == [1, 6, 11, 255, 255]
    assert one(spark, S.one_hot(S.base_codes(F.lit("AGN")))) == [[1, 0, 0], [0, 0, 0], [0, 1, 0], [0, 0, 0]]


def test_property_matrix_has_zero_for_unknown(spark):
    properties = [[float(i), float(10 * i)] for i in range(16)]
    matrix = S.property_matrix(S.dinucleotide_codes(F.lit("ACNT")), properties)
    assert one(spark, matrix) == [[1.0, 0.0, 0.0], [10.0, 0.0, 0.0]]


def test_checked_codes(spark):
    whole = [[float(i)] for i in range(16)]
    lacking = [None if i == 1 else row for i, row in enumerate(whole)]
    rows = spark.createDataFrame([("ACNT",)], "sequence string")

    def matrix(properties, window=4, strategy="zero", data=rows):
        codes = S.checked_codes(F.col("sequence"), window, properties, strategy)
        return data.select(S.property_matrix(codes, properties).alias("m")).first()["m"]

    assert matrix(whole, strategy="error") == [[1.0, 0.0, 0.0]]
    assert matrix(lacking) == [[0.0, 0.0, 0.0]]
    with pytest.raises(Exception, match="no properties"):
        matrix(lacking, strategy="error")
    with pytest.raises(Exception, match="invalid window"):
        matrix(whole, window=5)
    with pytest.raises(Exception, match="invalid window"):
        matrix(whole, data=spark.createDataFrame([("ACYT",)], "sequence string"))
    with pytest.raises(ValueError):
        matrix(whole, strategy="skip")


# -- splits ------------------------------------------------------------------


def counts(spark, rows):
    return spark.createDataFrame(rows, "chrom string, site_count bigint")


def test_equal_counts_go_in_name_order(spark):
    # Of 40 rows train wants 32: after three chromosomes it lacks 2 and validation lacks 4.
    rows = counts(spark, [("b", 10), ("a", 10), ("d", 10), ("c", 10)])
    assert values(X.greedy_split(rows), "chrom", "split") == [
        ("a", "train"), ("b", "train"), ("c", "train"), ("d", "validation")
    ]


def test_single_chromosome_leaves_empty_splits(spark):
    sites = spark.createDataFrame([("a", 1, 10), ("a", 0, 20)], "chrom string, label int, coverage bigint")
    summary = values(X.split_summary(X.split_sites(sites)), "split", "row_count", "methylated_fraction", "fraction_of_consensus")
    assert summary == [("test", 0, None, 0.0), ("train", 2, 0.5, 1.0), ("validation", 0, None, 0.0)]


# -- row numbers and samples -------------------------------------------------


def test_row_index_follows_the_order(spark):
    rows = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("k")).repartition(7)
    indexed = I.with_row_index(rows, ["k"], I.hash_blocks("k")).collect()
    assert [r["row_index"] for r in sorted(indexed, key=lambda r: r["k"])] == list(range(1000))


def test_group_index_restarts(spark):
    rows = spark.range(100).select((F.col("id") % 3).cast("string").alias("g"), "id")
    found = values(I.with_row_index(rows, ["id"], [F.floor(F.col("id") / 7)], group="g"), "g", "id", "row_index")
    assert all(index == id_ // 3 for _, id_, index in found)


@pytest.mark.parametrize("n", [1, 3, 4, 5, 9, 100])
def test_even_sample(spark, n):
    import numpy as np

    sites = spark.range(1, n + 1).select(
        F.lit("c").alias("chrom"), F.lit(0).alias("bin_start"), F.col("id").alias("canonical_position")
    )
    wanted = np.arange(n) if n <= 4 else np.unique(np.linspace(0, n - 1, num=4, dtype=np.int64))
    found = [r[0] - 1 for r in values(I.even_sample(sites, 4), "canonical_position")]
    assert found == list(wanted)
    in_row = one(spark, I.even_sample_in_row(F.sequence(F.lit(0), F.lit(n - 1)), 4))
    assert in_row == list(wanted)


@pytest.mark.parametrize("limit", [64, 128])
def test_even_sample_at_full_size(spark, limit):
    import numpy as np

    sizes = [limit, limit + 1, 777, 2999]
    sites = spark.createDataFrame([(str(n), n) for n in sizes], "chrom string, n int").select(
        "chrom", F.lit(0).alias("bin_start"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("canonical_position")
    )
    found = {}
    for chrom, position in values(I.even_sample(sites, limit), "chrom", "canonical_position"):
        found.setdefault(chrom, []).append(position)
    for n in sizes:
        wanted = np.arange(n) if n <= limit else np.unique(np.linspace(0, n - 1, num=limit, dtype=np.int64))
        assert sorted(found[str(n)]) == list(wanted)


# -- graph -------------------------------------------------------------------

EDGES = "src bigint, dst bigint, weight double"


def both_ways(*pairs):
    return [(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs if a != b]


def test_equal_weights_keep_the_lower_neighbour(spark):
    edges = spark.createDataFrame([(0, d, 5.0) for d in (3, 1, 2)], EDGES)
    assert values(H.topk_neighbours(edges, 2), "dst") == [(1,), (2,)]


def test_edge_in_the_weaker_list_only_survives(spark):
    edges = spark.createDataFrame(both_ways((0, 1, 9.0), (0, 2, 8.0), (0, 3, 1.0)), EDGES)
    kept = values(H.topk_union(edges, 2), "src", "dst")
    assert (0, 3) in kept and (3, 0) in kept


def test_diagonal_takes_a_slot_and_zero_edges_vanish(spark):
    edges = spark.createDataFrame(both_ways((0, 0, 9.0), (0, 1, 8.0), (0, 2, 7.0), (1, 2, 9.0), (1, 1, 8.5), (2, 2, 9.5), (3, 4, 0.0)), EDGES)
    kept = values(H.topk_union(edges, 2), "src", "dst")
    assert (0, 0) in kept and (0, 2) not in kept and (3, 4) not in kept


def test_duplicates_sum_and_diagonal_counts_once(spark):
    contacts = spark.createDataFrame(
        [("c", 0, 1, 2.0), ("c", 0, 1, 3.0), ("c", 1, 0, 1.0), ("c", 2, 2, 4.0)],
        "chrom string, bin_x bigint, bin_y bigint, count double",
    )
    offsets = spark.createDataFrame([("c", 10)], "chrom string, node_offset bigint")
    assert values(H.symmetric_edges(contacts, offsets), "src", "dst", "weight") == [(10, 11, 6.0), (11, 10, 6.0), (12, 12, 4.0)]
    assert len(values(H.symmetric_edges(contacts, offsets, drop_diagonal=True), "src")) == 2


def test_edge_features(spark):
    edges = spark.createDataFrame([(0, 2, 4.0), (1, 1, 2.0)], EDGES)
    nodes = spark.createDataFrame([(0,), (1,)], "node_index bigint")
    found = values(H.edge_features(edges, nodes, 10, 2), "src", "dst", "observed_expected", "is_self_loop", "log_distance")
    assert [(a, b, oe, loop) for a, b, oe, loop, _ in found] == [
        (0, 0, 1.0, 1.0), (0, 2, 1.0, 0.0), (1, 1, 1.0, 0.0), (1, 1, 1.0, 1.0)
    ]
    assert found[1][4] == pytest.approx(3.044522, abs=1e-5)
    with pytest.raises(Exception, match="longer than 1 bins"):
        H.edge_features(edges, nodes, 10, 1).collect()


def test_a_contact_outside_its_chromosome_is_an_error(spark):
    offsets = spark.createDataFrame([("c", 0, 25), ("d", 3, 10)], "chrom string, node_offset bigint, chrom_length bigint")
    rows = spark.createDataFrame([("c", 0, 2, 1.0), ("x", 9, 9, 1.0)], "chrom string, bin_x bigint, bin_y bigint, count double")
    assert values(H.contacts_inside(rows, offsets, 10), "chrom", "bin_y") == [("c", 2)]
    for bins in ((0, 3), (-1, 2)):
        wrong = spark.createDataFrame([("c", *bins, 1.0)], rows.schema)
        with pytest.raises(Exception, match="outside c"):
            H.contacts_inside(wrong, offsets, 10).collect()


def test_contacts_that_are_not_finite(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "count double")
    assert values(H.finite_contacts(rows), "count") == [(1.0,)]


def test_node_index_is_contiguous_in_the_given_order(spark):
    sizes = spark.createDataFrame([("chr2", 25), ("chr10", 10), ("chr1", 0), ("chrX", 1)], "chrom string, length bigint")
    found = H.node_index(sizes, 10, ("chr1", "chr2", "chr10", "chrX"))
    assert values(found, "node_index", "chrom", "bin_start", "bin_end") == [
        (0, "chr2", 0, 10), (1, "chr2", 10, 20), (2, "chr2", 20, 25), (3, "chr10", 0, 10), (4, "chrX", 0, 1)
    ]


# -- vectors -----------------------------------------------------------------


def test_softmax_over_a_wide_range_of_scores(spark):
    import numpy as np

    scores = [700.0, 699.0, 650.0, -5.0, 0.0, -800.0, -801.5]
    rows = [(i, s, [float(i), 1.0, float(i * i)]) for i, s in enumerate(scores)]
    tokens = spark.createDataFrame([("a", *r) for r in rows[:5]] + [("b", *r) for r in rows[5:]],
                                   "seq_id string, i int, score double, embedding array<float>")
    found = {r["seq_id"]: r["embedding"] for r in N.softmax_pool(tokens).collect()}
    for key, part in (("a", rows[:5]), ("b", rows[5:])):
        s = np.array([r[1] for r in part])
        w = np.exp(s - s.max())
        wanted = (w[:, None] * np.array([r[2] for r in part])).sum(0) / w.sum()
        assert found[key] == pytest.approx(list(wanted), rel=1e-12)


def test_masked_mean_of_nothing_is_zero(spark):
    rows = spark.createDataFrame([(1, 0, [3.0, 4.0]), (2, 1, [3.0, 4.0]), (2, 0, [9.0, 9.0])],
                                 "seq_id int, mask int, embedding array<double>")
    found = {r["seq_id"]: r["embedding"] for r in N.masked_mean(rows).collect()}
    assert found == {1: [0.0, 0.0], 2: [3.0, 4.0]}


def test_checks_on_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float("nan"), 1.0]), (3, [1.0]), (4, None)], "id int, v array<double>")
    assert values(audit.wrong_width(rows, "v", 2), "id") == [(3,), (4,)]
    assert values(audit.nonfinite_vectors(rows.filter("v IS NOT NULL"), "v"), "id") == [(2,)]


# -- metrics -----------------------------------------------------------------


def predictions(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, map(float, scores))), "label int, score double")


def test_single_class(spark):
    rows = predictions(spark, [0, 0, 0], [0.1, 0.9, 0.2])
    cumulative = M.cumulative_counts(rows)
    assert M.roc_auc(cumulative).first()[0] is None
    assert M.average_precision(cumulative).first()[0] == 0.0
    figures = M.confusion_metrics(rows).first()
    assert (figures["mcc"], figures["f1"]) == (0.0, 0.0)
    assert figures["balanced_accuracy"] == pytest.approx(2 / 3)
    with pytest.raises(Exception, match="no positive labels"):
        M.pos_weight(rows).collect()


def test_equal_scores_are_half_right(spark):
    rows = predictions(spark, [0, 1, 1, 0], [0.5] * 4)
    cumulative = M.cumulative_counts(rows)
    assert M.roc_auc(cumulative).first()[0] == 0.5
    assert M.average_precision(cumulative).first()[0] == 0.5


def test_constant_prediction_has_no_correlation(spark):
    figures = M.confusion_metrics(predictions(spark, [0, 1], [0.9, 0.8])).first()
    assert figures["mcc"] == 0.0


@pytest.mark.parametrize("slices", [1, 3, 1 << 16])
def test_cumulative_counts_do_not_depend_on_the_cut(spark, slices):
    import random

    rng = random.Random(slices)
    rows = [(rng.randint(0, 1), rng.choice([0.0, 1e-12, 0.3, 1.0, -2.0, 5.5, rng.random()])) for _ in range(400)]
    found = {r["score"]: (r["cum_pos"], r["cum_neg"]) for r in
             M.cumulative_counts(predictions(spark, *zip(*rows)), slices).collect()}
    for score, (pos, neg) in found.items():
        above = [y for y, s in rows if s >= score]
        assert (pos, neg) == (sum(above), len(above) - sum(above))


def test_sweep_prefers_half_then_the_lowest(spark):
    tie_with_half = predictions(spark, [0, 1], [0.2, 0.8])
    assert M.best_threshold(tie_with_half).first()["best_threshold"] == 0.5
    two_optima = predictions(spark, [0, 0, 1, 1], [0.5, 0.605, 0.8, 0.9])
    assert M.best_threshold(two_optima).first()["best_threshold"] == pytest.approx(0.61)


def history(spark, losses, frozen=0):
    rows = [("r", e, "frozen" if e < frozen else "unfrozen", float(v)) for e, v in enumerate(losses)]
    return spark.createDataFrame(rows, "run_id string, epoch int, phase string, loss double")


def test_improvement_must_exceed_the_delta(spark):
    found = M.early_stopping(history(spark, [1.0, 0.75, 0.8]), 5, 0.25).first()
    assert found["best_epoch"] == 0
    found = M.early_stopping(history(spark, [1.0, 0.7, 0.8]), 5, 0.25).first()
    assert found["best_epoch"] == 1


def test_patience_does_not_stop_a_frozen_run(spark):
    found = M.early_stopping(history(spark, [1, 2, 2, 2, 2, 2], frozen=4), 2, 1e-5).first()
    assert (found["best_epoch"], found["stop_epoch"]) == (0, 4)


def test_epochs_after_the_stop_do_not_count(spark):
    found = M.early_stopping(history(spark, [1, 2, 2, 0.1]), 2, 1e-5).first()
    assert (found["best_loss"], found["stop_epoch"], found["epoch_count"]) == (1.0, 2, 4)


def test_higher_is_better(spark):
    rows = history(spark, [0.1, 0.4, 0.3]).withColumnRenamed("loss", "mcc")
    found = M.early_stopping(rows, 5, 1e-5, value="mcc", higher_is_better=True).first()
    assert (found["best_epoch"], found["best_mcc"]) == (1, 0.4)


def test_long_runs_and_repeated_epochs(spark):
    found = M.early_stopping(history(spark, [1.0] * 25_000), 24_000, 1e-5).first()
    assert (found["epoch_count"], found["best_epoch"], found["stop_epoch"]) == (25_000, 0, 24_000)
    rows = history(spark, [1, 1, 1])
    with pytest.raises(Exception, match="missing or repeated"):
        M.early_stopping(rows.unionByName(rows.limit(1)), 2, 1e-5).collect()
    odd = M.early_stopping(history(spark, [float("nan"), 3.0, float("nan")]), 5, 1e-5).first()
    assert (odd["best_epoch"], odd["best_loss"]) == (1, 3.0)
    assert M.early_stopping(rows.limit(0), 2, 1e-5).count() == 0


def test_loss_of_confident_logits(spark):
    rows = spark.createDataFrame([(0, 40.0), (1, -700.0), (1, 2.0), (0, -1e6)], "label int, logit double")
    import math

    small = math.log1p(math.exp(-2.0))
    assert M.weighted_log_loss(rows).first()["loss"] == pytest.approx((40 + 700 + small) / 4, rel=1e-12)


@pytest.mark.parametrize("label, score", [(1, None), (1, float("nan")), (0, float("inf")), (2, 0.5), (None, 0.5)])
def test_figures_of_broken_rows_are_errors(spark, label, score):
    rows = spark.createDataFrame([(1, 0.5, 0.5), (label, score, score)], "label int, score double, logit double")
    for figures in (M.weighted_log_loss, M.confusion_metrics, M.best_threshold, lambda r: M.ranking_areas(M.cumulative_counts(r))):
        with pytest.raises(Exception, match="not finite"):
            figures(rows).collect()


def test_many_groups_are_split_in_one_pass(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("g"), "id").alias("chrom"), (F.col("id") % 50 + 1).alias("site_count"))
    split = X.greedy_split(rows)
    sums = {r["split"]: r["n"] for r in split.join(rows, "chrom").groupBy("split").agg(F.sum("site_count").alias("n")).collect()}
    assert split.count() == 20_000
    assert sums["train"] / sum(sums.values()) == pytest.approx(0.8, abs=0.001)


def test_a_hub_of_full_degree_and_wide_vectors(spark):
    import numpy as np

    cap, width = 40, 793
    vectors = np.random.default_rng(0).random((2 * cap + 1, width))
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "node_index bigint, features array<double>")
    edges = spark.createDataFrame([(i, cap, 0.0) for i in range(2 * cap + 1)] + [(0, 0, 1.0)], "src bigint, dst bigint, s double")
    found = {r["dst"]: r["embedding"] for r in N.neighbour_aggregate(edges, features, "s", cap).collect()}
    assert found.keys() == {0, cap} and np.allclose(found[cap], vectors.mean(axis=0)) and np.allclose(found[0], vectors[0])
    with pytest.raises(Exception, match="longer than 39 bins"):
        N.neighbour_aggregate(edges, features, "s", cap - 1).collect()


def test_neighbours_across_blocks(spark):
    import numpy as np

    cap, nodes = 3, 4 * N.BLOCK_REACHES * 4
    vectors = np.random.default_rng(1).random((nodes, 2))
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "node_index bigint, features array<double>")
    near = [[j for j in range(i - cap, i + cap + 1) if 0 <= j < nodes] for i in range(nodes)]
    edges = spark.createDataFrame([(j, i, 0.0) for i in range(nodes) for j in near[i]], "src bigint, dst bigint, s double")
    mixed = N.neighbour_aggregate(edges, features, "s", cap)
    found = {r["dst"]: r["embedding"] for r in mixed.collect()}
    assert len(found) == nodes and all(np.allclose(found[i], vectors[near[i]].mean(axis=0)) for i in range(nodes))


def test_most_vectors_are_sent_once(spark, monkeypatch):
    sent, nodes = [], 16 * N.BLOCK_REACHES * 4
    cogroup = type(spark.range(1).groupBy("id")).cogroup
    monkeypatch.setattr(
        type(spark.range(1).groupBy("id")), "cogroup", lambda a, b: sent.append(b._df.count()) or cogroup(a, b)
    )
    features = spark.range(nodes).selectExpr("id AS node_index", "array(1D) AS features")
    edges = spark.range(nodes).selectExpr("id AS src", "id AS dst", "0D AS s")
    assert N.neighbour_aggregate(edges, features, "s", 3).count() == nodes and sent[0] <= 1.25 * nodes


def test_masked_scores_have_no_weight(spark):
    low = float("-inf")
    rows = [("a", 1.0, [1.0]), ("a", low, [5.0]), ("a", None, [7.0]), ("b", low, [2.0])]
    tokens = spark.createDataFrame(rows, "seq_id string, score double, embedding array<double>")
    assert {r["seq_id"]: r["embedding"] for r in N.softmax_pool(tokens).collect()} == {"a": [1.0], "b": None}


def test_alignment_of_repeated_and_unlabelled_sites(spark):
    schema = "chrom string, canonical_position int, label int, node_index int"
    left = spark.createDataFrame([("c", 1, 1, 0), ("c", 1, 1, 0), ("c", 2, None, 0), ("c", 3, None, 0), ("c", 4, 0, 0)], schema)
    right = spark.createDataFrame([("c", 1, 1, 0), ("c", 2, 1, 0), ("c", 3, None, 0), ("c", 5, 0, 0)], schema)
    nodes = spark.createDataFrame([("c", p, 0) for p in range(6)], "chrom string, canonical_position int, node_index int")
    assert values(audit.alignment(left, right, nodes), "canonical_position", "outcome") == [
        (1, "row counts differ"), (2, "labels differ"), (3, "aligned"), (4, "only in the first set"), (5, "only in the second set")
    ]


# -- shards and audits -------------------------------------------------------


def test_shards_are_full_but_the_last(spark):
    rows = spark.range(25).select(
        F.when(F.col("id") < 4, "test").otherwise("train").alias("split"),
        F.lit("c").alias("chrom"), F.col("id").alias("canonical_position"), F.lit("ACGT").alias("sequence"),
    )
    coded = D.encode_windows(D.assign_shards(rows, 10))
    manifest = D.shard_manifest(coded, "pair_codes", 10, "part")
    assert values(manifest, "split", "shard_index", "row_count", "codes_width", "total_rows", "shard_count") == [
        ("test", 0, 4, 3, 4, 1), ("train", 0, 10, 3, 21, 3), ("train", 1, 10, 3, 21, 3), ("train", 2, 1, 3, 21, 3)
    ]
    assert values(D.shard_offsets(manifest), "split", "row_offset") == [("test", 0), ("train", 0), ("train", 10), ("train", 20)]
    short = spark.createDataFrame([("t", 0, 10), ("t", 1, 7), ("t", 2, 10), ("t", 2500, 1)], "split string, shard_index bigint, row_count bigint")
    assert values(D.shard_offsets(short), "shard_index", "row_offset") == [(0, 0), (1, 10), (2, 17), (2500, 27)]
    other = manifest.filter("shard_index < 2").withColumn("row_count", F.col("row_count") + 1)
    assert D.compare_layouts(manifest, other).filter("NOT agrees").count() == 4


def test_shuffle_repeats_with_the_seed_only(spark):
    rows = spark.range(50).select(F.col("id").alias("canonical_position"), F.lit("c").alias("chrom"))
    key = ["chrom", "canonical_position"]
    order = lambda seed, epoch: [r[0] for r in D.epoch_shuffle(rows, key, seed, epoch).collect()]
    assert order(1, 0) == order(1, 0)
    assert order(1, 0) != order(1, 1)
    assert sorted(order(1, 0)) == list(range(50))


def test_guards(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError, match="twice"):
        audit.require_empty(audit.duplicate_keys(rows, ["k"]), "listed twice")
    with pytest.raises(ValueError):
        audit.require_at_least(rows, "v", 2, "too small")
    audit.require_same_count(rows, rows, "counts")


def test_presets():
    assert (WGBS_GRCH38.max_contact_bins, WGBS_GRCH38.center) == (500, 250)
    assert (RRBS_HG19.min_replicate_coverage, RRBS_HG19.max_sampled_sites) == (5, 128)
