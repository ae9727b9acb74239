"""The given tables read as methylation data, in Spark and as SQL views.

``Tables`` builds the DataFrames; ``with_views`` prefixes a query with the views of the
same names that it mentions, for an engine that runs plain SQL.
"""

from __future__ import annotations

import re
from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.operators import calls as C
from epispark.operators import genome as G
from epispark.operators import graph as H
from epispark.operators import nodes as N
from epispark.operators import quality as Q
from epispark.operators import shards as D
from epispark.operators import splits as X
from epispark.params import RRBS_HG19
from epispark.sources import properties as P
from epispark.sources.staging import staged

PARAMS = replace(
    RRBS_HG19,
    min_replicate_coverage=10,
    min_total_coverage=20,
    window=51,
    tile_width=1_000,
    bin_width=100,
    max_contact_distance=4_000,
    top_k=8,
    max_sampled_sites=4,
    shard_size=500,
    batch_size=64,
    embedding_width=64,
    patience=5,
)

CHROM_OF_SUPPLIER = (
    "concat('chr', CASE l_suppkey % 25 WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN 'M' "
    "ELSE CAST(1 + l_suppkey % 25 AS STRING) END)"
)
PAIR_CHROM_OF_SUPPLIER = (
    "concat('chr', CASE WHEN l_suppkey % 23 = 22 THEN 'X' WHEN l_suppkey % 23 IN (5, 17) THEN '1'"
    " ELSE CAST(1 + l_suppkey % 23 AS STRING) END)"
)
RAW_NAME = (
    "CASE WHEN k < 10 THEN concat('chr', CAST(1 + k AS STRING)) WHEN k < 22 THEN CAST(1 + k AS STRING) "
    "WHEN k = 22 THEN 'CHRx' WHEN k = 23 THEN ' y ' ELSE 'MT' END"
)
IS_POSITIVE = "event_type IN ('purchase', 'signup')"


class Tables:
    """The bindings of one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- calls ---------------------------------------------------------------

    @cached_property
    def calls(self) -> DataFrame:
        site = "CAST(floor(l_partkey / 4) AS BIGINT)"
        return self.table("lineitem").selectExpr(
            "1 + l_linenumber % 2 AS rep",
            f"{CHROM_OF_SUPPLIER} AS chrom",
            f"{site} * 100 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS chrom_start",
            "CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand",
            "CAST(l_quantity AS BIGINT) AS coverage",
            f"CAST(least(100, ({site} * 7 + (l_suppkey % 25) * 13) % 97"
            " + CAST(round(l_discount * 100) AS BIGINT) + (l_orderkey % 5) * 12) AS DOUBLE)"
            " AS percent_methylated",
        )

    @cached_property
    def counted(self) -> DataFrame:
        return C.stranded_counts(self.calls, PARAMS.chroms)

    @cached_property
    def merged(self) -> DataFrame:
        return C.merge_strands(self.counted)

    @cached_property
    def consensus(self) -> DataFrame:
        return C.consensus_sites(self.calls, PARAMS)

    # -- genome --------------------------------------------------------------

    @cached_property
    def contigs(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "concat('ctg', doc_id) AS chrom",
            "translate(upper(regexp_replace(text, '[^acgtxqyACGTXQY]+', '')), 'XQ', 'NN') AS seq",
        )

    @cached_property
    def contig_lengths(self) -> DataFrame:
        return self.contigs.select("chrom", F.length("seq").cast("bigint").alias("length"))

    @cached_property
    def tiles(self) -> DataFrame:
        return G.tile_contigs(self.contigs, PARAMS.tile_width, PARAMS.center)

    @cached_property
    def cg(self) -> DataFrame:
        return G.cg_sites(self.tiles, PARAMS.tile_width)

    @cached_property
    def sites(self) -> DataFrame:
        """Every CG, a shifted copy of each fifth one, and one site on no contig.

        Two CGs never touch, so the shifted copies are new and no distinct is needed.
        """
        here = F.col("canonical_position")
        shifted = F.when(here % 5 == 0, F.array(here, here + 1)).otherwise(F.array(here))
        both = self.cg.withColumn("canonical_position", F.explode(shifted))
        absent = self.spark.range(1).select(
            F.lit("ctg_absent").alias("chrom"), F.lit(100).cast("bigint").alias("canonical_position")
        )
        return both.unionByName(absent)

    @cached_property
    def windows(self) -> DataFrame:
        return G.site_windows(self.sites, self.tiles, PARAMS.tile_width, PARAMS.window)

    @cached_property
    def valid(self) -> DataFrame:
        return Q.valid_windows(self.windows, PARAMS.window, PARAMS.max_unknown_fraction)

    @cached_property
    def rows(self) -> DataFrame:
        """Valid windows with a label and the split of their contig group."""
        number = F.regexp_replace("chrom", "^ctg", "").try_cast("bigint")
        labelled = self.valid.select(
            "chrom",
            "canonical_position",
            "sequence",
            (F.col("canonical_position") % 2).cast("tinyint").alias("label"),
            F.concat(F.lit("g"), number % 23).alias("grp"),
        )
        return X.split_sites(labelled, "grp")

    @cached_property
    def sharded(self) -> DataFrame:
        """From written rows: numbering reads them twice."""
        return D.assign_shards(staged(self.rows.drop("grp"), "rows"), PARAMS.shard_size)

    @cached_property
    def raw_properties(self) -> DataFrame:
        """Property rows in mixed spelling, repeated, some of them broken."""
        names = F.array(*[F.lit(d) for d in P.DINUCLEOTIDES])
        key, size = F.col("p_partkey"), F.col("p_size")
        known = F.get(names, (key % 18).cast("int"))
        spelled = F.concat(
            F.when(size % 3 == 0, " ").otherwise(""), F.when(size % 2 == 0, F.lower(known)).otherwise(known)
        )
        value = F.expr(
            "transform(sequence(0, CASE WHEN p_partkey % 13 = 0 THEN 10 ELSE 11 END), j ->"
            " CAST(CASE WHEN p_partkey % 11 = 0 AND j = 3 THEN CAST('NaN' AS DOUBLE)"
            " ELSE ((p_size * 12 + j) * 37 % 101) / 100D END AS FLOAT))"
        )
        return self.table("part").select(
            key.alias("row_number"),
            F.when(key % 18 < 16, spelled)
            .when(key % 18 == 16, "AN")
            .otherwise("A")
            .alias("dinucleotide"),
            value.alias("properties"),
        )

    # -- graph ---------------------------------------------------------------

    @cached_property
    def contacts(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            f"{PAIR_CHROM_OF_SUPPLIER} AS chrom",
            "least(l_partkey % 97, l_orderkey % 97) AS bin_x",
            "greatest(l_partkey % 97, l_orderkey % 97) AS bin_y",
            "CASE WHEN l_orderkey % 50 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END AS count",
        )

    @cached_property
    def chrom_sizes(self) -> DataFrame:
        """Names in mixed spelling; the lengths follow the largest position."""
        k = F.col("l_suppkey") % 25
        # The name comes from an aggregate, so tests on it are not pushed to every record.
        longest = self.table("lineitem").groupBy(k).agg(
            F.max(k).alias("k"), F.max("l_partkey").alias("top")
        )
        return longest.selectExpr(
            f"{RAW_NAME} AS raw_name", "9601 + k + CAST(floor(top / 4) AS BIGINT) * 100 AS length"
        )

    @cached_property
    def nodes(self) -> DataFrame:
        sizes = H.normalize_chrom_sizes(self.chrom_sizes, PARAMS.chroms)
        return H.node_index(sizes, PARAMS.bin_width, PARAMS.chroms)

    @cached_property
    def edges(self) -> DataFrame:
        usable = H.near_contacts(H.finite_contacts(self.contacts), PARAMS.max_contact_bins)
        offsets = H.chrom_offsets(self.nodes)
        return H.symmetric_edges(H.contacts_inside(usable, offsets, PARAMS.bin_width), offsets)

    @cached_property
    def kept_edges(self) -> DataFrame:
        return H.topk_union(self.edges, PARAMS.top_k)

    @cached_property
    def edge_features(self) -> DataFrame:
        return H.edge_features(
            self.kept_edges, self.nodes, PARAMS.bin_width, PARAMS.max_contact_bins
        )

    # -- vectors -------------------------------------------------------------

    @cached_property
    def window_embeddings(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "concat('chr', CAST(1 + vec_id % 2 AS STRING)) AS chrom",
            "CAST(floor(vec_id / 8) AS BIGINT) % 90 * 100 AS bin_start",
            "vec_id AS window_id",
            "embedding",
        )

    @cached_property
    def pooled(self) -> DataFrame:
        return N.pool_embeddings(self.window_embeddings)

    @cached_property
    def node_features(self) -> DataFrame:
        return N.node_features(self.nodes, self.pooled, PARAMS.embedding_width)

    @cached_property
    def full_features(self) -> DataFrame:
        return N.full_features(N.extra_features(self.node_features, PARAMS.chroms))

    @cached_property
    def tokens(self) -> DataFrame:
        """Tokens of sequences; every seventh sequence has no unmasked token."""
        return self.table("embeddings").selectExpr(
            "CAST(floor(vec_id / 8) AS BIGINT) AS seq_id",
            "vec_id % 8 AS token_pos",
            "CASE WHEN vec_id % 5 = 0 OR CAST(floor(vec_id / 8) AS BIGINT) % 7 = 0 THEN 0 ELSE 1 END AS mask",
            "CAST((vec_id * 37) % 101 AS DOUBLE)"
            " * CASE WHEN CAST(floor(vec_id / 8) AS BIGINT) % 2 = 0 THEN 0.05D ELSE 1.5D END - 20 AS score",
            "embedding",
        )

    # -- evaluation ----------------------------------------------------------

    @cached_property
    def predictions(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS row_id",
            f"CASE WHEN {IS_POSITIVE} THEN 1 ELSE 0 END AS label",
            f"((event_id * 7919) % 700 + CASE WHEN {IS_POSITIVE} THEN 300 ELSE 0 END) / 1000D AS score",
            "CASE event_id % 50 WHEN 0 THEN 40D WHEN 1 THEN -40D ELSE (event_id * 7919 % 1000) / 100D - 5 END AS logit",
        )

    @cached_property
    def history(self) -> DataFrame:
        """A hundred epochs per run."""
        return self.table("events").selectExpr(
            "CAST(floor(event_id / 100) AS BIGINT) AS run_id",
            "CAST(event_id % 100 AS INT) AS epoch",
            "CASE WHEN event_id % 100 < 5 THEN 'frozen' ELSE 'unfrozen' END AS phase",
            "value AS loss",
        )

    @cached_property
    def files(self) -> DataFrame:
        return self.table("pages").selectExpr(
            "url AS path",
            "page_id",
            "CAST(length(html) AS BIGINT) AS size",
            "md5(html) AS md5",
            "CAST(length(html) + CASE WHEN page_id % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS expected_size",
            "CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 10 = 5 THEN md5('x') ELSE md5(html) END"
            " AS expected_md5",
            "CASE WHEN page_id % 11 = 0 THEN 'hg19' ELSE 'GRCh38' END AS assembly",
            "CASE WHEN page_id % 17 = 0 THEN NULL ELSE 'contact matrix' END AS output_type",
            "CASE WHEN page_id % 13 = 0 THEN 'archived' ELSE 'released' END AS status",
        )


def digest(vector: str, places: int = 6) -> list[Column]:
    """A vector as its width and two weighted sums, to compare without printing it."""
    indexed = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))

    def total(values: Column) -> Column:
        return F.round(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x), places)

    return [
        F.size(vector).alias("width"),
        total(indexed).alias("weighted_sum"),
        total(squares).alias("square_sum"),
    ]


def long_form(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    """One row per vector element, rounded."""
    return df.select(*key, F.posexplode(vector).alias("dim", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )


def _in(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


_CHROM_LIST = _in(PARAMS.chroms)


def _duck(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


VIEWS: dict[str, str] = {
    "b_calls": f"""
        SELECT 1 + l_linenumber % 2 AS rep,
               {_duck(CHROM_OF_SUPPLIER)} AS chrom,
               (l_partkey // 4) * 100 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS chrom_start,
               CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand,
               CAST(l_quantity AS BIGINT) AS coverage,
               CAST(least(100, ((l_partkey // 4) * 7 + (l_suppkey % 25) * 13) % 97
                    + CAST(round(l_discount * 100) AS BIGINT) + (l_orderkey % 5) * 12) AS DOUBLE)
                 AS percent_methylated
        FROM lineitem""",
    "b_counted_all": """
        SELECT *, coverage - count_m AS count_u FROM (
          SELECT *, CAST(round_even(coverage * percent_methylated / 100.0, 0) AS BIGINT) AS count_m,
                 CASE WHEN strand = '+' THEN chrom_start + 1 ELSE chrom_start END AS canonical_position
          FROM b_calls) c""",
    "b_counted": f"SELECT * FROM b_counted_all WHERE chrom IN ({_CHROM_LIST})",
    "b_merged": """
        SELECT *, count_m + count_u AS coverage,
               CAST(count_m AS DOUBLE) / nullif(count_m + count_u, 0) AS methylation_ratio
        FROM (SELECT rep, chrom, canonical_position, count(*) AS strand_row_count,
                     CAST(sum(count_m) AS BIGINT) AS count_m, CAST(sum(count_u) AS BIGINT) AS count_u
              FROM b_counted GROUP BY ALL) m""",
    "b_both": """
        SELECT a.chrom, a.canonical_position, a.count_m + b.count_m AS count_m,
               a.count_u + b.count_u AS count_u, a.coverage + b.coverage AS coverage,
               abs(a.methylation_ratio - b.methylation_ratio) AS replicate_ratio_difference
        FROM b_merged a JOIN b_merged b USING (chrom, canonical_position)
        WHERE a.rep = 1 AND b.rep = 2 AND a.coverage >= 10 AND b.coverage >= 10""",
    "b_consensus": """
        SELECT *, CAST(CASE WHEN count_m > count_u THEN 1 ELSE 0 END AS TINYINT) AS label,
               CAST(count_m AS DOUBLE) / nullif(coverage, 0) AS consensus_methylation_ratio
        FROM b_both WHERE coverage >= 20 AND replicate_ratio_difference <= 0.2::DOUBLE""",
    "b_call_counts": "SELECT chrom AS name, count(*) AS n FROM b_consensus GROUP BY chrom",
    "b_contigs": """
        SELECT concat('ctg', doc_id) AS chrom, doc_id,
               translate(upper(regexp_replace(text, '[^acgtxqyACGTXQY]', '', 'g')), 'XQ', 'NN') AS seq
        FROM documents""",
    "b_cg": """
        SELECT chrom, pos AS canonical_position
        FROM (SELECT chrom, seq, unnest(range(1, length(seq))) AS pos FROM b_contigs) p
        WHERE substring(seq, pos, 2) = 'CG'""",
    "b_sites": """
        SELECT chrom, canonical_position FROM b_cg
        UNION SELECT chrom, canonical_position + 1 FROM b_cg WHERE canonical_position % 5 = 0
        UNION SELECT 'ctg_absent', 100""",
    "b_windows": """
        SELECT s.chrom, s.canonical_position,
               CASE WHEN s.canonical_position - 26 >= 0 AND s.canonical_position + 25 <= length(c.seq)
                    THEN substring(c.seq, s.canonical_position - 25, 51) END AS sequence
        FROM b_sites s LEFT JOIN b_contigs c ON s.chrom = c.chrom""",
    "b_measures": """
        SELECT *, CAST(length(sequence) AS INTEGER) AS sequence_length,
               substring(sequence, 26, 2) AS center_dinucleotide,
               CAST(length(regexp_replace(sequence, '[ACGT]', '', 'g')) AS INTEGER) AS unknown_base_count,
               CAST(length(regexp_replace(sequence, '[ACGTN]', '', 'g')) AS INTEGER) AS unsupported_base_count,
               length(regexp_replace(sequence, '[ACGT]', '', 'g')) / 51.0::DOUBLE AS unknown_fraction
        FROM b_windows""",
    "b_checked": """
        SELECT *, CASE WHEN sequence IS NULL THEN 'Missing chromosome or boundary sequence'
                       WHEN sequence_length <> 51 THEN 'Incorrect sequence length'
                       WHEN unsupported_base_count > 0 THEN 'Unsupported reference base'
                       WHEN center_dinucleotide <> 'CG' THEN 'Center is not CG'
                       WHEN unknown_fraction > 0.1::DOUBLE THEN 'Unknown fraction above threshold'
                       ELSE 'Valid' END AS sequence_status
        FROM b_measures""",
    "b_labelled": """
        SELECT chrom, canonical_position, sequence, CAST(canonical_position % 2 AS TINYINT) AS label,
               concat('g', CAST(replace(chrom, 'ctg', '') AS BIGINT) % 23) AS grp
        FROM b_checked WHERE sequence_status = 'Valid'""",
    "b_group_counts": "SELECT grp AS name, count(*) AS n FROM b_labelled GROUP BY grp",
    "b_rows": """
        SELECT l.*, m.split FROM b_labelled l JOIN b_group_split m ON l.grp = m.name""",
    "b_sharded": """
        SELECT *, row_index // 500 AS shard_index FROM (
          SELECT *, row_number() OVER (PARTITION BY split ORDER BY chrom, canonical_position) - 1 AS row_index
          FROM b_rows) r""",
    "b_shards": """
        SELECT split, shard_index, count(*) AS row_count FROM b_sharded GROUP BY split, shard_index""",
    "b_raw_properties": """
        SELECT p_partkey AS row_number,
               CASE WHEN p_partkey % 18 < 16
                    THEN concat(substring('ACGT', 1 + (p_partkey % 18) // 4, 1),
                                substring('ACGT', 1 + (p_partkey % 18) % 4, 1))
                    WHEN p_partkey % 18 = 16 THEN 'AN' ELSE 'A' END AS dinucleotide,
               CASE WHEN p_partkey % 18 >= 16 THEN 'invalid dinucleotide'
                    WHEN p_partkey % 13 = 0 THEN 'wrong number of properties'
                    WHEN p_partkey % 11 = 0 THEN 'non-finite value' END AS problem,
               p_partkey % 18 AS code, p_size
        FROM part""",
    "b_props": """
        SELECT code, CAST(j AS INTEGER) AS j,
               CAST(CAST(((p_size * 12 + j) * 37 % 101) / 100.0::DOUBLE AS FLOAT) AS DOUBLE) AS v
        FROM (SELECT code, arg_max(p_size, row_number) AS p_size FROM b_raw_properties
              WHERE problem IS NULL GROUP BY code) p, unnest(range(0, 12)) AS u(j)""",
    "b_base_codes": """
        SELECT chrom, canonical_position, CAST(i AS INTEGER) AS i,
               CASE substring(sequence, i + 1, 1) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2
                    WHEN 'T' THEN 3 ELSE 4 END AS code
        FROM (SELECT *, unnest(range(0, 51)) AS i FROM b_labelled) w""",
    "b_pair_codes": """
        SELECT a.chrom, a.canonical_position, a.i,
               CASE WHEN a.code = 4 OR b.code = 4 THEN 255 ELSE a.code * 4 + b.code END AS code
        FROM b_base_codes a JOIN b_base_codes b
          ON a.chrom = b.chrom AND a.canonical_position = b.canonical_position AND b.i = a.i + 1""",
    "b_matrix": """
        SELECT c.chrom, c.canonical_position, k.j AS property_no,
               string_agg(CAST(CAST(round(coalesce(p.v, 0) * 100) AS INTEGER) AS VARCHAR), ',' ORDER BY c.i) AS hundredths
        FROM b_pair_codes c CROSS JOIN (SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS j) k
        LEFT JOIN b_props p ON p.code = c.code AND p.j = k.j GROUP BY ALL""",
    "b_bins": """
        SELECT chrom, bin_start, least(bin_start + 100, length) AS bin_end FROM (
          SELECT concat('ctg', doc_id) AS chrom, length(seq) AS length,
                 unnest(range(0, length(seq), 100)) AS bin_start FROM b_contigs) b""",
    "b_contacts": f"""
        SELECT {_duck(PAIR_CHROM_OF_SUPPLIER)} AS chrom,
               least(l_partkey % 97, l_orderkey % 97) AS bin_x,
               greatest(l_partkey % 97, l_orderkey % 97) AS bin_y,
               CASE WHEN l_orderkey % 50 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END AS count
        FROM lineitem""",
    "b_chrom_sizes": f"""
        SELECT {_duck(RAW_NAME)} AS raw_name, 9601 + k + (top // 4) * 100 AS length, k
        FROM (SELECT l_suppkey % 25 AS k, max(l_partkey) AS top FROM lineitem GROUP BY 1) s""",
    "b_named_sizes": """
        SELECT concat('chr', CASE WHEN k < 22 THEN CAST(1 + k AS VARCHAR) ELSE 'X' END) AS chrom,
               raw_name, length, k FROM b_chrom_sizes WHERE k < 23""",
    "b_nodes": """
        SELECT chrom, bin_start, least(bin_start + 100, length) AS bin_end,
               row_number() OVER (ORDER BY k, bin_start) - 1 AS node_index
        FROM (SELECT chrom, k, length, unnest(range(0, length, 100)) AS bin_start FROM b_named_sizes) b""",
    "b_offsets": """
        SELECT chrom, min(node_index) AS node_offset, max(bin_end) AS chrom_length
        FROM b_nodes GROUP BY chrom""",
    "b_usable": """
        SELECT c.chrom, node_offset + bin_x AS x, node_offset + bin_y AS y, count
        FROM b_contacts c JOIN b_offsets o ON c.chrom = o.chrom
        WHERE isfinite(count) AND abs(bin_x - bin_y) <= 40""",
    "b_edges": """
        SELECT src, dst, sum(count) AS weight FROM (
          SELECT x AS src, y AS dst, count FROM b_usable
          UNION ALL SELECT y, x, count FROM b_usable WHERE x <> y) u GROUP BY src, dst""",
    "b_topk": """
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS INTEGER)
                              AS neighbour_rank FROM b_edges) r WHERE neighbour_rank <= 8""",
    "b_kept": """
        SELECT src, dst, max(weight) AS weight FROM (
          SELECT src, dst, weight FROM b_topk UNION ALL SELECT dst, src, weight FROM b_topk) u
        GROUP BY src, dst HAVING max(weight) > 0""",
    "b_expected": """
        SELECT abs(src - dst) AS distance, sum(weight) AS weight_sum, count(*) AS edge_count,
               sum(weight) / count(*) AS expected FROM b_kept GROUP BY 1""",
    "b_edge_features": """
        SELECT src, dst, CAST(ln(1 + weight) AS FLOAT) AS log_count,
               CAST(weight / greatest(expected, 1e-9) AS FLOAT) AS observed_expected,
               CAST(ln(1 + distance * 100.0::DOUBLE) AS FLOAT) AS log_distance,
               CAST(0 AS FLOAT) AS is_self_loop
        FROM b_kept k JOIN b_expected e ON abs(k.src - k.dst) = e.distance
        UNION ALL SELECT node_index, node_index, 0, 1, 0, 1 FROM b_nodes""",
    "b_wemb": """
        SELECT concat('chr', CAST(1 + vec_id % 2 AS VARCHAR)) AS chrom, (vec_id // 8) % 90 * 100 AS bin_start,
               vec_id, embedding FROM embeddings""",
    "b_pooled": """
        SELECT chrom, bin_start, dim, avg(v) AS v, count(*) AS sample_count FROM (
          SELECT chrom, bin_start, CAST(unnest(embedding) AS DOUBLE) AS v,
                 CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM b_wemb) e
        GROUP BY chrom, bin_start, dim""",
    "b_sample_counts": "SELECT DISTINCT chrom, bin_start, sample_count FROM b_pooled",
    "b_node_counts": """
        SELECT n.*, s.sample_count IS NOT NULL AS covered, coalesce(s.sample_count, 0) AS sample_count
        FROM b_nodes n LEFT JOIN b_sample_counts s USING (chrom, bin_start)""",
    "b_extra": """
        SELECT node_index, dim, v FROM (
          SELECT n.node_index, CAST(u.k AS INTEGER) AS dim,
                 CASE WHEN u.k < 23 THEN CASE WHEN s.k = u.k THEN 1.0 ELSE 0.0 END
                      WHEN u.k = 23 THEN CAST(n.bin_start AS DOUBLE) / o.chrom_length
                      ELSE CAST(n.sample_count AS DOUBLE) / (SELECT max(sample_count) FROM b_sample_counts)
                 END::DOUBLE AS v
          FROM b_node_counts n JOIN b_offsets o USING (chrom) JOIN b_named_sizes s USING (chrom),
               unnest(range(0, 25)) AS u(k)) e""",
    "b_node_vectors": """
        SELECT n.node_index, n.chrom, n.bin_start, n.dim, coalesce(p.v, 0) AS v
        FROM (SELECT *, CAST(unnest(range(0, 64)) AS INTEGER) AS dim FROM b_nodes) n
        LEFT JOIN b_pooled p USING (chrom, bin_start, dim)""",
    "b_full": """
        SELECT node_index, dim, v FROM b_node_vectors
        UNION ALL SELECT node_index, dim + 64, v FROM b_extra""",
    "b_tokens": """
        SELECT vec_id // 8 AS seq_id, vec_id,
               CASE WHEN vec_id % 5 = 0 OR (vec_id // 8) % 7 = 0 THEN 0 ELSE 1 END AS mask,
               CAST((vec_id * 37) % 101 AS DOUBLE)
                 * CASE WHEN (vec_id // 8) % 2 = 0 THEN 0.05::DOUBLE ELSE 1.5::DOUBLE END - 20 AS score,
               embedding FROM embeddings""",
    "b_token_values": """
        SELECT seq_id, vec_id, mask, score, CAST(unnest(embedding) AS DOUBLE) AS v,
               CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM b_tokens""",
    "b_predictions": f"""
        SELECT event_id AS row_id, CASE WHEN {IS_POSITIVE} THEN 1 ELSE 0 END AS label,
               CAST((event_id * 7919) % 700 + CASE WHEN {IS_POSITIVE} THEN 300 ELSE 0 END AS DOUBLE)
                 / 1000.0::DOUBLE AS score,
               CASE event_id % 50 WHEN 0 THEN 40::DOUBLE WHEN 1 THEN -40::DOUBLE
                    ELSE (event_id * 7919 % 1000) / 100.0::DOUBLE - 5 END AS logit
        FROM events""",
    "b_scores": """
        SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
        FROM b_predictions GROUP BY score""",
    "b_cumulative": """
        SELECT score, pos, neg, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg
        FROM b_scores WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""",
    "b_history": """
        SELECT event_id // 100 AS run_id, CAST(event_id % 100 AS INTEGER) AS epoch,
               CASE WHEN event_id % 100 < 5 THEN 'frozen' ELSE 'unfrozen' END AS phase, value AS loss
        FROM events""",
    "b_files": """
        SELECT url AS path, page_id, length(html) AS size, md5(html) AS md5,
               length(html) + CASE WHEN page_id % 10 = 0 THEN 1 ELSE 0 END AS expected_size,
               CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 10 = 5 THEN md5('x') ELSE md5(html) END
                 AS expected_md5,
               CASE WHEN page_id % 11 = 0 THEN 'hg19' ELSE 'GRCh38' END AS assembly,
               CASE WHEN page_id % 17 = 0 THEN NULL ELSE 'contact matrix' END AS output_type,
               CASE WHEN page_id % 13 = 0 THEN 'archived' ELSE 'released' END AS status
        FROM pages""",
}


def _greedy_view(counts: str) -> dict[str, str]:
    """Views that walk the groups in order and give each to the split that lacks most."""
    ranked, walk = f"{counts}_ranked", f"{counts}_walk"
    lacks = {
        "tr": "t.total * 0.8::DOUBLE - w.tr",
        "va": "t.total * 0.1::DOUBLE - w.va",
        "te": "t.total * 0.1::DOUBLE - w.te",
    }
    train = f"{lacks['tr']} >= {lacks['va']} AND {lacks['tr']} >= {lacks['te']}"
    validation = f"NOT ({train}) AND {lacks['va']} >= {lacks['te']}"
    return {
        ranked: f"SELECT name, n, row_number() OVER (ORDER BY n DESC, name) AS i FROM {counts}",
        walk: f"""
        SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS split,
               CAST(0 AS BIGINT) AS tr, CAST(0 AS BIGINT) AS va, CAST(0 AS BIGINT) AS te
        UNION ALL
        SELECT r.i, r.name,
               CASE WHEN {train} THEN 'train' WHEN {validation} THEN 'validation' ELSE 'test' END,
               w.tr + CASE WHEN {train} THEN r.n ELSE 0 END,
               w.va + CASE WHEN {validation} THEN r.n ELSE 0 END,
               w.te + CASE WHEN NOT ({train}) AND NOT ({validation}) THEN r.n ELSE 0 END
        FROM {walk} w JOIN {ranked} r ON r.i = w.i + 1,
             (SELECT CAST(sum(n) AS BIGINT) AS total FROM {counts}) t""",
    }


VIEWS.update(_greedy_view("b_group_counts"))
VIEWS.update(_greedy_view("b_call_counts"))
VIEWS["b_group_split"] = "SELECT name, split FROM b_group_counts_walk WHERE name IS NOT NULL"
VIEWS["b_call_split"] = "SELECT name AS chrom, split FROM b_call_counts_walk WHERE name IS NOT NULL"
VIEWS["b_split_sites"] = "SELECT * FROM b_consensus JOIN b_call_split USING (chrom)"


def with_views(query: str) -> str:
    """The query with every view it needs, directly or through another, in front."""
    ordered: list[str] = []

    def need(text: str, inside: str | None = None) -> None:
        for name in re.findall(r"\bb_\w+", text):
            if name in VIEWS and name != inside and name not in ordered:
                need(VIEWS[name], name)
                if name not in ordered:
                    ordered.append(name)

    need(query)
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    if not ordered:
        return query
    own = query.removeprefix("WITH ")
    return f"WITH RECURSIVE {views}" + (f",\n{own}" if own != query else f"\n{query}")
