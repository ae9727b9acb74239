"""Parameters of the flows, with one preset per assay."""

from __future__ import annotations

from dataclasses import dataclass, field

# Chromosomes kept, base order, split names and target fractions.
INCLUDED_CHROMS = tuple(f"chr{i}" for i in range(1, 23)) + ("chrX",)
BASE_ORDER = "ACGT"
UNKNOWN_BASE_CODE = 4
UNKNOWN_DINUCLEOTIDE_CODE = 255
PROPERTY_COUNT = 12
SPLIT_FRACTIONS = (("train", 0.80), ("validation", 0.10), ("test", 0.10))


@dataclass(frozen=True)
class Params:
    """Everything the flows can be tuned with; widths are in bases."""

    assembly: str
    min_replicate_coverage: int
    min_total_coverage: int
    min_two_strand_fraction: float
    max_sampled_sites: int
    sample_whole_genome: bool
    check_shard_layout: bool
    max_ratio_difference: float = 0.20
    window: int = 501
    max_unknown_fraction: float = 0.10
    tile_width: int = 10_000
    bin_width: int = 10_000
    max_contact_distance: int = 5_000_000
    top_k: int = 32
    drop_diagonal: bool = False
    #: Rounds in which raw contact counts are balanced; 0 takes them as normalised already.
    balance_steps: int = 0
    balance_tolerance: float = 1e-3
    min_balance_partners: int = 1
    shard_size: int = 50_000
    batch_size: int = 1_024
    embedding_width: int = 768
    extra_node_features: bool = True
    decision_threshold: float = 0.5
    patience: int = 20
    min_delta: float = 1e-5
    chroms: tuple[str, ...] = INCLUDED_CHROMS
    split_fractions: tuple[tuple[str, float], ...] = field(default=SPLIT_FRACTIONS)

    @property
    def center(self) -> int:
        return self.window // 2

    @property
    def max_contact_bins(self) -> int:
        return self.max_contact_distance // self.bin_width


# Whole-genome bisulfite sequencing on GRCh38.
WGBS_GRCH38 = Params(
    assembly="GRCh38",
    min_replicate_coverage=10,
    min_total_coverage=20,
    min_two_strand_fraction=0.50,
    max_sampled_sites=64,
    sample_whole_genome=False,
    check_shard_layout=True,
)

# Reduced-representation bisulfite sequencing on hg19; there is no
# floor on the total coverage.
RRBS_HG19 = Params(
    assembly="hg19",
    min_replicate_coverage=5,
    min_total_coverage=0,
    min_two_strand_fraction=0.05,
    max_sampled_sites=128,
    sample_whole_genome=True,
    check_shard_layout=False,
)
