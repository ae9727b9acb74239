"""Genome tiles read from a file of two bits a base."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from epispark.schemas import TILES

# Fixed values of the format: the signature, the version, and the bases in the order of their codes.
SIGNATURE, VERSION = 0x1A412743, 0
BASES = np.frombuffer(b"TCAG", np.uint8)
#: The four bases of every byte, first base in the highest bits.
UNPACKED = BASES[(np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3]


@dataclass(frozen=True)
class Record:
    """Where a chromosome's packed bases are, and which stretches of it are unknown."""

    chrom: str
    length: int
    begins: int
    unknown: tuple[tuple[int, int], ...]


@dataclass
class _Stretch(InputPartition):
    """Tiles ``first`` to ``last`` of a chromosome, and the unknown stretches that they meet."""

    record: Record
    first: int
    last: int

    def __init__(self, record: Record, first: int, last: int) -> None:
        super().__init__(None)
        self.record, self.first, self.last = record, first, last


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def read_records(path: str, chroms: frozenset[str] | None = None) -> list[Record]:
    """The index of the file and the unknown stretches of its chromosomes, or of some of them; no bases are read."""
    with _open(path) as file:
        head = file.read_at(16, 0)
        order = "<" if int.from_bytes(head[:4], "little") == SIGNATURE else ">"
        kind = np.dtype(f"{order}u4")
        signature, version, count, _ = np.frombuffer(head, kind).tolist()
        if (signature, version) != (SIGNATURE, VERSION):
            raise ValueError(f"{path} is no two-bit file of version {VERSION}")
        found, at = [], 16
        for _ in range(count):
            size = file.read_at(1, at)[0]
            entry = file.read_at(size + 4, at + 1)
            found.append((entry[:size].decode("ascii"), int(np.frombuffer(entry[size:], kind)[0])))
            at += size + 5
        records = []
        for chrom, begins in found:
            if chroms is not None and chrom not in chroms:
                continue
            length, blocks = np.frombuffer(file.read_at(8, begins), kind).tolist()
            spans = np.frombuffer(file.read_at(8 * blocks, begins + 8), kind).reshape(2, -1).astype(np.int64)
            masks = int(np.frombuffer(file.read_at(4, begins + 8 + 8 * blocks), kind)[0])
            unknown = tuple(zip(spans[0].tolist(), (spans[0] + spans[1]).tolist()))
            records.append(Record(chrom, length, begins + 16 + 8 * blocks + 8 * masks, unknown))
        return records


def bases(file, record: Record, start: int, end: int) -> np.ndarray:
    """Upper-case letters of the bases from ``start`` on; the bytes that hold them are read, no others."""
    lo, hi = start // 4, -(-end // 4)
    packed = np.frombuffer(file.read_at(hi - lo, record.begins + lo), np.uint8)
    letters = UNPACKED[packed].ravel()[start - 4 * lo:end - 4 * lo].copy()
    for a, b in record.unknown:
        if a < end and b > start:
            letters[max(a, start) - start:max(min(b, end) - start, 0)] = ord("N")
    return letters


class TwoBitTiles(DataSource):
    """Tiles with flanks, as ``TILES``. Options: ``path``, ``tile_width``, ``flank``, ``tiles`` per partition."""

    @classmethod
    def name(cls) -> str:
        return "two_bit_tiles"

    def schema(self) -> StructType:
        return TILES

    def reader(self, schema: StructType) -> _Reader:
        options = dict(self.options)
        return (_FilteredReader if options.get("filters") == "true" else _Reader)(options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.width, self.flank = int(options["tile_width"]), int(options["flank"])
        self.tiles = int(options.get("tiles", "256"))
        self.chroms = frozenset(options["chroms"].split(",")) if "chroms" in options else None

    def partitions(self) -> list[InputPartition]:
        out = []
        for record in read_records(self.path, self.chroms):
            count = -(-record.length // self.width)
            for first in range(0, count, self.tiles):
                last = min(first + self.tiles, count)
                lo, hi = first * self.width - self.flank, last * self.width + self.flank
                near = tuple(u for u in record.unknown if u[0] < hi and u[1] > lo)
                out.append(_Stretch(Record(record.chrom, record.length, record.begins, near), first, last))
        return out

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        record, step = partition.record, 64
        with _open(self.path) as file:
            for first in range(partition.first, partition.last, step):
                numbers = range(first, min(first + step, partition.last))
                starts = [max(n * self.width - self.flank, 0) for n in numbers]
                ends = [min((n + 1) * self.width + self.flank, record.length) for n in numbers]
                run = bases(file, record, starts[0], ends[-1]).tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array([record.chrom] * len(starts)), pa.array([record.length] * len(starts), pa.int64()),
                    pa.array(list(numbers), pa.int64()), pa.array([n * self.width for n in numbers], pa.int64()),
                    pa.array(starts, pa.int64()), pa.array([run[a - starts[0]:b - starts[0]].decode("ascii") for a, b in zip(starts, ends)]),
                ], TILES.fieldNames())


class _FilteredReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Chromosomes asked for by name are the only ones that partitions are planned for."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("chrom",):
                wanted = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.chroms = wanted if self.chroms is None else self.chroms & wanted
            else:
                yield f


def read_twobit_tiles(
    spark: SparkSession, path: str, tile_width: int, flank: int, tiles: int = 256, chroms: Sequence[str] | None = None
) -> DataFrame:
    """Tiles of a two-bit genome file on a shared filesystem; soft-masked bases are read as upper case.

    Partitions of ``tiles`` neighbouring tiles are planned from the file's index, for ``chroms``
    or all chromosomes. Where Spark may hand filters to Python sources
    (``spark.sql.python.filterPushdown.enabled``), one on ``chrom`` does the same.
    """
    spark.dataSource.register(TwoBitTiles)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    listed = {} if chroms is None else {"chroms": ",".join(chroms)}
    return spark.read.format("two_bit_tiles").options(
        path=path, tile_width=str(tile_width), flank=str(flank), tiles=str(tiles), filters=pushed, **listed
    ).load()
