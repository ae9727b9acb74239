"""A sink of numbered shards: one Parquet file each, and their manifest from what the tasks report."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Shards in one object of the manifest, at most.
LISTED = 10_000


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class _Shards(WriterCommitMessage):
    """What a task has written: split, shard, file, rows and width of the codes."""

    shards: list[tuple[str, int, str, int, int]] = field(default_factory=list)


class ShardFiles(DataSource):
    """Rows with ``split`` and ``shard_index``, dealt so that a shard lies in one task, sorted by both.

    Options: ``path`` of the files, ``manifest`` folder, ``codes`` (the list column whose width
    the manifest tells), ``shard_size``.
    """

    @classmethod
    def name(cls) -> str:
        return "shard_files"

    def writer(self, schema: StructType, overwrite: bool) -> _ShardWriter:
        if not overwrite:
            raise ValueError("shards are numbered over the whole table: only overwriting is possible")
        return _ShardWriter(dict(self.options))


class _ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.manifest = options["path"], options["manifest"]
        self.codes, self.shard_size = options["codes"], int(options["shard_size"])
        self.job = uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Shards:
        """One file per run of rows of a shard; its name tells the job and the attempt that wrote it."""
        system, root = _system(self.path)
        attempt, done = TaskContext.get().taskAttemptId(), _Shards()
        now, writer, file, rows, width = None, None, "", 0, 0

        def close():
            if writer is not None:
                writer.close()
                done.shards.append((*now, file, rows, width))

        for batch in batches:
            split, shard = batch.column("split").to_numpy(zero_copy_only=False), batch.column("shard_index").to_numpy()
            kept = batch.drop_columns(["split"])
            fresh = np.flatnonzero((split[1:] != split[:-1]) | (shard[1:] != shard[:-1])) + 1
            for lo, hi in zip([0, *fresh], [*fresh, len(shard)]):
                if lo == hi:
                    continue
                if (split[lo], int(shard[lo])) != now:
                    close()
                    now, rows, width = (split[lo], int(shard[lo])), 0, 0
                    file = f"split={now[0]}/shard-{now[1]:08d}-{self.job}-{attempt}.parquet"
                    system.create_dir(posixpath.dirname(posixpath.join(root, file)), recursive=True)
                    writer = pq.ParquetWriter(posixpath.join(root, file), kept.schema, filesystem=system)
                part = kept.slice(lo, hi - lo)
                writer.write_batch(part)
                rows += part.num_rows
                lengths = pc.list_value_length(part.column(self.codes))
                width = max(width, pc.max(lengths).as_py() or 0)
        close()
        return done

    def _files(self) -> list[str]:
        system, root = _system(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        return [x.path for x in found if x.is_file and "/shard-" in x.path]

    def commit(self, messages: list[_Shards | None]) -> None:
        """Write the manifest, then remove what is not in it: files of lost attempts and of earlier jobs."""
        shards = sorted(s for m in messages if m for s in m.shards)
        system, folder = _system(self.manifest)
        system.create_dir(folder, recursive=True)
        before = [x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.is_file]
        for split in sorted({s[0] for s in shards}):
            own = [s for s in shards if s[0] == split]
            for number, lo in enumerate(range(0, len(own), LISTED)):
                told = {
                    "split": split, "shard_size": self.shard_size, "total_rows": sum(s[3] for s in own), "shard_count": len(own),
                    "shards": [
                        {"shard_index": s[1], "file": s[2], "row_count": s[3], "codes_width": s[4], "dtype": "smallint"}
                        for s in own[lo:lo + LISTED]
                    ],
                }
                with system.open_output_stream(f"{folder}/{split}-{number:05d}-{self.job}.json") as out:
                    out.write(json.dumps(told).encode())
        for path in before:
            system.delete_file(path)
        system, root = _system(self.path)
        held = {posixpath.join(root, s[2]) for s in shards}
        for path in self._files():
            if path not in held:
                system.delete_file(path)

    def abort(self, messages: list[_Shards | None]) -> None:
        """Remove this job's files; those of the job before stay, and its manifest with them."""
        system, _ = _system(self.path)
        for path in self._files():
            if f"-{self.job}-" in path:
                system.delete_file(path)


def write_shard_files(rows: DataFrame, path: str, manifest: str, codes: str, shard_size: int) -> None:
    """One file per split and shard under ``path``, and a ``manifest`` of them, without reading the rows again.

    The driver gets a few dozen bytes per shard. File names differ from job to job, so a
    reader of the manifest never sees half of a rewrite.
    """
    rows.sparkSession.dataSource.register(ShardFiles)
    (
        rows.repartition("split", "shard_index").sortWithinPartitions("split", "shard_index")
        .write.format("shard_files").mode("overwrite")
        .options(path=path, manifest=manifest, codes=codes, shard_size=str(shard_size)).save()
    )
