"""Whole files: sizes, checksums, manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.schemas import MANIFEST

CHUNK = 1 << 20


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and size of every file; the contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))


def hash_files(files: DataFrame) -> DataFrame:
    """Add ``md5`` to a table with ``path`` and ``size``.

    Files are read in chunks, a task at a time; the whole-content column of the
    binary source ends at two gigabytes, less than one contact matrix.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            sums = []
            for path in batch["path"]:
                uri = path if "://" in path else path.replace("file:", "file://", 1)
                if "://" in uri:
                    system, inner = fs.FileSystem.from_uri(uri)
                else:
                    system, inner = fs.LocalFileSystem(), uri
                total = hashlib.md5()
                with system.open_input_stream(inner) as stream:
                    while chunk := stream.read(CHUNK):
                        total.update(chunk)
                sums.append(total.hexdigest())
            batch["md5"] = sums
            yield batch

    return files.select("path", "size").mapInPandas(digest, "path string, size bigint, md5 string")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Nested manifests: files of one JSON object or several, on a line each or over many."""
    text = spark.read.text(path, wholetext=True)
    objects = F.concat(F.lit("["), F.regexp_replace(F.trim("value"), r"\}\s*\n\s*\{", "},{"), F.lit("]"))
    return text.select(F.inline(F.from_json(objects, T.ArrayType(MANIFEST), {"mode": "FAILFAST"})))


def parse_manifests(text: DataFrame, column: str = "manifest") -> DataFrame:
    """Nested manifests held as JSON text in a column."""
    return text.select(F.from_json(column, MANIFEST).alias("m")).select("m.*")
