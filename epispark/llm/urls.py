"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _spots(blocks: int, bits: int) -> list[Column]:
    """``block`` of a key (``host``, ``path``), and in ``mask`` its bits among the 64 of that block."""
    again = F.xxhash64("path", "host")
    ones = [
        F.call_function(
            "shiftleft", F.lit(1).cast("long"),
            F.shiftrightunsigned(again, 6 * k).bitwiseAND(F.lit(63)).cast("int"),
        )
        for k in range(bits)
    ]
    mask = reduce(lambda a, b: a.bitwiseOR(b), ones)
    return [F.pmod(F.xxhash64("host", "path"), F.lit(blocks)).alias("block"), mask.alias("mask")]


def bloom_filter(listed: DataFrame, blocks: int, bits: int) -> DataFrame:
    """``block``, ``held``: at most ``blocks`` rows of 64 bits, however long the list is."""
    return (
        listed.select(*_spots(blocks, bits)).groupBy("block").agg(F.bit_or("mask").alias("held"))
    )


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    otherwise: str = "allow",
    blocks: int = 1 << 18,
    bits: int = 6,
) -> DataFrame:
    """Each page with the listed URL that covers it and that URL's verdict.

    ``listed`` has ``host``, ``path`` and ``verdict``. An entry covers a URL on its host or
    a subdomain whose path starts with the entry's; of several the longest entry (host and
    path together, then host) wins. A page that none covers gets ``otherwise``.

    Pages are reduced to what the entries can tell apart: the last labels of the host and
    the first characters of the path. Each of those expands into the entries that could
    cover it; the filter drops nearly all, an exact join the rest that only seemed listed.
    The filter's size is fixed by ``blocks`` (64 bits each), so broadcasting it is safe; a
    list too long for it lets more candidates through and changes no verdict.

    Returns ``id_column``, ``host``, ``path``, ``rule`` (entry as text, or null) and
    ``verdict``, one row per row of ``pages``. A null URL, or one without ``://``, has empty
    host and path. Entries with a null are ignored; of equal entries the last verdict in
    alphabetical order holds. Other columns of either table are not looked at.
    """
    rules = (
        listed.select(F.translate("host", _UPPER, _SMALL).alias("host"), "path", "verdict").dropna()
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    )
    shape = rules.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("path")).alias("longest"),
        F.collect_set(F.length("path")).alias("lengths"),
    ).first()
    labels, longest = shape.labels or 1, shape.longest or 0
    lengths = F.array(*[F.lit(n) for n in sorted(shape.lengths)]) if shape.lengths else F.array().cast("array<int>")
    seen = pages.select(
        F.col(id_column), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path")
    ).withColumns({
        "tail": F.substring_index("host", ".", -labels), "head": F.substring("path", 1, longest),
    })
    parts = F.split("tail", r"\.")
    candidates = (
        seen.select("tail", "head").distinct()
        .select("tail", "head", F.explode(F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
        )).alias("host"))
        .select("tail", "head", "host", F.explode(F.filter(lengths, lambda n: n <= F.length("head"))).alias("n"))
        .select("tail", "head", "host", F.substr("head", F.lit(1), F.col("n")).alias("path"))
    )
    possible = (
        candidates.select("*", *_spots(blocks, bits))
        .join(F.broadcast(bloom_filter(rules, blocks, bits)), "block")
        .filter(F.col("mask").bitwiseAND(F.col("held")) == F.col("mask"))
        .select("tail", "head", "host", "path")
    )
    covering = F.struct(
        (F.length("host") + F.length("path")).alias("long"), F.length("host").alias("wide"),
        F.concat("host", "path").alias("rule"), "verdict",
    )
    judged = (
        possible.join(rules, ["host", "path"]).groupBy("tail", "head").agg(F.max(covering).alias("best"))
        .select(F.struct("tail", "head").alias("_key"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    # A key of its own: both sides are dealt out for this join, and Spark can split a frequent host.
    return seen.withColumn("_key", F.struct("tail", "head")).join(judged, "_key", "left").select(
        id_column, "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict")
    )
