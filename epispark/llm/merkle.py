"""Merkle manifest of a dataset: a tree per group of rows, a tree over the groups, a proof per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.llm.store import saved

#: Children of a node.
FANOUT = 16
#: Nodes in a window: whole runs, so that no run is cut.
SPAN = FANOUT * FANOUT
#: Rows in one part of the order that positions are counted in, at most about.
PART = 1 << 20


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (a written table with a non-null ``key``) with ``pos``, counted per key along ``order``, and ``size``.

    Rows are dealt by ranges of key and order, so that a key of any size is spread over parts;
    equal rows are told apart by a row number. Positions are the place in the part after all
    parts before it.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART))
    by = ["key", *order, "_row"]
    dealt = saved(
        rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *by)
        .withColumn("_part", F.spark_partition_id()),
        "parts",
    )
    along = Window.partitionBy("key").orderBy("_part")
    counts = dealt.groupBy("key", "_part").agg(F.count("*").alias("_n")).select(
        "key", "_part",
        (F.sum("_n").over(along) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy("key")).alias("size"),
    )
    place = F.row_number().over(Window.partitionBy("key", "_part").orderBy(*order, "_row")) - 1
    return (
        dealt.withColumn("_place", place).join(counts, ["key", "_part"])
        .withColumn("pos", F.col("_before") + F.col("_place")).drop("_part", "_row", "_before", "_place")
    )


_OVER = f"OVER (PARTITION BY key, pos div {SPAN} ORDER BY pos)"
_SLOT, _RUN = f"pos % {FANOUT}", f"least({FANOUT}, size - pos + pos % {FANOUT})"

#: Digests to the left and right of a node in its run. The columns are lags and leads of every
#: fixed offset; slot and length of the run mask those of another run. Windows hold ``SPAN``
#: nodes, never a whole group.
LEFT = ", ".join(f"CASE WHEN {_SLOT} >= {k} THEN lag(node, {k}) {_OVER} END" for k in range(FANOUT - 1, 0, -1))
RIGHT = ", ".join(f"CASE WHEN {_SLOT} + {k} < {_RUN} THEN lead(node, {k}) {_OVER} END" for k in range(1, FANOUT))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The level given and those above it, each written: ``key``, ``pos``, ``size``, ``node``."""
    levels, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        parents = levels[-1].filter("size > 1").selectExpr(
            "key", "pos", "size", f"sha2(cast(concat_ws('', node, {RIGHT}) AS binary), 256) AS node"
        ).filter(f"{_SLOT} = 0")
        levels.append(saved(
            parents.selectExpr("key", f"pos div {FANOUT} AS pos", f"(size + {FANOUT - 1}) div {FANOUT} AS size", "node"), "level"
        ))
        most = -(-most // FANOUT)
    return levels


_PATH = "array<struct<left:string,right:string>>"


def _paths(levels: list[DataFrame], tops: DataFrame | None) -> DataFrame:
    """The lowest level with ``path``: the joined siblings, left and right, on the way up.

    ``tops`` has the ``path`` of each key from its single node on; without it the way ends there.
    """
    above, none = None, f"cast(array() AS {_PATH})"
    for level in reversed(levels):
        own = f"array(struct(concat_ws('', {LEFT}) AS left, concat_ws('', {RIGHT}) AS right))"
        rows = level.selectExpr("*", f"pos div {FANOUT} AS _up", f"CASE WHEN size > 1 THEN {own} ELSE {none} END AS _own")
        rest = [none]
        if tops is not None:
            rows = rows.join(tops.selectExpr("key", "0L AS _up", "1L AS size", "path AS _top"), ["key", "_up", "size"], "left")
            rest.insert(0, "_top")
        if above is not None:
            rows = rows.join(above, ["key", "_up"], "left")
            rest.insert(0, "_rest")
        rows = rows.selectExpr(*level.columns, f"concat(_own, coalesce({', '.join(rest)})) AS path")
        above = rows.selectExpr("key", "pos AS _up", "path AS _rest")
    return rows


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def merkle_manifest(
    docs: DataFrame,
    altered: dict[str, Column] | None = None,
    changed: Column | None = None,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    order: str = "doc_id",
    group: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: its ``order`` column, ``leaf``, ``subroot``, ``root``, ``path``,
    ``folded_root`` and ``verified``.

    A leaf is the digest of the ``fields``. Per ``group`` the leaves ascend by ``order`` (null
    first; equal ones by leaf, so the tree does not depend on how rows are read); every ``FANOUT``
    consecutive nodes become one, until one is left, the subroot; the subroots ascend by
    group (null first, bytewise) and lead to the root likewise. ``path`` has the siblings of
    every level. ``folded_root`` is made from the path and the leaf of the row as it is now:
    with the columns of ``altered`` in place of its own where ``changed`` holds (null: it does
    not). ``verified`` tells whether it is the root.

    Levels are written tables, a sixteenth of the one below; no window holds more than ``SPAN``
    nodes and no key's rows meet in one task. A null field is encoded as one; an empty text has a leaf.
    Repeated rows are leaves of their own. An empty table gives no rows. Other columns are ignored.
    """
    found = [encoded(F.col(f)) for f in fields]
    now = [encoded((altered or {}).get(f, F.col(f))) for f in fields]
    changed = F.coalesce(changed if changed is not None else F.lit(bool(altered)), F.lit(False))
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = saved(
        docs.select(
            F.col(order).alias("id"), key.alias("key"), digest(*found).alias("node"),
            F.when(changed, digest(*now)).alias("now"),
        ),
        "leaves",
    )
    ground = saved(placed(leaves, "id", "node"), "ground")
    levels = _levels(ground.select("key", "pos", "size", "node"))
    subroots = levels[0].filter("size = 1")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.filter("size = 1"))
    subroots = saved(subroots.select(F.lit("").alias("key"), F.col("key").alias("id"), "node"), "subroots")
    upper = saved(placed(subroots, "id"), "upper")
    top = _levels(upper.select("key", "pos", "size", "node"))
    roots = top[-1].filter("size = 1").select(F.col("node").alias("root"))
    # the single node on top: one row, so a join with it adds a column only
    ways = _paths([upper, *top[1:]], None).select(
        F.col("id").alias("key"), F.col("node").alias("subroot"), "path"
    ).join(F.broadcast(roots))
    ways = saved(ways, "ways")
    proven = _paths([ground, *levels[1:]], ways.select("key", "path"))
    back = folded(F.coalesce("now", "node"), F.col("path"))
    return proven.join(ways.drop("path"), "key").select(
        F.col("id").alias(order), F.col("node").alias("leaf"), "subroot", "root", "path", back.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
