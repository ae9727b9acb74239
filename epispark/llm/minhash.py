"""Near-duplicate texts: circulant MinHash, banding, exact Jaccard check."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.groups import in_blocks, map_groups, star
from epispark.llm.links import components
from epispark.llm.store import saved
from epispark.llm.words import SPACED, hashed_words, mix, shingles, slices, text_bytes

#: Rows of a band and number of bands: a pair at similarity 0.8 shares no band with
#: probability (1 - 0.8**5)**40 = 1.3e-7.
ROWS, BANDS = 5, 40
#: Signatures that agree in fewer coordinates than this many of 200 are no candidates. At
#: similarity 0.8 fewer than 120 agree with probability below 1e-10.
AGREEING = 120
#: Members of a bucket, and texts of a cluster, that one task compares with as many others.
BLOCK = 256


def _first(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit universe."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(values: np.ndarray, size: int = ROWS * BANDS) -> np.ndarray:
    """All ``size`` coordinates from two permutations of the 32-bit universe.

    The first one shuffles the shingles, the second, shifted circularly by k places, is
    the k-th hash function; a coordinate is its least value over the set.
    """
    shuffled = _first(values.astype(np.uint32))
    shifts = np.arange(size, dtype=np.uint32)
    low = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(shuffled), 128):
        x = shuffled[lo : lo + 128, None] + shifts
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        x ^= x >> np.uint32(13)
        np.minimum(low, x.min(axis=0), out=low)
    return low


def _sets(part: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """The distinct shingles of every text, sorted."""
    rows, hashes = hashed_words(*text_bytes(part.column("text")), SPACED)
    row, value = shingles(rows, hashes, part.num_rows, size)
    edges = np.searchsorted(row, np.arange(part.num_rows + 1))
    return [np.unique(value[a:b]) for a, b in zip(edges, edges[1:])]


def _key(values: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; none for the empty one."""
    if len(values):
        return b"".join(np.sum(mix(values * np.uint64(k)), dtype=np.uint64).tobytes() for k in (3, 5))


def _bands(batches):
    """A row for every band of a set: its number above the low bytes of the band's coordinates.

    Sets that have nothing in common agree in the 40 bits of a band by chance 1 time in 2**40."""
    place = np.uint64(256) ** np.arange(ROWS, dtype=np.uint64)
    number = np.arange(BANDS, dtype=np.uint64) << np.uint64(8 * ROWS)
    for batch in batches:
        marks = np.frombuffer(b"".join(batch.column("marks").to_pylist()), np.uint8)
        band = marks.reshape(-1, BANDS, ROWS).astype(np.uint64) @ place + number
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column("set").to_numpy(), BANDS)), pa.array(band.ravel().view(np.int64))], ["set", "band"]
        )


def _signed(size: int):
    def sign(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _sets(part, size)
                lows = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_key(s) for s in sets], pa.binary()),
                    pa.array([None if x is None else x.astype(np.uint8).tobytes() for x in lows], pa.binary()),
                ], ["doc_id", "n_shingles", "key", "marks"])

    return sign


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places rows of signature bytes agree, eight places at a time."""
    equal = (a == b).view(np.uint64).sum(axis=-1, dtype=np.uint64)
    return (equal * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _alike(table: pa.Table, bounds: np.ndarray):
    """Members of a bucket (or of two blocks of it) whose signatures and sizes agree."""
    ids, n = table.column("doc_id").to_numpy(), table.column("n_shingles").to_numpy()
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(len(ids), ROWS * BANDS)
    sizes = np.diff(bounds)
    number = np.repeat(np.arange(len(sizes)), sizes)
    few = sizes[number] <= 16
    stars = []
    for step in range(1, 16):
        at = np.flatnonzero(few[:-step] & (number[:-step] == number[step:]))
        if not len(at):
            break
        to = at + step
        at, to = (x[100 * np.minimum(n[at], n[to]) >= 80 * np.maximum(n[at], n[to])] for x in (at, to))
        close = _agreeing(marks[at], marks[to]) >= AGREEING
        stars.append((ids[at[close]], ids[to[close]]))
    for k in np.flatnonzero(sizes > 16):
        own = slice(bounds[k], bounds[k + 1])
        links = np.array([_agreeing(marks[own], m) >= AGREEING for m in marks[own]])
        links &= 100 * np.minimum(n[own], n[own, None]) >= 80 * np.maximum(n[own], n[own, None])
        stars.append(star(ids[own], links))
    if stars:
        a, b = (np.concatenate(x) for x in zip(*stars))
        low, high = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        yield pa.table({"a": low, "b": high})


def _similar(percent: int):
    def verify(table: pa.Table, bounds: np.ndarray):
        """Texts of a cluster (or of two blocks of it) whose whole sets are similar enough."""
        every, sets = table.column("doc_id").to_numpy(), table.column("shingles").combine_chunks()
        flat, edges = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        stars = [
            star(every[a:b], _linked(flat[edges[a] : edges[b]], np.diff(edges[a : b + 1]), percent))
            for a, b in zip(bounds, bounds[1:])
        ]
        a, b = (np.concatenate(x) for x in zip(*stars))
        yield pa.table({"a": a, "b": b})

    return verify


def _linked(values: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets that ``values`` holds one after the other (``n`` each) are similar."""
    owner = np.repeat(np.arange(len(n)), n)
    _, code, often = np.unique(values, return_inverse=True, return_counts=True)
    shared = often[code] > 1
    owner, (kinds, code) = owner[shared], np.unique(code[shared], return_inverse=True)
    common, width = np.zeros((len(n), len(n)), dtype=np.float32), 1 << 13
    for lo in range(0, len(kinds), width):
        inside = (code >= lo) & (code < lo + width)
        held = np.zeros((len(n), min(width, len(kinds) - lo)), dtype=np.float32)
        held[owner[inside], code[inside] - lo] = 1
        common += held @ held.T
    common = common.astype(np.int64)
    return 100 * common >= percent * (n + n[:, None] - common)


def link_near_duplicates(
    docs: DataFrame, shingle: int = 4, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Documents linked by similar sets of ``shingle``-word runs, and the groups they form.

    Words are runs of anything but white space, A-Z lower-cased. Two documents are linked if
    100 * intersection >= ``percent`` * union of their distinct runs; a text of fewer words
    is one run, a null or empty one has none and is linked with nothing.

    1. Documents with equal sets become one: a 128-bit sum over the set tells.
    2. Circulant MinHash signs each set, of which the low bytes are kept; those that share a
       band form a bucket, which is compared by whole signatures. Members that agree often enough and are
       of like size are candidates. Of a large bucket only a star over what hangs together
       leaves a task, never its pairs.
    3. Candidates that hang together form a cluster, for which the texts are read again.
       Every pair inside is compared on the whole sets, by products of incidence matrices;
       again a star over what is linked leaves the task.
    4. Connected components over these links, spread to the copies.

    Buckets and clusters of any size are compared in pairs of blocks, each in a task of its
    own. ``percent`` below 80 needs more bands than the module has and is an error.

    Returns one row per row of ``docs``: its id, ``n_shingles``, ``component_id`` (smallest
    id reachable) and ``kept`` (whether it is that one). Rows that share an id and a text
    are alike; if texts differ, each row gets the group of its own text, and the id stands
    for all of them in links. A null id belongs to no group: ``component_id`` is null,
    ``kept`` true. Other columns are ignored.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the bands are laid out for 80 to 100 percent")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = saved(texts.mapInArrow(_signed(shingle), "doc_id long, n_shingles long, key binary, marks binary"), "signed")
    # One row for each set, however often its text is repeated; equal sets are signed alike.
    members = saved(
        signed.filter("key is not null and doc_id is not null").groupBy("key").agg(
            F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n_shingles", "marks")]
        ),
        "members",
    )
    classes = members.select("key", "doc_id")
    # Half a key stands for a set on the way; two that agree in it would both come to their buckets.
    marked = members.select(F.xxhash64("key").alias("set"), "doc_id", "n_shingles", "marks")
    banded = marked.select("set", "marks").mapInArrow(_bands, "set long, band long")
    other = F.bitwise_not("band").alias("_key")  # of its own, so that Spark can split a frequent band
    full = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select(other)
    placed = banded.select("set", other).join(full, "_key", "left_semi").select("set", F.bitwise_not("_key").alias("band"))
    buckets = saved(placed.join(marked, "set"), "buckets")
    candidates = map_groups(
        in_blocks(buckets, ("band",), BLOCK, "set").drop("set"), ("band", "part"), _alike, "a long, b long"
    )
    # Where a text will be compared is known before it is read, so its set is moved there at once.
    found = components(candidates).withColumnsRenamed({"node": "doc_id", "component": "cluster"})
    often = signed.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("often"))
    clusters = saved(
        in_blocks(saved(found, "found"), ("cluster",), BLOCK)
        .groupBy("doc_id", "cluster").agg(F.collect_list("part").alias("parts")).join(often, "doc_id", "left")
        .select("doc_id", "cluster", "parts", F.coalesce("often", F.lit(False)).alias("often")),
        "clusters",
    )

    def read(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _sets(part, shingle)
                yield pa.RecordBatch.from_arrays([
                    *[part.column(c) for c in ("doc_id", "cluster", "parts")], pa.array([_key(s) for s in sets], pa.binary()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ], ["doc_id", "cluster", "parts", "key", "shingles"])

    def sets(wanted: str) -> DataFrame:
        ids = clusters.filter(wanted).drop("often")
        return texts.join(ids, "doc_id").mapInArrow(
            read, "doc_id long, cluster long, parts array<string>, key binary, shingles array<long>"
        ).filter("key is not null")

    # Only the rows of an id that has several are moved to be told apart first.
    whole = sets("not often").unionByName(sets("often").dropDuplicates(["doc_id", "key"]))
    links = map_groups(
        whole.select("doc_id", "cluster", F.explode("parts").alias("part"), "shingles"), ("cluster", "part"), _similar(percent), "a long, b long"
    )
    return _grouped(signed, classes, components(links), doc_id)


def first_of_groups(
    docs: DataFrame, shingle: int = 4, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates (see ``link_near_duplicates``).

    Every row is judged by its own text, whatever other rows have its id: of a group the row
    with the smallest id stays, one without an id only if none has one, and of rows with
    equal ids any one. Rows with a null or empty text all stay.
    """
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "rows")
    texts = rows.select("row", F.col("doc")[text].alias("text"))
    found = link_near_duplicates(texts, shingle, percent, "row", "text").select("row", "component_id")
    own = F.col("doc")[doc_id]
    order = F.struct(own.isNull().alias("none"), own.alias("id"), "row")
    firsts = (
        found.join(rows, "row").groupBy("component_id").agg(F.min(order).alias("first"))
        .select(F.col("first.row").alias("row"))
    )
    return rows.join(firsts, "row", "left_semi").select("doc.*")


def _grouped(signed: DataFrame, classes: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    named = saved(
        classes.join(found, classes.doc_id == found.node, "left")
        .select("key", F.coalesce("component", "doc_id").alias("component")),
        "named",
    )
    return signed.select("doc_id", "n_shingles", "key").join(named, "key", "left").select(
        F.col("doc_id").alias(doc_id), "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("component").isNull() | (F.col("doc_id") == F.col("component")), F.lit(True)).alias("kept"),
    )
