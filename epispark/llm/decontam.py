"""Benchmark decontamination with a distributed positional inverted index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epispark.llm.groups import map_groups
from epispark.llm.store import saved
from epispark.llm.words import ALPHANUMERIC, hashed_words, mix, slices, text_bytes, word_ranges

#: Bits of the table of terms that each task gets; its size never grows.
TERM_BITS = 1 << 22
#: Places of a document whose alignments are verified together, at least.
STRETCH = 4096
#: Words of items that tasks get at once to verify alignments, about.
PASS_WORDS = 1 << 20
#: Places of alignments that are looked up at once, about.
LOOKUPS = 1 << 20


def _grams(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from each place on; what reaches beyond the end is none."""
    out = mix(hashes + np.uint64(length))
    for k in range(1, length):
        out[:-k] = mix(out[:-k] * np.uint64(0xD6E8FEB86659FD93) + hashes[k:])
    return out


def _item_words(run: int):
    """The words of every item, and the runs of ``run`` words (a shorter item is one) by their first."""

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, data = text_bytes(part.column("text"))
                rows, hashes = hashed_words(offsets, data, ALPHANUMERIC)
                starts = word_ranges(rows, part.num_rows)
                sizes, place = np.diff(starts)[rows], np.arange(len(rows)) - starts[rows]
                grams, length = np.zeros(len(rows), dtype=np.uint64), np.minimum(sizes, run)
                for n in range(1, run + 1):
                    grams[length == n] = _grams(hashes, n)[length == n]
                yield pa.RecordBatch.from_arrays([
                    part.column("item").take(pa.array(rows)), part.column("item_id").take(pa.array(rows)),
                    pa.array(place.astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(hashes.view(np.int64)),
                    pa.array(grams.view(np.int64), mask=place + length > sizes), pa.array(length.astype(np.int32)),
                ], ["item", "item_id", "place", "size", "term", "gram", "length"])

    return cut


def _spots(terms: DataFrame) -> bytes:
    """The terms as a table of ``TERM_BITS`` bits. More terms set more bits; none is left out."""
    found = terms.select(F.col("term").bitwiseAND(F.lit(TERM_BITS - 1)).cast("int").alias("spot")).distinct().toArrow()
    bits = np.zeros(TERM_BITS, dtype=bool)
    bits[found.column(0).to_numpy()] = True
    return np.packbits(bits).tobytes()


def _among(packed: bytes, hashes: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(packed, np.uint8)
    spot = hashes & np.uint64(TERM_BITS - 1)
    return (bits[spot >> np.uint64(3)] >> (np.uint64(7) - (spot & np.uint64(7))).astype(np.uint8)) & 1 == 1


def _term_counts(packed: bytes):
    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                _, hashes = hashed_words(*text_bytes(part.column("text")), ALPHANUMERIC)
                terms, n = np.unique(hashes[_among(packed, hashes)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], ["term", "n"])

    return count


def _around(at: np.ndarray, before: int, behind: int, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which places are so near to one ``at`` in the same text."""
    steps = np.zeros(len(rows) + 1, dtype=np.int32)
    np.add.at(steps, np.maximum(at - before, starts[rows[at]]), 1)
    np.add.at(steps, np.minimum(at + behind + 1, starts[rows[at] + 1]), -1)
    return np.cumsum(steps[:-1]) > 0


def _postings(terms: bytes, anchors: bytes, grams: dict[int, bytes], window: int):
    def post(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows, hashes = hashed_words(*text_bytes(part.column("text")), ALPHANUMERIC)
                starts = word_ranges(rows, part.num_rows)
                near = np.zeros(len(rows), dtype=bool)
                for n, spots in grams.items():
                    at = np.flatnonzero(_among(spots, _grams(hashes, n)))
                    near |= _around(at[at + n <= starts[rows[at] + 1]], window - n, window - 1, rows, starts)
                at = np.flatnonzero(near & _among(anchors, hashes))
                kept = np.flatnonzero(near & _around(at, window - 1, window - 1, rows, starts))
                kept = kept[_among(terms, hashes[kept])]
                edges = pa.array(np.searchsorted(rows[kept], np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(starts)),
                    pa.ListArray.from_arrays(edges, pa.array((kept - starts[rows[kept]]).astype(np.int32))),
                    pa.ListArray.from_arrays(edges, pa.array(hashes[kept].view(np.int64))),
                ], ["doc_id", "text_hash", "n_words", "places", "terms"])

    return post


def _stretches(reach: int):
    """Postings of a document by stretch: those that an alignment which begins there can meet."""

    def cut(batches):
        for batch in batches:
            for row, places, terms in zip(*(batch.column(c) for c in ("row", "places", "terms"))):
                at, held = places.values.to_numpy(), terms.values.to_numpy()
                first, last = (int(at[0]) - reach) // STRETCH, int(at[-1]) // STRETCH
                lo = np.searchsorted(at, np.arange(first, last + 1) * STRETCH)
                hi = np.searchsorted(at, np.arange(first + 1, last + 2) * STRETCH + reach)
                used = np.flatnonzero(hi > lo)
                edges = np.concatenate([[0], np.cumsum(hi[used] - lo[used])]).astype(np.int32)
                taken = np.concatenate([np.arange(lo[k], hi[k]) for k in used])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(used), row.as_py())), pa.array(used + first),
                    pa.ListArray.from_arrays(edges, pa.array(at[taken])), pa.ListArray.from_arrays(edges, pa.array(held[taken])),
                ], ["row", "stretch", "places", "terms"])

    return cut


_MATCH = "row long, item long, start int, end int, item_start int, n_equal long, exact boolean, hits array<int>"


def _verified(words: dict[int, np.ndarray], window: int, near: int):
    """Matches along each alignment of a document with an item, from the postings of the stretch."""

    def judge(row, item, shift, owner, place, sizes):
        """``owner`` (an alignment, ascending) and ``place`` (in its item, ascending) of every equal word."""
        far = 2 * window + int(sizes.max(initial=0))
        key = owner * far + place
        close = np.searchsorted(key, key + window) - np.arange(len(key))
        run = np.cumsum(np.diff(key, prepend=-2) != 1) - 1
        exact = np.bincount(run)[run] >= np.minimum(sizes[owner], window)
        begins = exact | (close >= near) & (sizes[owner] >= window)
        till = np.maximum.accumulate(np.where(begins, key, -far)) + window
        covered = till > key
        fresh = covered & (np.concatenate([[0], till[:-1]]) <= key)
        key, owner, place, exact = (x[covered] for x in (key, owner, place, exact))
        starts = np.flatnonzero(fresh[covered])
        if not len(starts):
            return None
        ends, whose = np.append(starts[1:], len(key)) - 1, owner[starts]
        counted = np.concatenate([[0], np.cumsum(exact)])
        return pa.table([
            pa.array(row[whose]), pa.array(item[whose]), pa.array((place[starts] + shift[whose]).astype(np.int32)),
            pa.array((place[ends] + shift[whose] + 1).astype(np.int32)), pa.array(place[starts].astype(np.int32)),
            pa.array(ends - starts + 1), pa.array(counted[ends + 1] > counted[starts]),
            pa.ListArray.from_arrays(
                pa.array(np.append(counted[starts], counted[-1]).astype(np.int32)),
                pa.array((place + shift[owner])[exact].astype(np.int32)),
            ),
        ], ["row", "item", "start", "end", "item_start", "n_equal", "exact", "hits"])

    def verify(table, starts):
        group = np.zeros(table.num_rows, np.int64)
        group[starts[(starts > 0) & (starts < table.num_rows)]] = 1
        group = np.cumsum(group)
        shift_column = table["shift"].combine_chunks()
        posted = pc.is_null(shift_column).to_numpy(zero_copy_only=False)
        lists = table.filter(pa.array(posted))
        places, terms = (lists[c].combine_chunks() for c in ("places", "terms"))
        at, held = places.flatten().to_numpy().astype(np.int64), terms.flatten().to_numpy()
        of = np.repeat(group[posted], np.diff(places.offsets.to_numpy()))
        found = np.unique(np.stack([
            group[~posted], pc.fill_null(table["item"], 0).to_numpy()[~posted], pc.fill_null(shift_column, 0).to_numpy()[~posted],
        ]), axis=1)
        sizes = np.array([len(words[i]) for i in found[1].tolist()], np.int64)
        far = int(at.max(initial=0)) + 2 * int(sizes.max(initial=0)) + 2
        base = int(sizes.max(initial=0))
        index = of * far + at + base
        row_of = table["row"].to_numpy()[np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])]
        part = np.cumsum(sizes) // LOOKUPS
        for lo, hi in zip(cuts := [0, *(np.flatnonzero(np.diff(part)) + 1).tolist()], [*cuts[1:], len(sizes)]):
            where, item, shift = found[:, lo:hi]
            own = sizes[lo:hi]
            owner = np.repeat(np.arange(hi - lo), own)
            place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            wanted = np.concatenate([words[i] for i in item.tolist()]) if hi > lo else np.zeros(0, np.int64)
            key = where[owner] * far + shift[owner] + place + base
            spot = np.searchsorted(index, key)
            equal = spot < len(index)
            equal[equal] = index[spot[equal]] == key[equal]
            equal[equal] = held[spot[equal]] == wanted[equal]
            made = judge(row_of[where], item, shift, owner[equal], place[equal], own) if equal.any() else None
            if made is not None:
                yield made

    return verify


def _words_of(items: DataFrame) -> dict[int, np.ndarray]:
    """The words of the items, in order; callers bound how many there are."""
    found = items.select("item", "place", "term").toArrow().sort_by([("item", "ascending"), ("place", "ascending")])
    names, starts = np.unique(found["item"].to_numpy(), return_index=True)
    return dict(zip(names.tolist(), np.split(found["term"].to_numpy(), starts[1:])))


def _verified_from(words, window: int, near: int):
    def verify(table, starts):
        yield from _verified(words.value, window, near)(table, starts)

    return verify


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    near: int = 8,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Which words of each document lie inside a run of ``window`` words of a benchmark item.

    Words are runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased; an item of
    fewer than ``window`` words counts as one window if it has any.

    1. All documents are counted for the benchmark's terms. The ``window - near + 1`` rarest
       places of every window become its anchors: a near match lacks ``window - near`` places
       at most, so it has one of them. Places whose term no document has are the rarest and
       need no anchor; a window with more than ``window - near`` of them is out already.
    2. The index: postings (term, document, place) of the benchmark's terms, written to the
       shared folder. A match has at least ``near`` equal places in ``window`` with at most
       ``window - near`` others between them, so somewhere it has near / (window - near + 1)
       equal words in a row, rounded up. A posting farther than a window from every such run
       of a benchmark item, or from every anchor term, can be part of no match and is left out.
    3. Anchors meet their postings: each hit aligns an item with a document. Alignments meet
       the document's own postings, in stretches of places, and the item's other terms are
       looked up there at their offsets. Tasks get the words of the items in passes of about
       ``PASS_WORDS``, an item's own together.
    4. Runs along one alignment of at least ``window`` matching places are exact matches; if
       ``near`` of ``window`` consecutive places match, around an anchor, that is a
       proximity match.

    A term is a 64-bit hash of a word; tasks hold tables of fixed size that say which
    terms to post, and the joins on terms then remove what only seemed to be one.

    Returns one row per row of ``docs``: its id, ``n_words``, ``n_hit`` (words in exact
    matches), ``n_items``, ``items_sha256`` (of their ids, sorted as strings and joined by
    commas), ``contaminated``, ``n_near`` (items with an exact or proximity match),
    ``text_hash`` (xxhash64 of the text, to tell rows of one id apart) and ``matches``, sorted:
    of every alignment the runs of words under overlapping matches, as ``item_id``, ``start``
    and ``end`` (words of the document, the end exclusive), ``item_start``, ``n_equal`` (places
    that match) and ``exact`` (whether an exact match is among them). Null
    or empty texts have no words. Rows of the benchmark with one id are one item; those with a
    null id are one as well, which is counted but not in the list of ids. With ``near`` equal to ``window`` only
    exact matches are looked for, which needs far fewer postings. Repeated rows are each judged, other columns of either table ignored.
    """
    numbered = benchmark.select(
        F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")
    ).withColumn("item", F.monotonically_increasing_id())
    run = max(1, -(-near // (window - near + 1)))
    items = saved(
        numbered.mapInArrow(
            _item_words(run), "item long, item_id string, place int, size int, term long, gram long, length int"
        ),
        "items",
    )
    grams = {
        n: _spots(items.filter(F.col("gram").isNotNull() & (F.col("length") == n)).select(F.col("gram").alias("term")))
        for n in sorted(r.length for r in items.select("length").distinct().collect())
    }
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    terms = _spots(items)
    counted = (
        texts.select("text").mapInArrow(_term_counts(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        .join(items.select("term").distinct(), "term", "left_semi")
    )
    ahead = Window.partitionBy("item").orderBy("place").rowsBetween(0, window - 1)
    missing = F.count_if(F.col("n").isNull()).over(ahead)
    rarest = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("n", "place", "term"))).over(ahead))
    needed = F.when(F.col("size") >= window, window - near + 1 - F.col("missing")).otherwise(1)
    anchors = saved(
        items.drop("gram", "length").join(counted, "term", "left").withColumns({"rarest": rarest, "missing": missing})
        .filter((F.col("place") == 0) | (F.col("place") <= F.col("size") - window))
        .filter((F.col("missing") == 0) | (F.col("missing") <= window - near) & (F.col("size") >= window))
        .select("item", F.explode(F.slice("rarest", F.lit(1), needed.cast("int"))).alias("rare"))
        .select("item", F.col("rare.place").alias("anchor"), F.col("rare.term").alias("term")).distinct(),
        "anchors",
    )
    kind = dict(texts.dtypes)["doc_id"]
    judged = saved(
        hashed.mapInArrow(
            _postings(terms, _spots(anchors), grams, window),
            f"doc_id {kind}, text_hash long, n_words long, places array<int>, terms array<long>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "judged",
    )
    index = saved(
        judged.filter(F.size("places") > 0)
        .select("row", F.explode(F.arrays_zip("places", "terms")).alias("p"))
        .select(F.col("p.terms").alias("term"), "row", F.col("p.places").alias("at")),
        "postings",
    )
    shift = F.col("at") - F.col("anchor")
    aligned = index.join(anchors, "term").select("row", F.floor(shift / STRETCH).alias("stretch"), "item", shift.alias("shift"))
    longest, total = items.agg(F.max("size"), F.count("*")).first()
    stretches = judged.filter(F.size("places") > 0).select("row", "places", "terms").mapInArrow(
        _stretches(max(longest or 0, 1)), "row long, stretch long, places array<int>, terms array<long>"
    )
    passes = -(-total // PASS_WORDS) or 1
    if passes > 1:
        aligned, stretches = saved(aligned, "aligned"), saved(stretches, "stretches")
    matches = None
    for number in range(passes):
        own = F.pmod(F.xxhash64("item"), F.lit(passes)) == number
        words = _words_of(items.filter(own))
        both = stretches.select("row", "stretch", F.lit(None).cast("long").alias("item"), F.lit(None).cast("int").alias("shift"), "places", "terms").unionByName(
            aligned.filter(own), allowMissingColumns=True
        )
        verify = _verified_from(docs.sparkSession.sparkContext.broadcast(words), window, near)
        part = map_groups(both, ("row", "stretch"), verify, _MATCH)
        matches = part if matches is None else matches.unionByName(part)
    matches = matches.join(items.filter("place = 0").select("item", "item_id"), "item")
    figures = matches.groupBy("row").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"),
        F.collect_set(F.when(F.col("exact"), F.col("item_id"))).alias("items"),
        F.max((F.col("exact") & F.col("item_id").isNull()).cast("long")).alias("nameless"),
        (F.count_distinct("item_id") + F.max(F.col("item_id").isNull().cast("long"))).alias("n_near"),
        F.array_sort(F.collect_set(F.struct("item_id", "start", "end", "item_start", "n_equal", "exact"))).alias("matches"),
    )
    none = F.lit(0).cast("long")
    return judged.select("row", F.col("doc_id").alias(doc_id), "n_words", "text_hash").join(figures, "row", "left").select(
        doc_id, "n_words", F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce(F.size("items") + F.col("nameless"), none).alias("n_items"),
        F.sha2(F.coalesce(F.array_join(F.array_sort("items"), ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"), F.coalesce("n_near", none).alias("n_near"), "text_hash",
        F.coalesce("matches", F.array().cast(figures.schema["matches"].dataType)).alias("matches"),
    )
