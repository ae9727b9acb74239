"""Ranked lexical search over posting lists in blocks of similar documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epispark.llm.groups import map_groups
from epispark.llm.store import saved
from epispark.llm.words import ALPHANUMERIC, hashed_words, slices, text_bytes

#: Documents in a block of a posting list.
BLOCK = 64
#: Documents in a segment, at most, and cells of its table of documents and terms, about.
SEGMENT, CELLS = 4096, 1 << 24
#: Different words of the items that are searched for at once, about.
ITEM_TERMS = 1 << 17
#: Bits of the signature that documents are ordered by.
BITS = 32


@dataclass
class Asked:
    """Items of one pass: the words of all, and each item's words of positive weight, heaviest first."""

    terms: np.ndarray
    weights: np.ndarray
    rows: np.ndarray
    bounds: np.ndarray
    words: np.ndarray

    def item(self, k: int) -> np.ndarray:
        return self.words[self.bounds[k]:self.bounds[k + 1]]


def _item_terms(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            rows, hashes = hashed_words(*text_bytes(part.column("text")), ALPHANUMERIC)
            pairs = np.unique(np.rec.fromarrays([rows, hashes], names="r,h"))
            yield pa.RecordBatch.from_arrays(
                [part.column("row").take(pa.array(pairs.r)), pa.array(pairs.h.view(np.int64))], ["row", "term"]
            )


def _vectors(terms: np.ndarray):
    """Per document its number of words, and which of ``terms`` (sorted) it has, how often."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows, hashes = hashed_words(*text_bytes(part.column("text")), ALPHANUMERIC)
                at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                held = terms[at] == hashes
                pairs, n = np.unique(rows[held].astype(np.int64) * len(terms) + at[held], return_counts=True)
                edges = pa.array(np.searchsorted(pairs, np.arange(part.num_rows + 1) * len(terms)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(np.bincount(rows, minlength=part.num_rows)),
                    pa.ListArray.from_arrays(edges, pa.array((pairs % len(terms)).astype(np.int32))),
                    pa.ListArray.from_arrays(edges, pa.array(n.astype(np.int32))),
                ], ["doc_id", "n", "terms", "times"])

    return count


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of a list column."""
    return lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()


def _signed(asked: Asked, documents: int, words: int):
    """What each term adds to a document's score before its weight, and a signature: documents
    that score alike have the same sign along most of ``BITS`` directions drawn at random."""

    def sign(batches):
        ways = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (len(asked.terms), BITS))
        ways *= asked.weights[:, None]
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds, terms = _flat(batch.column("terms"))
            times = _flat(batch.column("times"))[1].astype(np.int64)
            norms = np.array([10 + 90 * n * documents // words for n in batch.column("n").to_pylist()], np.int64)
            values = 1_000_000_000 * times // (1000 * times + 8 * np.repeat(norms, np.diff(bounds)))
            bits = np.empty((batch.num_rows, BITS), bool)
            for lo in range(0, batch.num_rows, 256):
                cut = bounds[lo:lo + 257]
                span = slice(cut[0], cut[-1])
                bits[lo:lo + 256] = np.add.reduceat(ways[terms[span]] * values[span, None], cut[:-1] - cut[0]) > 0
            signature = bits.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1))
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("doc_id"), batch.column("terms"),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.astype(np.int32))), pa.array(signature),
            ], ["row", "doc_id", "terms", "values", "signature"])

    return sign


class Segment:
    """Documents in the order of their signatures, with a posting list per term and its blocks' summaries."""

    def __init__(self, doc_ids: pa.Array, bounds: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        self.doc_ids, self.bounds, self.terms, self.values = doc_ids, bounds, terms, values
        order = np.argsort(terms, kind="stable")
        self.docs = np.repeat(np.arange(len(doc_ids)), np.diff(bounds))[order]
        self.present, starts = np.unique(terms[order], return_index=True)
        self.starts = dict(zip(self.present.tolist(), starts.tolist()))
        self.ends = dict(zip(self.present.tolist(), [*starts[1:].tolist(), len(order)]))
        self.summaries: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def listed(self, term: int) -> np.ndarray:
        return self.docs[self.starts[term]:self.ends[term]]

    def summarise(self, asked: Asked) -> None:
        """For every block of a list, the largest value of each term that some item asks for
        together with the list's own and that is not heavier: bounds need no other."""
        table = np.zeros((len(self.doc_ids), len(asked.terms)), np.int32)
        table[np.repeat(np.arange(len(self.doc_ids)), np.diff(self.bounds)), self.terms] = self.values
        beside: dict[int, list[np.ndarray]] = {}
        for k in range(len(asked.rows)):
            words = asked.item(k)
            for j, term in enumerate(words.tolist()):
                if term in self.starts:
                    beside.setdefault(term, []).append(words[j:])
        for term, found in beside.items():
            docs = self.listed(term)
            along = np.unique(np.concatenate(found))
            top = np.maximum.reduceat(table[np.ix_(docs, along)], np.arange(0, len(docs), BLOCK))
            used = top.any(axis=0)
            self.summaries[term] = along[used], top[:, used]

    def limits(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No document of a block of the first term's list scores more over ``terms`` than its limit."""
        along, top = self.summaries[int(terms[0])]
        at = np.minimum(np.searchsorted(along, terms), len(along) - 1)
        held = along[at] == terms
        return top[:, at[held]].astype(np.int64) @ weights[held]

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores, from the weights of all terms."""
        sizes = self.bounds[docs + 1] - self.bounds[docs]
        first = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(first - self.bounds[docs], sizes)
        return np.add.reduceat(weights[self.terms[at]] * self.values[at], first)

    def best(self, docs: np.ndarray, scores: np.ndarray, k: int, least: int) -> tuple[pa.Array, np.ndarray]:
        """Ids and scores of the ``k`` best of the documents with a score of at least ``least``."""
        if len(scores) > k:
            least = max(least, int(np.partition(scores, -k)[-k]))
        kept = np.flatnonzero(scores >= max(least, 1))
        found = pa.table({"s": scores[kept], "d": self.doc_ids.take(pa.array(docs[kept]))})
        if len(found) > k:
            found = found.sort_by([("s", "descending"), ("d", "ascending")]).slice(0, k)
        found = found.combine_chunks()
        return found["d"], found["s"].to_numpy()

    def seeds(self, asked: Asked, item: int, weights: np.ndarray, k: int):
        """The best documents of the block with the highest limit."""
        words = asked.item(item)
        top, at, chosen = 0, 0, None
        for j, term in enumerate(words.tolist()):
            if term in self.summaries:
                limits = self.limits(words[j:], weights[words[j:]])
                if limits.max() > top:
                    top, at, chosen = int(limits.max()), int(limits.argmax()), term
        if chosen is None:
            return None
        docs = self.listed(chosen)[at * BLOCK:(at + 1) * BLOCK]
        return self.best(docs, self.scores(docs, weights), k, 1)

    def search(self, asked: Asked, item: int, weights: np.ndarray, k: int, least: int):
        """The ``k`` best documents with a score of at least ``least``, ties by id.

        Lists are read heaviest term first. A document that lacks the terms before scores no
        more than its block's limit over the rest; one that has such a term was judged there.
        So a block is skipped if its limit is below what the ``k``-th best document has.
        """
        words = np.array([t for t in asked.item(item).tolist() if t in self.summaries], np.int64)
        if not len(words):
            return None
        most = np.array([int(self.summaries[t][1][:, self.summaries[t][0] == t].max()) for t in words.tolist()], np.int64)
        rest = np.cumsum((most * weights[words])[::-1])[::-1]
        seen = np.zeros(len(self.doc_ids), bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for j in range(len(words)):
            if rest[j] < least:
                break
            limits = self.limits(words[j:], weights[words[j:]])
            found = self.listed(int(words[j]))
            found = found[np.repeat(limits >= least, BLOCK)[:len(found)]]
            found = found[~seen[found]]
            if len(found):
                seen[found] = True
                docs, scores = np.append(docs, found), np.append(scores, self.scores(found, weights))
                kept = scores >= least
                docs, scores = docs[kept], scores[kept]
                if len(scores) > k:
                    least = max(least, int(np.partition(scores, -k)[-k]))
        return self.best(docs, scores, k, least) if len(docs) else None


def _indexed(asked: Asked, k: int, schema):
    """Segments of the documents read: a row per document, per posting list, and per seed of a threshold."""
    size = max(BLOCK, min(SEGMENT, CELLS // max(1, len(asked.terms))))

    def rows(segment, kind, number, doc_ids, terms, values, scores):
        n = len(number)
        empty = pa.nulls(n, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, segment)), pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(number, np.int32)),
            doc_ids, terms if terms is not None else empty, values if values is not None else empty, scores,
        ], schema.names)

    def lists(parts):
        edges = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(parts).astype(np.int32)))

    def made(table):
        name = int(table["row"][0].as_py())
        ids = table["doc_id"].combine_chunks()
        bounds, terms = _flat(table["terms"].combine_chunks())
        segment = Segment(ids, bounds, terms, _flat(table["values"].combine_chunks())[1].astype(np.int64))
        segment.summarise(asked)
        n = table.num_rows
        yield rows(name, 0, np.arange(n), ids, table["terms"].combine_chunks(), table["values"].combine_chunks(), pa.nulls(n, pa.int64()))
        terms = list(segment.summaries)
        for lo in range(0, len(terms), 512):
            part = terms[lo:lo + 512]
            yield rows(
                name, 1, part, pa.nulls(len(part), ids.type), lists([segment.summaries[t][0] for t in part]),
                lists([segment.summaries[t][1].ravel() for t in part]), pa.nulls(len(part), pa.int64()),
            )
        for item in range(len(asked.rows)):
            weights = _item_weights(asked, item)
            if found := segment.seeds(asked, item, weights, k):
                yield rows(name, 2, np.full(len(found[1]), item), found[0].combine_chunks() if isinstance(found[0], pa.ChunkedArray) else found[0],
                           None, None, pa.array(found[1]))

    def index(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(held)
                yield from made(table.slice(0, size))
                held, n = table.slice(size).to_batches(), n - size
        if n:
            yield from made(pa.Table.from_batches(held))

    return index


def _item_weights(asked: Asked, item: int) -> np.ndarray:
    weights = np.zeros(len(asked.terms), np.int64)
    weights[asked.item(item)] = asked.weights[asked.item(item)]
    return weights


def _searched(asked: Asked, least: np.ndarray, k: int):
    def search(table, starts):
        for lo, hi in zip(starts, starts[1:]):
            part = table.slice(lo, hi - lo).sort_by([("kind", "ascending"), ("number", "ascending")]).combine_chunks()
            n = int((part["kind"].to_numpy() == 0).sum())
            docs, blocks = part.slice(0, n).combine_chunks(), part.slice(n).combine_chunks()
            bounds, terms = _flat(docs["terms"].combine_chunks())
            values = _flat(docs["values"].combine_chunks())[1].astype(np.int64)
            segment = Segment(docs["doc_id"].combine_chunks(), bounds, terms, values)
            if blocks.num_rows:
                edges, along = _flat(blocks["terms"].combine_chunks())
                cuts, tops = _flat(blocks["values"].combine_chunks())
                for row, term in enumerate(blocks["number"].to_pylist()):
                    own = along[edges[row]:edges[row + 1]]
                    segment.summaries[term] = own, tops[cuts[row]:cuts[row + 1]].reshape(-1, len(own))
            for item in range(len(asked.rows)):
                found = segment.search(asked, item, _item_weights(asked, item), k, int(least[item]))
                if found:
                    ids, scores = found
                    yield pa.table([pa.array(np.full(len(scores), asked.rows[item])), ids, pa.array(scores)], ["row", "doc_id", "score"])

    return search


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``k`` best documents for every row of ``items``: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Terms are runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased, known by a 64-bit
    hash. The weight of a term is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's norm m is
    10 + 90 n N div L, and it scores w * (10**9 tf div (1000 tf + 8 m)) for each different term.

    1. Documents are read once for the items' terms: how many words, and which terms how often.
       All documents count for N, L and df.
    2. They are dealt by ranges of a signature of their weighted terms, so that similar ones lie
       side by side, and cut into segments. In a segment each term's posting list keeps that
       order in blocks of ``BLOCK`` documents, each with a summary: the largest value of every
       term. Segments are written, with the best documents of each item's best block.
    3. The ``k``-th best of those is where an item's search starts from: in every segment its
       lists are read heaviest term first, and a block whose summary allows less is skipped.
    4. The best of all segments are ranked, equal scores by ascending id, null last.

    Items are taken in passes of about ``ITEM_TERMS`` words, so that what tasks get of them is
    bounded; an item's own words go together. An item whose terms no document has gets no rows,
    nor does one without text; repeated rows of either table are answered, or ranked, each.
    Null and empty texts have no terms. Other columns are ignored.
    """
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    named = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    named = saved(named.withColumn("row", F.monotonically_increasing_id()), "items")
    words = saved(named.select("row", "text").mapInArrow(_item_terms, "row long, term long"), "item-terms")
    passes = max(1, -(-words.count() // ITEM_TERMS))
    found = None
    for number in range(passes):
        part = words.filter(F.pmod(F.xxhash64("row"), F.lit(passes)) == number)
        ranked = _ranked(texts, part, k, kind)
        if ranked is not None:
            found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        found = texts.sparkSession.createDataFrame([], f"row long, rank int, doc_id {kind}, score long")
    return found.join(named.select("row", "item_id"), "row").select(
        F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score"
    )


def _ranked(texts: DataFrame, words: DataFrame, k: int, kind: str) -> DataFrame | None:
    """One pass over all documents for the items that ``words`` (row, term) has; None if nothing can match."""
    pairs = words.toArrow()
    if not pairs.num_rows:
        return None
    hashes, codes = np.unique(pairs["term"].to_numpy().view(np.uint64), return_inverse=True)
    vectors = saved(
        texts.mapInArrow(_vectors(hashes), f"doc_id {kind}, n long, terms array<int>, times array<int>")
        .withColumn("row", F.monotonically_increasing_id()),
        "vectors",
    )
    documents, length = vectors.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    counts = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighed = counts.withColumn("w", F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1)))).toArrow()
    weights = np.zeros(len(hashes), np.int64)
    weights[weighed["term"].to_numpy()] = weighed["w"].to_numpy()
    rows, item = np.unique(pairs["row"].to_numpy(), return_inverse=True)
    asked_for = np.lexsort((codes, -weights[codes], item))
    asked_for = asked_for[weights[codes[asked_for]] > 0]
    bounds = np.searchsorted(item[asked_for], np.arange(len(rows) + 1))
    asked = Asked(hashes, weights, rows, bounds, codes[asked_for])
    context = texts.sparkSession.sparkContext
    sent = context.broadcast(asked)

    def signed(batches):
        return _signed(sent.value, documents, length)(batches)

    lists = "doc_id {0}, terms array<int>, values array<int>".format(kind)
    schema = texts.sparkSession.createDataFrame([], f"segment long, kind int, number int, {lists}, score long").schema

    def indexed(batches):
        return _indexed(sent.value, k, schema)(batches)

    index = saved(
        vectors.filter(F.size("terms") > 0).select("row", "doc_id", "n", "terms", "times")
        .mapInArrow(signed, f"row long, {lists}, signature long")
        .repartitionByRange(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "signature", "row")
        .sortWithinPartitions("signature", "row").drop("signature").mapInArrow(indexed, schema),
        "index",
    )
    best = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score")))
    starts = index.filter("kind = 2").select("number", "score").withColumn("rank", best).filter(F.col("rank") == k).toArrow()
    least = np.ones(len(rows), np.int64)
    least[starts["number"].to_numpy()] = starts["score"].to_numpy()

    def searched(table, at):
        return _searched(sent.value, least, k)(table, at)

    segments = index.filter("kind < 2").drop("score")
    tops = map_groups(segments, ("segment",), searched, f"row long, doc_id {kind}, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("row", "rank", "doc_id", "score")
