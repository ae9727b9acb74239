"""Token sequences of several context sizes, packed from whole documents."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from epispark.llm.bytepairs import encoder
from epispark.llm.store import saved
from epispark.llm.words import slices

#: Context sizes, longest first.
TIERS = (2048, 1024, 512, 256, 128)
#: Tokens that a task holds before it packs them, about.
HELD = 1 << 22
#: Tasks and tiers whose counts are sent whole to every task; beyond it pieces are shuffled.
MOST_SENT = 1 << 18
#: Characters of a text that are encoded at once, at least, if it can be cut.
CHUNK = 1 << 20
#: A space between two words: byte-level tokens never reach across its left edge.
_GAP = re.compile(r"(?<=\w) (?=\w)")

Piece = tuple[int, int, int]  # document, start, length


class Stock:
    """Pieces that wait for a sequence, by length; a set bit for each length that there is."""

    def __init__(self) -> None:
        self.held: dict[int, list[Piece]] = {}
        self.lengths = 0

    def put(self, piece: Piece) -> None:
        self.held.setdefault(piece[2], []).append(piece)
        self.lengths |= 1 << piece[2]

    def take(self, most: int) -> Piece | None:
        """A longest piece of at most that length."""
        found = (self.lengths & ((2 << most) - 1)).bit_length() - 1
        if found < 1:
            return None
        pieces = self.held[found]
        piece = pieces.pop()
        if not pieces:
            self.lengths ^= 1 << found
        return piece


def _cut_up(run: list[Piece], tiers: tuple[int, ...]) -> Iterator[tuple[int, list[Piece]]]:
    """A sequence that nothing is left to fill, as full ones of shorter tiers; the last may have a gap."""
    rest = sum(p[2] for p in run)
    run = run[::-1]
    while rest:
        size = next((w for w in tiers if w <= rest), rest)
        out, need = [], size
        while need:
            doc, start, length = run.pop()
            out.append((doc, start, min(length, need)))
            if length > need:
                run.append((doc, start + need, length - need))
            need -= out[-1][2]
        yield next(w for w in tiers[::-1] if w >= size), out
        rest -= size


def sequences(stock: Stock, tiers: tuple[int, ...], last: bool) -> Iterator[tuple[int, list[Piece]]]:
    """Context size and pieces of each sequence that the stock gives, longest tier first.

    A piece belongs to the shortest tier that holds it and opens a sequence there. Its gap is
    filled by pieces of shorter tiers, always the longest that fits whole; where none does, a
    piece of a shorter tier (or, without any, of the same) is cut and its rest goes back into
    the tier of its length. So only the very last sequence can have a gap: its pieces stay in
    the stock, or are cut to shorter tiers if it is the ``last`` time.
    """
    for window, shorter in zip(tiers, (*tiers[1:], 0)):
        while (piece := stock.take(window)) is not None:
            if piece[2] <= shorter:
                stock.put(piece)
                break
            run, gap = [piece], window - piece[2]
            while gap:
                piece = stock.take(gap)
                if piece is None:
                    piece = stock.take(shorter) or stock.take(window)
                    if piece is None:
                        break
                    doc, start, length = piece
                    stock.put((doc, start + gap, length - gap))
                    piece = (doc, start, gap)
                run.append(piece)
                gap -= piece[2]
            if not gap:
                yield window, run
            elif last:
                yield from _cut_up(run, tiers)
            else:
                for piece in run:
                    stock.put(piece)
                return


def _parts(text: str) -> Iterator[str]:
    """The text in runs of at least ``CHUNK`` characters that are encoded alike alone; without a gap it stays whole."""
    lo = 0
    while len(text) - lo > CHUNK and (gap := _GAP.search(text, lo + CHUNK)):
        yield text[lo:gap.start()]
        lo = gap.start()
    yield text[lo:]


def _encoded(encode: Callable[[str], list[int]], text: str, end: int) -> np.ndarray:
    parts = [np.array(encode(part), np.int32) for part in _parts(text)]
    return np.concatenate([*parts, np.array([end], np.int32)])


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end: int = 1,
    tiers: tuple[int, ...] = TIERS,
    doc_id: str = "doc_id",
    text: str = "text",
    step_tokens: int = 1 << 17,
) -> DataFrame:
    """Pieces of sequences: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``,
    ``window`` (the sequence's context size), ``step`` and ``ids``.

    ``tokenizer`` is the path of a byte-level tokenizers file, read by the driver and sent along. A
    document is the ids of its text and ``end``; a null or empty text is ``end`` alone. What fills
    the longest context by itself becomes sequences at once; the rest is routed to the tier of
    its length and packed as ``sequences`` says, where a task holds about ``HELD`` tokens and
    carries over what is left. Thus each task has one sequence at most that is not full.

    Sequences are dealt to steps of about ``step_tokens``: those of a tier are numbered over all
    tasks, and every step gets its share of each tier, so that two steps differ by one sequence
    of each tier at most.

    Repeated rows are documents of their own; ids may be null. An empty table gives no rows.
    The pieces are a written table, since their steps depend on all tasks. Other columns are ignored.
    """
    if list(tiers) != sorted(set(tiers), reverse=True) or tiers[-1] < 1:
        raise ValueError("tiers are context sizes, longest first")
    built = docs.sparkSession.sparkContext.broadcast(Tokenizer.from_file(tokenizer).to_str())
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = kept.select(
        "doc_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (
            ("start", "long"), ("length", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"),
            ("window", "int"), ("part", "int"), ("number", "long"), ("ids", "array<int>"),
        )]
    ).schema
    names = schema.names

    def pack(batches):
        encode, part = encoder(built.value), TaskContext.get().partitionId()
        stock, held, tokens = Stock(), {}, 0
        rows, ids, made, numbers = [], [], 0, dict.fromkeys(tiers, 0)
        kind = None

        def placed(window, run):
            nonlocal made
            at = 0
            for doc, start, length in run:
                name, own = held[doc]
                rows.append((name, start, length, len(own), (part << 32) + made, at, window, part, numbers[window]))
                ids.append(own[start:start + length])
                at += length
            made += 1
            numbers[window] += 1

        def written():
            columns = [pa.array(c, kind if k == 0 else f"int{32 if k in (6, 7) else 64}") for k, c in enumerate(zip(*rows))]
            edges = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(ids)))
            rows.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([*columns, lists], names)

        def packed(last):
            nonlocal held, tokens
            for window, run in sequences(stock, tiers, last):
                placed(window, run)
                if made % 512 == 0:
                    yield written()
            if rows:
                yield written()
            left = {p[0] for pieces in stock.held.values() for p in pieces}
            held, tokens = {d: held[d] for d in left}, 0

        number = 0
        for batch in batches:
            for slice_ in slices(batch, "text", 2 << 20):
                kind = slice_.column("doc_id").type
                texts = pc.fill_null(slice_.column("text"), "").to_pylist()
                for name, content in zip(slice_.column("doc_id").to_pylist(), texts):
                    own = _encoded(encode, content, end)
                    held[number] = name, own
                    whole = len(own) // tiers[0] * tiers[0]
                    for start in range(0, whole, tiers[0]):
                        placed(tiers[0], [(number, start, tiers[0])])
                        if made % 512 == 0:
                            yield written()
                    if whole < len(own):
                        stock.put((number, whole, len(own) - whole))
                    number += 1
                    tokens += len(own)
                    if tokens >= HELD:
                        yield from packed(False)
        yield from packed(True)

    pieces = saved(kept.mapInArrow(pack, schema), "packed")
    counts = pieces.filter("offset = 0").groupBy("window", "part").agg(F.count("*").alias("n"))
    tier = Window.partitionBy("window")
    shares = saved(counts.select(
        "window", "part", (F.sum("n").over(tier.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(tier).alias("all"), "n",
    ), "shares")
    total, rows = shares.agg(F.sum(F.col("window") * F.col("n")), F.count("*")).first()
    steps = max(1, -(-(total or 0) // step_tokens))
    # a row per task and tier; while they are few, the pieces need not be moved
    return pieces.join(F.broadcast(shares) if rows <= MOST_SENT else shares, ["window", "part"]).select(
        F.col("doc_id").alias(doc_id), "start", "length", "doc_tokens", "sequence_id", "offset", "window",
        F.expr(f"(before + number) * {steps} div all").alias("step"), "ids",
    )


def with_checksum(pieces: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of ``ids``: the CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    schema = pieces.drop("ids").select("*", F.lit(None).cast("long").alias("ids_crc32")).schema
    names = schema.names

    def summed(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(flat[lo:hi].tobytes()) for lo, hi in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in names[:-1]], pa.array(sums, pa.int64())], names
            )

    return pieces.mapInArrow(summed, schema)
