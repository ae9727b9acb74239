"""Language model by deleted interpolation, counted and looked up in blocks.

Texts are taken in blocks of a few MB. A block asks for the counts of its distinct words
and word pairs, one message to each range of keys; each range adds up what all blocks hold
and answers. So a key costs one entry per block, however frequent it is.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.llm.groups import map_groups
from epispark.llm.store import saved
from epispark.llm.words import SPACED, hashed_words, mix, slices, text_bytes

END = np.uint64(0xE4D)
#: How often a context was seen, as a power of two, chooses its mixture weights.
LEVELS = 24
_FINE = 4
#: Bytes of text in a block.
BLOCK = 6 << 20
#: Low bits left out of a key: a word has 64 bits, a pair of words 56.
FREE = (0, 8)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes, as many as the largest needs."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<BQ", width, len(values)) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", raw)
    planes = np.frombuffer(pa.decompress(raw[9:], width * n, "zstd"), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def pack_sorted(keys: np.ndarray, free: int = 0) -> bytes:
    """Rising keys: the first one, and the steps to the next ones; their ``free`` low bits are 0."""
    return keys[:1].astype("<u8").tobytes() + pack(np.diff(keys) >> np.uint64(free))


def unpack_sorted(raw: bytes, free: int = 0) -> np.ndarray:
    first = np.frombuffer(raw, "<u8", count=1)
    return np.cumsum(np.concatenate([first, unpack(raw[8:]) << np.uint64(free)]), dtype=np.uint64)


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with one end after each text, and how many each text has."""
    rows, hashes = hashed_words(*text_bytes(part.column("_text")), SPACED)
    sizes = np.bincount(rows, minlength=part.num_rows) + 1
    tokens = np.full(int(sizes.sum()), END, dtype=np.uint64)
    tokens[np.arange(len(rows)) + rows] = hashes
    return tokens, sizes


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """A key for each token with the one before it; before a text stands an end."""
    before = np.concatenate([[END], tokens[:-1]])
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + tokens) >> np.uint64(FREE[1]) << np.uint64(FREE[1])


def _blocks(batches):
    """Whole batches in blocks, each with a name that is the same whenever the task runs."""
    task = TaskContext.get().partitionId()
    for i, batch in enumerate(batches):
        for j, part in enumerate(slices(batch, "_text", BLOCK)):
            offsets, data = text_bytes(part.column("_text"))
            yield f"{task}-{i}-{j}-{zlib.crc32(data[offsets[0] : offsets[-1]]):x}", part


def _bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal ranges of the 64 bits begins among sorted keys."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))


_ASKED = "range int, block string, kind int, keys binary, n binary, held binary"


def _ask(ranges: int):
    """What each block has of each word (kind 0) and pair (kind 1), by range of keys."""

    def ask(batches):
        for block, part in _blocks(batches):
            tokens, sizes = _tokens(part)
            fold = np.repeat(part.column("_fold").to_numpy(), sizes)
            out = []
            for kind, values in enumerate((tokens, _pairs(tokens))):
                keys, where = np.unique(values, return_inverse=True)
                n = np.bincount(where, weights=fold != 1, minlength=len(keys))
                held = np.bincount(where, weights=fold == 0, minlength=len(keys))
                edges = _bounds(keys, ranges)
                out += [
                    (r, block, kind, pack_sorted(keys[a:b], FREE[kind]), pack(n[a:b]), pack(held[a:b]))
                    for r, (a, b) in enumerate(zip(edges, edges[1:])) if b > a
                ]
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1]), pa.array(columns[2], pa.int32()), *map(pa.array, columns[3:])],
                ["range", "block", "kind", "keys", "n", "held"])

    return ask


_ANSWERED = ["block", "kind", "range", "a", "b"]


def _answer(table: pa.Table, bounds: np.ndarray):
    """To each block the counts over all training texts, and over those held out; and one row
    without a block: tokens, tokens held out and distinct words of the range."""
    for a, b in zip(bounds, bounds[1:]):
        rows = table.slice(a, b - a).to_pylist()
        number = rows[0]["range"]
        out = []
        for kind in (0, 1):
            asked = [r for r in rows if r["kind"] == kind]
            if not asked:
                continue
            parts = [unpack_sorted(r["keys"], FREE[kind]) for r in asked]
            keys, where = np.unique(np.concatenate(parts), return_inverse=True)
            n, held = (
                np.bincount(where, weights=np.concatenate([unpack(r[c]) for r in asked]), minlength=len(keys)).astype(np.int64)
                for c in ("n", "held")
            )
            if not kind:
                total = np.array([n.sum(), held.sum(), (n > 0).sum()])
                out.append(("", 0, number, pack(total), pack(total)))
            edges = np.cumsum([0, *map(len, parts)])
            for r, lo, hi in zip(asked, edges, edges[1:]):
                own = where[lo:hi]
                out.append((r["block"], kind, number, pack(n[own]), pack(held[own])))
        columns = list(zip(*out))
        yield pa.table(
            [pa.array(columns[0]), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), *map(pa.array, columns[3:])],
            _ANSWERED)


def _hold(batches):
    """The texts of each block as places in the list of its words."""
    for block, part in _blocks(batches):
        tokens, sizes = _tokens(part)
        keys, where = np.unique(tokens, return_inverse=True)
        ids = part.column("doc_id")
        yield pa.RecordBatch.from_arrays([
            pa.array([block]), pa.array([2], pa.int32()), pa.array([0], pa.int32()),
            pa.array([pack_sorted(keys)]), pa.array([pack(where)]),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([pack(part.column("_fold").to_numpy())]), pa.array([pack(sizes)]),
        ], [*_ANSWERED, "ids", "folds", "sizes"])


def level(n: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the power of two below its count."""
    return np.minimum(np.frexp(n.astype(np.float64))[1], LEVELS - 1)


def _cells(pair: np.ndarray, before: np.ndarray, word: np.ndarray) -> dict[str, np.ndarray]:
    """Held-out tokens by level of the context and size of both counts, with the sums of the
    pair's share and of the word's count in each cell; so many cells at most, ever."""
    share = np.where(pair > 0, pair / np.maximum(before, 1), 0.0)
    first = np.where(pair > 0, np.clip(1 - np.floor(np.log2(np.maximum(share, 1e-12)) * _FINE), 1, 127), 0)
    second = np.where(word > 0, np.clip(1 + np.floor(np.log2(np.maximum(word, 1)) * _FINE), 1, 255), 0)
    cell, where = np.unique((level(before) * 128 + first) * 256 + second, return_inverse=True)
    return {
        "cell": cell.astype(np.int64), "n": np.bincount(where).astype(np.float64),
        "share": np.bincount(where, weights=share), "word": np.bincount(where, weights=word),
    }


def _join(table: pa.Table, bounds: np.ndarray):
    """The counts of every token of a block, and what its held-out texts say of the mixture."""
    for a, b in zip(bounds, bounds[1:]):
        rows = sorted(table.slice(a, b - a).to_pylist(), key=lambda r: (r["kind"], r["range"]))
        block = rows[0]["block"]
        if not block:
            total = np.sum([unpack(r["a"]) for r in rows], axis=0)
            row = {"ids": [], "folds": None, "sizes": None, "word": pack(total), "pair": None, "cells": []}
        else:
            texts = [r for r in rows if r["kind"] == 2]
            if len(texts) != 1:
                raise RuntimeError("a block changed between two readings: the documents are not read in a stable order")
            keys, where = unpack_sorted(texts[0]["a"]), unpack(texts[0]["b"]).astype(np.int64)
            tokens = keys[where]
            distinct, pairs = np.unique(_pairs(tokens), return_inverse=True)

            def counts(kind, part, size):
                found = np.concatenate([unpack(r[part]) for r in rows if r["kind"] == kind]).astype(np.int64)
                if len(found) != size:
                    raise RuntimeError("a block changed between two readings: the documents are not read in a stable order")
                return found

            word, word_held = (counts(0, p, len(keys))[where] for p in "ab")
            pair, pair_held = (counts(1, p, len(distinct))[pairs] for p in "ab")
            rest = word - word_held
            held = np.repeat(unpack(texts[0]["folds"]), unpack(texts[0]["sizes"]).astype(np.int64)) == 0
            before = np.concatenate([rest[-1:], rest[:-1]])
            cells = _cells((pair - pair_held)[held], before[held], rest[held])
            row = {
                "ids": texts[0]["ids"], "folds": texts[0]["folds"], "sizes": texts[0]["sizes"], "word": pack(word),
                "pair": pack(pair), "cells": [dict(zip(cells, x)) for x in zip(*(v.tolist() for v in cells.values()))],
            }
        kind = table.schema.field("ids").type
        shape = pa.list_(pa.struct([("cell", pa.int64()), ("n", pa.float64()), ("share", pa.float64()), ("word", pa.float64())]))
        yield pa.table({
            "block": pa.array([block]), "ids": pa.array([row["ids"]], kind), "folds": pa.array([row["folds"]], pa.binary()),
            "sizes": pa.array([row["sizes"]], pa.binary()), "word": pa.array([row["word"]], pa.binary()),
            "pair": pa.array([row["pair"]], pa.binary()), "cells": pa.array([row["cells"]], shape),
        })


def learn_weights(
    levels: np.ndarray, n: np.ndarray, pair: np.ndarray, word: np.ndarray, floor: float, strength: float = 5.0, steps: int = 200
) -> np.ndarray:
    """Weights of pair, word and uniform share for each level, by expectation-maximisation on
    held-out counts ``n`` whose events have the given shares. Levels with few events lean on
    the weights of all together. A context never seen has no weight for pairs."""
    shares = np.stack([pair, word, np.full(len(n), floor)])

    def fit(chosen, prior):
        weights = prior / prior.sum()
        for _ in range(steps):
            parts = weights[:, None] * shares[:, chosen]
            events = (parts / np.maximum(parts.sum(axis=0), 1e-300) * n[chosen]).sum(axis=1)
            fresh = (events + prior) / (events + prior).sum()
            if np.abs(fresh - weights).max() < 1e-9:
                break
            weights = fresh
        return weights

    every = fit(np.ones(len(n), dtype=bool), np.array([1.0, 1.0, 1.0]))
    table = np.array([fit(levels == k, strength * every) for k in range(LEVELS)])
    table[0] = [0.0, *(table[0, 1:] / table[0, 1:].sum())]
    return table


def _score(weights: np.ndarray, tokens: int, distinct: int):
    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = unpack(row["sizes"]).astype(np.int64)
                word, pair = (unpack(row[c]).astype(np.float64) for c in ("word", "pair"))
                before = np.concatenate([word[-1:], word[:-1]])
                mixed = weights[level(before)]
                chance = (
                    mixed[:, 0] * pair / np.maximum(before, 1) + mixed[:, 1] * word / max(tokens, 1) + mixed[:, 2] / (distinct + 1)
                )
                base = np.log10((word + 0.5) / (tokens + 0.5 * (distinct + 1)))
                starts = np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], batch.schema.field("ids").type.value_type), pa.array(unpack(row["folds"]) == 1),
                    pa.array(sizes), pa.array(np.add.reduceat((word > 0).astype(np.int64), starts)),
                    pa.array(np.full(len(sizes), tokens, np.int64)), pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(np.log10(chance), starts)),
                ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def score_texts(docs: DataFrame, fold: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Log10 probability of every whole text under a model of words and pairs of words.

    ``fold`` is a whole number from 0 per row: 1 is never learned from, 0 is what the mixture
    weights are learned on, the others are counted for that; the model then counts all but
    1. A null fold is taken as 2. Tokens are words (A-Z lower-cased, split at ASCII white
    space) and one end per text; a word is known by a 64-bit hash, a pair by one of 56 bits.

    P(w | h) = a c(h, w) / c(h) + b c(w) / N + c / (V + 1), with weights (a, b, c) for each
    power of two of c(h). They are learned by expectation-maximisation on held-out tokens,
    gathered over all blocks into a table of fixed size.

    Returns one row per row of ``docs``: its id, ``held_out`` (fold 1), ``n_tokens``,
    ``n_known`` (tokens seen in training), ``train_tokens`` (N), ``base_score`` (sum of log10
    ((c + 0.5) / (N + 0.5 (V + 1)))) and ``score``. A null or empty text is one end. Without
    training texts all scores are 0. Repeated rows count each; other columns are ignored.

    Texts are read twice, and have to come in the same order both times, as from a file.
    """
    spark = docs.sparkSession
    ranges = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    picked = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(fold, F.lit(2)).cast("long").alias("_fold"), F.col(text).alias("_text")
    )
    kind = dict(picked.dtypes)["doc_id"]
    answers = map_groups(
        picked.mapInArrow(_ask(ranges), _ASKED), ("range",), _answer, "block string, kind int, range int, a binary, b binary"
    )
    texts = picked.mapInArrow(
        _hold, f"block string, kind int, range int, a binary, b binary, ids array<{kind}>, folds binary, sizes binary"
    )
    joined = saved(
        map_groups(
            texts.unionByName(answers, allowMissingColumns=True), ("block",), _join,
            f"block string, ids array<{kind}>, folds binary, sizes binary, word binary, pair binary, "
            "cells array<struct<cell:bigint,n:double,share:double,word:double>>",
        ),
        "counted",
    )
    total = joined.filter("block = ''").select("word").first()
    tokens, held, distinct = (int(x) for x in unpack(total[0])) if total else (0, 0, 0)
    cells = (
        joined.select(F.explode("cells").alias("c")).groupBy("c.cell")
        .agg(F.sum("c.n").alias("n"), F.sum("c.share").alias("share"), F.sum("c.word").alias("word")).toArrow()
    )
    cell, n, share, word = (cells.column(c).to_numpy() for c in ("cell", "n", "share", "word"))
    weights = learn_weights(cell // (128 * 256), n, share / np.maximum(n, 1), word / np.maximum(n, 1) / max(tokens - held, 1), 1 / (distinct + 1))
    if not tokens:
        weights = np.tile([0.0, 0.0, 1.0], (LEVELS, 1))
    return joined.filter("block <> ''").select("ids", "folds", "sizes", "word", "pair").mapInArrow(
        _score(weights, tokens, distinct),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    ).withColumnRenamed("doc_id", doc_id)
