"""SentencePiece models run by the tokenizers library."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from epispark.llm.words import slices

SPACE = "▁"

# Field numbers, kinds of pieces and kinds of models of the format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_KIND, BYTE_FALLBACK, UNIGRAM, BPE = 3, 35, 1, 2
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA_SPACES, ESCAPE_SPACES = 2, 3, 4, 5


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _number(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    remove_extra_spaces: bool
    escape_spaces: bool


def parse_model(data: bytes) -> Model:
    """What a model file says; absent fields have the format's defaults."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in fields(data):
        if number == PIECES:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece[PIECE_SCORE])[0] if PIECE_SCORE in piece else 0.0
            pieces.append((piece[PIECE_TEXT].decode(), score, piece.get(PIECE_KIND, NORMAL)))
        elif number == TRAINER:
            trainer = dict(fields(value))
        elif number == NORMALIZER:
            normalizer = dict(fields(value))
    return Model(
        pieces, trainer.get(MODEL_KIND, UNIGRAM), bool(trainer.get(BYTE_FALLBACK, 0)), normalizer.get(CHARSMAP, b""),
        bool(normalizer.get(DUMMY_PREFIX, 1)), bool(normalizer.get(REMOVE_EXTRA_SPACES, 1)),
        bool(normalizer.get(ESCAPE_SPACES, 1)),
    )


def _merges(model: Model, ids: dict[str, int]) -> list[tuple[str, str]]:
    """All ways to join two pieces to a third, best third first.

    Runs of markers all have one score, which means from left to right; joining equal
    halves first leads to the same pieces.
    """
    scores = {t: s for t, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    joins = []
    for text, score in scores.items():
        if any(c not in ids for c in text):
            raise ValueError(f"piece {text!r} has a character that is no piece")
        for cut in range(1, len(text)):
            left, right = text[:cut], text[cut:]
            if left in scores and right in scores:
                joins.append((-score, left != right, ids[text], ids[left], ids[right], left, right))
    return [j[-2:] for j in sorted(joins)]


def build_tokenizer(data: bytes) -> Tokenizer:
    """The model as a tokenizer: its normaliser, marker, scores or merges, and byte fallback."""
    model = parse_model(data)
    ids = {text: k for k, (text, _, _) in enumerate(model.pieces)}
    unknown = next(text for text, _, kind in model.pieces if kind == UNKNOWN)
    if model.kind == UNIGRAM:
        built = models.Unigram(
            [(text, score) for text, score, _ in model.pieces], ids[unknown], model.byte_fallback
        )
    elif model.kind == BPE:
        built = models.BPE(
            ids, _merges(model, ids), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback,
            cache_capacity=100_000,
        )
    else:
        raise ValueError("only unigram and BPE models are known")
    tokenizer = Tokenizer(built)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", SPACE))
    tokenizer.normalizer = normalizers.Sequence(steps)
    undo = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(undo + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return tokenizer


def piece_bytes(data: bytes) -> tuple[list[bytes], int]:
    """What each id stands for in a decoded text, and how many bytes to drop at its start."""
    model = parse_model(data)
    spelled = [
        bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(SPACE, " ").encode() for text, _, kind in model.pieces
    ]
    return spelled, int(model.dummy_prefix)


def _loaded(built: str, threads: int) -> Tokenizer:
    os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true"
    return Tokenizer.from_str(built)


def encode_texts(
    docs: DataFrame, model: str, text: str = "text", ids: str = "ids", threads: int = 2, check: bool = True
) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and, if ``check``, ``round_trip`` behind its columns.

    ``model`` is the path of a model file, read by the driver and sent along. A task encodes
    a few MB of texts at a time with ``threads`` threads. ``round_trip`` tells whether the
    decoded ids, and the pieces put together, are the text again, for every text; a text that holds
    the marker itself comes back with spaces. A null text has null ids and tokens and no round trip; an empty
    text has no ids. Columns of ``docs`` named like a new one are replaced.
    """
    with open(model, "rb") as file:
        data = file.read()
    built = docs.sparkSession.sparkContext.broadcast((build_tokenizer(data).to_str(), *piece_bytes(data)))
    own = [c for c in docs.columns if c not in (ids, "n_tokens", "round_trip")]
    kept = docs.select(*own)
    schema = kept.select(
        "*", F.lit(None).cast("array<int>").alias(ids), F.lit(None).cast("long").alias("n_tokens"),
        *[F.lit(None).cast("boolean").alias("round_trip")] * check,
    ).schema

    def encode(batches):
        tokenizer = _loaded(built.value[0], threads)
        _, spelled, extra = built.value
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                column = part.column(text)
                texts = pc.fill_null(column, "").to_pylist()
                found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                null = pc.is_null(column)
                new = {
                    ids: pa.array(found, pa.list_(pa.int32()), mask=null.to_numpy(zero_copy_only=False)),
                    "n_tokens": pc.if_else(null, None, pa.array([len(x) for x in found], pa.int64())),
                }
                if check:
                    back = tokenizer.decode_batch(found, skip_special_tokens=False)
                    joined = (b"".join([spelled[i] for i in x])[extra:] for x in found)
                    same = pa.array([a == b and a.encode() == c for a, b, c in zip(texts, back, joined)])
                    new["round_trip"] = pc.if_else(null, None, same)
                yield pa.RecordBatch.from_arrays([*part.columns, *new.values()], [*part.schema.names, *new])

    return kept.mapInArrow(encode, schema)


def decode_texts(encoded: DataFrame, model: str, ids: str = "ids", text: str = "text", threads: int = 2) -> DataFrame:
    """``encoded`` with ``text`` made from its ``ids``, behind its other columns; null ids have a null text."""
    with open(model, "rb") as file:
        built = encoded.sparkSession.sparkContext.broadcast(build_tokenizer(file.read()).to_str())
    kept = encoded.drop(text)
    schema = kept.select("*", F.lit(None).cast("string").alias(text)).schema

    def decode(batches):
        tokenizer = _loaded(built.value, threads)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                held = part.column(ids).to_pylist()
                made = tokenizer.decode_batch([x or [] for x in held], skip_special_tokens=False)
                texts = pa.array([None if x is None else t for x, t in zip(held, made)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, text])

    return kept.mapInArrow(decode, schema)
