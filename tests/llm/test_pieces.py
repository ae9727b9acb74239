"""The rebuilt tokenizer against the sentencepiece library, and round trips."""

import random
import struct

import sentencepiece
from tokenizers import Tokenizer, decoders

from epispark.llm import pieces
from epispark.llm.workload import PIECE_MODEL

FOLDER = "/root/testdata/sf0.001"


def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def test_parity_on_odd_texts():
    with open(PIECE_MODEL, "rb") as file:
        data = file.read()
    tokenizer, (spelled, extra) = pieces.build_tokenizer(data), pieces.piece_bytes(data)
    rng = random.Random(1)
    bits = [" ", "  ", " " * 17, " " * 33, "a", "the", "Thing", pieces.SPACE, "é", "\n", "\t", "世", "🙂", "<s>", "<0x41>",
            "</s>", "x́", "\x00", "​", "0", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["", " ", "a" * 5000, " " * 1000]
    found = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert found == library().encode(texts)
    back = tokenizer.decode_batch(found, skip_special_tokens=False)
    assert all(a == b for a, b in zip(texts, back) if pieces.SPACE not in a)
    assert back == [b"".join(spelled[i] for i in x)[extra:].decode() for x in found]


def test_documents_agree_with_the_library_and_come_back(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    encoded = pieces.encode_texts(docs, PIECE_MODEL)
    assert encoded.columns == [*docs.columns, "ids", "n_tokens", "round_trip"]
    rows = encoded.collect()
    assert [r.ids for r in rows] == library().encode([r.text for r in rows])
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    decoded = pieces.decode_texts(encoded, PIECE_MODEL)
    assert {r.doc_id: r.text for r in decoded.collect()} == {r.doc_id: r.text for r in rows}


def test_corner_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 2), (2, "", 2), (None, "ab " * 200_000, 3), (4, f"a{pieces.SPACE}b", 4)],
        "doc_id long, text string, ids int")
    out = pieces.encode_texts(docs, PIECE_MODEL)
    rows = sorted(out.collect(), key=lambda r: (r.doc_id or 0, r.text or ""))
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "round_trip"]
    assert [(r.n_tokens, r.round_trip) for r in rows if r.doc_id] == [
        (None, None), (0, True), (0, True), (rows[4].n_tokens, False)]
    assert rows[0].doc_id is None and rows[0].round_trip and rows[0].n_tokens == len(library().encode(rows[0].text))
    assert pieces.encode_texts(docs.limit(0), PIECE_MODEL).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode_texts(out, PIECE_MODEL).collect()}
    assert back[1] is None and back[2] == "" and back[4] == "a b"


def _field(number, value):
    def size(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + size(n >> 7)

    if isinstance(value, int):
        return bytes([number << 3]) + size(value)
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    return bytes([number << 3 | 2]) + size(len(value)) + value


def test_a_unigram_model_keeps_its_scores():
    pieces_ = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -1.5, 1), ("▁", -2.0, 1), ("a", -2.5, 1), ("▁ab", -1.2, 1)]
    data = b"".join(_field(1, _field(1, t.encode()) + _field(2, s) + _field(3, k)) for t, s, k in pieces_)
    data += _field(2, _field(3, 1)) + _field(3, _field(1, b"identity"))
    tokenizer = pieces.build_tokenizer(data)
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["ab", "a b", "  a   bab ", "ba", ""]
    assert [e.ids for e in tokenizer.encode_batch(texts)] == own.encode(texts)
    assert isinstance(tokenizer, Tokenizer)


def test_the_round_trip_asks_the_decoder(spark, monkeypatch):
    whole = pieces.build_tokenizer

    def wrong(data):
        built = whole(data)
        built.decoder = decoders.Fuse()
        return built

    monkeypatch.setattr(pieces, "build_tokenizer", wrong)
    docs = spark.createDataFrame([("two words",)], "text string")
    assert [r.round_trip for r in pieces.encode_texts(docs, PIECE_MODEL).collect()] == [False]
