"""Packing: every id in exactly one place, sequences full, steps balanced."""

import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from epispark.llm import bytepairs, packing, workload

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def encoded(texts):
    return [e.ids + [1] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def check(pieces, whole):
    """The pieces put together are ``whole`` (document to ids); sequences have no gaps. Returns the lengths of the sequences."""
    found, runs = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) >= 1
        found[p.doc_id].append((p.start, p.ids))
        runs[p.sequence_id].append((p.offset, p.length, p.window, p.step))
    made = {d: [i for _, ids in sorted(own) for i in ids] for d, own in found.items()}
    assert made == whole
    lengths = {}
    for name, run in runs.items():
        at = 0
        for offset, length, _, _ in sorted(run):
            assert offset == at
            at += length
        (window, step), = {r[2:] for r in run}
        assert at <= window <= 2048
        lengths[name] = at, window, step
    return lengths


def padding(lengths):
    return sum(0 if n & (n - 1) == 0 else 2048 - n for n, _, _ in lengths.values())


def test_query_on_the_given_table(spark):
    docs = {r.doc_id: r.text or "" for r in workload.table(spark, FOLDER, "documents").collect()}
    whole = dict(zip(docs, encoded(list(docs.values()))))
    rows = workload.op11_packing(spark, FOLDER).collect()
    covered = Counter()
    for r in rows:
        ids = whole[r.doc_id]
        part = np.array(ids[r.start:r.start + r.length], "<u4")
        assert r.doc_tokens == len(ids) and r.length == len(part) and r.ids_crc32 == zlib.crc32(part.tobytes())
        covered[r.doc_id] += r.length
    assert covered == {d: len(ids) for d, ids in whole.items()}
    pieces = packing.pack_documents(workload.table(spark, FOLDER, "documents"), PATH).collect()
    lengths = check(pieces, whole)
    assert padding(lengths) <= 2048
    assert {w for _, w, _ in lengths.values()} >= {2048}
    for r in pieces:  # an uncut document of a short tier is never spread over sequences without need
        assert r.start + r.length <= r.doc_tokens


def test_odd_texts(spark):
    rows = [(None, None, 1), (1, "", 2), (2, "a", 3), (2, "a", 4), (3, "x " * 40_000, 5), (4, "é<|endoftext|>\n \t b", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(3)
    found = packing.pack_documents(docs, PATH).collect()
    want = [tuple(ids) for ids in encoded([r[1] or "" for r in rows])]
    per = defaultdict(list)
    for p in found:
        per[p.doc_id].append(p)
    for doc in (None, 1, 3, 4):
        ids = [i for p in sorted(per[doc], key=lambda p: p.start) for i in p.ids]
        assert tuple(ids) == want[[r[0] for r in rows].index(doc)]
    assert sum(p.length for p in per[2]) == 2 * len(want[2])
    none = packing.pack_documents(docs.filter("false"), PATH)
    assert none.count() == 0 and none.columns == found[0].__fields__


def test_long_texts_are_cut_where_tokens_end(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 50)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["word", " ", "  ", "\n", "7", "'s", "!", "é", "日本", " a", "<|endoftext|>"]) for _ in range(400)) for _ in range(40)]
    texts += ["x" * 500, " " * 500, ""]
    encode = bytepairs.encoder(Tokenizer.from_file(PATH).to_str())
    assert [list(packing._encoded(encode, t, 1)) for t in texts] == encoded(texts)
    assert any(len([*packing._parts(t)]) > 2 for t in texts)


def test_ids_are_those_of_the_library():
    """Every code point beside letters, digits, spaces and quotes, and a tokenizer that is no plain byte-level one."""
    library = Tokenizer.from_file(PATH)
    assert len(bytepairs.merge_ranks(json.loads(library.to_str()))) == 50_256
    encode = bytepairs.encoder(library.to_str())
    points = [chr(c) for c in range(1, 0x110000, 7) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(1, 0x3000)]
    texts = [f"a{c}1{c} {c}{c}'{c}" for c in points] + ["", " ", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "'S 's\n\n  x"]
    assert [encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert bytepairs.merge_ranks(json.loads(other.to_str())) is None
    assert bytepairs.encoder(other.to_str())("Some  words") == other.encode("Some  words", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_sequences_by_chance(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, rng.choice([40, 300, 2047])) for _ in range(rng.choice([0, 1, 5, 700]))]
    stock, held, made = packing.Stock(), set(), []
    for k, size in enumerate(sizes):
        stock.put((k, 0, size))
        if k % 200 == 199:
            made += packing.sequences(stock, packing.TIERS, False)
    made += packing.sequences(stock, packing.TIERS, True)
    for window, run in made:
        for doc, start, length in run:
            span = {(doc, i) for i in range(start, start + length)}
            assert length and not span & held
            held |= span
    assert len(held) == sum(sizes)
    assert sum(sum(p[2] for p in run) != window for window, run in made) <= 1
    assert stock.take(4096) is None


def test_steps_share_every_tier(spark):
    docs = workload.table(spark, "/root/testdata/sf0.01", "documents").repartition(4)
    found = packing.pack_documents(docs, PATH, step_tokens=1 << 14).filter("offset = 0").collect()
    per = defaultdict(Counter)
    for p in found:
        per[p.step][p.window] += 1
    steps = set(per)
    assert steps == set(range(len(steps))) and len(steps) > 20
    for window in packing.TIERS:
        counts = [per[s][window] for s in steps]
        assert max(counts) - min(counts) <= 1
