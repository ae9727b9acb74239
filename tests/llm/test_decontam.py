"""Decontamination against a brute-force scan of every window."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from epispark.llm import decontam
from epispark.llm.decontam import find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            k = min(10, len(v))
            if not k:
                continue
            windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    ids.add(item_id)
        digest = hashlib.sha256(",".join(sorted(str(i) for i in ids if i is not None)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=repr)


def found(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, row int")
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, place int")
    return sorted((tuple(r)[:6] for r in find_contamination(d, b).collect()), key=repr)


def test_random_texts_with_planted_passages(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "É1", "a", *(f"w{i}" for i in range(30))]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 25, 60]))) for i in range(12)] + [(3, text(20)), (None, text(12))]
    docs = []
    for i in range(60):
        piece = rng.choice(items)[1].split()
        cut = rng.randrange(len(piece))
        docs.append((i, f"{text(rng.randrange(40))}, {' '.join(piece[cut // 2 :]).upper()}\n{text(rng.randrange(9))}"))
    assert found(spark, docs, items) == brute(docs, items)


def test_corner_cases(spark):
    ten = "one two three four five six seven eight nine ten"
    docs = [
        (1, None), (2, ""), (None, ten), (4, ten + " " + ten), (4, ten + " " + ten), (5, ten[:-4]), (6, "!? ..."),
        (7, "the " * 30), (8, "filler " * 400_000 + ten), (9, "x" * 700_000 + " lone word"),
    ]
    items = [(10, ten), (9, ten + " eleven"), (2, None), (3, ""), (4, "the the the"), (5, "lone word"), (5, "lone word")]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_a_null_id_is_no_name(spark):
    b = spark.createDataFrame([(None, "a b c"), ("null", "b c d"), ("x", "c d e")], "item_id string, text string")
    d = spark.createDataFrame([(1, "a b c d e"), (2, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r for r in find_contamination(d, b).collect()}
    assert [(got[k].n_items, got[k].n_near) for k in (1, 2)] == [(3, 3), (1, 1)]
    assert got[1].items_sha256 == hashlib.sha256(b"null,x").hexdigest() and got[2].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_exact_only_passes_and_stretches(spark, monkeypatch):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(["the", "of", *(f"w{i}" for i in range(20))]) for _ in range(n))
    items = [(i, text(rng.choice([4, 10, 30, 90]))) for i in range(20)]
    docs = [(i, " ".join([text(rng.randrange(60)), rng.choice(items)[1], text(30), rng.choice(items)[1]] * 3)) for i in range(25)]
    monkeypatch.setattr(decontam, "PASS_WORDS", 100)
    monkeypatch.setattr(decontam, "LOOKUPS", 64)
    want = brute(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for near in (8, 10):
        assert sorted((tuple(r)[:6] for r in find_contamination(d, b, near=near).collect()), key=repr) == want


def test_stretches_hold_what_an_alignment_needs():
    rng = np.random.default_rng(4)
    for reach in (1, 30, 9_000):
        places = np.unique(rng.integers(0, 30_000, 400)).astype(np.int32)
        batch = pa.RecordBatch.from_pydict({"row": [7], "places": [places], "terms": [places.astype(np.int64) * 3]})
        (out,) = decontam._stretches(reach)([batch])
        held = dict(zip(out.column("stretch").to_pylist(), out.column("places").to_pylist()))
        for anchor in rng.integers(0, reach, 50):
            for at in places:
                shift = int(at) - int(anchor)
                near = [p for p in places if shift <= p < shift + reach]
                assert set(near) <= set(held[shift // decontam.STRETCH])


def test_a_near_match_is_no_contamination(spark):
    item = [f"w{i}" for i in range(20)]
    doc = [*item[:9], "other", *item[10:18]]
    d = spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    row = find_contamination(d, b).first()
    assert (row.n_hit, row.contaminated, row.n_near) == (0, False, 1)


def near_items(text, items):
    """Items with at least 8 equal words in 10 in a row, or a short one as a whole, at any alignment."""
    w, out = words(text), set()
    for item_id, item in items:
        v = words(item)
        for shift in range(-len(v), len(w)):
            same = [0 <= shift + i < len(w) and w[shift + i] == x for i, x in enumerate(v)]
            if v and max(sum(same[i : i + 10]) for i in range(max(1, len(v) - 9))) >= (8 if len(v) >= 10 else len(v)):
                out.add(item_id)
    return out


def test_a_near_match_that_lacks_the_rarest_term(spark):
    ten = "one two three four five six seven eight nine ten".split()
    docs = [(1, " ".join(["zero", *ten[:4], "other", *ten[5:]])), (2, "five"), (3, " ".join(ten * 3)), (4, " ".join(ten))]
    docs += [(5, " ".join(ten[:4] + ten[5:9] * 2))]
    long = [f"v{i}" for i in range(7)] + ["rare"] + [f"v{i}" for i in range(8, 15)]
    docs += [(6, " ".join(w if w != "rare" else "x" for w in long)), (7, "rare and rare"), (8, " ".join(long[:7] + long[8:]))]
    items = [(1, " ".join(ten)), (2, " ".join(long))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in find_contamination(d, b).collect()}
    assert {k: r.n_near for k, r in got.items()} == {k: len(near_items(t, items)) for k, t in docs}
    assert [tuple(m) for m in got[1].matches] == [("1", 1, 11, 0, 9, False)]
    assert [tuple(m) for m in got[3].matches] == [("1", k, k + 10, 0, 10, True) for k in (0, 10, 20)]
    assert [tuple(m) for m in got[6].matches] == [("2", 0, 15, 0, 14, False)] and got[2].matches == []


def test_near_matches_of_random_texts(spark):
    rng = random.Random(8)
    text = lambda n: [rng.choice(["the", "of", *(f"w{i}" for i in range(40))]) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([4, 10, 13, 40])))) for i in range(15)]
    docs = []
    for i in range(80):
        piece = [w if rng.random() > 0.15 else rng.choice(text(3)) for w in rng.choice(items)[1].split()]
        docs.append((i, " ".join(text(rng.randrange(15)) + piece + text(rng.randrange(15)))))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: {int(m.item_id) for m in r.matches} for r in find_contamination(d, b).collect()}
    assert got == {k: near_items(t, items) for k, t in docs}
