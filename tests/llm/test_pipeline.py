"""The pipeline against brute force on a small corpus, stage by stage."""

import re

import pytest
import sentencepiece

import corpus_pipeline as chain
from epispark.llm import quality, workload
from test_decontam import brute as brute_contamination
from test_minhash import brute as brute_groups
from test_secrets import brute as brute_secrets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs, folder, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), tmp_path_factory.mktemp("stages"), {}
    columns = docs.columns
    for name, stage in chain.STAGES:
        made = stage(spark, docs, FOLDER)
        if name != "pieces":
            assert made.columns == columns
        made.write.parquet(f"{folder}/{name}")
        before, docs = docs, spark.read.parquet(f"{folder}/{name}")
        out[name] = (sorted(before.collect(), key=lambda r: r.doc_id), sorted(docs.collect(), key=lambda r: r.doc_id))
    return out


def test_quality_keeps_what_the_scores_say(spark, outputs):
    before, after = outputs["quality"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = quality.score_quality(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels, "source", "lang")
    kept = {r.doc_id for r in scores.filter("kept").collect()}
    assert after == [r for r in before if r.doc_id in kept] and 0 < len(after) < len(before)


def test_one_document_of_each_group_stays(outputs):
    before, after = outputs["near_duplicates"]
    kept = {d for d, _, _, first in brute_groups([(r.doc_id, r.text) for r in before], 5) if first}
    assert after == [r for r in before if r.doc_id in kept] and len(after) < len(before)


def test_no_benchmark_passage_stays(spark, outputs):
    before, after = outputs["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaks = {r[0] for r in brute_contamination([(r.doc_id, r.text) for r in before], items) if r[5]}
    assert after == [r for r in before if r.doc_id not in leaks] and leaks


def test_no_secret_stays(outputs):
    before, after = outputs["secrets"]
    assert len(before) == len(after)
    for a, b in zip(before, after):
        spans = brute_secrets(a.text, [r.kind for r in chain.secrets.RULES])
        assert (a.text == b.text) == (not spans) and len(re.findall(r"\[secret\]", b.text)) <= len(spans)
        assert b.n_chars == len(b.text) and not brute_secrets(b.text)


def test_ids_are_the_library_s(outputs):
    before, after = outputs["pieces"]
    library = sentencepiece.SentencePieceProcessor(model_file=workload.PIECE_MODEL)
    assert [r.ids for r in after] == library.encode([r.text for r in before])
    assert all(r.round_trip for r in after)


def test_run_is_the_stages_in_a_row(spark, outputs):
    rows = chain.run(spark, FOLDER).collect()
    assert sorted(rows, key=lambda r: r.doc_id) == outputs["pieces"][1]


def test_empty_and_odd_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "", "en", "s", 0), (5, "word " * 200_000, None, None, None)], docs.schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for k, given in enumerate((docs.limit(0), odd)):
        given.write.parquet(f"{tmp_path}/{k}.parquet")
        now = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        for _, stage in chain.STAGES:
            now = stage(spark, now, str(tmp_path))
        assert now.count() == (0, 3)[k]


def test_one_row_of_each_group_stays(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcde"}
    given = [
        (1, text["a"]), (1, text["a"]), (1, text["a"]),  # repeated rows
        (2, text["b"]), (2, text["a"]),  # a text of its own, and a copy of another document
        (None, text["c"]), (None, text["c"]),  # copies without an id
        (None, text["d"]), (4, text["d"] + " more"), (5, text["d"]),
        (6, text["e"] + " more"), (None, text["e"]), (7, None), (7, None), (None, ""),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in given], schema)
    made = chain.near_duplicate_stage(spark, docs, FOLDER)
    assert made.columns == docs.columns
    expected = [(1, text["a"]), (2, text["b"]), (None, text["c"]), (4, text["d"] + " more"), (6, text["e"] + " more"),
                (7, None), (7, None), (None, "")]
    assert sorted(((r.doc_id, r.text) for r in made.collect()), key=repr) == sorted(expected, key=repr)


def test_columns_named_like_inner_ones_stay(spark):
    names = ("_row", "row", "doc", "_id", "_hash", "text_hash", "component_id", "shingles")
    rows = [(i, t, "en", "s", 1, *[f"{n}{i}" for n in names]) for i, t in enumerate(["a b c d e f", "A b c d e f", None, "g h"])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for stage in (chain.near_duplicate_stage, chain.decontamination_stage, chain.secret_stage):
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        kept = {r.doc_id: tuple(r)[5:] for r in out.collect()}
        assert len(kept) == (3 if stage is chain.near_duplicate_stage else 4)
        assert all(kept[i] == rows[i][5:] for i in kept)
