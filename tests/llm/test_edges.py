"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator and stage."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimspark.llm import (
    chat,
    embedding_dedup,
    mixing,
    packing,
    quality,
    secret_scan,
    sharding,
    simhash,
    substring,
    topk,
)
from claimspark.llm.queries import tokenizer_path

CLASHING = ("score spans rank fp ord kind f0 F1 before text_kept row_a row_b mix_rows mix_same tokens epoch budget block held runs "
            "copied doc col virtual_slot shard slot salt order component").split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{name}` int" for name in CLASHING)
LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "a plain text of some words that says nothing at all to anyone who reads it now", "s0"),
        (2, "a plain text of some words that says nothing at all to anyone who reads it now", "s0"),
        (2, "a plain text of some words that says nothing at all to anyone who reads it now", "s0"),
        (3, None, None),
        (4, "", "s1"),
        (5, "  \t\n ", "s1"),
        (None, "no id here, token = abcdefghijklmnop", "s1"),
        (None, None, None),
        (6, LONG, "s0"),
        (7, "naïve 中文 text with   odd spaces\x1c and <|endoftext|>", "s2"),
    ]
    full = [(i, t, "en", s, len(t) if t else None, *range(len(CLASHING))) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 0, None), (None, 1, 0), (6, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "substring": lambda d: substring.remove_repeated(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "sharding": lambda d: sharding.shard(d),
    "secrets": lambda d: secret_scan.scan(d),
    "redact": lambda d: secret_scan.redact(d),
    "schedule": lambda d: mixing.schedule(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(name, docs, none):
    found = OPERATORS[name](docs).collect()
    assert len(found) >= docs.count()
    assert OPERATORS[name](none).collect() == []


def test_quality(docs, none, labels):
    for rows in (labels, labels.limit(0)):
        model = quality.train(docs, rows)
        found = quality.classify(docs, model).collect()
        assert len(found) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in found)
        assert {f for f in docs.columns} <= set(found[0].asDict())
        by_text = {r["text"] or "": r["score"] for r in found}
        assert all(r["score"] == by_text[r["text"] or ""] for r in found)
        assert quality.classify(none, model).collect() == []


def test_simhash_groups(docs):
    found = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    zero = "0" * 16
    assert {(3, zero, 3), (4, zero, 3), (5, zero, 3), (None, zero, 3)} <= found
    assert {r[2] for r in found if r[0] in (1, 2)} == {1}
    kept = simhash.keep_one(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "3", "6", "7", "None"]
    assert kept[0].asDict().keys() == docs.first().asDict().keys()


def test_substring_rules(docs):
    found = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.remove_repeated(docs).collect()}
    assert (1, 17, 0) in found and (2, 17, 17) in found  # the repeated rows of 2 do not remove from each other
    assert {(3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 100_000, 0)} <= found


def test_secrets_and_redaction(docs):
    found = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs).where("text is not null and doc_id is null or doc_id = 1").collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in found[None]] == [("assign", 12, 36)] and found[1] == []
    clean = {r["text"]: r["n_chars"] for r in secret_scan.redact(docs).collect()}
    assert clean["no id here, [SECRET]"] == 20 and clean[LONG] == len(LONG) and None in clean


def test_sharding_places(docs):
    found = sharding.shard(docs, 3, slots=64).collect()
    for shard in range(3):
        own = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert {r["text_crc32"] for r in found if r["size"] == 1} == {zlib.crc32(b"")}


def test_packing_covers_every_document(docs, none):
    packed = packing.pack(docs, tokenizer_path(), 64)
    found = packed.collect()
    assert {r["doc_id"] for r in found} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(none, tokenizer_path(), 64).collect() == []


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 5), (2, [2.0, 0.0], 5), (2, [2.0, 0.0], 5), (3, None, 5), (4, [], 5), (5, [0.0, 0.0], 5),
        (6, [nan, 1.0], 5), (7, [inf, 1.0], 5), (8, [None, 1.0], 5), (9, [1.0], 5), (10, [0.0, 1e-300], 5),
        (None, [1.0, 0.0], 5), (11, [-1.0, 0.0], 5),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    found = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(table).collect()}
    assert {(1, 2, 1, True), (2, 2, 1, False), (9, 0, 9, True), (10, 0, 10, True), (11, 0, 11, True), (None, 0, None, True)} <= found
    assert all(n == 0 for i, n, _, _ in found if i in (3, 4, 5, 6, 7, 8))
    assert embedding_dedup.near_duplicates(table.limit(0)).collect() == []
    top = topk.top_k(table, F.col("vec_id") % 2 == 1, 2)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top.collect()} == {
        (1, 1, 2, 131072), (1, 2, 5, 0), (5, 1, 1, 0), (5, 2, 2, 0), (11, 1, 5, 0), (11, 2, 10, 0),
    }
    assert topk.top_k(table.limit(0), F.col("vec_id") % 2 == 1, 2).collect() == []


def test_chat(spark):
    schema = "conv_id long, messages array<struct<role:string,content:string>>, prompt string, response string, formatted string"
    rows = [
        (1, [("user", None), (None, "b")], None, None, None), (2, None, "p", None, None), (3, None, None, None, None),
        (4, [], None, None, None), (None, [None, ("a:b", "### </turn>\n")], None, None, None), (5, None, "p", "r", "an extra field"),
    ]
    turns = chat.canonical_turns(spark.createDataFrame(rows, schema), "conv_id")
    done = chat.format_turns(turns).withColumn("back", chat.read_turns(F.col("formatted")))
    found = {r["id"]: r for r in done.collect()}
    said = {i: [tuple(t) for t in r["back"]] for i, r in found.items()}
    assert said == {1: [("user", ""), ("", "b")], 2: [("user", "p")], 3: [], 4: [], None: [("a:b", "### </turn>\n")], 5: []}
    assert found[3]["layout"] is None and found[5]["layout"] is None and found[2]["layout"] == "prompt_response"


@pytest.mark.parametrize("number", range(5))
def test_stages(spark, docs, none, labels, number, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    _, stage = corpus_pipeline.STAGES[number]
    found = stage(spark, docs, str(tmp_path))
    if number < 4:
        assert found.columns == docs.columns
        assert [f.dataType for f in found.schema.fields] == [f.dataType for f in docs.schema.fields]
    assert found.count() > 0
    assert stage(spark, none, str(tmp_path)).count() == 0
