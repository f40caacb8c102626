"""Operators against plain versions on small made-up data."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimspark.llm import embedding_dedup, grouping, packing, quality, secret_scan, sharding, simhash, substring, topk
from claimspark.llm.automaton import Automaton
from claimspark.llm.cover_tree import CoverTree, search
from claimspark.llm.components import components
from claimspark.llm.queries import tokenizer_path
from claimspark.llm.vectors import first_by_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(ids, linked):
    """The smallest id that each reaches."""
    of = {i: i for i in ids}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def corpus(seed, number, copies=0.3):
    """Texts of which some share passages and some are near or exact copies."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = []
    for _ in range(number):
        if texts and rng.random() < copies:
            text = rng.choice(texts).split(" ")
            if rng.random() < 0.6 and len(text) > 3:
                text[rng.randrange(len(text))] = "changed"
        else:
            text = [rng.choice(words) for _ in range(rng.randint(0, 120))]
            if rng.random() < 0.4:
                at = rng.randint(0, len(text))
                text[at:at] = passage[rng.randint(0, 20) :]
        texts.append(" ".join(text))
    return texts


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(1, 1), (2, 3), (3, 2)]
    links += [(rng.randint(300, 500), rng.randint(300, 500)) for _ in range(150)]
    rng.shuffle(links)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {i for pair in links if pair[0] != pair[1] for i in pair}
    assert found == {i: c for i, c in groups({i for p in links for i in p}, links).items() if i in ids}


@pytest.mark.parametrize("window", [1, 5, 13, 20])
def test_repeated_passages(spark, window):
    texts = corpus(window, 120)
    ids = random.Random(3).sample(range(1000), len(texts))
    rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeated(rows, window).collect()}
    first = {}
    split = {i: WORD.findall(t) for i, t in zip(ids, texts)}
    for i in sorted(split):
        for at in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][at : at + window]), i)
    for i, words in split.items():
        gone = set()
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < i:
                gone |= set(range(at, at + window))
        assert found[i] == (len(words), len(gone), " ".join(w for at, w in enumerate(words) if at not in gone))


def plain_fingerprint(text, size=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("shard", [16_384, 24])
def test_simhash_links(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    texts = corpus(11, 150, 0.6) + ["", "One", "one", "ÀB c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    expected = {i: (format(prints[i], "016x"), c) for i, c in groups(prints, linked).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(rows).collect()} == expected
    assert sorted(r["doc_id"] for r in simhash.keep_one(rows).collect()) == sorted({c for _, c in expected.values()})


def test_vantage_point_trees_lose_no_link():
    rng = np.random.default_rng(4)
    points = rng.integers(0, 2**63, 3000).astype(np.uint64)
    near = points[:1000].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64)
    points = np.unique(np.concatenate([points, near]))
    expected = {(int(a), int(b)) for a in points for b in points[np.bitwise_count(points ^ a) <= 4] if a < b}
    found = set()
    for mask in simhash.masks():
        found |= {(int(min(p)), int(max(p))) for p in simhash._local_links(points, points, mask, 1, 4)}
    assert found == expected


def test_hot_cluster_is_told_by_few_links():
    points = np.arange(1024, dtype=np.uint64)  # all within ten bits
    found = simhash._local_links(points, points, simhash.masks()[0], 1, 10)
    assert len(found) < 20 * len(points)
    assert set(groups([int(p) for p in points], [tuple(map(int, p)) for p in found]).values()) == {0}


@pytest.mark.parametrize("tile", [6144, 40])
@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_embedding_links(spark, tile, threshold):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 12)) * np.linspace(3, 0.2, 12)
    rows = np.concatenate([base[rng.integers(0, 20, 150)] + rng.normal(size=(150, 12)) * 0.3, rng.normal(size=(100, 12))])
    rows = np.concatenate([rows, rows[:10]]).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(table, threshold, tile=tile).collect()}
    cosine = (rows @ rows.T) / np.linalg.norm(rows, axis=1)[:, None] / np.linalg.norm(rows, axis=1)[None, :]
    linked = cosine >= threshold
    np.fill_diagonal(linked, False)
    component = groups(range(len(rows)), [tuple(map(int, p)) for p in np.argwhere(linked)])
    assert found == {i: (int(linked[i].sum()), component[i]) for i in range(len(rows))}


@pytest.mark.parametrize("cell", [8192, 30])
def test_top_k(spark, monkeypatch, cell):
    monkeypatch.setattr(topk, "CELL", cell)
    monkeypatch.setattr(topk, "GROUP", 7)
    rng = np.random.default_rng(9)
    rows = np.concatenate([rng.normal(size=(150, 4)), np.repeat(rng.normal(size=(3, 4)), 20, 0)])
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(table, F.col("vec_id") % 10 == 0, 5).collect()}
    whole = np.floor(rows * 256)
    expected = {}
    for q in range(0, len(rows), 10):
        best = sorted((-int(whole[q] @ whole[c]), c) for c in range(len(rows)) if c != q)[:5]
        expected |= {(q, rank): (c, -s) for rank, (s, c) in enumerate(best, 1)}
    assert found == expected


ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PARTS = ["password", "Passwd", "secret", "token", "api_key", "APIKEY", "AKIA", "AKI", "=", ":", " ", "'", '"', "é", "\n", "K",
         "abcdef0123456789", "ABCDEFGH12345678", "x.y-z", "0123456789ab", "tok", "-----BEGIN ", "PRIVATE KEY-----"]
SCANNER = secret_scan.Scanner(secret_scan.RULES)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_secrets_like_plain_expressions(text):
    data = text.encode()
    spans = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(data) if len(m[1]) >= 12]
    spans += [(m.start(), "access", m.end()) for m in re.finditer(rb"AKIA[A-Z0-9]+", data) if len(m[0]) >= 18]
    spans += [(m.start(), "hex", m.end()) for m in re.finditer(rb"[0-9a-f]+", data) if len(m[0]) >= 16]
    spans += [(m.start(), "pem", m.end()) for m in re.finditer(rb"-----BEGIN [A-Z ]*PRIVATE KEY-+", data)]
    spans.sort(key=lambda s: (s[0], list(secret_scan.RULES).index(s[1])))
    place = lambda p: len(data[:p].decode())
    assert SCANNER.find(data) == [(place(a), k, place(b)) for a, k, b in spans]
    assert SCANNER.spans(data, 3) == SCANNER.spans(data)


def test_automaton_refuses_what_it_cannot_follow():
    for pattern in ("a*", "(ab)+", "a"):
        with pytest.raises(ValueError):
            Automaton({"rule": (pattern, False)})


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), max_size=40), st.integers(1, 30))
def test_plans_place_every_item_once(counts, kinds):
    plan = grouping.best_plan(counts, 100, kinds)
    room, seen = defaultdict(list), defaultdict(set)
    for length, rank, number, sequence, offset, each in plan.rows:
        for step in range(number):
            room[sequence + step // each].append((offset + length * (step % each), length))
            seen[length].add(rank + step)
    assert {k: set(range(n)) for k, n in counts.items()} == dict(seen)
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert len(room) == plan.sequences
    # no worse than first-fit decreasing by more than a few sequences
    bins = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fit = next((i for i, left in enumerate(bins) if left >= length), None)
        bins.append(100 - length) if fit is None else bins.__setitem__(fit, bins[fit] - length)
    assert plan.sequences <= len(bins) * 1.02 + 1


def test_configurations_meet_the_relaxed_bound():
    sizes, demand = np.array([60, 50, 40, 30]), np.array([300, 100, 300, 200])
    found, gap = grouping.patterns(sizes, demand, 100)
    assert gap == 0
    assert all((column * sizes).sum() <= 100 for column, _ in found)
    # 300 times 60 + 40, 50 times 50 + 50 and 66 2/3 times 30 + 30 + 30 is the relaxed optimum
    assert 417 - len(sizes) <= sum(times for _, times in found) <= 417
    assert (sum(column * times for column, times in found) <= demand).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\tab1é!'　\x1c"), max_size=14), max_size=6))
def test_tokens_are_those_of_the_tokenizer(texts):
    tokens = packing._tokens(tokenizer_path())
    whole = [np.array(e.ids, "<u4").tobytes() for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert tokens.encode(texts) == whole


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" + " \u3000" * 600_000 + "b"], ids=["spaces", "newlines", "between"])
def test_white_space_of_any_length_has_ids(text):
    tokens = packing._tokens(tokenizer_path())
    whole = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False)
    assert tokens.encode([text, "b"]) == [np.array(whole.ids, "<u4").tobytes(), tokens.encode(["b"])[0]]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "some", "1é"]), max_size=8).map("".join), max_size=6))
def test_added_tokens_are_those_of_the_unmodified_tokenizer(texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = ["some text <|endoftext|> more", *texts]
    whole = [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    assert packing._tokens(tokenizer_path()).encode(texts) == whole
    assert np.frombuffer(whole[0], "<u4").tolist() == [11246, 2420, 220, 50256, 517]


def test_packing_a_document_of_white_space(spark):
    rows = spark.createDataFrame([(1, "\n" * 2_000_000), (2, "some words")], "doc_id long, text string")
    found = packing.pack(rows, tokenizer_path(), 2048).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    sizes = {1: len(Tokenizer.from_file(tokenizer_path()).encode("\n" * 2_000_000).ids) + 1, 2: 3}
    assert {r["doc_id"]: r["n"] for r in found} == sizes


def test_packed_ids_are_the_documents_ids(spark):
    texts = corpus(8, 60)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = packing.pack(rows, tokenizer_path(), 64, keep_ids=True)
    found, sequences = packed.collect(), {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    tokens = packing._tokens(tokenizer_path())
    for doc, text in enumerate(texts):
        whole, at = tokens.encode([text])[0] + bytes(4), 0
        for r in sorted((r for r in found if r["doc_id"] == doc), key=lambda r: r["piece"]):
            own = whole[4 * at : 4 * (at + r["length"])]
            assert r["start"] == at and zlib.crc32(own) == r["ids_crc32"] and (r["piece"] == 0 or r["length"] == 64)
            assert sequences[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == own
            at += r["length"]
        assert 4 * at == len(whole)


def test_slot_map_versions(spark, tmp_path):
    sizes = [(slot, 100 + slot * 7 % 41, 1) for slot in range(400)]
    held = lambda chosen, n: [sum(s for slot, s, _ in sizes if chosen[slot] == k) for k in range(n)]
    one = sharding.assign(sizes, 16)
    two = sharding.rebalance(sizes, one, 17)
    for chosen, n in ((one, 16), (two, 17)):
        assert max(held(chosen, n)) <= min(held(chosen, n)) + 141
    assert all(two[s] in (one[s], 16) for s in one)  # a new shard takes slots only into itself
    three = sharding.rebalance(sizes, two, 15)
    assert set(three.values()) == set(range(15)) and max(held(three, 15)) <= min(held(three, 15)) + 141
    sharding.store_map(spark, str(tmp_path), 1, one, sizes)
    sharding.store_map(spark, str(tmp_path), 2, two, sizes)
    assert sharding.load_map(spark, str(tmp_path), 1) == one and sharding.load_map(spark, str(tmp_path), 2) == two


def test_quality_on_labels_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    scored = quality.classify(docs, quality.train(docs, labels)).withColumn("held_out", quality.held_out())
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    unheld = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.classify(docs, quality.train(docs, unheld))  # held-out labels have no say
    assert scored.select("doc_id", "score").exceptAll(again.select("doc_id", "score")).count() == 0


def test_added_tokens_and_white_space():
    """One encoder gives the ids of the tokenizer's own library, whatever the text holds."""
    tokens, plain = packing.Tokens(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    assert tokens.ranked
    space = [" " * 30_000, "\n" * 12_000, " \n\t" * 5_000, "\u3000" * 10_000, " " * 10_000, " " * 9_999]
    texts = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b ", " <|endoftext|> c's", "<|endoftext", "\x1c" * 20_000 + "x", "a" * 30_000]
    texts += [before + run + after for run in space for before in ("", "word", "x's") for after in ("", "word", "'s", "!", "\x1c")]
    texts += [space[0] + "<|endoftext|>" + space[1] + "\x85" + "end"]
    for text in texts:
        want = np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert tokens.encode([text]) == [want], text[:20]


def test_quality_samples_cover_whole_texts(spark, monkeypatch):
    """What tells good from bad stands at the end of long texts only."""
    seen = []
    monkeypatch.setattr(quality, "_dictionary", lambda samples: seen.append(samples) or b"".join(samples)[:1000])
    texts = [(n, "x" * 9000 + ("good" if n % 2 else "bad") * 200) for n in range(1, 60)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n, _ in texts], "doc_id long, quality int")
    quality.train(rows, labels)
    whole = {text.encode() for _, text in texts}
    for samples in seen:
        assert all(len(s) <= quality.SAMPLE and any(s in w for w in whole) for s in samples)
        assert any(b"good" in s or b"badbad" in s for s in samples) and any(s == b"x" * quality.SAMPLE for s in samples)
        assert sum(map(len, samples)) in {n * len(w) for w in whole for n in range(1, 60)}
    seen.clear()
    quality.train(rows, labels, samples=5)
    assert [len(samples) for samples in seen] == [5, 5]


def clustered(seed, clusters, each, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims)) * 3000
    return np.floor((centres[:, None, :] + rng.normal(size=(clusters, each, dims)) * 15).reshape(-1, dims))


def test_cover_tree_prunes_clustered_vectors():
    rows = clustered(1, 60, 40)
    ids, asks = np.arange(len(rows)), np.arange(0, len(rows), 7)
    tree = CoverTree(rows)
    assert tree.root.children

    def check(node):
        for child in node.children:
            assert np.linalg.norm(rows[child.points] - child.centre, axis=1).max() <= child.radius + 1e-9
            check(child)
        if node.children:
            assert sorted(p for c in node.children for p in c.points) == sorted(node.points)

    check(tree.root)
    least = np.full(len(asks), -np.inf)
    found = search(CoverTree(rows[asks]), ids[asks], tree, ids, 5, least)
    scores = rows[asks] @ rows.T
    scores[np.arange(len(asks)), asks] = -np.inf
    for n in range(len(asks)):
        order = np.lexsort((ids, -scores[n]))[:5]
        assert found.ids[n].tolist() == order.tolist() and found.scores[n].tolist() == scores[n][order].tolist()
    assert found.compared < 0.3 * scores.size  # pairs of balls were left out


def test_cover_tree_of_far_copies_and_singles():
    rows = np.concatenate([np.eye(100) * 1000, np.eye(100) * 1000, np.zeros((70, 100))])
    tree = CoverTree(rows)
    assert len(tree.root.children) >= 100 and {len(c.points) for c in tree.root.children} >= {2}


def test_search_leaves_out_cells_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL", 60)
    monkeypatch.setattr(topk, "GROUP", 20)
    rows = clustered(2, 12, 50)
    table = spark.createDataFrame([(int(i), [float(x) / 256 for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    met = []
    keep = topk.materialise
    monkeypatch.setattr(topk, "materialise", lambda df, label: met.append((label, keep(df, label))) or met[-1][1])
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(table, F.col("vec_id") % 10 == 0, 5).collect()}
    for query in range(0, 600, 10):
        scores = rows @ rows[query]
        order = [i for i in np.lexsort((np.arange(600), -scores)) if i != query][:5]
        assert [found[query, n + 1] for n in range(5)] == [(i, int(scores[i])) for i in order]
    cells = next(df for label, df in met if label == "cells").select("cell").distinct().count()
    asking = next(df for label, df in met if label == "asking").count()
    assert cells >= 8 and asking < 0.5 * cells * 60


def test_search_keeps_large_ids_apart(spark):
    big = 2**53
    rows = [(big, [1.0, 0.0]), (big + 1, [1.0, 0.0]), (big + 2, [0.5, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [(r["rank"], r["vec_id"]) for r in topk.top_k(table, F.col("vec_id") == 1, 3).orderBy("rank").collect()]
    assert found == [(1, big), (2, big + 1), (3, big + 2)]


def test_simhash_of_a_hot_block(spark, monkeypatch):
    """Very many fingerprints that agree in one block are parted by the other bits and searched in several tasks."""
    monkeypatch.setattr(simhash, "SHARD", 400)
    rng = np.random.default_rng(3)
    hot = np.uint64(0x12345) | (rng.integers(0, 1 << 43, 2500, np.uint64) << np.uint64(21))
    near = hot[:300] ^ (np.uint64(1) << rng.integers(21, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(21, 64, 300).astype(np.uint64))
    points = np.unique(np.concatenate([hot, near, rng.integers(0, 1 << 63, 500, np.uint64)]))
    table = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    found = simhash.links(table, 4)
    assert found.rdd.getNumPartitions() > 10
    pairs = [(r["a"], r["b"]) for r in found.collect()]
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    want = [(int(points[i].view(np.int64)), int(points[j].view(np.int64))) for i, j in zip(*np.nonzero(close)) if i < j]
    ids = [int(p) for p in points.view(np.int64)]
    assert groups(ids, pairs) == groups(ids, want) and len(want) > 250
    held = np.bitwise_count(np.array([a for a, _ in pairs]).view(np.uint64) ^ np.array([b for _, b in pairs]).view(np.uint64))
    assert held.max() <= 8  # links go to a member that the pairs join, through one other at most


def test_repeated_rows_give_each_place_once(spark):
    text = " ".join(f"w{n % 50}" for n in range(120))
    rows = spark.createDataFrame([(1, text)] + [(2, text + " end")] * 50 + [(None, text)] * 20, "doc_id long, text string").repartition(6)
    marked = substring.mark(rows, 13).where("doc_id = 2").collect()
    assert len(marked) == 50 and all(len(r["runs"]) == len({tuple(x) for x in r["runs"]}) <= 120 for r in marked)
    found = substring.remove_repeated(rows, 13).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in found) == [("1", 0)] + [("2", 120)] * 50 + [("None", 120)] * 20


def test_one_row_of_equal_documents_stays(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "y"), (2, "a b c d e", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = [simhash.keep_one(docs.repartition(n)).collect() for n in (1, 3)]
    assert first[0] == first[1] and len(first[0]) == 1 and first[0][0]["doc_id"] == 1


@pytest.mark.parametrize("dims", [1, 2, 3, 8, 40])
def test_blocks_of_any_density(dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(70, dims))
    vectors = np.concatenate([base, base * 3, base + rng.normal(size=base.shape) * 0.2])
    for some in (vectors, np.concatenate([vectors, np.ones((150, dims)) + rng.normal(size=(150, dims)) * 0.05])):
        tile = embedding_dedup.Tile(some, embedding_dedup.principal_axes(embedding_dedup.unit(some)))
        cosine = np.array([[float(np.dot(a, b)) for b in tile.unit[20:200]] for a in tile.unit])
        found = embedding_dedup.linked(tile, tile, slice(0, len(some)), slice(20, 200), 0.9)
        sure = np.abs(cosine - 0.9) > 1e-12
        assert (found == (cosine >= 0.9))[sure].all()


def test_first_by_hash_hands_over_few_rows(spark):
    rows = spark.range(0, 60_000, 1, 16).withColumn("more", F.col("id") * 2)
    whole = rows.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(500).collect()
    drawn = first_by_hash(rows, ["id"], 60_000, 500)
    assert drawn.collect() == whole
    filters = [line for line in drawn._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert filters  # most rows are left out before the limit
    assert first_by_hash(rows.limit(30), ["id"], 30, 500).count() == 30
    assert first_by_hash(rows.limit(0), ["id"], 0, 500).count() == 0
