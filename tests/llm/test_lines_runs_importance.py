"""Line dedup, periodic runs and importance resampling against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimspark.llm import importance, line_dedup, periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 20_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{name} int" for name in "line line_a line_b hot cold pos key dropped lines row_a row_b places range copy rank score weight runs drawn_id".split()
)


def frame(spark, rows):
    return spark.createDataFrame([(*row, "en", None, None, *range(19)) for row in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "Common\nown line\n"), (2, " common \t\nother"), (2, " common \t\nother"), (3, "COMMON"), (4, None), (5, ""), (None, "common\nno id"),
        (None, None), (6, LONG), (7, "\n\n\ncömmon\ncÖmmon\n\x1ccommon "), (8, "common\ncommon\ncommon"), (9, " ".join(["ha"] * 40)),
    ]
    return frame(spark, rows)


# ---- lines


def plain_lines(rows, documents, min_chars):
    """[(doc_id, n_lines, n_dropped, kept)] by a dictionary of keys."""
    def key(line):
        bare = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in bare)

    found = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            found[key(line)].add(doc)
    gone = {k for k, docs in found.items() if len(k) >= min_chars and len(docs) >= documents}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in gone]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("documents, min_chars", [(2, 1), (3, 1), (4, 0), (2, 7), (50, 1)])
def test_lines_against_a_dictionary(spark, documents, min_chars):
    rng = random.Random(documents)
    pool = ["a b", " A B", "Hello World", "hello world\t", "é", "É", "", " ", "\x0b", "x" * 50, "中文 Text", "中文 text"]
    rows = []
    for n in range(150):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"line {rng.randint(0, 200)}" for _ in range(rng.randint(0, 12))]
        rows.append((rng.randint(0, 99) if n % 9 else None, "\n".join(lines) if n % 11 else None))
    rows += [(1000 + n, "a third of all rows\nshare this") for n in range(80)]
    rows += [(5000, "the very same row\nagain and again")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = line_dedup.drop_common_lines(docs, documents, min_chars).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_lines(rows, documents, min_chars)


def test_lines_of_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    found = line_dedup.drop_common_lines(odd, 3).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_lines(rows, 3, 1)
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by[3]["kept_text"] == "" and by[8]["n_dropped"] == 3 and by[4]["n_lines"] == by[5]["n_lines"] == 1
    assert by[7]["n_dropped"] == 0 and by[6]["kept_text"] == LONG
    assert line_dedup.drop_common_lines(odd.limit(0), 3).collect() == []


def test_lines_run_without_python_and_without_cross_joins(spark, odd):
    plan = line_dedup.drop_common_lines(odd, 3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_only_lines_that_hold_much_are_broadcast(spark, monkeypatch):
    """With every common line looked up by the join, and with all by broadcast, results are the same."""
    rows = [(n, f"common {n % 7}\nown {n}\nall") for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for hot in (1, 8192):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        results.append(sorted(tuple(r) for r in line_dedup.drop_common_lines(docs, 5).collect()))
    assert results[0] == results[1] == sorted(plain_lines(rows, 5, 1))


# ---- runs


def plain_runs(words, least_words=24, least_periods=3):
    """All periods by comparing each word with that a period later."""
    number, found = len(words), {}
    for period in range(1, number // least_periods + 1):
        at = 0
        while at < number - period:
            if words[at] != words[at + period]:
                at += 1
                continue
            end = at
            while end < number - period and words[end] == words[end + period]:
                end += 1
            length = end - at + period
            if length >= max(least_words, least_periods * period):
                found.setdefault((at, length), period)  # the smallest comes first
            at = end
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda run: (run[0], run[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.integers(1, 12), st.integers(2, 4))
def test_runs_of_few_words(words, least_words, least_periods):
    assert periodic.find_runs(words, least_words, least_periods) == plain_runs(words, least_words, least_periods)


def test_runs_in_runs():
    rng = random.Random(1)
    for _ in range(300):
        words = []
        for _ in range(rng.randint(1, 4)):
            part = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
            part = (part * rng.randint(1, 12))[: rng.randint(1, 80)]
            words += (part + [rng.choice("abcdxyz") for _ in range(rng.randint(0, 3))]) * rng.randint(1, 4)
        words = [w.encode() for w in words]
        assert periodic.find_runs(words) == plain_runs(words)


def test_long_runs_take_little_more_than_their_words():
    words = [b"a", b"b"] * 100_000 + [b"x"] + [b"a"] * 100_000
    assert periodic.find_runs(words) == [(0, 200_000, 2), (200_001, 100_000, 1)]


def test_collapsed_texts_of_odd_rows(spark, odd):
    found = periodic.collapse_runs(odd).collect()
    assert len(found) == 12
    for r in found:
        words = WORD.findall({1: "Common\nown line\n", 6: LONG, 9: " ".join(["ha"] * 40)}.get(r["doc_id"], ""))
        if words:
            runs = plain_runs(words) if r["doc_id"] != 6 else [(0, 100_000, 5)]
            assert [tuple(run) for run in r["runs"]] == runs and r["n_words"] == len(words)
            gone = {i for s, n, p in runs for i in range(s + p, s + n)}
            assert r["collapsed_text"] == " ".join(w for i, w in enumerate(words) if i not in gone) and r["n_dropped"] == len(gone)
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by[9]["collapsed_text"] == "ha" and by[6]["collapsed_text"] == "lorem ipsum dolor sit amet"
    assert all(by[i]["n_words"] == 0 and by[i]["runs"] == [] and by[i]["collapsed_text"] == "" for i in (4, 5))
    assert periodic.collapse_runs(odd.limit(0)).collect() == []


def test_runs_query_against_a_plain_version(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 150)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (None, "a " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    planted = 0
    for doc, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, r = plain_runs(words), found[doc]
        best = min(runs, key=lambda run: (-run[1] / run[2], run[0], run[2]), default=(None, None, None))
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert planted > 5


# ---- importance


def plain_features(text, longest, buckets):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(run.encode()) % buckets for run in runs]


def plain_draw(rows, target, percent, least_words, longest, buckets, seed):
    own = [plain_features(t, longest, buckets) for _, t in rows]
    held, wanted = Counter(b for _, f in own for b in f), Counter(b for t in target for b in plain_features(t, longest, buckets)[1])
    every, all_wanted = sum(held.values()) + buckets, sum(wanted.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * every / ((held[b] + 1) * all_wanted)))
    scored = []
    for at, ((doc, _), (words, found)) in enumerate(zip(rows, own)):
        weight = math.floor(sum(map(gain, found)) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        scored.append((at, doc, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((s for s in scored if s[2] >= least_words), key=lambda s: (-s[5], s[1] is None, s[1] or 0))
    rank = {s[0]: n + 1 for n, s in enumerate(able[: percent * len(able) // 100])}
    return sorted(((doc, n, w, s, rank.get(at)) for at, doc, _, n, w, s in scored), key=str)


@pytest.mark.parametrize("percent, least_words, longest, buckets", [(25, 20, 2, 10_000), (100, 0, 1, 50), (40, 5, 3, 997)])
def test_draw_against_a_plain_version(spark, monkeypatch, percent, least_words, longest, buckets):
    monkeypatch.setattr(importance, "PIECE", 40)
    rng = random.Random(percent)
    pool = ["Naïve", "中文", "abc", "A-B", "x1", "don't", "_", "Zeta", "q" * 30] + [f"w{n}" for n in range(40)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(7, "the same row many times over " * 5)] * 60 + [(None, "no id " * 12), (200, None), (201, ""), (202, "\x00 \x7f ,"), (203, LONG)]
    target = [" ".join(rng.choice(pool[:9]) for _ in range(30)) for _ in range(5)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resample(docs, wanted, percent, least_words, longest, buckets).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_draw(rows, target, percent, least_words, longest, buckets, 7)


def test_draw_of_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    for target in (["common line"], []):
        wanted = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
        found = importance.resample(odd, wanted, 50, 1)
        assert sorted((tuple(r) for r in found.collect()), key=str) == plain_draw(rows, target, 50, 1, 2, 10_000, 7)
        ranks = sorted(r["rank"] for r in found.collect() if r["rank"])
        assert ranks == list(range(1, len(ranks) + 1))
    whole = importance.drawn_documents(odd, wanted, percent=50, least_words=1)
    assert whole.columns == odd.columns and 0 < whole.count() < odd.count()
    assert importance.resample(odd.limit(0), wanted).collect() == []
