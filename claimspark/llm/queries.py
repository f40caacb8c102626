"""The registered queries of the operators here, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import (
    chat,
    embedding_dedup,
    importance,
    line_dedup,
    mixing,
    packing,
    periodic,
    quality,
    secret_scan,
    sharding,
    simhash,
    substring,
    topk,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Rows that Python workers are sent at a time: texts are a few kilobytes, some a hundred.
ROWS_SENT = 2_000


def prepare(spark: SparkSession) -> None:
    """Small batches for Python workers, and this library on their import path.

    Workers that have its files at the same place (one machine, a shared folder) need no
    more; elsewhere the library is installed or given with ``--py-files``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_SENT)
    folder = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if folder not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, folder])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query

    return add


@register("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.classify(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@register("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


@register("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), 4, 4)


OWN_WORDS = r"\### Assistant: </turn> ok"


@register(
    "op8_chat",
    r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
    SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') AS escaped,
           replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS said
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(said) + length(escaped) + 14) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    item = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))
    stored = rows.groupBy("conv_id").agg(F.transform(said, item).alias("messages"))
    words = F.lit(OWN_WORDS)
    own = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), words.alias("prompt"), words.alias("response"))
    records = stored.unionByName(own, allowMissingColumns=True)
    formatted = chat.format_turns(chat.canonical_turns(records, "conv_id"))
    back = formatted.select(
        "id", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").alias("chars"),
    )
    flat = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(flat, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )


def _named(spans) -> "F.Column":
    shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")


@register("op9_secrets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secret_scan.BASE],
        F.sha2(_named(base), 256).alias("base_sha256"),
        _named(F.col("spans")).alias("spans"),
    )


@register("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


@register(
    "op2_embedding_dedup",
    """
WITH RECURSIVE good AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (
    SELECT vec_id AS node, vec_id AS other FROM embeddings
    UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.node = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


@register(
    "op3_topk",
    """
WITH scaled AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
placed AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@register(
    "op4_mixing",
    r"""
WITH docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS tokens,
           coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name FROM documents),
sources AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS held FROM docs GROUP BY source),
facts AS (SELECT min(held) AS low, max(held) AS high FROM sources),
-- the repetition limit of 2 has a closed form: (high / low) ^ (1 - a) = 2
exponent AS (SELECT CASE WHEN high <= 2 * low THEN 0 ELSE ceil((1 - ln(2) / ln(high / low)) * 1e6 - 1e-3) / 1e6 END AS a, high FROM facts),
budgets AS (SELECT source, held, greatest(CAST(round(exp(a * ln(held) + (1 - a) * ln(high))) AS BIGINT), held) AS budget FROM sources, exponent),
blocks AS (SELECT CAST(greatest(1, ceil(sum(budget) / 1048576)) AS HUGEINT) AS blocks FROM budgets),
copies AS (
    SELECT d.*, b.held, b.budget, CAST(e.epoch AS INTEGER) AS epoch, md5('mix:' || e.epoch || ':' || d.name) AS place
    FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source,
         LATERAL (SELECT unnest(range(CAST(ceil(b.budget / b.held) AS BIGINT))) AS epoch) e),
placed AS (
    SELECT *, epoch * held + coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY place
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM copies)
SELECT doc_id, source, tokens, epoch, CAST((start * blocks) // budget AS BIGINT) AS block, CAST(start AS BIGINT) AS start
FROM placed, blocks WHERE start < budget
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.schedule(table(spark, sf_dir, "documents"), repetition=2.0)
    return planned.drop("row_a", "row_b")


@register(
    "op6_substring",
    r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
begins AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM words),
wins AS (SELECT doc_id, pos, array_to_string(w[pos : pos + 12], ' ') AS win FROM begins),
judged AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY win) AS first FROM wins),
gone AS (SELECT DISTINCT doc_id, pos + k AS place FROM judged, range(13) r(k) WHERE first < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM words),
kept AS (
    SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.place) FILTER (g.place IS NULL) AS kept, count(g.place) AS n_removed
    FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.place = g.place GROUP BY e.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeated(table(spark, sf_dir, "documents"), 13)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The 256 remainders that a CRC-32 is made from, as SQL.
CRC_TABLE = """(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc)"""


@register(
    "op11_importance",
    r"""
WITH table_ AS MATERIALIZED """ + CRC_TABLE + r""",
texts AS (SELECT doc_id AS id, false AS wanted, text FROM documents UNION ALL SELECT NULL, true, text FROM benchmark),
words AS (
    SELECT row_number() OVER () AS row, id, wanted, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
    SELECT row, wanted, unnest(w) AS gram FROM words
    UNION ALL SELECT row, wanted, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
counted AS (SELECT row, wanted, gram, count(*) AS n FROM grams GROUP BY ALL),
hexes AS (SELECT gram, hex(encode(gram)) AS x FROM (SELECT DISTINCT gram FROM counted)),
bytes AS (SELECT gram, list_transform(range(0, len(x), 2), lambda k: CAST('0x' || x[k + 1 : k + 2] AS BIGINT)) AS b FROM hexes),
buckets AS (
    SELECT gram, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, y: xor(crc[(xor(c, y) & 255) + 1], c >> 8))) % 10000 AS bucket
    FROM bytes, table_),
placed AS (SELECT row, wanted, bucket, sum(n) AS n FROM counted JOIN buckets USING (gram) GROUP BY ALL),
sums AS (
    SELECT bucket, CAST(coalesce(sum(n) FILTER (NOT wanted), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (wanted), 0) AS DOUBLE) AS t
    FROM placed GROUP BY bucket),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS BIGINT) AS gain FROM sums, totals),
means AS (
    SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
    FROM placed JOIN gains USING (bucket) GROUP BY row),
scored AS (
    SELECT id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM words LEFT JOIN means USING (row) WHERE NOT wanted),
drawn AS (
    SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS place,
           count(*) FILTER (words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank FROM drawn
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register(
    "op12_line_dedup",
    r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON c.key = k.key GROUP BY doc_id
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"), 10, 1)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as op13 reads them: the end of every tenth text, by a hash, is made periodic."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # an array for the chosen texts only, so that the others are not cut into words here
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    cut = cut.withColumn("n", F.size("words")).withColumn("a", (F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
    left = F.col("n") - F.col("a")
    cut = cut.withColumn("p", (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil(left / F.col("p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    made = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


@register(
    "op13_periodic_runs",
    r"""
WITH table_ AS MATERIALIZED """ + CRC_TABLE + r""",
hashed AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
               lambda c, y: xor(crc[(xor(c, y) & 255) + 1], c >> 8))) AS h FROM documents, table_),
sized AS (SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS made FROM hashed),
begun AS (SELECT *, CASE WHEN made THEN g % n ELSE n END AS a FROM sized),
timed AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM begun),
spread AS (
    SELECT doc_id, unnest(range(n)) AS i, unnest(list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END])) AS word
    FROM timed),
sixteen AS (
    SELECT doc_id, i, string_agg(word, ' ') OVER next AS gram, count(*) OVER next AS held FROM spread
    WINDOW next AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
grams AS (SELECT doc_id, i, gram FROM sixteen WHERE held = 16),
-- 24 words or more, three periods or more: the first 16 words stand again a period later
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS d FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, d AS period, min(i) AS start, count(*) + 15 + d AS length FROM islands GROUP BY doc_id, d, island),
runs AS (
    SELECT doc_id, start, length, min(period) AS period FROM stretches
    WHERE length >= 24 AND length >= 3 * period GROUP BY doc_id, start, length),
told AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said
    FROM runs GROUP BY doc_id),
best AS (
    SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
    SELECT s.doc_id, string_agg(word, ' ' ORDER BY s.i) AS kept FROM spread s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.i = s.i
    WHERE g.i IS NULL GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(with_planted_runs(table(spark, sf_dir, "documents")), 24, 3)
    # runs come by start and period, so the first of those with the greatest exponent stays
    longer = lambda best, run: run["length"] * best["period"] > best["length"] * run["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, run: F.when(longer(best, run), run).otherwise(best))
    line = lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))
    told = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
    return told.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )
