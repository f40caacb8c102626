"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``documents``.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables
and further columns with any names; those that return documents keep the columns, their order
and their types. An empty table gives an empty result. What else a case means is said at the
stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimspark.functions.scratch import materialise
from claimspark.llm import mixing, packing, quality, secret_scan, simhash
from claimspark.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL for the rows of ``run``: none, as compression and tokenizers are not in SQL.
ORACLE_SQL: str | None = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, unchanged.

    Only the text decides: a null text like an empty one, equal texts alike, long texts whole.
    Labels of documents that are not there, held-out ones and labels other than 0 and 1 teach
    nothing; without labels of both classes all documents score alike.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    # other columns go by number meanwhile, so that none is taken for the classifier's
    numbered = [name if name == "text" else f"column_{n}" for n, name in enumerate(docs.columns)]
    kept = quality.classify(docs.toDF(*numbered), model).where("predicted = 1")
    return kept.select(*numbered).toDF(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Texts without words (null, empty, white space) are one group. A null doc_id is the
    largest; between rows that share a doc_id the smaller hash of the text, then of all
    columns, decides, and of equal rows one stays.
    """
    return simhash.keep_one(docs, 4, 4)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced and ``n_chars`` follows.

    Texts without secrets, null and empty ones among them, and their ``n_chars`` stay as they
    are. Long texts are searched whole. Repeated rows stay repeated.
    """
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; those of small sources are repeated, at most twice, towards the target weights.

    Rows come in blocks that each hold the weights. A null source is a source; null and empty
    texts weigh one token; equal rows are documents each; ties in the order of a permutation
    (rows that share a doc_id) go by hashes of the row.
    """
    return mixing.mix(docs, repetition=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place.

    A null or empty text is one piece, its closing id; a long text is cut into pieces that
    fill a sequence each. Equal rows are packed each, and which of equal lengths goes where
    does not matter. Only doc_id and text are read.
    """
    return packing.pack(docs, tokenizer_path(), 2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them tables in the scratch folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
