"""Quality of texts from how well dictionaries of good and of bad text compress them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.batches import as_bytes, free_names, slices

#: Labelled texts of each class for the dictionaries and for calibration, samples of a class
#: for its dictionary, their bytes, bytes of a dictionary, compression level, held-out share's divisor.
PER_CLASS, SAMPLES, SAMPLE, DICTIONARY, LEVEL, FOLDS = 2000, 8000, 4096, 112_640, 3, 5
REJECT_BELOW = 0.3


def held_out() -> "F.Column":
    """Whether a document's label is kept for checking: crc32 of its id as text leaves no remainder."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Two dictionaries and a logistic calibration; a few hundred kilobytes, whatever the corpus."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]


class _Sizes:
    """Compressed sizes of a text with the good, the bad and no dictionary."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        dictionaries = [zstandard.ZstdCompressionDict(d) if d else None for d in (good, bad)]
        self.compressors = [zstandard.ZstdCompressor(dict_data=d, **plain) for d in (*dictionaries, None)]

    def features(self, data: bytes) -> tuple[float, ...]:
        """The normalised difference and its square, the text's length and its plain ratio."""
        good, bad, plain = (len(c.compress(data)) for c in self.compressors)
        difference = (bad - good) / (plain + 1)
        return difference, difference * difference, float(np.log1p(len(data))), plain / (len(data) + 20)


@cache
def _sizes(good: bytes, bad: bytes) -> _Sizes:
    return _Sizes(good, bad)


def _features(docs: DataFrame, good: bytes, bad: bytes, kept: list[str]) -> tuple[DataFrame, list[str]]:
    """``kept`` columns and the features of each whole text, and the features' names."""
    names = free_names(kept, "f0", "f1", "f2", "f3")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)

    def work(batches) -> Iterator[pa.RecordBatch]:
        sizes = _sizes(good, bad)
        for batch in slices(batches, "text"):
            rows = np.array([sizes.features(data) for data in as_bytes(batch.column("text"))]).reshape(-1, 4)
            columns = [batch.column(name) for name in kept] + [pa.array(rows[:, n].copy()) for n in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    schema = ", ".join([types, *(f"{name} double" for name in names)])
    return docs.select(*[F.col(f"`{name}`") for name in kept], F.col("text")).mapInArrow(work, schema), names


def _logistic(features: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the constant last), means and scales, by damped Newton steps with a small penalty."""
    mean, scale = features.mean(0), features.std(0) + 1e-6
    x = np.column_stack([(features - mean) / scale, np.ones(len(features))])
    weights = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - labels @ z + 5e-3 * w @ w)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
        slope = x.T @ (p - labels) + 1e-2 * weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(weights)), slope)
        rate = 1.0
        while rate > 1e-6 and loss(weights - rate * step) > loss(weights):
            rate /= 2
        weights = weights - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return weights, mean, scale


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, samples: int = SAMPLES) -> Model:
    """A model from at most ``2 * per_class`` labelled texts of each class, held-out ones never among them.

    Rows are taken in the order of a hash of doc_id. Of each class, ``per_class`` are cut into
    samples of 4 KB that cover them from end to end, and the first ``samples`` of all these by
    a hash make the dictionary, so that every part of a text is as likely in it. As many
    others, whole, calibrate, so that no text is scored by a dictionary that holds it.
    Labels other than 0 and 1 (null too) and texts without bytes are passed over; rows
    of ``labels`` that repeat a doc_id count once, with the larger label. Without labels
    of both classes the score is the share of label 1 among those there are, or 0.5.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.where(~held_out() & F.col("doc_id").isNotNull())
    known = known.withColumn("order", F.xxhash64("doc_id", F.lit("quality")))
    # per class: a top-k by hash, of ids only; then the few texts
    picked = None
    for label in (0, 1):
        some = known.where(F.col("quality") == label).orderBy("order", "doc_id").limit(2 * per_class)
        picked = some if picked is None else picked.unionByName(some)
    rows = picked.collect()
    if not rows:
        return Model(b"", b"", (0.0,) * 4 + (0.0,), (0.0,) * 4, (1.0,) * 4)
    chosen = docs.sparkSession.createDataFrame(
        [(r["doc_id"], r["quality"], r["order"], place % 2) for label in (0, 1)
         for place, r in enumerate(r for r in rows if r["quality"] == label)],
        "doc_id long, quality int, `order` long, half int",
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") > 0)
    texts = texts.join(F.broadcast(chosen), "doc_id")  # at most 4 * per_class rows of four numbers
    places = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / SAMPLE).cast("int"))
    parts = texts.where("half = 0").select("quality", "order", F.col("text").cast("binary").alias("text"), F.explode(places).alias("at"))
    cut = F.substring("text", F.col("at") * SAMPLE + 1, F.lit(SAMPLE))
    parts = parts.select("quality", cut.alias("part"), F.xxhash64("order", "at").alias("order"))
    dictionaries = []
    for label in (1, 0):
        held = parts.where(F.col("quality") == label).orderBy("order", "part").limit(samples).collect()
        dictionaries.append(_dictionary([bytes(r["part"]) for r in held]))
    features, names = _features(texts.where("half = 1"), *dictionaries, ["quality", "order"])
    measured = features.collect()
    measured.sort(key=lambda r: (r["order"], r["quality"]))
    truth = np.array([r["quality"] for r in measured], float)
    if len(set(truth)) < 2:
        ones = sum(r["quality"] for r in rows)
        share = (ones + 0.5) / (len(rows) + 1)
        return Model(*dictionaries, (0.0,) * 4 + (float(np.log(share / (1 - share))),), (0.0,) * 4, (1.0,) * 4)
    weights, mean, scale = _logistic(np.array([[r[name] for name in names] for r in measured]), truth)
    return Model(*dictionaries, tuple(weights), tuple(mean), tuple(scale))


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, from 0 to 1: the higher, the likelier the text is good.

    The whole text is compressed with either dictionary; the difference, divided by the
    size without a dictionary, is calibrated together with the text's length and plain
    ratio. Nothing but the text enters. A null text scores like an empty one, and equal
    texts score alike. A long text is compressed whole, in its row's task. There is no
    shuffle; other columns and repeated rows stay, and a column ``score`` is replaced. An
    empty table gives an empty result.
    """
    kept = [name for name in docs.columns if name != "score"]
    own = [name for name in kept if name != "text"]
    (copy,) = free_names(docs.columns, "text_kept")
    inputs = docs.withColumn(copy, F.col("text"))
    measured, names = _features(inputs, model.good, model.bad, [*own, copy])
    z = F.lit(float(model.weights[-1]))
    for n, name in enumerate(names):
        z = z + (F.col(name) - F.lit(float(model.mean[n]))) * F.lit(float(model.weights[n] / model.scale[n]))
    shown = [F.col(f"`{copy if name == 'text' else name}`").alias(name) for name in kept]
    return measured.select(*shown, (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("score"))


def classify(docs: DataFrame, model: Model, threshold: float = REJECT_BELOW) -> DataFrame:
    """``score`` and ``predicted``: 1 where the score reaches ``threshold``, else 0."""
    return score(docs.drop("predicted"), model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
