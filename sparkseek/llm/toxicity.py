"""Toxicity scores from a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Character n-grams of the lower-cased text are hashed into a fixed number of features. Spark counts, for a bounded sample of
labelled documents, in how many of each class a feature occurs; the log ratio of the smoothed counts scales the feature.
The features that tell most are kept and a logistic regression is fitted on the scaled counts, each document divided by
the norm of its scaled features. What it learned folds into one weight per feature, so scoring is a table lookup per
n-gram, and the table, of fixed size, is broadcast. The prior of the score is that of all labelled rows given.

Bounds, all parameters: `per_class` sampled documents of either class (those with the smallest hash of their doc_id),
`1 << BITS` hashed features, `features` of them kept. Whole texts are read, in training and in scoring.

Defined results: null and empty texts, and texts shorter than an n-gram, get the prior alone; labels that are null, or
whose document is missing, teach nothing; of repeated doc_ids in the sample one row is used; without labels of both
classes every score is the share of toxic labels (a half without any label). Extra columns pass through; inputs of a score
are the characters of the text alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import release
from ..shipping import ship
from .arrow import with_columns

BITS = 18
SIZES = (3, 4, 5)


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # of each hashed feature; 0 for those not kept
    weight: np.ndarray  # the learned weight times the ratio
    bias: float


def n_grams(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text, with repeats."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    hashed, out = codes * np.uint32(0x9E3779B1), []
    for size in range(2, max(SIZES) + 1):
        if len(codes) < size:
            break
        hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[size - 1 :] * np.uint32(0xC2B2AE35)
        if size in SIZES:
            out.append((hashed ^ (hashed >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def _presence(batches):
    """For each feature, the numbers of toxic and of clean documents of the batches that have it."""
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic, np.unique(n_grams(text))] += 1
    found = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[1, found]), pa.array(counts[0, found])], names=["feature", "toxic", "clean"])


def _scaled(kept: np.ndarray):
    """The kept features of each document, by their place among the kept, and their counts."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                own, count = np.unique(n_grams(text), return_counts=True)
                place = np.searchsorted(kept, own)
                here = (place < len(kept)) & (kept[np.minimum(place, len(kept) - 1)] == own)
                rows.append((place[here].astype(np.int32).tobytes(), count[here].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                names=["toxic", "places", "counts"],
            )

    return run


#: Entries of the training data that are computed on at a time; bounds what the driver holds besides the data.
_FIT_ENTRIES = 500_000


def _blocks(size: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of neighbouring documents of about _FIT_ENTRIES entries, one document at least."""
    ranges, start, held = [], 0, 0
    for row, n in enumerate(size.tolist()):
        if held and held + n > _FIT_ENTRIES:
            ranges.append((start, row))
            start, held = row, 0
        held += n
    return [*ranges, (start, len(size))]


def _fit(place: np.ndarray, count: np.ndarray, size: np.ndarray, ratio: np.ndarray, toxic: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over all rows at once, both classes weighing the same.

    The data are the places and counts of all documents, one after the other, `size` of each; values are computed block by
    block, so that besides the data only one block of them is held.
    """
    width, edges, blocks = len(ratio), np.concatenate([[0], np.cumsum(size)]), _blocks(size)

    def of_block(start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = slice(edges[start], edges[end])
        return np.repeat(np.arange(end - start), size[start:end]), place[own], count[own] * ratio[place[own]]

    norm = np.empty(len(toxic))
    for start, end in blocks:
        row, at, value = of_block(start, end)
        norm[start:end] = np.sqrt(1 + np.bincount(row, weights=value * ratio[at], minlength=end - start))
    share = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
    w, bias = np.zeros(width), 0.0
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        slope = np.append(penalty * w, 0.0)
        for start, end in blocks:
            row, at, value = of_block(start, end)
            z = np.bincount(row, weights=value * w[at], minlength=end - start) / norm[start:end] + bias
            error = (1 / (1 + np.exp(-z)) - toxic[start:end]) * share[start:end]
            slope[:-1] += np.bincount(at, weights=value * (error / norm[start:end])[row], minlength=width)
            slope[-1] += error.sum()
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return w, bias


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, features: int = 20_000, smoothing: float = 1.0,
          rounds: int = 80, penalty: float = 1e-4) -> Model:
    """A model from labels (doc_id, toxic) of some of the documents (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter("toxic IN (0, 1)")
    prior = {row.toxic: row["count"] for row in labels.groupBy("toxic").count().collect()}
    empty = np.zeros(1 << BITS)
    if len(prior) < 2:
        return Model(empty, empty, float("inf") if prior.get(1) else -float("inf") if prior else 0.0)
    order = F.xxhash64("doc_id")
    sample = [labels.filter(F.col("toxic") == toxic).orderBy(order, "doc_id").limit(per_class) for toxic in (0, 1)]
    # At most 2 * per_class rows.
    chosen = F.broadcast(sample[0].unionByName(sample[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    counts = rows.select("text", "toxic").mapInArrow(_presence, "feature long, toxic long, clean long")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    of_class = rows.groupBy("toxic").count().collect()
    in_sample = {row.toxic: row["count"] for row in of_class}
    if len(in_sample) < 2:
        return Model(empty, empty, float(np.log(prior[1] / prior[0])))
    share = lambda name, total: (F.col(name) + smoothing) / (total + 2 * smoothing)
    ratio = F.log(share("toxic", in_sample[1]) / share("clean", in_sample[0]))
    telling = F.abs(F.col("ratio")) * F.sqrt(F.col("toxic") + F.col("clean"))
    best = counts.withColumn("ratio", ratio).orderBy(telling.desc(), "feature").limit(features).select("feature", "ratio").toPandas()
    best = best.sort_values("feature")
    kept, ratio_of = best["feature"].to_numpy(), best["ratio"].to_numpy()
    data = rows.select("text", "toxic").mapInArrow(_scaled(kept), "toxic int, places binary, counts binary").toPandas()
    size = np.array([len(p) // 4 for p in data["places"]])
    place = np.frombuffer(b"".join(data["places"]), dtype=np.int32)
    count = np.frombuffer(b"".join(data["counts"]), dtype=np.int32)
    toxic = data["toxic"].to_numpy()
    del data
    release()
    w, bias = _fit(place, count, size, ratio_of, toxic, rounds, penalty)
    del place, count
    release()
    ratios, weights = np.zeros(1 << BITS), np.zeros(1 << BITS)
    ratios[kept], weights[kept] = ratio_of, w * ratio_of
    return Model(ratios, weights, float(bias + np.log(prior[1] / prior[0])))


def score(docs: DataFrame, model: Model, text: str = "text", added: str = "score") -> DataFrame:
    """The frame with the probability that a text is toxic."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.weight.astype(np.float32), (model.ratio**2).astype(np.float32), model.bias))

    def run(texts: list) -> list[pa.Array]:
        weight, square, bias = shared.value
        z = []
        for one in texts:
            own = n_grams(one)
            z.append(bias + float(weight[own].sum(dtype=np.float64)) / float(np.sqrt(1 + square[own].sum(dtype=np.float64))))
        with np.errstate(over="ignore"):
            return [pa.array(1 / (1 + np.exp(-np.array(z, dtype=np.float64))), pa.float64())]

    return with_columns(docs, text, f"`{added}` double", lambda: run)


def held_out(doc_id: Column) -> Column:
    """One fifth of the documents, whose labels are for evaluation only."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
