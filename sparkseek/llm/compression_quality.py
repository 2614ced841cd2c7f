"""Text quality from how well a text compresses with what good and bad texts have taught.

Two zstandard dictionaries are trained, one from good labelled texts and one from bad ones. A text, cut into blocks, is
compressed with each; the difference of its two compressed sizes over their sum says which kind it resembles, and the
smaller size over the text's own how much it repeats itself. A logistic curve over the two, fitted on labelled texts that
went into neither dictionary, makes a probability, with the prior of all labelled rows.

Bounds, all parameters: `per_class` sampled documents of either class (those with the smallest hash of their doc_id),
`per_dictionary` blocks of either class (those with the smallest hash; equal blocks count once), `dictionary_bytes` for a
dictionary. Statistics of labels, and scores, cover everything; texts are scored whole.

Defined results: null and empty texts get the prior; labels that are null, or whose document is missing, teach nothing;
a document with several labels counts as good if one says so; of rows that share a doc_id each is read; without labels
of both classes every score is the share of good labels (a half without any label). Extra columns pass through; inputs of
a score are the characters of the text alone.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .arrow import with_columns

#: Bytes of a text that are compressed at a time.
BLOCK = 1 << 10


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[bytes, bytes] | None  # of bad and of good texts
    level: int
    weights: tuple[float, float]
    centre: float  # usual logarithm of compressed over own size
    odds: float  # of the prior
    bias: float = 0.0

    def probability(self, features: np.ndarray) -> np.ndarray:
        """Of rows (difference, logarithm); those of texts without bytes are not numbers."""
        z = self.odds + np.where(np.isnan(features[:, 0]), 0.0, self.bias + (features - [0.0, self.centre]) @ np.array(self.weights))
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-z))


def blocks_of(text: str | None) -> list[bytes]:
    data = text.encode() if text else b""
    return [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]


class Sizes:
    """Compresses with both dictionaries; made once per task."""

    def __init__(self, dictionaries: tuple[bytes, bytes], level: int):
        self.both = []
        for data in dictionaries:
            ready = zstandard.ZstdCompressionDict(data)
            ready.precompute_compress(level=level)
            self.both.append(zstandard.ZstdCompressor(dict_data=ready, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: str | None) -> tuple[float, float]:
        """Difference of the sizes over their sum, higher for texts like the good ones; logarithm of the smaller over the text's."""
        parts = blocks_of(text)
        if not parts:
            return float("nan"), float("nan")
        bad, good = (sum(len(one.compress(part)) for part in parts) for one in self.both)
        return (bad - good) / (bad + good), float(np.log(min(bad, good) / sum(map(len, parts))))


def _trained(samples: list[bytes], size: int, level: int) -> bytes:
    """A dictionary from samples; too few or too uniform ones are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of the columns of x by Newton's steps, both classes weighing the same, with a weak pull to 0."""
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share * (p - y)) + 1e-5 * weights
        bend = (x.T * (share * p * (1 - p))) @ x + 1e-5 * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        largest = np.abs(step).max()
        weights = weights - step * min(1.0, 5 / max(largest, 1e-9))
        if largest < 1e-9:
            break
    return weights


def _blocks(batches):
    for batch in batches:
        for good, text in zip(batch.column("good").to_pylist(), batch.column("text").to_pylist(), strict=True):
            parts = [part for part in blocks_of(text) if len(part) >= 8]
            yield pa.RecordBatch.from_arrays([pa.array([good] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["good", "part"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, per_dictionary: int = 4000, dictionary_bytes: int = 64 << 10, level: int = 3) -> Model:
    """A model from labels (doc_id, quality) of some of the documents (doc_id, text)."""
    ship(docs.sparkSession)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).dropna().filter("good IN (0, 1)")
    prior = {row.good: row["count"] for row in labels.groupBy("good").count().collect()}
    share = prior.get(1, 0) / sum(prior.values()) if prior else 0.5
    with np.errstate(divide="ignore"):
        odds = float(np.log(share) - np.log(1 - share))
    plain = Model(None, level, (0.0, 0.0), 0.0, odds)
    if len(prior) < 2:
        return plain
    order = F.xxhash64("doc_id", F.lit(11))
    sample = [labels.filter(F.col("good") == good).orderBy(order, "doc_id").limit(per_class) for good in (0, 1)]
    # At most 2 * per_class rows; two documents in three teach the dictionaries, the others the curve.
    chosen = F.broadcast(sample[0].unionByName(sample[1]).groupBy("doc_id").agg(F.max("good").alias("good")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    teaches = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) > 0
    parts = rows.filter(teaches).select("good", "text").mapInArrow(_blocks, "good int, part binary").distinct()
    texts = []
    for good in (0, 1):
        best = parts.filter(F.col("good") == good).orderBy(F.xxhash64("part"), "part").limit(per_dictionary)
        texts.append([bytes(row.part) for row in best.select("part").collect()])
    if not all(texts):
        return plain
    dictionaries = tuple(_trained(own, dictionary_bytes, level) for own in texts)
    data = _with_features(rows.filter(~teaches), replace(plain, dictionaries=dictionaries), "text", "found").select("good", "found").toPandas()
    features, good = np.array(data["found"].tolist(), dtype=np.float64).reshape(-1, 2), data["good"].to_numpy()
    features, good = features[~np.isnan(features[:, 0])], good[~np.isnan(features[:, 0])]
    if len(set(good.tolist())) < 2:
        return plain
    centre = float(features[:, 1].mean())
    weights = _logistic(np.column_stack([features - [0.0, centre], np.ones(len(features))]), good)
    return Model(dictionaries, level, (float(weights[0]), float(weights[1])), centre, odds, float(weights[2]))


def _with_features(docs: DataFrame, model: Model, text: str, added: str, probability: bool = False) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        model = shared.value
        sizes = Sizes(model.dictionaries, model.level) if model.dictionaries else None

        def run(texts: list) -> list[pa.Array]:
            found = np.array([sizes.features(one) if sizes else (np.nan, np.nan) for one in texts], dtype=np.float64).reshape(-1, 2)
            return [pa.array(model.probability(found), pa.float64()) if probability else pa.array(list(found), pa.list_(pa.float64()))]

        return run

    return with_columns(docs, text, f"`{added}` {'double' if probability else 'array<double>'}", prepare)


def score(docs: DataFrame, model: Model, text: str = "text", added: str = "score") -> DataFrame:
    """The frame with the probability that a text is good."""
    ship(docs.sparkSession)
    return _with_features(docs, model, text, added, probability=True)


def held_out(doc_id: Column) -> Column:
    """One fourth of the documents, whose labels are for evaluation only."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
