"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Tokens are words and runs of punctuation, with their case; single tokens, pairs, and up to three consecutive
tokens' ways of writing (case, digits, repetition) are hashed into BUCKETS weights, and a text's value of a feature is its count over the root of the text's number of features. A score
is a sparse dot product, so whole texts of any length are scored in one pass.

SAMPLE is the one bound: the model is fitted, in one task, on at most so many labelled rows, those with the
smallest hash of their id. Only its weights leave that task.

Defined results: null and empty text have the bias alone as their score; a null label or id is not learned
from; of several labels of one id the largest counts; without labelled rows every score is 0.5; repeated rows
score alike; columns other than doc_id and text never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from orrery.llm.session import packed, released, unpacked
from orrery.llm.textkit import TOKENS, ngrams, runs, seeded, slices, token_hashes

SAMPLE = 8_000
BUCKETS = 1 << 18
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.05, 0.05, 3
THRESHOLD = 0.3


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(folds)) == 0, F.lit(False))


def _shapes(data: np.ndarray, offsets: np.ndarray, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of how each token is written: punctuation, digits, its case, and whether it repeats the one before."""
    first, length, of = runs(data, offsets, TOKENS[0])
    kept = of != 0
    upper = np.add.reduceat(((data >= 65) & (data <= 90)).astype(np.int64), first)[kept]
    digit = (data[first[kept]] >= 48) & (data[first[kept]] <= 57)
    shape = np.select([of[kept] == 2, digit, upper == length[kept], upper > 0], [1, 2, 3, 4], 5)
    same = np.zeros(tokens.size, bool)
    same[1:] = tokens[1:] == tokens[:-1]
    same[bounds[:-1][bounds[:-1] < bounds[1:]]] = False
    return seeded(np.where(same, shape + 8, shape).astype(np.uint64), 3)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, text after text, and where each text's begin and end. Bucket 0 is the bias's."""
    tokens, bounds = token_hashes(data, offsets, TOKENS)
    count = np.diff(bounds)
    one = np.repeat(np.arange(count.size), count)
    shapes = _shapes(data, offsets, tokens, bounds) if tokens.size else tokens
    pair, of_pair = ngrams(tokens, bounds, 2)
    drawn, of_drawn = ngrams(shapes, bounds, 3)
    text = np.concatenate([one, one, of_pair, of_drawn])
    order = np.argsort(text, kind="stable")
    bucket = (np.concatenate([tokens, shapes, pair, drawn]) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    return bucket[order], np.searchsorted(text[order], np.arange(count.size + 1))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights after EPOCHS passes over the rows in their order."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for _ in range(EPOCHS):
        for buckets, y in zip(rows, labels, strict=True):
            at, times = np.unique(buckets, return_counts=True)
            x = times / np.sqrt(max(len(buckets), 1))
            at, x = np.append(at, 0), np.append(x, 1.0)
            w = _weights(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return _weights(z, n)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, offsets in slices(batch.column(2)):
                bucket, bounds = features(data, offsets)
                found += [bucket[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "label", "buckets"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(rows["doc_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
        rows = rows.iloc[order]
        weights = fit([np.frombuffer(b, np.int32) for b in rows["buckets"]], rows["label"].to_numpy())
        return pd.DataFrame({"weights": [weights.astype("<f8").tobytes()]})

    known_rows = chosen.mapInArrow(hashed, "doc_id long, label int, buckets binary").dropDuplicates(["doc_id", "buckets"])
    # An id may have several texts, so rows are bounded as well.
    known_rows = known_rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("buckets")).limit(sample)
    model = known_rows.withColumn("model", F.lit(0)).groupBy("model").applyInPandas(learn, "weights binary").collect()
    return np.frombuffer(model[0][0], "<f8") if model else np.zeros(BUCKETS)


def scores(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """`row`, the columns of `documents`, and `score`; the texts alone go to Python."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf(DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for texts in batches:
            out = np.zeros(len(texts))
            for lo, hi, data, offsets in slices(texts):
                bucket, bounds = features(data, offsets)
                sums = np.concatenate([[0.0], np.cumsum(w[bucket])])
                out[lo:hi] = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.sqrt(np.maximum(np.diff(bounds), 1)) + w[0]
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))
        released()

    return packed(documents).withColumn("score", score(F.col("row.text").cast("string")))


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    scored = scores(rows, train(rows, labels))
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    return unpacked(scores(documents, train(documents, labels)).where(F.col("score") >= THRESHOLD), documents.columns)
