"""Quality classifier with supervised subword embeddings.

A document is the mean of the learned vectors of its hashed words, pairs of
neighbouring words and 2- to 4-byte grams, followed by a softmax over two classes, all trained by stochastic
gradient descent in numpy.  Because the output layer is linear, each bucket
contributes one number to a document's log-odds, so scoring adds up one
looked-up value per feature over the whole text.

The model is fitted on a bounded sample of about SAMPLE labelled documents, in
equal shares of both classes, chosen by the hash of doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textbytes import byte_ngrams, flat, gram_sums, mix64, segment_sum, slices, word_hashes

SAMPLE = 3000
BITS = 15
GRAMS = (2, 3, 4)
DIM = 8
#: Units that a weight of 1 has: sums of whole numbers don't depend on a text's place.
UNIT = 1 << 20


@dataclass
class Model:
    odds: np.ndarray  # each bucket's part of the log-odds, in units of 1 / UNIT
    bias: float


def word_features(data: np.ndarray, offsets: np.ndarray):
    """(buckets, where each text's begin) of words, then of pairs of neighbours."""
    words, first = word_hashes(data, offsets)
    yield (words >> np.uint64(64 - BITS)).astype(np.int64), first
    # a pair hashes by the difference of its words, so all repeats of a word share one bucket
    pairs = np.zeros(len(words), np.uint64)
    pairs[1:] = words[1:] ^ words[:-1]
    inside = np.ones(len(words), bool)
    inside[first[:-1][first[:-1] < len(words)]] = False
    yield (mix64(pairs[inside] + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([[0], np.cumsum(inside)])[first]


def features(texts: pa.Array):
    """For each kind of feature: (buckets of all texts, where each text's begin)."""
    data, offsets = flat(texts)
    yield from word_features(data, offsets)
    for n in GRAMS:
        yield byte_ngrams(data, offsets, n, BITS)


def log_odds(texts: pa.Array, model: Model) -> np.ndarray:
    """Each text's log-odds for label 1."""
    data, offsets = flat(texts)
    total, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for bucket, at in word_features(data, offsets):
        total += segment_sum(model.odds[bucket], at)
        n += np.diff(at)
    for k in GRAMS:
        more, grams = gram_sums(data, offsets, k, BITS, model.odds[:, None])
        total += more[:, 0]
        n += grams
    return total / UNIT / np.maximum(n, 1) + model.bias


def _sample_features(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            kinds = list(features(part.column("text")))
            index, weight = [], []
            for i in range(part.num_rows):
                own = np.concatenate([b[at[i] : at[i + 1]] for b, at in kinds])
                bucket, n = np.unique(own, return_counts=True)
                index.append(bucket.astype(np.int32).tobytes())
                weight.append((n / max(len(own), 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), part.column("doc_id"), pa.array(index, pa.binary()), pa.array(weight, pa.binary())], ["label", "doc_id", "index", "weight"]
            )


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 30.0, seed: int = 5) -> Model:
    """Train on (label, buckets, weights) rows; without both classes the model knows only the classes' shares."""
    labels = np.array([r[0] for r in rows])
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(1 << BITS, np.int64), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    batch, steps, total = 16, 0, epochs * -(-len(rows) // 16)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            pick = [rows[i] for i in order[start : start + batch]]
            index, weight = np.concatenate([p[1] for p in pick]), np.concatenate([p[2] for p in pick])
            at = np.concatenate([[0], np.cumsum([len(p[1]) for p in pick])])
            hidden = segment_sum((vectors[index] * weight[:, None]).astype(np.float64), at)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), [r[0] for r in pick]] -= 1
            lr = rate * (1 - steps / total)
            back = p @ out.T
            out -= (lr * 0.02 * hidden.T @ p).astype(np.float32)
            bias -= (lr * 0.002 * p.sum(0)).astype(np.float32)
            owner = np.repeat(np.arange(len(pick)), np.diff(at))
            step = (lr * weight[:, None] * back[owner]).astype(np.float32)
            for d in range(DIM):
                vectors[:, d] -= np.bincount(index, step[:, d], 1 << BITS).astype(np.float32)
            steps += 1
    return Model(np.rint(vectors @ (out[:, 1] - out[:, 0]).astype(np.float64) * UNIT).astype(np.int64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the documents that (doc_id, label 0 or 1) marks; null and other labels are ignored.

    A doc_id with several labels takes the least.  Only the sample's ids, a
    bounded number, are broadcast to find its texts.
    """
    marked = labels.where("label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    counts = dict(marked.groupBy("label").count().collect())
    draw = F.xxhash64(F.lit("quality sample"), "doc_id").bitwiseAND((1 << 52) - 1) / float(1 << 52)
    rate = F.lit(0.0)
    for label, n in counts.items():
        rate = F.when(F.col("label") == label, F.lit(min(1.0, sample / 2 / n))).otherwise(rate)
    ids = [(r["doc_id"], r["label"]) for r in marked.where(draw < rate).collect()]
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, label int")
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = rows.mapInArrow(_sample_features, "label int, doc_id long, index binary, weight binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["index"])))
    return fit([(r["label"], np.frombuffer(r["index"], np.int32), np.frombuffer(r["weight"], np.float32)) for r in rows])


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                odds = log_odds(part.column("text"), model)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))))], ["row", "score"])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row with score (0 to 1); a null or empty text scores by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), "text")
    out = packed.mapInArrow(_score(shared), f"row {packed.schema['row'].dataType.simpleString()}, score double")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "score")
