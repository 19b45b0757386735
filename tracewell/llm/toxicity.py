"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, pairs, triples and pairs with a gap, with A-Z as a-z, and of the
first bytes of its words, so that what is learnt of a stem holds for its other endings. FTRL keeps a
learning rate for each coordinate and an L1 penalty that leaves few weights above zero, so the model is a short list of
(feature, weight): at most DIMS entries, which bounds what is broadcast."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

#: Coordinates of the model; most labelled rows, and bytes of their texts, that it is fitted on (those of least hash; all rows
#: are scored).
DIMS, MOST_LABELLED, MOST_BYTES = 1 << 22, 16384, 64 << 20
#: Bytes of text whose features are made at a time.
CHUNK = 512 << 10
ALPHA, BETA, L1, L2, EPOCHS = 4.0, 1.0, 4.0, 0.0, 4
#: What an error on a toxic row counts, beside one on another.
TOXIC_WEIGHT = 2.0
#: Lengths in bytes of the beginnings of words.
STEMS = (4, 5, 6, 7)
#: Values of a feature by its kind, which the low three bits of its coordinate tell: word, pair, triple, pair with a gap, stem.
VALUES = np.array([1.0, 0.25, 0.25, 0.25, 0.5, 0.0, 0.0, 0.0])
KIND = len(VALUES) - 1
#: Scores from here on are toxic.
THRESHOLD = 0.7
#: White space and ASCII punctuation part words here.
PARTS = words.SPACE.copy()
PARTS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def features(column: pa.Array, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Row and coordinate of every feature of every text, repeats included."""
    data, offs = common.utf8(column)
    starts, ends, first = words.spans(data, offs, PARTS)
    one = words.hashes(data, starts, ends, lower=True)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low = np.uint64(KIND)
    rows, out = [row], [one & ~low]
    factors = words.odd(8)
    for kind, gaps in enumerate(((0, 1), (0, 1, 2), (0, 2)), 1):
        n = len(one) - gaps[-1]
        if n <= 0:
            continue
        h = one[:n] * factors[kind]
        for j in gaps[1:]:
            h = h * factors[5] + one[j : j + n]
        same = row[:n] == row[gaps[-1] :]
        rows.append(row[:n][same])
        out.append(words.mix(h[same]) & ~low | np.uint64(kind))
    stem, length = np.zeros(len(starts), np.uint64), ends - starts
    for k in range(max(STEMS)):
        stem = stem * factors[6] + words._LOWER[data[np.minimum(starts + k, len(data) - 1)]] if len(starts) else stem
        if k + 1 in STEMS:
            long = length > k
            rows.append(row[long])
            out.append(words.mix(stem[long] + np.uint64(k + 1)) & ~low | np.uint64(4))
    return np.concatenate(rows), (np.concatenate(out) % np.uint64(dims)).astype(np.int64)


@dataclass
class Weights:
    """A bias and the coordinates with a weight."""

    bias: float
    index: np.ndarray
    value: np.ndarray

    def of(self, at: np.ndarray) -> np.ndarray:
        """Weights of coordinates. The index is sorted, and short beside DIMS."""
        if not len(self.index):
            return np.zeros(len(at))
        place = np.minimum(np.searchsorted(self.index, at), len(self.index) - 1)
        return np.where(self.index[place] == at, self.value[place], 0.0)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, dims: int = DIMS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS, toxic: float = TOXIC_WEIGHT) -> Weights:
    """Weights for rows of distinct coordinates, seen in the order given. The last coordinate is the bias, without a penalty."""
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)
    bias = np.array([dims])
    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            at = np.concatenate([at, bias])
            x = VALUES[at & KIND]
            x[-1] = 1.0
            zi, ni = z[at], n[at]
            shrink = np.where(at == dims, 0.0, l1)
            w = np.where(np.abs(zi) <= shrink, 0.0, -(zi - np.sign(zi) * shrink) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip((w * x).sum(), -35, 35))) - y) * x * (toxic if y else 1.0)
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    index = np.flatnonzero(np.abs(z[:dims]) > l1)  # few; nothing else of this size is made
    zi, ni = z[index], n[index]
    value = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
    return Weights(float(-z[dims] / ((beta + np.sqrt(n[dims])) / alpha + l2)), index, value * VALUES[index & KIND])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", most: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> Weights:
    """A model of label (0 or 1; a row with another value or null is left out; of repeated keys the highest label and the text
    of least hash count) from at most `most` labelled keys, those of least hash, and `most_bytes` of their texts (longer ones are
    passed over, and the first to exceed it ends the sample). Null texts have no words. Without any row, the model is one bias
    of 0."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    known = known.withColumn("_order", F.xxhash64("_key")).orderBy("_order", "_key").limit(most)
    sample = docs.select(F.col(key).alias("_doc"), F.coalesce(text, F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes)
    sample = sample.join(F.broadcast(known), F.col("_doc") == F.col("_key")).groupBy("_order", "_doc", "_label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ys, left = [], [], most_bytes
        for batch in common.chunks(batches, "text", CHUNK):
            size = np.cumsum(np.diff(common.utf8(batch.column("text"))[1]))
            batch = batch.slice(0, int(np.searchsorted(size, left, side="right")))
            left = -1 if batch.num_rows < len(size) else left - (size[-1] if len(size) else 0)
            if left < 0 and not batch.num_rows:
                break
            row, at = features(batch.column("text"))
            both = np.unique(row * DIMS + at)
            cuts = np.searchsorted(both, np.arange(batch.num_rows + 1) * DIMS)
            at = (both % DIMS).astype(np.int32)
            rows += [at[a:b].copy() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            ys += batch.column("_label").to_pylist()
            if left < 0:
                break
        found = ftrl(rows, np.array(ys, float))
        yield pa.RecordBatch.from_arrays([pa.array([found.bias]), common.binary([found.index.astype("<i4").tobytes()]), common.binary([found.value.astype("<f8").tobytes()])], ["bias", "at", "value"])

    # one task sees the sample, in one order; its rows are bounded by `most`
    got = sample.repartition(1).sortWithinPartitions("_order", "_doc").mapInArrow(fit, "bias double, at binary, value binary").collect()
    if not got:
        return Weights(0.0, np.zeros(0, np.int64), np.zeros(0))
    return Weights(got[0]["bias"], np.frombuffer(got[0]["at"], "<i4").astype(np.int64), np.frombuffer(got[0]["value"], "<f8"))


def score(docs: DataFrame, model: Weights, text: str = "text") -> DataFrame:
    """docs with _tw_score (0 to 1). Null and empty texts have the bias alone."""
    held = docs.sparkSession.sparkContext.broadcast((model.bias, model.index, model.value))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(*held.value)
        for batch in common.chunks(batches, text, CHUNK):
            row, at = features(batch.column(text))
            keep = weights.of(at) != 0
            both = np.unique(row[keep] * DIMS + at[keep])
            total = np.bincount(both // DIMS, weights.of(both % DIMS), minlength=batch.num_rows) + weights.bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], [*batch.schema.names, "_tw_score"])

    return docs.mapInArrow(run, f"{columns}, _tw_score double")


def fold(key) -> F.Column:
    """crc32 of the key as text, modulo 3; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


def model_of(spark: SparkSession, sf_dir: str) -> Weights:
    """Trained on the labelled documents that are not held out."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic").where(fold("doc_id") != 1))


def clean(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without those that score THRESHOLD or more, by a model of the labels that are not held out."""
    model = train(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels.where(fold("doc_id") != 1))
    docs, back = common.apart(docs, text, key)
    return back(score(docs, model, text).where(F.col("_tw_score") < THRESHOLD))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    scored = score(common.table(spark, sf_dir, "documents").select("doc_id", "text"), model_of(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), F.col("_tw_score").alias("score"), (F.col("_tw_score") >= THRESHOLD).cast("int").alias("predicted"))
