"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted as present or absent and hashed into ``2 ** bits`` slots: its words, its
pairs of neighbouring words, and its pairs with one or two words between them. Words are hashed by
Spark; a task combines the hashes with numpy.

The model is fitted on at most ``max_rows`` labelled texts, a documented bound: the rows of least hashed
id. Each text is made into its different feature slots before texts meet. Shards of about ``shard_rows`` of them, and of about
``shard_slots`` slots, so that long texts make more shards, are fitted in tasks of their own by FTRL-proximal with a learning
rate for each coordinate and L1 sparsity; their weights are averaged. Only weights other than zero are sent
out, at most ``2 ** bits`` of them whatever the input. Scoring reads every whole text; ids, languages,
sources and labels are never features.

An empty or null text has no features: its score is that of the bias. Labels other than 0 and 1, and labels
of unknown ids, are left out; where an id has several labels, any 1 counts. Without labels
the score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaitwork.llm._util import fresh, prepare, staged, word_hashes

BITS, MAX_ROWS, SHARD_ROWS, SHARD_SLOTS, LOT_ROWS = 20, 16_384, 8_192, 32_000_000, 256
ALPHA, BETA, L1, L2, EPOCHS, THRESHOLD = 2.0, 1.0, 8.0, 0.0, 4, 0.7

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def features(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Slots of the words, and of the pairs 1, 2 and 3 words apart: four arrays by first word."""
    h = hashes.astype(np.int64).view(np.uint64)
    out = [_slots(h * _ODD[0], bits)]
    out += [_slots((h[:-gap] * _ODD[gap]) ^ (h[gap:] * _ODD[0] + np.uint64(gap)), bits) if len(h) > gap else np.empty(0, np.int64) for gap in (1, 2, 3)]
    return out


def fit(examples: list[np.ndarray], labels: np.ndarray, bits: int, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal weights of one shard; slot ``2 ** bits`` is the bias, which has no L1."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, L1)
    l1[-1] = 0.0
    order = np.random.default_rng(0)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1[at], 0.0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            at = examples[k]
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - labels[k]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = BITS, max_rows: int = MAX_ROWS, shard_rows: int = SHARD_ROWS, shard_slots: int = SHARD_SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) other than zero, learned from the rows of ``labels`` for which ``learn`` holds."""
    prepare(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1)) if learn is None else labels.where(learn & F.col(label_col).isin(0, 1))
    known = known.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)  # the bound
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    hashed = texts.select(F.xxhash64("id").alias("h"), "y", word_hashes(F.col("text")).alias("wh"))

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LOT_ROWS):
                part = batch.slice(at, LOT_ROWS)
                rows = [np.unique(np.concatenate([*features(x.values.to_numpy(zero_copy_only=False), bits), [1 << bits]])).astype(np.int32) for x in part.column("wh")]
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("y"), pa.array(rows, pa.list_(pa.int32()))], names=["h", "y", "slots"])

    ready = staged(hashed.mapInArrow(slots_of, "h long, y double, slots array<int>"), "toxicity-slots")
    sizes = ready.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("slots")), F.lit(0)).alias("slots")).first()
    if not sizes["rows"]:
        return np.empty(0, np.int64), np.empty(0)
    shards = max(-(-sizes["rows"] // shard_rows), -(-sizes["slots"] // shard_slots))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        w = fit([np.asarray(x) for x in pdf["slots"]], pdf["y"].to_numpy(), bits)
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": at, "w": w[at]})

    dealt = ready.groupBy(F.pmod("h", F.lit(shards)).alias("shard"))
    mean = dealt.applyInPandas(run, "slot long, w double").groupBy("slot").agg((F.sum("w") / shards).alias("w")).toPandas()
    return mean["slot"].to_numpy(np.int64), mean["w"].to_numpy(float)


def scorer(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str, bits: int = BITS) -> Column:
    """The score as a Column: only word hashes go to the Python workers, and they take a few rows at a time."""
    prepare(docs.sparkSession)
    slots, w = model
    sent = docs.sparkSession.sparkContext.broadcast((slots, w.astype(np.float64)))

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, values = sent.value
        inner = at < (1 << bits)
        table = np.zeros(1 << bits)
        table[at[inner]] = values[inner]
        bias = float(values[~inner].sum()) if len(values) else -35.0
        for lists in batches:
            yield pa.concat_arrays([_score_lot(lists.slice(k, LOT_ROWS), table, bias, bits) for k in range(0, len(lists), LOT_ROWS)] or [pa.array([], pa.float64())])

    return run(word_hashes(F.col(text_col)))


def _score_lot(lists: pa.ListArray, table: np.ndarray, bias: float, bits: int) -> pa.Array:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    hashes = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    hits = []
    for gap, got in enumerate(features(hashes, bits)):
        first = row[: len(got)]
        k = np.flatnonzero((table[got] != 0) & (first == row[gap:]))
        hits.append((first[k] << bits) | got[k])
    # A feature counts once a text, however often it is there.
    pairs = np.unique(np.concatenate(hits))
    total = np.full(len(lists), bias)
    np.add.at(total, pairs >> bits, table[pairs & ((1 << bits) - 1)])
    return pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0))))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(``id_col``, score): for each row, the probability that its whole text is toxic."""
    return docs.select(F.col(id_col), scorer(docs, model, text_col, bits).alias("score"))


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; null and empty texts get the bias.

    The score is a column beside the row, so nothing is joined and no text is shuffled.
    """
    name = fresh(docs, "score")
    return docs.withColumn(name, scorer(docs, model, text_col)).where(F.col(name) < threshold).select(*docs.columns)
