"""Quality scores: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text: its words (A-Z lower-cased) and pairs of neighbouring words, hashed to ``2^BITS`` weights, together
with coarse shapes of its words (length, capitals, digits, signs, repetition), hashed to the same weights. Counts are damped
(``log(1 + n)``) and each text's vector is scaled to length 1.

Training uses at most ``MAX_ROWS`` labelled rows, those with the smallest hash of their id (a documented bound; scoring
covers every row). They are dealt to ``SHARDS`` shards by that hash. A shard runs FTRL-Proximal over its rows ``EPOCHS``
times in hash order; a grouping averages the shards' weights. A weight table has ``2^BITS`` numbers at most, whatever the
corpus, and travels to the executors as one broadcast of that bounded size. Averaging shrinks the log-odds, so last a
slope and a constant are fitted to the training rows (at most ``MAX_ROWS`` numbers).

Null and empty texts have no feature but the constant one, so they get a score too. Repeated rows are scored alike. With
no labelled row the score is 0.5. Only ``doc_id`` and ``text`` are read, so extra columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom.llm.common import BASE, IS_SPACE, LOWER, MIX1, U64, hash_words, mix, segments, texts, word_bounds

BITS, MAX_ROWS, SHARDS, EPOCHS = 18, 20_000, 8, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
THRESHOLD = 0.3

_KIND = np.zeros(256, np.int64)  # 0 letter or other byte, 1 capital, 2 digit, 3 sign
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's vector."""
    found, shape = [], np.zeros(8)
    for part in segments(text or b""):
        raw = np.frombuffer(part, np.uint8)
        starts, ends = word_bounds(raw)
        if not len(starts):
            continue
        hashes = hash_words(LOWER[raw], starts, ends)
        kind = _KIND[raw]
        found += [hashes, mix(hashes[:-1] * BASE + hashes[1:])]
        capitals, digits, signs = (np.add.reduceat((kind == k) & ~IS_SPACE[raw], starts) for k in (1, 2, 3))
        size = ends - starts
        last = raw[ends - 1]
        # the shape of each word: a small number, hashed as a feature of its own
        code = np.minimum(size, 15) * 64 + np.minimum(capitals, 3) * 16 + np.minimum(digits, 3) * 4 + np.minimum(signs, 3)
        found += [mix(code.astype(U64) + MIX1), mix(np.where(_KIND[last] == 3, last, 0).astype(U64) + (MIX1 << U64(1)))]
        shape += [len(starts), (hashes[1:] == hashes[:-1]).sum(), (capitals == size).sum(), (signs > 0).sum(),
                  (signs == size).sum(), (digits > 0).sum(), size.sum(), len(np.unique(hashes))]
    n = max(shape[0], 1.0)
    ratios = np.concatenate([(10 * shape[1:6] / n), [min(shape[6] / n, 40.0), 10 * shape[7] / n, np.log2(n)]]).round().astype(np.int64)
    whole = mix((np.arange(len(ratios)) * 1000 + ratios).astype(U64) + (MIX1 << U64(2)))
    constant = mix(np.array([7], U64))
    place, n_times = np.unique((np.concatenate([*found, constant]) >> U64(64 - BITS)).astype(np.int32), return_counts=True)
    value = np.log1p(n_times)
    value = value / np.sqrt((value * value).sum())
    at = (whole >> U64(64 - BITS)).astype(np.int32)
    return np.concatenate([place, at]), np.concatenate([value, np.full(len(at), 0.3)]).astype(np.float32)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights after ``EPOCHS`` passes of FTRL-Proximal over the rows."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, value, label in rows:
            w = weights(at)
            g = (_sigmoid(w @ value) - label) * value
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(1 << BITS))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    """Weights by place; the last two numbers are the slope and the constant of the log-odds."""
    order = F.xxhash64(F.lit("quality"), "doc_id")
    # labels that contradict each other: the majority, 0 where there is none
    marked = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(F.col(label).cast("int")) > 0.5).cast("int").alias("y"))
    # MAX_ROWS ids at most, so that unchosen texts need not move
    chosen = F.broadcast(marked.orderBy(order, "doc_id").limit(MAX_ROWS))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(
        "doc_id", "text", "y", order.alias("o"), F.xxhash64("text").alias("th"), F.pmod(order, F.lit(SHARDS)).alias("shard")
    )

    def shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["o", "doc_id", "th"])
        held = [(*features(None if t is None else t.encode()), y) for t, y in zip(group["text"], group["y"])]
        w = _ftrl(held)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "w": w[at]})

    averaged = rows.groupBy("shard").applyInPandas(shard, "at long, w double").groupBy("at").agg(F.sum("w").alias("w"))
    found = averaged.toPandas()  # 2^BITS rows at most
    out = np.zeros((1 << BITS) + 2)
    out[found["at"].to_numpy(np.int64)] = found["w"].to_numpy() / SHARDS
    out[-2] = 1.0
    held = _odds(rows, out, ["y"]).toPandas()
    if len(held):
        out[-2:] = _line(held["odds"].to_numpy(), held["y"].to_numpy())
    return out


def _line(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and constant that fit labels to log-odds, by Newton steps on the ridge-penalised likelihood."""
    both, at = np.stack([x, np.ones_like(x)]), np.array([1.0, 0.0])
    ridge = np.diag([0.5, 0.01])
    for _ in range(50):
        p = _sigmoid(at @ both)
        step = np.linalg.solve((both * (p * (1 - p))) @ both.T + ridge, both @ (p - y) + ridge @ (at - [1.0, 0.0]))
        at = at - np.clip(step, -1, 1)
    return at


def _odds(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``odds``, the log-odds, for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def dot(batches):
        w = shared.value
        for batch in batches:
            odds = np.zeros(batch.num_rows)
            for i, text in enumerate(texts(batch)):
                at, value = features(text)
                odds[i] = (w[at] @ value) * w[-2] + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(odds)], names=[*keep, "odds"])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("odds", T.DoubleType())])
    return docs.select(*keep, "text").mapInArrow(dot, schema)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted`` for every row of ``docs``."""
    p = 1 / (1 + F.exp(-F.col("odds")))
    found = _odds(docs, weights, keep).withColumn("score", p).drop("odds")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def by_folds(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows outside fold 0, score every row."""
    docs = docs.withColumn("held_out", held_out())
    weights = train(docs.where(~F.col("held_out")), labels.where(~held_out()))
    return score(docs, weights, ["doc_id", "held_out"])
