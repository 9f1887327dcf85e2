"""What the text operators share: row keys, word and byte hashes, shared tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.session import new_shared_path

U64 = np.uint64
#: Odd multipliers of the hashes (fixed values, so that reruns agree).
BASE, MIX1, MIX2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Words longer than this fold their positions.
FOLD = 4096
#: Bytes of a text hashed at once; longer texts are cut between words.
SEGMENT = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
_SPACE = re.compile(rb"[\x20\x09-\x0d]")

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The word pattern of the contracts, for Java and for DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = h ^ (h >> U64(30))
    h = h * MIX1
    h = h ^ (h >> U64(27))
    h = h * MIX2
    return h ^ (h >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


WORD_POWERS = powers(BASE, FOLD)
_VALUE = np.where(IS_SPACE, 0, np.arange(1, 257)).astype(U64)


def segments(data: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut at white space; a longer word stays whole."""
    at = 0
    while len(data) - at > size:
        cut = _SPACE.search(data, at + size)
        if not cut:
            break
        yield data[at : cut.start()]
        at = cut.start()
    yield data[at:]


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of UTF-8 bytes."""
    inside = ~IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word."""
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    head = int(starts[0])
    offset = np.arange(head, len(buf)) - np.repeat(starts, np.diff(starts, append=len(buf)))
    value = _VALUE[buf[head:]]
    if int(size.max()) <= FOLD:
        # white space behind a word has value 0, wherever it stands
        value *= WORD_POWERS[np.minimum(offset, FOLD - 1)]
    else:
        spread = mix(value + (offset // FOLD).astype(U64)) * WORD_POWERS[offset % FOLD]
        value = np.where(value != 0, spread, U64(0))
    return mix(np.add.reduceat(value, starts - head) + size.astype(U64) * MIX2)


def words(text: bytes | None, lower: bool = True) -> np.ndarray:
    """Hashes of the words of a whole text, in order; ``lower`` folds A-Z."""
    found = []
    for part in segments(text or b""):
        buf = np.frombuffer(part, np.uint8)
        if lower:
            buf = LOWER[buf]
        found.append(hash_words(buf, *word_bounds(buf)))
    return found[0] if len(found) == 1 else np.concatenate(found)


def shingles(found: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; a shorter text is one run, no words none."""
    if not len(found):
        return found
    n = min(size, len(found))
    total = np.full(len(found) - n + 1, U64(n), U64)
    for k in range(n):
        total = (total + found[k : len(found) - n + 1 + k]) * BASE
    return np.unique(mix(total))


def prefix_hash(buf: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Sums of byte x power from the start; differences of it hash any substring."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * power[: len(buf)], out=out[1:])
    return out


#: Inverse of BASE modulo 2^64: takes a substring's hash back to place 0.
INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def per_batch(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(record batch) -> record batch`` over all of ``df``; batches are bounded in rows and bytes by Spark."""
    return df.mapInArrow(lambda batches: (fn(b) for b in batches), schema)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, th``: ``(doc_id, th)`` names a row; rows equal in both are the same document."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th"))


def on_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the row key, where doc_id may be null; the key stays once."""
    right = right.withColumnsRenamed({"doc_id": "__doc_id", "th": "__th"})
    found = left.join(right, left["doc_id"].eqNullSafe(F.col("__doc_id")) & (left["th"] == F.col("__th")), how)
    return found.drop("__doc_id", "__th")


def aside(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, list[str], list]:
    """``docs`` with every column but ``own`` renamed, so that no name clashes; the new names, and the columns to select back."""
    names = [c if c in own else f"c_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names, [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def written(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that a lost executor costs a reread and no recomputation."""
    spark: SparkSession = df.sparkSession
    path = new_shared_path(spark, purpose)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
