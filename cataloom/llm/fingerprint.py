"""Document fingerprints: improbable features in chained Bloom filters.

Each window of ``WINDOW`` bytes of a text has an entropy, rounded to one of ``LEVELS`` values. How rare a value is over the windows of
all texts gives its rank (rarest first; ties: higher entropy first); near-constant windows (below ``PLAIN``) come last. Of every
``SPAN`` neighbouring windows the best-ranked one (ties: the first) gets a vote, and windows with ``VOTES`` votes or more are the
text's features. A feature sets ``HASHES`` bits in a filter of ``BITS`` bits; after ``PER_FILTER`` features the next filter of the
chain begins. Two fingerprints are compared filter by filter: the common bits beyond those expected by chance, over the most that
could be common; each filter of the shorter chain takes its best partner, and the mean by features is the likeness (0 to 1).

In a text of fewer than ``SHORT`` bytes every window of ``SHORT_WINDOW`` bytes is a feature (a still shorter text is one); an empty or null text has an empty fingerprint, alike (1.0) to another empty one and
unlike (0.0) all others. Equal texts have equal fingerprints. Very long texts are read in parts, filters grow with the text.

``with_neighbours`` pairs each row with the next in descending doc_id (null last; ties by text hash; the last with the first). Rows
are dealt by ranges of doc_id and sorted there; one copy of the first text of the following range is added to each range, so the
texts move once and a task reads its rows as a stream. Equal rows are neighbours of each other. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm.common import BASE, INVERSE, SEGMENT, U64, keyed, mix, powers, prefix_hash, texts, written

WINDOW, SPAN, VOTES, LEVELS, PLAIN = 64, 64, 16, 1000, 100
SHORT, SHORT_WINDOW = 256, 8
BLOCK = 1 << 17  # bytes of short texts looked at together
BITS, HASHES, PER_FILTER = 2048, 5, 128
_COUNT = np.arange(WINDOW + 1)
#: c log2 c for a byte that occurs c times in a window, in units of 2^-20, so that sums are exact
_TERM = np.rint(np.where(_COUNT > 0, _COUNT * np.log2(np.maximum(_COUNT, 1)), 0) * (1 << 20)).astype(np.int64)
_FULL = int(_TERM[WINDOW])


def entropy_levels(buf: np.ndarray) -> np.ndarray:
    """The rounded entropy (0 to LEVELS) of every window of a text of at least WINDOW bytes."""
    n = len(buf)
    # how often a byte occurs in the window it begins, and in the window it ends
    begin, end = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (buf[:-lag] == buf[lag:]).view(np.uint8)
        begin[:-lag] += same
        end[lag:] += same
    first = int(_TERM[np.bincount(buf[:WINDOW], minlength=1)].sum())
    out, into = begin[: n - WINDOW], end[WINDOW:]
    gain = np.diff(_TERM, prepend=0)
    sums = np.empty(n - WINDOW + 1, np.int64)
    sums[0] = first
    np.cumsum(gain[into] - gain[out], out=sums[1:])
    sums[1:] += first
    return ((_FULL - sums) * LEVELS // _FULL).astype(np.int32)


def _parts(data: bytes):
    """A text in overlapping parts, so that every window is in one of them."""
    for at in range(0, max(1, len(data) - WINDOW + 1), SEGMENT):
        yield np.frombuffer(data[at : at + SEGMENT + WINDOW - 1], np.uint8)


def _blocks(found: list[bytes | None]):
    """The windows' levels of many texts, some texts at a time; parts of very long ones alone."""
    held, size = [], 0
    for text in found:
        if not text or len(text) < WINDOW:
            continue
        for part in _parts(text):
            if held and size + len(part) > BLOCK:
                yield _levels_of(held)
                held, size = [], 0
            held.append(part)
            size += len(part)
    if held:
        yield _levels_of(held)


def _levels_of(parts: list[np.ndarray]) -> np.ndarray:
    level = entropy_levels(np.concatenate(parts))
    inside = np.ones(len(level), bool)
    for end in np.cumsum([len(p) for p in parts[:-1]]):
        inside[end - WINDOW + 1 : end] = False  # windows that reach into the next text
    return level[inside]


def ranks(docs: DataFrame) -> np.ndarray:
    """Rank by level from the windows of all texts; LEVELS + 1 numbers."""

    def count(batches):
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for level in _blocks(texts(batch)):
                total += np.bincount(level, minlength=LEVELS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS + 1)), pa.array(total)], names=["level", "n"])

    found = docs.select("text").mapInArrow(count, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect()
    n = {row.level: row.n for row in found}
    order = sorted(range(LEVELS + 1), key=lambda v: (v < PLAIN, n.get(v, 0), -v))
    out = np.empty(LEVELS + 1, np.int64)
    out[order] = np.arange(LEVELS + 1)
    return out


def levels_of(data: bytes) -> np.ndarray | None:
    """The levels of a text that is read in one part, to be used again for texts made from it."""
    return entropy_levels(np.frombuffer(data, np.uint8)) if SHORT <= len(data) <= SEGMENT else None


def joined_levels(a: bytes, of_a: np.ndarray | None, b: bytes, of_b: np.ndarray | None) -> np.ndarray | None:
    """The levels of ``a + b`` from those of texts that begin with ``a`` and with ``b``."""
    if of_a is None or of_b is None or min(len(a), len(b)) < WINDOW or not SHORT <= len(a) + len(b) <= SEGMENT:
        return None
    middle = entropy_levels(np.frombuffer(a[1 - WINDOW :] + b[: WINDOW - 1], np.uint8))
    return np.concatenate([of_a[: len(a) - WINDOW + 1], middle, of_b[: len(b) - WINDOW + 1]])


def _features(
    data: bytes, rank: np.ndarray, power: np.ndarray, inverse: np.ndarray, levels: np.ndarray | None = None
) -> np.ndarray:
    """Hashes of a text's features, in order; ``levels`` of a text of one part need not be worked out again."""
    if len(data) < SHORT:
        width = min(SHORT_WINDOW, len(data))
        sums = prefix_hash(np.frombuffer(data, np.uint8), power)
        return np.unique(mix((sums[width:] - sums[: len(sums) - width]) * inverse[: len(sums) - width])) if data else np.zeros(0, U64)
    found = []
    for buf in _parts(data):
        key = (rank[entropy_levels(buf) if levels is None else levels] << 24) | np.arange(len(buf) - WINDOW + 1)
        width, step = min(SPAN, len(key)), 1
        best = key
        while step < width:  # minimum over `width` neighbours by doubling
            move = min(step, width - step)
            best = np.minimum(best[:-move], best[move:])
            step += move
        votes = np.bincount(best & 0xFFFFFF, minlength=len(key))
        at = np.flatnonzero(votes >= min(VOTES, len(best)))
        sums = prefix_hash(buf, power)
        found.append(mix((sums[at + WINDOW] - sums[at]) * inverse[at]))
    return np.concatenate(found)


class Maker:
    """Fingerprints with given ranks."""

    def __init__(self, rank: np.ndarray):
        self.rank = rank
        self.power, self.inverse = powers(BASE, SEGMENT + WINDOW), powers(INVERSE, SEGMENT + WINDOW)

    def filters(self, data: bytes, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bloom filters (rows of bytes) and the features in each."""
        found = _features(data, self.rank, self.power, self.inverse, levels)
        n = -(-len(found) // PER_FILTER)
        bits = np.zeros((n, BITS), bool)
        row = np.arange(len(found)) // PER_FILTER
        for k in range(HASHES):
            bits[row, ((found >> U64(11 * k)) & U64(BITS - 1)).astype(np.int64)] = True
        return np.packbits(bits, axis=1), np.bincount(row, minlength=n)[:n]


def shown(made: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint as text: features of each filter, then the filters."""
    bits, n = made
    return ",".join(map(str, n)) + ":" + base64.b64encode(bits.tobytes()).decode()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[1]) or not len(b[1]):
        return float(len(a[1]) == len(b[1]))
    if (len(a[1]), a[1].sum()) > (len(b[1]), b[1].sum()):
        a, b = b, a
    left, right = a[0].view(U64), b[0].view(U64)
    ones_left, ones_right = (np.bitwise_count(x).sum(axis=1).astype(np.int64) for x in (left, right))
    best = np.zeros(len(left))
    for i in range(len(left)):
        common = np.bitwise_count(left[i] & right).sum(axis=1)
        chance = ones_left[i] * ones_right / BITS
        most = np.minimum(ones_left[i], ones_right)
        best[i] = np.max(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1))
    return float((best * a[1]).sum() / a[1].sum())


def _ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with ``part``, a number for its range in descending order of doc_id (null last), then by text hash.

    An id that stands in several ranges' worth of rows, or the null, is divided among them by text hash.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, empty = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    without_id = 1 + parts * empty // max(n, 1)
    cuts = docs.stat.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    shares = Counter(int(c) for c in cuts)
    above, share = F.lit(0), F.lit(1)
    if cuts:
        places = F.array([F.lit(c) for c in sorted(shares.elements())]).cast("array<bigint>")
        above = F.size(F.filter(places, lambda c: c > F.col("doc_id")))
        often = F.create_map([F.lit(x).cast("bigint") for pair in shares.items() for x in pair])
        share = F.coalesce(F.try_element_at(often, F.col("doc_id").cast("bigint")), F.lit(1))
    share = F.when(F.col("doc_id").isNull(), without_id).otherwise(share)
    inside = F.least(F.floor((F.col("th") / 2.0**64 + 0.5) * share), share - 1)
    part = F.when(F.col("doc_id").isNull(), parts).otherwise(above) + inside
    return docs.withColumn("part", part.cast("int")), parts + without_id


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Rows sorted within partitions: ``part, last, doc_id, text``; behind the rows of a part (``last = 0``) stands the text that follows
    it (``last = 1``, no row of its own)."""
    rows, parts = _ranges(keyed(docs))
    order = [F.desc_nulls_last("doc_id"), F.asc("th")]
    keys = rows.select("part", "doc_id", "th")
    head = keys.groupBy("part").agg(F.max(F.struct("doc_id", (-F.col("th")).alias("o"), "th")).alias("h"))
    around = Window.orderBy("part")  # one row for each part
    every = head.select("part", F.col("h.doc_id").alias("d"), F.col("h.th").alias("t"))
    nexts = every.select(
        F.coalesce(F.lag("part").over(around), F.last("part").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("p"),
        "d", "t",
    )
    nexts = F.broadcast(written(nexts, "heads"))  # at most one row for each part
    added = rows.join(nexts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    added = added.select(F.col("p").alias("part"), F.lit(1).alias("last"), F.lit(None).cast("bigint").alias("doc_id"), "th", "text")
    both = rows.select("part", F.lit(0).alias("last"), F.col("doc_id").cast("bigint"), "th", "text").union(added.dropDuplicates(["part"]))
    return both.repartitionByRange(parts, "part").sortWithinPartitions("part", "last", *order)


_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def halves(text: str, following: str) -> tuple[str, str]:
    """The edited text in two: ``text`` without its last third, and as much of the head of the next text."""
    cut = len(text) // 3
    return text[: len(text) - cut], following[:cut]


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Per row its fingerprint, that of its edited text, and how alike they and the next row's are."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks(docs))

    def read(batches):
        maker, held = Maker(shared.value), None
        names = [part.split()[0] for part in _SCHEMA.split(", ")]
        for batch in batches:
            out = []
            for part, last, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "last", "doc_id", "text"))):
                text = text or ""
                data = text.encode()
                levels = levels_of(data)
                made = maker.filters(data, levels)
                if held is not None and held[0] == part:
                    _, before, old, own, of_old = held
                    a, b = (x.encode() for x in halves(old, text))
                    of_new = maker.filters(a + b, joined_levels(a, of_old, b, levels))
                    out.append((before, len(old), hashlib.sha256(a + b).hexdigest(), shown(own), shown(of_new),
                                likeness(own, of_new), likeness(own, made)))
                held = None if last else (part, doc_id, text, made, levels)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            cols = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return with_neighbours(docs).mapInArrow(read, _SCHEMA)
