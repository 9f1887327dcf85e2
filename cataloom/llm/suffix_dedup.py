"""Repeated substrings by run-length indexes of the places where texts can repeat.

A text's UTF-8 bytes lose every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere in the input, in the same
text or another. Overlaps count, and strings are judged on the input, not on what is left.

1. *Anchors.* Every window of ``LENGTH`` bytes has an anchor: among its substrings of ``GRAM`` bytes the one with the least hash
   (ties: the first). Equal windows have equal anchors at the same place, so windows are dealt by anchor; neighbouring windows with the same
   anchor form a *unit*. Anchors that occur once are dropped by a count that map tasks combine.
2. *Units* with equal bytes are counted; one that occurs twice is repeated as a whole. Only anchors with several different units need
   their bytes, one copy of each unit.
3. *Index.* The units of a bucket of anchors (about ``BUCKET`` bytes) are concatenated and their suffixes ordered. The Burrows-Wheeler
   transform is cut in runs; only at the ends of runs is the suffix position kept, with the length it shares with its neighbour across the
   end. Elsewhere that length is the one before minus 1, so a stream over the text from sample to sample gives the matching statistics:
   how far each position matches another one. Windows whose statistic reaches LENGTH are repeated. Copies make long runs, so the samples are few.
4. *Hot anchors* with more than ``HOT`` different units (a passage with ever new surroundings) do not enter a bucket: their windows are
   counted by hash in a grouping that map tasks combine. The result is the same; both ways are exact up to 64-bit hashes of windows that
   share a 64-bit hash of their anchor.
5. *Removal.* Repeated windows go back to the texts that hold them, and the texts lose the covered bytes.

Null text counts as empty; texts shorter than LENGTH lose nothing and still can't match. Each row is a text of its own, so of two equal rows
both lose what repeats. A cut may fall inside a character: the kept text is those bytes (``kept``, binary). Only ``doc_id`` and ``text`` are
read. Texts move twice, compressed; what a task holds is one text, one bucket, or one batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import BASE, INVERSE, SEGMENT, U64, keyed, mix, on_key, powers, prefix_hash, texts, written

LENGTH, GRAM, BUCKET, HOT = 200, 64, 1_000_000, 16_384
_CHOICES = LENGTH - GRAM + 1  # anchors to choose from in a window


class Reader:
    """Units of a text."""

    def __init__(self):
        self.power, self.inverse = powers(BASE, SEGMENT + LENGTH), powers(INVERSE, SEGMENT + LENGTH)

    def units(self, data: bytes) -> list[tuple[np.ndarray, ...]]:
        """For each part of a text: first window, number of windows, anchor hash and hash of each unit."""
        out = []
        for at in range(0, len(data) - LENGTH + 1, SEGMENT):
            buf = np.frombuffer(data[at : at + SEGMENT + LENGTH - 1], np.uint8)
            sums = prefix_hash(buf, self.power)
            n = len(buf) - GRAM + 1
            gram = mix((sums[GRAM:] - sums[:-GRAM]) * self.inverse[:n])
            best = (gram & ~U64(0xFFFFFF)) | np.arange(n, dtype=U64)
            step = 1
            while step < _CHOICES:
                move = min(step, _CHOICES - step)
                best = np.minimum(best[:-move], best[move:])
                step += move
            anchor = (best & U64(0xFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.diff(anchor, prepend=-1))
            n_windows = np.diff(first, append=len(anchor))
            whole = (sums[first + n_windows + LENGTH - 1] - sums[first]) * self.inverse[first]
            unit = mix(whole + n_windows.astype(U64) * BASE)
            out.append((first + at, n_windows, gram[anchor[first]].view(np.int64), unit.view(np.int64)))
        return out

    def windows(self, data: bytes) -> np.ndarray:
        """Hashes of the windows of a unit."""
        sums = prefix_hash(np.frombuffer(data, np.uint8), self.power)
        n = len(data) - LENGTH + 1
        return mix((sums[LENGTH:] - sums[:-LENGTH]) * self.inverse[:n]).view(np.int64)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions by suffix; 0 ends a unit, and ends count as different letters, smaller than all, in order of place."""
    n, width = len(symbols), 7
    ahead = np.concatenate([symbols.astype(np.int64), np.zeros(width, np.int64)])
    key, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(width):
        now = np.where(ended, 0, ahead[k : k + n])
        key = (key << 9) | now
        ended |= now == 0
    order = np.argsort(key, kind="stable")
    fresh = np.append(True, key[order[1:]] != key[order[:-1]]) | ended[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while width < n:
        # groups of more than one suffix, by what follows
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        where = order[at]
        behind = np.minimum(where + width, n - 1)
        key = rank[where] * (n + 1) + rank[behind]
        by = np.argsort(key, kind="stable")
        order[at] = where[by]
        key = key[by]
        fresh[at] = np.append(True, key[1:] != key[:-1])
        rank[order[at]] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))[at]
        width *= 2
    return order


def _shared(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters the suffixes at ``a`` and ``b`` share, up to the end of a unit."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    n, k = len(symbols), 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        same = (symbols[x] == symbols[y]) & (symbols[x] != 0)
        live = live[same]
        k += 1
        out[live] = k
    return out


def matching_statistics(symbols: np.ndarray) -> np.ndarray:
    """For each position the longest match of what starts there with what starts elsewhere, from a run-length index."""
    n = len(symbols)
    order = suffix_order(symbols)
    letters = symbols[order - 1]
    # runs of the transform; the ends of units are letters of their own
    change = np.append(True, (letters[1:] != letters[:-1]) | (letters[1:] == 0))
    best = np.zeros(n, np.int64)
    starts = np.flatnonzero(change)
    for at, step in ((starts, -1), (np.append(starts[1:], n) - 1, 1)):
        other = at + step
        inside = (other >= 0) & (other < n)
        place = order[at]
        length = np.zeros(len(at), np.int64)
        length[inside] = _shared(symbols, place[inside], order[other[inside]])
        # from a sample on, each position matches one letter less than the one before it
        by = np.argsort(place)
        place, length = place[by], length[by]
        nearest = np.searchsorted(place, np.arange(n), "right") - 1
        known = nearest >= 0
        value = length[nearest] - (np.arange(n) - place[nearest])
        best = np.maximum(best, np.where(known, value, 0))
    return best


def repeated_windows(units: list[bytes]) -> list[np.ndarray]:
    """Of each unit the windows (by first byte) that also start elsewhere in the units."""
    symbols = np.concatenate([np.append(np.frombuffer(u, np.uint8).astype(np.uint16) + 1, np.uint16(0)) for u in units])
    long = np.flatnonzero(matching_statistics(symbols) >= LENGTH)
    begin = np.cumsum([0] + [len(u) + 1 for u in units])
    cut = np.searchsorted(long, begin)
    return [long[cut[i] : cut[i + 1]] - begin[i] for i in range(len(units))]


def _runs(found: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of consecutive numbers: firsts and lasts (exclusive)."""
    edge = np.flatnonzero(np.diff(found) > 1)
    return found[np.append(0, edge + 1)].tolist(), (found[np.append(edge, len(found) - 1)] + 1).tolist()


def _placed(docs: DataFrame) -> DataFrame:
    def read(batches):
        reader = Reader()
        for batch in batches:
            row, parts = [], []
            for i, text in enumerate(texts(batch)):
                if text and len(text) >= LENGTH:
                    found = reader.units(text)
                    parts += found
                    row += [i] * sum(len(p[0]) for p in found)
            if not parts:
                continue
            first, n_windows, anchor, unit = (np.concatenate(c) for c in zip(*parts))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(first), pa.array(n_windows.astype(np.int32)),
                 pa.array(anchor), pa.array(unit)],
                names=["doc_id", "th", "first", "windows", "anchor", "unit"],
            )

    return keyed(docs).mapInArrow(read, "doc_id bigint, th bigint, first bigint, windows int, anchor bigint, unit bigint")


def _packed(docs: DataFrame) -> DataFrame:
    def pack(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [squeeze.compress(t or b"") for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(z, pa.binary())], names=["doc_id", "th", "z"])

    return keyed(docs).mapInArrow(pack, "doc_id bigint, th bigint, z binary")


def _bytes_of(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """``anchor, unit, n, hot, data``: the bytes of the chosen units, from the text of one row that holds them."""
    of_text = chosen.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "windows", "anchor", "unit", "n", "hot")).alias("us"))
    # equal rows give the same unit several times; such a unit occurs more than once anyway
    held = on_key(_packed(docs), of_text, "inner")

    def cut(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        names = ["anchor", "unit", "n", "hot", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for z, units in zip(batch.column("z").to_pylist(), batch.column("us").to_pylist()):
                data = open_.decompress(z)
                for u in units:
                    for column, value in zip(out, (u["anchor"], u["unit"], u["n"], u["hot"], data[u["first"] : u["first"] + u["windows"] + LENGTH - 1])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return held.select("z", "us").mapInArrow(cut, "anchor bigint, unit bigint, n bigint, hot boolean, data binary")


_MARKS = "anchor bigint, unit bigint, froms array<int>, tos array<int>"


def _indexed(units: DataFrame, buckets: int) -> DataFrame:
    def mark(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["anchor", "unit"])
        out = []
        for anchor, unit, n, found in zip(group["anchor"], group["unit"], group["n"], repeated_windows(list(group["data"]))):
            if n == 1 and len(found):
                out.append((anchor, unit, *_runs(found)))
        return pd.DataFrame(out, columns=["anchor", "unit", "froms", "tos"])

    dealt = units.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(mark, _MARKS)


def _counted(units: DataFrame) -> DataFrame:
    """The same for hot anchors: windows by hash."""

    def read(batches):
        reader = Reader()
        for batch in batches:
            found = [reader.windows(u) for u in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("anchor", "unit", "n")), pa.array(found, pa.list_(pa.int64()))], names=["anchor", "unit", "n", "hs"]
            )

    windows = units.mapInArrow(read, "anchor bigint, unit bigint, n bigint, hs array<bigint>")
    windows = written(windows.select("anchor", "unit", "n", F.posexplode("hs").alias("i", "h")), "windows")
    several = windows.groupBy("anchor", "h").agg(F.sum("n").alias("k")).where("k > 1").select(F.col("anchor").alias("a"), F.col("h").alias("w"))
    met = windows.where("n = 1").join(several, (F.col("anchor") == F.col("a")) & (F.col("h") == F.col("w")))
    places = met.groupBy("anchor", "unit").agg(F.sort_array(F.collect_list("i")).alias("froms"))
    return places.select("anchor", "unit", "froms", F.transform("froms", lambda i: i + 1).alias("tos"))


def _marks(docs: DataFrame, hot: int) -> DataFrame:
    """``doc_id, th, marks``: for rows with repeated windows, where they are."""
    placed = _placed(docs)
    # a table of its own: a join straight above a grouping by the same key cannot be split where a key is hot
    several = written(placed.groupBy("anchor").count().where("count > 1").select(F.col("anchor").alias("a")), "anchors")
    placed = written(placed.join(several, F.col("anchor") == F.col("a")).drop("a"), "units")
    holder = F.min(F.struct("doc_id", "th", "first", "windows")).alias("at")
    units = written(placed.groupBy("anchor", "unit").agg(F.count("*").alias("n"), holder), "units")
    kinds = units.groupBy("anchor").count().where("count > 1").select(F.col("anchor").alias("a"), (F.col("count") > hot).alias("hot"))
    chosen = units.join(kinds, F.col("anchor") == F.col("a")).select("at.*", "anchor", "unit", "n", "hot")
    held = written(_bytes_of(chosen, docs), "bytes")
    size = held.where("not hot").agg(F.sum(F.length("data"))).first()[0] or 0
    whole = units.where("n > 1").select(
        "anchor", "unit", F.array(F.lit(0)).alias("froms"), F.array(F.col("at.windows")).alias("tos")
    )
    marks = whole.union(_indexed(held.where("not hot"), size // BUCKET + 1)).union(_counted(held.where("hot")))
    marks = written(marks, "marks").withColumnsRenamed({"anchor": "a", "unit": "u"})
    met = placed.join(marks, (F.col("anchor") == F.col("a")) & (F.col("unit") == F.col("u")))
    return met.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "froms", "tos")).alias("marks"))


def covered(size: int, marks: list[dict] | None) -> np.ndarray:
    """Which bytes of a text the marked windows cover."""
    depth = np.zeros(size + 1, np.int32)
    for m in marks or ():
        np.add.at(depth, m["first"] + np.array(m["froms"]), 1)
        np.add.at(depth, m["first"] + np.array(m["tos"]) + LENGTH - 1, -1)
    return np.cumsum(depth[:-1]) > 0


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row of ``docs``."""
    rows = on_key(_packed(docs), _marks(docs, hot), "left")

    def cut(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for z, marks in zip(batch.column("z").to_pylist(), batch.column("marks").to_pylist()):
                data = open_.decompress(z)
                gone = covered(len(data), marks)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if marks else data
                spans = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1))
                for column, value in zip(out, (len(data), len(data) - len(kept), spans, kept)):
                    column.append(value)
            numbers = [pa.array(c, pa.int64()) for c in out[:3]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(out[3], pa.binary())], names=names)

    return rows.select("doc_id", "z", "marks").mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digest(found: DataFrame) -> DataFrame:
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
