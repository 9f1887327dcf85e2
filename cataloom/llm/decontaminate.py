"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of words (A-Z lower-cased). A text holds an item of ``n`` words if some stretch of it is at
most ``floor(RATE * n)`` word edits from the item.

0. *Parts.* CGK's Hamming distance grows with the square of the edits, so an item of more than ``PART`` words is cut into equal
   parts of at most ``PART`` words. If every part had more than ``RATE`` of its words edited, so had the item; so at least one
   part is within its own ``floor(RATE * m)`` edits in every stretch sought, and recall does not fall with the length of items.
1. *Windows.* A part is cut into one piece more than the edits it may have, so one piece stays whole in every stretch sought.
   Where a piece occurs in a text, the windows of ``m`` words that would put it at its place, shifted by up to the edits
   allowed, are looked at. This loses no stretch, and most texts have no window at all.
2. *Embedding.* In each of ``WALKS`` repetitions a random walk (Chakraborty, Goldenberg, Koucky) reads a window: step j puts out
   the word it stands on and moves on or stays by a random bit of (j, word). Few edits become few differing outputs.
3. *LSH.* A repetition samples ``BITS`` places of the output and hashes the words there; a window and a part of the same length
   that share a hash in any repetition are a candidate pair. ``WALKS``, ``BITS`` and ``PART`` are set for a recall of 0.95 or more
   at the full edit rate (measured in the tests by length and kind of edit; unedited copies are always found).
4. *Verification.* The least edit distance between the whole item and any stretch around the place that the window gives it, by
   dynamic programming, broken off once it is beyond the edits allowed.

Items travel in blocks of at most ``BLOCK_WORDS`` words (about 100 MB with their tables): the benchmark is read block by block
and each block is one more step in the same pass over the texts, with a broadcast of that bounded size. Texts are never shuffled,
so a passage that many documents share costs each of them its own check and no more.

Null and empty texts hold nothing. Null, empty and wordless items match nothing; items with equal text are all reported. An empty
benchmark leaves every text clean. Rows are independent, so repeated rows get equal results; extra columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cataloom.llm.common import BASE, MIX1, U64, aside, mix, texts, words

RATE, WALKS, BITS, PART, BLOCK_WORDS = 0.2, 40, 3, 48, 2_000_000
_FILTER_BITS = 20
HIT = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.LongType()) for n in ("item_id", "first_word", "last_word", "edits")]
    )
)
_HIT = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "first_word", "last_word", "edits")]))


def allowed(n: int) -> int:
    return int(RATE * n)


def parts(n: int) -> list[tuple[int, int]]:
    """Where the parts of an item of n words begin and end."""
    k = -(-n // PART)
    return [(i * n // k, (i + 1) * n // k) for i in range(k)]


def grams(found: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order."""
    if len(found) < size:
        return np.zeros(0, U64)
    total = np.full(len(found) - size + 1, U64(size), U64)
    for k in range(size):
        total = (total + found[k : len(found) - size + 1 + k]) * BASE
    return mix(total)


def _draws(n: int) -> np.ndarray:
    """The sampled places of each repetition, within the first n steps (about half a window, where fewer edits were met)."""
    of = np.arange(WALKS, dtype=U64)[:, None] * U64(1000) + U64(n)
    return np.sort((mix(np.arange(BITS, dtype=U64) * BASE + mix(of)) % U64(max(n, 1))).astype(np.int64), axis=1)


def embed(windows: np.ndarray, steps: int) -> Iterator[np.ndarray]:
    """CGK outputs of windows of equal length, step by step (rows x WALKS); every other walk reads backwards.

    Past the end a walk puts out 0.
    """
    rows, n = windows.shape
    padded = np.zeros((2, rows, n + 1), U64)
    padded[0, :, :n], padded[1, :, :n] = windows, windows[:, ::-1]
    way, row = np.arange(WALKS)[None, :] % 2, np.arange(rows)[:, None]
    flat, base = padded.ravel(), (way * rows + row) * (n + 1)
    at = np.zeros((rows, WALKS), np.int64)
    salts = mix(np.arange(steps, dtype=U64)[:, None] * BASE + mix(np.arange(WALKS, dtype=U64)))
    for j in range(steps):
        word = flat[base + at]
        yield word
        at = np.minimum(at + ((word ^ salts[j]) * MIX1 >> U64(63)).astype(np.int64), n)


def signatures(windows: np.ndarray) -> np.ndarray:
    """LSH hashes (rows x WALKS) of windows of equal length; holds one step of the walks at a time."""
    draws = _draws(windows.shape[1])
    total = np.tile(np.arange(1, WALKS + 1, dtype=U64), (len(windows), 1))
    for j, word in enumerate(embed(windows, int(draws.max()) + 1)):
        for k in range(BITS):  # the draws of a walk ascend
            walks = np.flatnonzero(draws[:, k] == j)
            total[:, walks] = (total[:, walks] + word[:, walks]) * BASE
    return mix(total)


def best_stretch(item: np.ndarray, text: np.ndarray, most: int | None = None) -> tuple[int, int, int]:
    """The least edit distance of ``item`` to any stretch of ``text``, and that stretch (first, last exclusive).

    Where it is above ``most``, any number above ``most``.
    """
    m = len(text)
    cost, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i, word in enumerate(item):
        swap = np.append(np.int64(i + 1), cost[:-1] + (text != word))
        drop = cost + 1
        start = np.append(begin[:1], begin[:-1])
        step = np.where(drop < swap, drop, swap)
        origin = np.where(drop < swap, begin, start)
        # insertions: running minimum of step - place
        level = step - np.arange(m + 1)
        low = np.minimum.accumulate(level)
        first = np.maximum.accumulate(np.where(np.append(True, level[1:] < low[:-1]), np.arange(m + 1), 0))
        cost, begin = low + np.arange(m + 1), origin[first]
        if most is not None and cost.min() > most:  # it never falls again
            break
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


class Block:
    """Items with the tables to find them."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.parts = [(i, a, b - a) for i, (_, found) in enumerate(items) for a, b in parts(len(found))]
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        by_length: dict[int, list[int]] = {}
        for part, (i, begin, n) in enumerate(self.parts):
            found = items[i][1][begin : begin + n]
            pieces = allowed(n) + 1
            size = n // pieces
            all_grams = grams(found, size)
            for p in range(pieces):
                offset = p * n // pieces
                seeds.setdefault(size, []).append((int(all_grams[offset]), part, offset))
            by_length.setdefault(n, []).append(part)
        self.seeds = {}
        for size, rows in seeds.items():
            rows.sort()
            self.seeds[size] = (np.array([r[0] for r in rows], U64), np.array([r[1:] for r in rows], np.int64))
        self.signs = {}
        for n, members in by_length.items():
            held = (self.parts[part] for part in members)
            signs = signatures(np.stack([items[i][1][begin : begin + n] for i, begin, _ in held]))
            order = np.argsort(signs.ravel(), kind="stable")
            self.signs[n] = (signs.ravel()[order], np.repeat(np.array(members), WALKS)[order])

    def prepared(self) -> Block:
        """With filters over the seeds; made in the task."""
        self.filters = {}
        for size, (hashes, _) in self.seeds.items():
            self.filters[size] = np.zeros(1 << _FILTER_BITS, bool)
            self.filters[size][(hashes >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return self

    def _starts(self, found: np.ndarray) -> dict[int, np.ndarray]:
        """By part length: where windows of the text start that hold a whole piece of a part at its place."""
        starts: dict[int, list[np.ndarray]] = {}
        for size, (hashes, places) in self.seeds.items():
            run = grams(found, size)
            at = np.flatnonzero(self.filters[size][(run >> U64(64 - _FILTER_BITS)).astype(np.int64)])
            if not len(at):
                continue
            low, high = np.searchsorted(hashes, run[at], "left"), np.searchsorted(hashes, run[at], "right")
            for p, a, b in zip(at[high > low], low[high > low], high[high > low]):
                for part, offset in places[a:b]:
                    n = self.parts[part][2]
                    k = allowed(n)
                    starts.setdefault(n, []).append(np.arange(p - offset - k, p - offset + k + 1))
        return {n: np.unique(np.clip(np.concatenate(s), 0, max(0, len(found) - 1))) for n, s in starts.items()}

    def hits(self, text: bytes | None) -> list[dict]:
        """Items held by a text; each once, at its best stretch (ties: the first)."""
        found = words(text)
        if not len(found):
            return []
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for n, starts in self._starts(found).items():
            # a window that reaches beyond the text is filled up with 0
            padded = np.concatenate([found, np.zeros(n, U64)])
            table, members = self.signs[n]
            for at in range(0, len(starts), 512):
                begin = starts[at : at + 512]
                signs = signatures(padded[begin[:, None] + np.arange(n)])
                low, high = np.searchsorted(table, signs, "left"), np.searchsorted(table, signs, "right")
                for row, walk in zip(*np.nonzero(high > low)):
                    for part in members[low[row, walk] : high[row, walk]]:
                        i, offset, _ = self.parts[part]
                        item = self.items[i][1]
                        # neighbouring windows, and the parts of one item, reach the same stretches
                        k = allowed(len(item))
                        near = (i, (int(begin[row]) - offset) // (k + 1))
                        if near in tried:
                            continue
                        tried.add(near)
                        left = near[1] * (k + 1) - k
                        right, left = max(0, left + len(item) + 4 * k + 1), max(0, left)
                        edits, first, last = best_stretch(item, found[left:right], k)
                        if edits <= k and (i not in best or (edits, left + first) < best[i][:2]):
                            best[i] = (edits, left + first, left + last)
        return [
            {"item_id": self.items[i][0], "first_word": a, "last_word": b, "edits": e} for i, (e, a, b) in sorted(best.items())
        ]


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, one after the other."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").sort("item_id", "text").toLocalIterator():
        found = words(row.text.encode())
        if not len(found):
            continue
        if held and size + len(found) > BLOCK_WORDS:
            yield Block(held)
            held, size = [], 0
        held.append((row.item_id, found))
        size += len(found)
    if held:
        yield Block(held)


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``hits`` (an array, empty for clean texts) for every row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    carried = docs.select(*keep, *({"text"} - set(keep)))
    names = carried.columns
    schema = T.StructType([*carried.schema.fields, T.StructField("__hits", HIT)])

    def step(shared):
        def look(batches):
            if shared is not None:
                block = Block.__new__(Block)
                block.items, block.parts, block.seeds, block.signs = shared.value
                block.prepared()
            for batch in batches:
                old = batch.column("__hits").to_pylist() if "__hits" in batch.schema.names else [[]] * batch.num_rows
                new = [a + block.hits(t) for a, t in zip(old, texts(batch))] if shared is not None else old
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(new, _HIT)], names=[*names, "__hits"])

        return look

    found, any_block = carried, False
    for block in blocks(benchmark):
        found = found.mapInArrow(step(sc.broadcast((block.items, block.parts, block.seeds, block.signs))), schema)
        any_block = True
    if not any_block:
        found = found.mapInArrow(step(None), schema)
    return found.select(*keep, found["__hits"].alias("hits"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    renamed, names, back = aside(docs, ("text",))
    return find(renamed, benchmark, names).where("size(hits) = 0").select(*back)
