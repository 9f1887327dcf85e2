"""Token counts of whole texts by overlap resynchronisation.

A text of up to ``CHUNK`` characters is encoded at once. A longer one is encoded in chunks that overlap; each chunk's
token ends are offsets in the text, and neighbours are spliced at an end that both have and that is *stable*: a
character that is no white space stands before it and white space after it. The tokenizer cuts words there whatever
surrounds them, so what stands left of such a place cannot change what stands right of it. If the overlap holds no such
end, it is doubled, up to the rest of the text.

Within a chunk the encoder itself uses the same fact: the pieces between stable places are encoded once and remembered
(at most ``MEMO`` of them).

Null text counts as empty: 0 bytes, 0 tokens. Rows are independent, so repeated rows, ties and extra columns change
nothing; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, MEMO = 32_768, 256, 600_000
#: White space, or what some pattern takes for it, besides the four of _PIECE.
_ODD = r"\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_LETTER, _SIGN, _WHITE = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ʯ", r"!-&(-/:-@\[-`{-~", r" \t\n\r"
#: White space, then letters up to a sign, signs up to a letter, or all up to white space. A tokenizer's pattern cuts at
#: all these places; the apostrophe is no sign here, since 's and the like stay together.
_PIECE = re.compile(
    f"[{_WHITE}]*+(?:[{_LETTER}]++(?=[{_SIGN}{_WHITE}]|\\Z)|[{_SIGN}]++(?=[{_LETTER}{_WHITE}]|\\Z)|[^{_WHITE}]++|\\Z)"
)
_HAS_ODD = re.compile(f"[{_ODD}]")
_PLAIN = {" ", "\t", "\n", "\r"}
_SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
_ENCODERS: dict[str, "Encoder"] = {}  # one for each worker process


class Encoder:
    """Token counts and token ends of a text by a tokenizer file, with remembered pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: texts that are encoded as they are: odd white space, or strings of added tokens
        self.whole = re.compile("|".join([f"[{_ODD}]", *added]))
        self.counts: dict[str, int] = {}
        self.offsets: dict[str, tuple[int, ...]] = {}

    def _learn(self, memo: dict, pieces: list[str], value: Callable) -> None:
        lacking = list({p for p in pieces if p not in memo})
        if len(memo) + len(lacking) > MEMO:
            memo.clear()
            lacking = list(set(pieces))
        for at in range(0, len(lacking), 20_000):
            part = lacking[at : at + 20_000]
            memo.update(zip(part, map(value, self.tokenizer.encode_batch(part, add_special_tokens=False))))

    def ends(self, text: str) -> list[int]:
        """Where each token of ``text`` ends, in characters."""
        if self.whole.search(text):
            return [end for _, end in self.tokenizer.encode(text, add_special_tokens=False).offsets]
        pieces = _PIECE.findall(text)
        self._learn(self.offsets, pieces, lambda e: tuple(end for _, end in e.offsets))
        out: list[int] = []
        for piece, at in zip(pieces, accumulate(map(len, pieces), initial=0)):
            out.extend([at + end for end in self.offsets[piece]])
        return out

    def count(self, text: str) -> int:
        """Tokens of a text that fits a chunk."""
        if self.whole.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        pieces = _PIECE.findall(text)
        try:
            return sum(map(self.counts.__getitem__, pieces))
        except KeyError:
            self._learn(self.counts, pieces, len)
            return sum(map(self.counts.__getitem__, pieces))


def stable(text: str, at: int) -> bool:
    """Is ``at`` a place that the tokenizer always cuts?"""
    before, after = text[at - 1 : at], text[at : at + 1]
    return bool(before) and after in _PLAIN and not before.isspace() and not _HAS_ODD.match(before)


def spliced_count(text: str, ends: Callable[[str], list[int]], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length; ``ends(part)`` gives the token ends of a part, as offsets in it."""
    total, begin, size = 0, 0, chunk
    while True:
        stop = begin + size
        left = ends(text[begin:stop])
        if stop >= len(text):
            return total + len(left)
        wide, place = overlap, None
        while place is None and wide <= size:
            # the head of the next chunk, which starts `wide` before this one ends
            start = stop - wide
            right = {start - begin + e for e in ends(text[start : stop + wide])}
            low = bisect_right(left, start - begin)
            place = next((e for e in reversed(left[low:]) if begin + e < stop and e in right and stable(text, begin + e)), None)
            wide *= 2
        if place is None:
            size *= 2
            continue
        total += bisect_right(left, place)
        begin, size = begin + place, chunk


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def count_tokens(
    docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``path`` is the tokenizer file, readable at the same place on every executor.
    """

    def count(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = _encoder(path)
        for batch in batches:
            found = batch.column("text").to_pylist()
            tokens = [
                0 if not t else encoder.count(t) if len(t) <= chunk else spliced_count(t, encoder.ends, chunk, overlap)
                for t in found
            ]
            size = pc.fill_null(pc.cast(pc.binary_length(batch.column("text")), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, _SCHEMA)
