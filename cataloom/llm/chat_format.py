r"""Chat formatting with a grammar round trip.

A turn is its opening mark, its text and its closing mark (``MARKS``; a role without marks of its own is named in the turn). A
conversation is its turns, one behind the other. The grammar is deterministic: what stands at the beginning of a turn names its
kind, and the first control string behind it has to be the closing mark, else the text does not parse.

Turns are rendered as they are, the rendered text is parsed again, and the turns recovered are compared with the source. Texts that
are not recovered are escaped (a backslash behind the bracket of each control string, one more where there are some already, so that
taking one away gives the text back) until the turns are identical. Texts without conflicts stay untouched.

``format_conversations`` gives each conversation as one or more *parts* of about ``PART_CHARS`` characters, cut between turns, with
the spans that count for the loss (the texts of assistant turns). Conversations are dealt by ranges of (conversation, turn), so
one of any length is rendered, parsed and escaped by many tasks, and each task holds one part. ``read_back`` parses the parts and takes
the digests: in place, where a part is a whole conversation; those cut at a range's end or by length move once, and a task streams
their parts in order (a SHA-256 has no parallel form), one part at a time.

A null role or text is empty. Turns are in order of ``turn`` (null first; ties: role, hash of the text); equal rows are turns of their
own. Rows without a conv_id are a conversation with the id null. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.turns import cleaned, in_order

MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
#: Any other role: its name, a line end, the text.
NAMED = ("[TURN] ", " [/TURN]")
LOSS_ROLE = "assistant"
PART_CHARS = 1 << 20

CONTROL = re.compile(r"<</?SYS>>|</?s>|\[/?(?:INST|TURN)\]")
_ESCAPE = re.compile(r"<<(?=\\*/?SYS>>)|<(?=\\*/?s>)|\[(?=\\*/?(?:INST|TURN)\])")
_UNESCAPE = re.compile(r"(<<(?=\\+/?SYS>>)|<(?=\\+/?s>)|\[(?=\\+/?(?:INST|TURN)\]))\\")

Turn = tuple[str, str]


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def _name(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def render(roles: list[str], bodies: list[str]) -> str:
    out = []
    for role, body in zip(roles, bodies):
        head, tail = MARKS.get(role, NAMED)
        out += (head, body, tail) if role in MARKS else (head, _name(role), "\n", body, tail)
    return "".join(out)


class NotChat(ValueError):
    """The text does not follow the grammar."""


def parse(text: str) -> list[tuple[str, int, int]]:
    """``(role, from, to)`` of each turn: where its text, still escaped, stands."""
    found, at = [], 0
    while at < len(text):
        role, (head, tail) = next(((r, m) for r, m in [*MARKS.items(), ("", NAMED)] if text.startswith(m[0], at)), ("", ("", "")))
        if not head:
            raise NotChat(f"no turn begins at {at}")
        begin = at + len(head)
        mark = CONTROL.search(text, begin)
        end = mark.start() - CONTROL.search(tail).start() if mark else -1
        if end < begin or not text.startswith(tail, end):
            raise NotChat(f"the turn at {at} does not end")
        at = end + len(tail)
        if not role:
            line = text.find("\n", begin, end)
            if line < 0:
                raise NotChat(f"a turn without a role ends at {end}")
            role = unescape(text[begin:line]).replace("%0A", "\n").replace("%25", "%")
            begin = line + 1
        found.append((role, begin, end))
    return found


def recovered(text: str) -> list[Turn] | None:
    """The turns that a rendered text stands for; none if it has no meaning."""
    try:
        return [(role, unescape(text[a:b])) for role, a, b in parse(text)]
    except NotChat:
        return None


def settle(turns: list[Turn]) -> str:
    """The rendered turns, escaped where the round trip asks for it."""
    roles, bodies = [r for r, _ in turns], [t for _, t in turns]
    shown = render(roles, bodies)
    if recovered(shown) != turns:
        bodies = [t if recovered(render([r], [t])) == [(r, t)] else escape(t) for r, t in turns]
        shown = render(roles, bodies)
        if recovered(shown) != turns:
            raise AssertionError("escaped turns are not recovered")
    return shown


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_PARTS = "conv_id bigint, place bigint, whole boolean, n_turns bigint, formatted string, loss array<struct<start: bigint, end: bigint>>"


def _part(turns: list[Turn]) -> tuple[int, str, list[dict]]:
    shown = settle(turns)
    return len(turns), shown, [{"start": a, "end": b} for role, a, b in parse(shown) if role == LOSS_ROLE]


def _join_parts(batches):
    """Sorted turns to parts. The first and the last conversation of a task may go on elsewhere, so they are never ``whole``."""
    from pyspark import TaskContext

    place = TaskContext.get().partitionId() << 33
    turns: list[Turn] = []
    held: list[tuple] = []  # the last part of a conversation, until it is known whether more follows
    now, chars, parts, first = None, 0, 0, True

    def rows(found):
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), _SPANS]
        names = [f.split()[0] for f in _PARTS.split(", ", 5)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    started = False
    for batch in batches:
        out, size = [], 0
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if started and (conv != now or chars >= PART_CHARS):
                whole = conv != now and parts == 0 and not first
                place += 1
                out.append((now, place, whole, *_part(turns)))
                size += chars
                parts, first = (0, False) if conv != now else (parts + 1, first)
                turns, chars = [], 0
                if size >= PART_CHARS:
                    yield rows(out)
                    out, size = [], 0
            started, now = True, conv
            turns.append((role, text))
            chars += len(text)
        if out:
            yield rows(out)
    if started:
        yield rows([(now, place + 1, False, *_part(turns))])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, whole, n_turns, formatted, loss``: the parts of each conversation in order of ``place``.

    ``loss`` holds the spans (code points of ``formatted``, end exclusive) of the assistant's texts; ``whole`` says that the part is
    known to be all of its conversation.
    """
    return in_order(cleaned(conversations)).select("conv_id", "role", "text").mapInArrow(_join_parts, _PARTS)


_READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _read(batches):
    """Digests of the conversations of sorted parts."""
    now, started = None, False
    state: list = []

    def fresh():
        return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

    def rows(found):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [f.split()[0] for f in _READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    def ended():
        return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    for batch in batches:
        out = []
        for conv, shown, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
            if not started or conv != now:
                if started:
                    out.append(ended())
                now, started, state = conv, True, fresh()
            for role, a, b in parse(shown):
                state[0] += 1
                state[1].update(f"{role}\n{unescape(shown[a:b])}\n".encode())
            for span in loss:
                text = unescape(shown[span["start"] : span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(shown)
        if out:
            yield rows(out)
    if started:
        yield rows([ended()])


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says: turns, the text under the loss mask, and their digests.

    Read from a table of parts (they are read twice).
    """
    rows = parts.select("conv_id", "place", "whole", "formatted", "loss")
    cut = rows.where(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    # every whole part is a conversation, so their order does not matter
    return rows.where("whole").mapInArrow(_read_each, _READ).unionByName(cut.mapInArrow(_read, _READ))


def _read_each(batches):
    for batch in batches:
        yield from _read(iter([batch]))
