"""The order of conversation turns, for operators that read them in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ``conv_id``, then ``turn`` (null first); ties by role and by a hash of the text, so that reruns agree.
ORDER = [F.asc_nulls_first, F.asc_nulls_first, F.asc, F.asc]
KEYS = ["conv_id", "turn", "role", "th"]


def cleaned(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, th``; a null role or text is empty."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    return rows.withColumn("th", F.xxhash64("text"))


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by ranges of KEYS and sorted in each: a conversation of any length is split over as many tasks as it needs."""
    keys: list[Column] = [how(name) for how, name in zip(ORDER, KEYS)]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
