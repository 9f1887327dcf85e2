"""Line dedup by overlapping three-line windows.

A text is cut at line feeds. Every run of three consecutive lines is a window; windows with the same lines are equal. The
first of equal windows (by doc_id, null first, then by the hash of the text, then by place) stays; the three lines of every
later one are covered, overlapping cover is merged, and covered lines are removed. What repeats is judged on the input, so an
exact copy of a text with three lines or more loses all its lines, and its text becomes empty; texts of fewer lines are kept.

Lines are compared exactly, blank ones included. A null text stays null, with 0 lines; an empty text is one blank line. Rows
equal in doc_id and text count as one document: both lose the same lines. Extra columns are untouched: ``dedup_lines`` reads
``doc_id`` and ``text`` only, ``apply`` keeps all columns and replaces ``text`` and ``n_chars``.

Only hashes of lines travel to find repeats: map tasks combine equal windows before the shuffle, so a window that a third of
all documents share is a few rows; the join back is a sort-merge join whose hot keys Spark splits. Texts move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import aside, keyed, on_key, written

WINDOW = 3


def _with(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, also where ``fn`` uses it inside a lambda."""
    return F.transform(F.array(value), fn)[0]


def windows(docs: DataFrame) -> DataFrame:
    """``doc_id, th, pos, w1, w2``: every window by its place and two hashes of its lines."""

    def triples(h: Column) -> Column:
        n = F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))
        return F.arrays_zip(*(F.slice(h, k + 1, n).alias(f"l{k}") for k in range(WINDOW)))

    hashed = F.transform(F.split("text", "\n", -1), lambda line: F.xxhash64(line))
    found = keyed(docs).where("text is not null").select("doc_id", "th", F.posexplode(_with(hashed, triples)).alias("pos", "w"))
    lines = [F.col("w")[f"l{k}"] for k in range(WINDOW)]
    return found.select("doc_id", "th", "pos", F.xxhash64(*lines).alias("w1"), F.xxhash64(F.lit("w"), *lines).alias("w2"))


def later_windows(docs: DataFrame) -> DataFrame:
    """``doc_id, th, starts``: where windows start that another one equals and comes before; sorted."""
    place = F.struct("doc_id", "th", "pos")
    found = windows(docs)
    first = found.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # a table of its own: a join straight above a grouping by the same key cannot be split where a key is hot
    repeated = written(first.where("first <> last").select(F.col("w1").alias("r1"), F.col("w2").alias("r2"), "first"), "repeated")
    later = found.join(repeated, (F.col("w1") == F.col("r1")) & (F.col("w2") == F.col("r2")) & (place != F.col("first")))
    return later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def _kept(lines: Column) -> Column:
    """The lines outside the merged cover of the windows at ``starts``."""
    at = F.col("starts")
    head = F.filter(at, lambda x, i: (i == 0) | (x - at[i - 1] > WINDOW))
    tail = F.transform(F.filter(at, lambda x, i: (i == F.size(at) - 1) | (at[i + 1] - x > WINDOW)), lambda x: x + WINDOW)
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0)), tail).alias("b"), F.concat(head, F.array(F.size(lines))).alias("e"))
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["b"] + 1, g["e"] - g["b"])))


def _applied(docs: DataFrame) -> DataFrame:
    kept = _with(F.split("text", "\n", -1), _kept)
    with_starts = on_key(docs, later_windows(docs), "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    out = with_starts.select(
        *docs.columns, n_lines.alias("__n"), F.when(F.col("starts").isNull(), None).otherwise(kept).alias("__kept")
    )
    text = F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n"))
    removed = F.when(F.col("__kept").isNull(), 0).otherwise(F.col("__n") - F.size("__kept"))
    return out.withColumns({"__text": text, "__removed": removed})


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` for every row: the text without covered lines."""
    found = _applied(keyed(docs))
    return found.select(
        "doc_id", F.col("__text").alias("text"), F.col("__n").cast("bigint").alias("n_lines"),
        F.col("__removed").cast("bigint").alias("n_removed"),
    )


def apply(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining text, its columns unchanged but for ``text`` and ``n_chars``."""
    renamed, names, _ = aside(docs, ("doc_id", "text"))
    found = _applied(renamed.withColumn("th", F.xxhash64("text")))
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("bigint")}
    return found.select(*(new.get(c, F.col(n)).alias(c) for n, c in zip(names, docs.columns)))
