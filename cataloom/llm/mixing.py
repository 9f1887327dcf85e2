"""Mixing sources to target weights over a curriculum that changes with time.

Every source has a target number of words and a weight schedule over the training time 0..1. Schedules are straight
lines around 1 (``1 + slope * (2 t - 1)``; the slopes of SLOPES repeat over the sources), so the words a source has been
asked for up to time t are ``target * (t + slope * (t * t - t))``. The documents of a source stand in an order given by a
hash; a document that takes the words ``[from, to)`` of its source's stream is read when the demand reaches their middle:
its *position* is that integral, inverted. A stream runs over the source once or twice (targets stop at ``CAP`` times the
source's size), so a document has up to two positions. Documents are then range-sorted by position.

Words up to a document are summed in two steps, within ``BUCKETS`` ranges of the hash and over the ranges, so no task
holds a source. ``taken`` is exact: the words taken from a source add up to its target, rounded.

Targets: the sources in code point order, null last, weigh 3, 1, 2, repeating; they share 150 % of all words by weight; where
that is above ``CAP`` times a source's words, the target stops there and the rest is shared again by weight. That is one level
for all uncapped sources, found by one pass over the sources in order of words per weight (one narrow row for each source).

Null and empty texts have size 0 and take nothing; rows with a null doc_id or equal rows are kept, each counts by itself (ties
of the hash are taken in order of id, size and text hash, so only equal rows can be exchanged). An empty table gives an
empty result. Only ``doc_id, text, source`` are read; ``mix`` keeps the columns it is asked to keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm.common import WORD, written

WEIGHTS, SHARE, CAP, SLOPES, BUCKETS = (3, 1, 2), 1.5, 2, (0.0, -0.5, 0.5), 1024


def words_in(text: str = "text") -> Column:
    """How many words a text has (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight, slope, target`` from one row ``source, source_size`` for each source."""
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("place") % len(values) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": of(WEIGHTS), "slope": of(SLOPES)})
    # sources that reach their cap first come first; `rest` and `left` are what the others still share
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = ranked.withColumns(
        {
            "rest": F.sum("source_size").over(every) * SHARE - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("level", F.col("rest") / F.col("left"))
    open_ = F.col("level") * F.col("weight") <= CAP * F.col("source_size")
    level = F.min(F.when(open_, F.struct(F.col("source_size") / F.col("weight"), "place", "level"))).over(every)["level"]
    filled = filled.withColumn("common", level)
    target = F.least(F.col("common") * F.col("weight"), F.col("source_size") * F.lit(float(CAP)))
    return filled.select("source", "source_size", "weight", "slope", F.coalesce(target, F.col("source_size") * float(CAP)).alias("target"))


def _position(at: Column) -> Column:
    """The time at which a share ``at`` of a source's words has been asked for: the demand, inverted."""
    s = F.col("slope")
    # slope * t^2 + (1 - slope) * t - at = 0
    root = (F.sqrt((1 - s) * (1 - s) + 4 * s * at) - (1 - s)) / (2 * s)
    return F.when(s == 0, at).otherwise(root)


def mix(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row with ``size, source_size, target, taken, position, again`` in the order of the mix.

    Columns of the operator replace those of ``docs`` with the same name. ``position`` is when the document is first read (null: never), ``again`` when it is read once more.
    """
    keep = [c for c in keep if c not in ("size", "source_size", "target", "taken", "position", "again")]
    extra = [c for c in keep if c not in ("doc_id", "source")]
    # 60 bits of a digest, which other engines have too
    order = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    rows = docs.select("doc_id", "source", words_in().alias("size"), order.alias("o"), F.xxhash64("text").alias("th"), *[F.col(c).alias(f"k_{c}") for c in extra])
    rows = rows.withColumn("bucket", F.shiftright("o", 60 - (BUCKETS.bit_length() - 1)))
    sums = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(ahead), F.lit(0))).join(
        plan.withColumnRenamed("source", "p"), F.col("source").eqNullSafe(F.col("p")), "inner"
    )
    starts = written(starts.select(F.col("source").alias("p"), F.col("bucket").alias("b"), "start", "source_size", "slope", "target"), "starts")
    within = Window.partitionBy("source", "bucket").orderBy("o", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        starts, F.col("source").eqNullSafe(F.col("p")) & (F.col("bucket") == F.col("b")), "inner"
    )
    begin, wanted = F.col("start") + F.col("ahead"), F.round("target").cast("bigint")
    take = lambda at: F.greatest(F.least(F.col("size"), wanted - at), F.lit(0))
    once, more = take(begin), take(begin + F.col("source_size"))
    when = lambda at, n: F.when(n > 0, _position(F.least((at + n / 2) / wanted, F.lit(1.0))))
    found = placed.select(
        "doc_id", "source", *[F.col(f"k_{c}").alias(c) for c in extra], "size", "source_size", "target",
        (once + more).alias("taken"), when(begin, once).alias("position"), when(begin + F.col("source_size"), more).alias("again"),
    )
    return found.select(*keep, "size", "source_size", "target", "taken", "position", "again").orderBy(
        F.asc_nulls_last("position"), "doc_id"
    )
