"""Ranked keywords per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions.names import OTHERS
from cataloom.functions.text import keyword_string
from cataloom.operators.tokens import lexicon_lookup, token_filter, tokens

TOP_KEYWORDS = 20


def keyword_eligible(files: DataFrame) -> DataFrame:
    """Files that get keywords: some preview, and a category other than ``Others``."""
    return files.where((F.col("preview") != "") & (F.col("category") != OTHERS))


def term_frequency(rows: DataFrame) -> DataFrame:
    """``(path, lemma, n, first_pos)``; partial counts are made before any shuffle."""
    return rows.groupBy("path", "lemma").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos")
    )


def word_frequency(rows: DataFrame) -> DataFrame:
    """``(path, text, times, pos)``: each word of a file once, with its first place."""
    return rows.groupBy("path", "text").agg(F.count("*").alias("times"), F.min("pos").alias("pos"))


def rank_keywords(counts: DataFrame, k: int = TOP_KEYWORDS) -> DataFrame:
    """The ``k`` most frequent lemmas per file; the one seen first wins a tie."""
    order = Window.partitionBy("path").orderBy(F.desc("n"), "first_pos")
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("path", F.col("rank").cast("long").alias("rank"), F.col("lemma").alias("keyword"), "n", "first_pos")
    )


def top_keywords(texts: DataFrame, lexicon: DataFrame, k: int = TOP_KEYWORDS) -> DataFrame:
    """``(path, rank, keyword, n, first_pos)`` from ``(path, preview)``.

    Hand in previews partitioned by ``path``, as ``previews`` and
    ``dispatch_text`` make them: counting and ranking then find their rows in
    place. (A preview is several times smaller than its counted tokens, so it
    is the preview that should move.) Other partitionings work too and cost a
    shuffle of the counts.
    """
    # a word is looked up once for each file that has it
    rows = token_filter(lexicon_lookup(word_frequency(tokens(texts)), lexicon))
    counts = rows.groupBy("path", "lemma").agg(F.sum("times").alias("n"), F.min("pos").alias("first_pos"))
    return rank_keywords(counts, k)


def keyword_strings(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(path, keywords)`` with one comma-joined string per file, ``''`` where there are none."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "keyword"))).getField("keyword")
    gathered = keywords.groupBy("path").agg(keyword_string(ordered).alias("keywords"))
    return (
        texts.select("path")
        .join(gathered, "path", "left")
        .withColumn("keywords", F.coalesce("keywords", F.lit("")))
    )
