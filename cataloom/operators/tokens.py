"""Tokens of a preview, their lexicon entries and the keyword filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions.text import words

# The tags, the generic words and the shortest length of a keyword.
KEYWORD_TAGS = ["NOUN", "PROPN", "VERB", "ADJ"]
TARGET_TAGS = ["NOUN", "PROPN"]
GENERIC_WORDS = ["page", "date", "file", "total", "text", "format", "number", "datum", "sheet"]
MIN_LENGTH = 3
UNKNOWN_TAG = "NOUN"


def tokens(texts: DataFrame, *keep: str) -> DataFrame:
    """``(path, pos, text)``: one row per word of ``preview``."""
    return texts.select(
        "path", *keep, F.posexplode(words(F.col("preview"))).alias("pos", "text")
    ).withColumn("pos", F.col("pos").cast("long"))


def lexicon_lookup(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Add ``lemma``, ``tag`` and ``is_stop``.

    The exact token decides, then its lower-case form; a word in neither is a
    noun that stands for itself in lower case. Entries that differ in case
    only are gathered first, so one equi join finds both; Spark broadcasts a lexicon below its threshold and splits the
    skewed partitions of a shuffled one.
    """
    entry = F.struct("token", "lemma", "tag", "is_stop")
    index = lexicon.groupBy(F.lower("token").alias("lower_token")).agg(F.collect_list(entry).alias("entries"))
    joined = rows.join(index, F.lower("text") == F.col("lower_token"), "left")

    def form(text: Column) -> Column:
        return F.get(F.filter("entries", lambda e: e["token"] == text), F.lit(0))

    found = F.coalesce(form(F.col("text")), form(F.lower("text")))
    return joined.withColumn("entry", found).withColumns(
        {
            "lemma": F.coalesce(F.col("entry.lemma"), F.lower("text")),
            "tag": F.coalesce(F.col("entry.tag"), F.lit(UNKNOWN_TAG)),
            "is_stop": F.coalesce(F.col("entry.is_stop"), F.lit(False)),
        }
    ).drop("lower_token", "entries", "entry")


def token_filter(rows: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Content words: right tag, no stop word, long enough, no generic lemma."""
    return rows.where(
        F.col("tag").isin(KEYWORD_TAGS)
        & ~F.col("is_stop")
        & (F.length("text") >= min_length)
        & ~F.col("lemma").isin(GENERIC_WORDS)
    )


def query_targets(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(query_id, idx, label)``: the nouns of each sentence, in order, duplicates kept."""
    rows = queries.select("query_id", F.posexplode(words(F.col("text"))).alias("pos", "text"))
    nouns = lexicon_lookup(rows, lexicon).where(F.col("tag").isin(TARGET_TAGS) & ~F.col("is_stop"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return nouns.select("query_id", (place - 1).cast("long").alias("idx"), F.col("text").alias("label"))
