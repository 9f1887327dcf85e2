"""One preview per file out of ordered pieces: picture lines, slide decks, transcripts.

Only the first ``max_words`` words of a joined text are ever used, so pieces
that cannot reach them are left behind before anything is gathered. A file
with any number of pieces therefore ends up as at most ``max_words`` of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions.names import TEXT_BEARING, is_slide_deck
from cataloom.functions.text import PREVIEW_WORDS, squeeze, word_count

CUTOFF_SECONDS = 150
#: A file's pieces are first ranked in this many shares, then among the survivors.
SHARES = 64


def _first(df: DataFrame, keys: list, order: Column, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def assemble_preview(pieces: DataFrame, *order: str, max_words: int = PREVIEW_WORDS) -> DataFrame:
    """``(path, preview)`` from ``(path, text, *order)``: pieces joined by blanks, in order.

    Every piece kept has a word, so only the first ``max_words`` pieces can
    matter. They are picked share by share (pre-limited in the map tasks by
    WindowGroupLimit), so that no task sorts all pieces of a hot file.
    """
    at = F.struct(*order)
    rows = pieces.select(
        "path", at.alias("at"), F.substring_index(squeeze(F.col("text")), " ", max_words).alias("text")
    ).where("text != ''")
    rows = rows.withColumn("share", F.pmod(F.xxhash64("at"), F.lit(SHARES)))
    rows = _first(rows, ["path", "share"], F.col("at"), max_words)
    rows = _first(rows, ["path"], F.col("at"), max_words)
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(
        "before", F.coalesce(F.sum(word_count(F.col("text"))).over(before), F.lit(0))
    ).where(F.col("before") < max_words)
    ordered = F.array_sort(F.collect_list(F.struct("at", "text")))
    joined = F.array_join(ordered.getField("text"), " ")
    return rows.groupBy("path").agg(F.substring_index(joined, " ", max_words).alias("preview"))


def assemble_ocr_text(lines: DataFrame) -> DataFrame:
    """Picture lines ``(path, line_num, text)`` in line order."""
    return assemble_preview(lines, "line_num")


def assemble_slide_text(slides: DataFrame, picture_lines: DataFrame) -> DataFrame:
    """Slide text ``(path, text)``, then the picture lines in slide, shape, line order."""
    zero = F.lit(0).cast("long")
    text = slides.select(
        "path", "text", zero.alias("part"), zero.alias("slide_num"), zero.alias("shape_num"), zero.alias("line_num")
    )
    lines = picture_lines.select(
        "path",
        "text",
        F.lit(1).cast("long").alias("part"),
        *[F.col(c).cast("long").alias(c) for c in ("slide_num", "shape_num", "line_num")],
    )
    return assemble_preview(text.unionByName(lines), "part", "slide_num", "shape_num", "line_num")


def seconds_to_read(duration_s: Column, cutoff_s: int = CUTOFF_SECONDS) -> Column:
    """Seconds of a clip that count; NULL (no trimming) where the duration is unknown or 0."""
    return F.when(duration_s > 0, F.least(duration_s, F.lit(cutoff_s)))


def assemble_transcript(segments: DataFrame, cutoff_s: int = CUTOFF_SECONDS) -> DataFrame:
    """Segments ``(path, seq, start_s, duration_s, untrimmed, text)`` that start before the cut-off.

    A clip that could not be trimmed, or whose duration is unknown, counts whole.
    """
    limit = seconds_to_read(F.col("duration_s"), cutoff_s)
    heard = F.col("untrimmed") | limit.isNull() | (F.col("start_s") < limit)
    return assemble_preview(segments.where(heard), "seq")


def text_bearing(files: DataFrame) -> DataFrame:
    """Files of the categories whose text is extracted at all."""
    return files.where(F.col("category").isin(TEXT_BEARING))


def dispatch_text(
    files: DataFrame,
    documents: DataFrame | None = None,
    images: DataFrame | None = None,
    media: DataFrame | None = None,
    decks: DataFrame | None = None,
) -> DataFrame:
    """``files`` with the preview from the source that its category selects, else ``''``.

    Each source is ``(path, preview)``; slide decks have one of their own. All of them meet the files in one join
    on ``path``; whether the source fits the category is a residual condition,
    so the result stays partitioned by ``path`` for the token steps.
    """
    tagged = [
        source.select(F.col("path").alias("text_path"), "preview", F.lit(kind).alias("kind"))
        for kind, source in (("document", documents), ("image", images), ("media", media), ("deck", decks))
        if source is not None
    ]
    if not tagged:
        return files.withColumn("preview", F.lit(""))
    texts = reduce(DataFrame.unionAll, tagged).where("preview != ''")
    fits = (
        ((F.col("category") == "Documents") & (F.col("kind") == F.when(is_slide_deck(F.col("path")), "deck").otherwise("document")))
        | ((F.col("category") == "Images") & (F.col("kind") == "image"))
        | (F.col("category").isin("Audio", "Video") & (F.col("kind") == "media"))
    )
    return (
        files.join(texts, (F.col("path") == F.col("text_path")) & fits, "left")
        .withColumn("preview", F.coalesce("preview", F.lit("")))
        .drop("text_path", "kind")
    )
