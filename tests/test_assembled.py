import random

import pytest
from cataloom.sources.assembled import (
    assemble_ocr_text, assemble_preview, assemble_slide_text, assemble_transcript, dispatch_text, seconds_to_read, text_bearing,
)
from cataloom.sources.content import attach_extracted_text
from pyspark.sql import functions as F


def previews(df):
    return {r.path: r.preview for r in df.collect()}


def test_pieces_equal_joined_text(spark):
    """One file holds most pieces; only its first words may count, in order."""
    rnd = random.Random(5)
    rows, texts = [], {}
    for path, count in [("hot", 6000), ("wordy", 3), ("empty", 4), *((f"p{i}", rnd.randint(1, 9)) for i in range(40))]:
        for line in range(count):
            words = 300 if path == "wordy" else rnd.randint(0, 3)
            text = "" if path == "empty" else " ".join(f"{path}{line}w{w}" for w in range(words)) + rnd.choice(["", " ", "\n\n"])
            rows.append((path, line, text))
            texts.setdefault(path, []).append(text)
    rnd.shuffle(rows)
    lines = spark.createDataFrame(rows, "path string, line_num long, text string").repartition(8)
    expected = {p: " ".join(" ".join(t).split()[:500]) for p, t in texts.items()}
    assert previews(assemble_ocr_text(lines)) == {p: t for p, t in expected.items() if t}
    short = {p: " ".join(" ".join(t).split()[:7]) for p, t in texts.items()}
    assert previews(assemble_preview(lines, "line_num", max_words=7)) == {p: t for p, t in short.items() if t}


def test_slides(spark):
    slides = spark.createDataFrame([("a", "slide text"), ("b", ""), ("c", "only")], "path string, text string")
    lines = spark.createDataFrame(
        [("a", 2, 0, 0, "last"), ("a", 1, 1, 0, "third"), ("a", 1, 0, 1, "second"), ("a", 1, 0, 0, "first"), ("b", 0, 0, 0, "img")],
        "path string, slide_num int, shape_num int, line_num int, text string",
    )
    assert previews(assemble_slide_text(slides, lines)) == {
        "a": "slide text first second third last", "b": "img", "c": "only",
    }


@pytest.mark.parametrize("duration,untrimmed,expected", [
    (400.0, False, "s0 s50 s100"), (120.0, False, "s0 s50 s100"), (90.0, False, "s0 s50"),
    (0.0, False, "s0 s50 s100 s150 s200"), (None, False, "s0 s50 s100 s150 s200"), (400.0, True, "s0 s50 s100 s150 s200"),
])
def test_transcript_cutoff(spark, duration, untrimmed, expected):
    rows = [("x", i, i * 50.0, duration, untrimmed, f"s{i * 50}") for i in range(5)]
    segments = spark.createDataFrame(rows, "path string, seq int, start_s double, duration_s double, untrimmed boolean, text string")
    assert previews(assemble_transcript(segments)) == {"x": expected}


def test_seconds_to_read(spark):
    row = spark.range(1).select(*[seconds_to_read(F.lit(v).cast("double")) for v in (100, 150, 151, 0, None)]).first()
    assert tuple(row) == (100.0, 150.0, 150.0, None, None)


def test_category_selects_the_source(spark):
    files = spark.createDataFrame(
        [(f"/{c}", c) for c in ("Documents", "Images", "Audio", "Video", "Archives", "Executables", "Code", "Others")] + [("/none", "Images")],
        "path string, category string",
    )
    def source(kind):
        return spark.createDataFrame([(r.path, kind) for r in files.collect() if r.path != "/none"], "path string, preview string")
    found = previews(dispatch_text(files, source("d"), source("i"), source("m")))
    assert found == {"/Documents": "d", "/Images": "i", "/Audio": "m", "/Video": "m", "/Archives": "", "/Executables": "", "/Code": "", "/Others": "", "/none": ""}
    assert text_bearing(files).count() == 5
    assert set(previews(dispatch_text(files)).values()) == {""}


def test_attach_extracted_text(spark):
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    texts = spark.createDataFrame([("a", "t")], "path string, text string")
    assert {tuple(r) for r in attach_extracted_text(files, texts).collect()} == {("a", "t"), ("b", "")}
