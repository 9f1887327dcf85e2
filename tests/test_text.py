import random

from cataloom.functions.text import (
    capitalise, decode, is_blank, keyword_string, parse_keywords, text_prefix, word_count, word_preview,
)
from pyspark.sql import functions as F


def column(spark, values, kind, fn):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", fn(F.col("x")).alias("y"))
    return [r.y for r in sorted(rows.collect())]


def test_decode_drops_bad_bytes_and_folds_line_ends(spark):
    rnd = random.Random(3)
    pieces = [b"a", b"\xc3\xa9", b"\xff", b"\xe2\x82", b"\xf0\x9f\x98\x80", b"\r\n", b"\r", b"\n", b"\xc0\xaf", b"\xed\xa0\x80", b" "]
    values = [b"".join(rnd.choices(pieces, k=rnd.randint(0, 12))) for _ in range(1500)]
    expected = [v.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for v in values]
    assert column(spark, map(bytearray, values), "binary", decode) == expected


def test_text_prefix_counts_characters(spark):
    texts = ["x" * 4999, "x" * 5000, "x" * 5001, "\U0001f600" * 5001, "é" * 6000, ""]
    assert column(spark, [bytearray(t, "utf-8") for t in texts], "binary", text_prefix) == [t[:5000] for t in texts]


def test_white_space_is_that_of_python(spark):
    points = [c for c in range(0x1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}b" for c in points]
    assert column(spark, texts, "string", word_preview) == [" ".join(t.split()) for t in texts]


def test_preview(spark):
    texts = ["", "   \n", " a  b\tc ", " ".join(map(str, range(500))), " ".join(map(str, range(501))), " x y\x1cz", None]
    expected = [" ".join((t or "").split()[:500]) for t in texts]
    assert column(spark, texts, "string", word_preview) == expected
    assert column(spark, texts, "string", lambda x: word_count(word_preview(x))) == [len(e.split()) for e in expected]


def test_blank(spark):
    assert column(spark, ["", " \t", "\x1c", "a"], "string", is_blank) == [True, True, True, False]


def test_capitalise(spark):
    labels = ["HR", "legal", "x-ray", "INVOICE DATE", "", "ß", "ßA", "é", "1A"]
    assert column(spark, labels, "string", capitalise) == [t.capitalize() for t in labels]


def test_keyword_strings(spark):
    texts = ["a, b,, c ", ",", "", " a b , c", "a"]
    expected = [[k.strip() for k in t.split(",") if k.strip()] for t in texts]
    assert column(spark, texts, "string", parse_keywords) == expected
    assert column(spark, [["a", "b"], []], "array<string>", keyword_string) == ["a, b", ""]
