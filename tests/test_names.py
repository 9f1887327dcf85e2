import os
import posixpath
import random

from cataloom.functions.names import (
    EXTENSION_MAP, base_name, category_of, extension, is_plain_text, is_slide_deck, join_path, parent_of, raw_extension, stem,
)
from cataloom.operators.classify import classify
from cataloom.sources.listing import below
from pyspark.sql import functions as F

EDGES = ["a.txt", "A.TXT", ".bashrc", "a.tar.gz", "foo.", "a..b", "...", "noext", "x\ny.t", ".a.b", "..a", "a. b", "é.ß", ""]


def test_extension_equals_splitext(spark):
    rnd = random.Random(7)
    names = EDGES + ["".join(rnd.choices("ab._-\n é", k=rnd.randint(1, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", stem(F.col("n")), raw_extension(F.col("n")), extension(F.col("n"))
    )
    for name, root, raw, low in rows.collect():
        assert (root, raw) == os.path.splitext(name)
        assert low == raw.lower()


def test_path_parts(spark):
    paths = ["/a/b.txt", "/b", "c", "/a/b/", "http://x/y?z", "/a//b"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(
        "p", parent_of(F.col("p")), base_name(F.col("p")), join_path(F.lit("/r"), base_name(F.col("p")))
    )
    for path, parent, base, joined in rows.collect():
        assert base == posixpath.basename(path)
        assert parent == (path[: -len(base) - 1] if base else path[:-1]) or "/" not in path and parent == ""
        assert joined == "/r/" + base


def test_every_extension_has_its_category(spark):
    files = [(f"x{e.upper()}", c) for c, exts in EXTENSION_MAP.items() for e in exts] + [("x", "Others"), ("x.zzz", "Others")]
    rows = classify(spark.createDataFrame(files, "filename string, expected string"))
    assert rows.where("category <> expected").count() == 0
    assert len(files) == 43
    assert sum(map(len, EXTENSION_MAP.values())) == 41


def test_other_maps(spark):
    row = spark.range(1).select(category_of(F.lit(".a"), {"First": [".a"], "Second": [".a", ".b"]}), category_of(F.lit(".a"), {})).first()
    assert tuple(row) == ("First", "Others")


def test_suffix_tests_are_case_sensitive(spark):
    rows = spark.createDataFrame([("/a.txt",), ("/A.TXT",), ("/b.csv",), ("/c.pptx",)], "p string")
    found = rows.select(is_plain_text(F.col("p")), is_slide_deck(F.col("p"))).collect()
    assert [tuple(r) for r in found] == [(True, False), (False, False), (True, False), (False, True)]
    assert rows.select(F.col("p").alias("filename")).transform(classify).where("category = 'Documents'").count() == 4


def test_below(spark):
    rows = spark.createDataFrame([("/in/a", "/in"), ("/in/s/b", "/in/s"), ("/inn/c", "/inn")], "path string, parent string")
    assert {r.path for r in below(rows, "/in/").collect()} == {"/in/a", "/in/s/b"}
    assert {r.path for r in below(rows, "/in", recursive=False).collect()} == {"/in/a"}
