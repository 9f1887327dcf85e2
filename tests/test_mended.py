"""Cases that once lost data: odd names, names taken late, folders in the way, unread folders, wrong matches."""

import os

import pytest
from cataloom import organise_folder
from cataloom.functions.names import as_shown, on_disk
from cataloom.functions.text import decode, words
from cataloom.operators.layout import copy_files, write_layout
from cataloom.operators.match import match_categories, without_vector
from cataloom.plans.organise import categorise
from cataloom.sources.assembled import dispatch_text
from cataloom.sources.listing import scan
from pyspark.sql import functions as F

LEXICON = "token string, lemma string, tag string, is_stop boolean"
VECTORS = "term string, vec array<float>"
PLAN = "path string, dest_path string, status string, length long"


def test_words_keep_marks_and_digits(spark):
    texts = ["H2O COVID-19 mp3", "café हिन्दी", "12 3.4 Q3report _x_"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", words(F.col("t")).alias("w"))
    assert [r.w for r in sorted(rows.collect())] == [
        ["H2O", "COVID", "mp3"], ["café", "हिन्दी"], ["Q3report", "x"],
    ]


def test_decode_keeps_replacement_characters_of_the_file(spark):
    values = ["a�b".encode() + b"\xff", "﷐﷒�﷐".encode() + b"\xc3", "�".encode(), b"\xff\xfe"]
    rows = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "i int, b binary").select("i", decode(F.col("b")).alias("t"))
    assert [r.t for r in sorted(rows.collect())] == [v.decode("utf-8", "ignore") for v in values]


@pytest.mark.parametrize("name", ["a.txt", "é.txt", "caf\udce9.txt", "\udcff"])
def test_names_come_back(name):
    shown = as_shown(name)
    shown.encode()
    assert on_disk(shown) == name


def test_name_that_is_no_utf8(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    odd = os.fsencode(str(root)) + b"/caf\xe9.txt"
    with open(odd, "wb") as out:
        out.write(b"text")
    done = organise_folder(spark, str(root), str(tmp_path / "out"))
    assert done.retire.count() == 1 and done.summary.first().originals_retired
    assert os.listdir(os.fsencode(str(tmp_path / "out" / "Documents"))) == [b"caf\xe9.txt"]


def test_copies_never_replace(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text(name)
    out = tmp_path / "out"
    (out / "c").mkdir(parents=True)
    (out / "a").write_text("came later")
    plan = spark.createDataFrame([(str(tmp_path / f"{n}.txt"), str(out / n), "planned", 1) for n in "abc"], PLAN)
    log = {os.path.basename(r.dest_path): r for r in copy_files(plan).collect()}
    assert (log["a"].status, log["b"].status, log["c"].status) == ("failed", "copied", "failed")
    assert "FileExistsError" in log["a"].error and (out / "a").read_text() == "came later"
    # the same task once more finds its own copy and accepts it
    again = {os.path.basename(r.dest_path): r.status for r in copy_files(plan).collect()}
    assert again == {"a": "failed", "b": "copied", "c": "failed"}
    assert sorted(os.listdir(out)) == ["a", "b", "c"]


def test_folders_at_the_destination_are_taken(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    (root / "a.txt").write_text("x")
    (root / "b.txt").write_text("y")
    os.symlink(tmp_path / "absent", root / "c.txt")
    (out / "Documents" / "a.txt").mkdir(parents=True)
    os.symlink(tmp_path / "absent", out / "Documents" / "free.txt")
    done = organise_folder(spark, str(root), str(out))
    plan = {os.path.basename(r.path): (r.dest_path and os.path.basename(r.dest_path), r.status) for r in done.plan.collect()}
    assert plan == {"a.txt": ("a_1.txt", "planned"), "b.txt": ("b.txt", "planned"), "c.txt": (None, "missing_source")}
    assert done.log.where("status = 'copied'").count() == 2 and done.failed.count() == 0 and done.retire.count() == 0


def test_errors_of_listing_are_reported(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    # a file in place of a folder fails as an unreadable folder does
    found = scan(spark, str(tmp_path / "in" / "a.txt"))
    assert [(r.path, "NotADirectoryError" in r.error) for r in found.errors.collect()] == [(str(tmp_path / "in" / "a.txt"), True)]
    with pytest.raises(RuntimeError, match="destination"):
        organise_folder(spark, str(tmp_path / "in"), str(tmp_path / "in" / "a.txt"))
    done = organise_folder(spark, str(tmp_path / "in" / "a.txt"), str(tmp_path / "out"))
    assert not done.summary.first().originals_retired
    assert [r.status for r in done.log.collect()] == ["scan_error"]


def test_layout_without_content_fails(spark, tmp_path):
    plan = spark.createDataFrame([("/a", "/o/C/a", "planned", 1, "C"), ("/b", "/o/C/b", "planned", 1, "C")], PLAN + ", category string")
    contents = spark.createDataFrame([("/a", bytearray(b"x")), ("/b", None)], "path string, content binary")
    log = {r.path: (r.status, r.error) for r in write_layout(plan, contents, str(tmp_path / "t")).collect()}
    assert log == {"/a": ("copied", None), "/b": ("failed", "no content")}


def _files(spark):
    return spark.createDataFrame([("/x.py", "Code"), ("/y.md", "Documents")], "path string, category string")


def test_only_text_bearing_files_are_matched_and_nan_matches_nothing(spark):
    keywords = spark.createDataFrame([("/x.py", "law"), ("/y.md", "law"), ("/y.md", "odd")], "path string, keyword string")
    targets = spark.createDataFrame([(0, "legal"), (1, "none")], "idx bigint, label string")
    vectors = spark.createDataFrame([("legal", [1.0, 0.0]), ("law", [0.9, 0.1]), ("odd", [float("nan"), 1.0])], VECTORS)
    found = {r.path: (r.category, r.score) for r in match_categories(_files(spark), keywords, targets, vectors).collect()}
    assert found["/x.py"] == ("Code", None)
    assert found["/y.md"][0] == "Legal" and found["/y.md"][1] > 0.9
    only_nan = vectors.where("term <> 'law'")
    assert {r.category for r in match_categories(_files(spark), keywords, targets, only_nan).collect()} == {"Code", "Documents"}
    assert [r.label for r in without_vector(targets, "label", vectors).collect()] == ["none"]


def test_vectors_of_unequal_length_are_an_error(spark):
    keywords = spark.createDataFrame([("/y.md", "law")], "path string, keyword string")
    targets = spark.createDataFrame([(0, "legal")], "idx bigint, label string")
    vectors = spark.createDataFrame([("legal", [1.0, 0.0]), ("law", [1.0])], VECTORS)
    with pytest.raises(Exception, match="differ in length"):
        match_categories(_files(spark), keywords, targets, vectors).collect()


def test_model_in_the_pipeline(spark):
    def make():
        import numpy as np

        return lambda terms: np.array([[1.0, 0.0] if t.lower() in ("legal", "contract") else [0.0, 1.0] for t in terms], dtype="float32")

    lexicon = spark.createDataFrame([("organize", "organize", "VERB", False), ("by", "by", "ADP", True)], LEXICON)
    texts = spark.createDataFrame([("/y.md", "a contract"), ("/x.py", "a contract")], "path string, preview string")
    found = categorise(_files(spark), texts, "organize by Legal", lexicon, model=make)
    assert {r.path: r.category for r in found.collect()} == {"/x.py": "Code", "/y.md": "Legal"}


def test_decks_have_their_own_text(spark):
    files = spark.createDataFrame([("/a.pptx", "Documents"), ("/b.pdf", "Documents")], "path string, category string")
    texts = spark.createDataFrame([("/a.pptx", "wrong"), ("/b.pdf", "right")], "path string, preview string")
    decks = spark.createDataFrame([("/a.pptx", "slides")], "path string, preview string")
    assert {r.path: r.preview for r in dispatch_text(files, texts, decks=decks).collect()} == {"/a.pptx": "slides", "/b.pdf": "right"}
