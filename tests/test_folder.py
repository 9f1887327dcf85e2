"""End to end over real folders."""

import os
import shutil
import time

import pytest
from cataloom import organise, organise_folder
from cataloom.operators.layout import default_destination, names_in_layout, plan_layout
from cataloom.operators.summary import category_breakdown, run_summary, with_progress
from cataloom.operators.verify import failed_verifications, retire_gate, retire_list, verify_copies
from cataloom.sources.content import _Apart, extract_with, read_text_prefix
from cataloom.sources.listing import scan_files

FILES = {
    "a.txt": b"contract terms and more contract", "sub/a.txt": b"nothing here", "sub/deep/b.CSV": b"x",
    "sub/.hidden": b"h", "_name": b"", "empty.txt": b"", "pic.PNG": b"p", "sub/arch.tar.gz": b"zz", "bad.txt": b"caf\xff\xc3\xa9\r\nok",
}


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    for name, content in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    os.symlink(root / "sub", root / "link")
    os.symlink(root / "absent", root / "broken")
    (root / "void").mkdir()
    return str(root)


def walked(root):
    return sorted(os.path.join(d, f) for d, _, files in os.walk(root) for f in files)


def test_scan_equals_walk(spark, folder):
    rows = scan_files(spark, folder).orderBy("scan_seq").collect()
    assert [r.path for r in rows] == walked(folder)
    assert [r.scan_seq for r in rows] == list(range(len(rows)))
    assert all(r.length == (os.path.getsize(r.path) if os.path.exists(r.path) else 0) for r in rows)
    assert all(r.path == r.parent + "/" + r.filename for r in rows)


def test_scan_top_level(spark, folder):
    top = {f for f in os.listdir(folder) if os.path.isfile(os.path.join(folder, f))}
    assert {r.filename for r in scan_files(spark, folder, recursive=False).collect()} == top


@pytest.mark.parametrize("recursive", [True, False])
def test_absent_folder_is_empty(spark, tmp_path, recursive):
    found = scan_files(spark, str(tmp_path / "nowhere"), recursive)
    assert found.count() == 0
    assert set(found.columns) == {"path", "filename", "parent", "length", "mtime", "scan_seq"}


def test_text_prefix(spark, folder, tmp_path):
    with open(os.path.join(folder, "long.txt"), "w", encoding="utf-8") as f:
        f.write("é" * 5001)
    rows = {os.path.basename(r.path): r.text for r in read_text_prefix(scan_files(spark, folder)).collect() if "/sub/" not in r.path}
    assert rows == {"a.txt": FILES["a.txt"].decode(), "empty.txt": "", "bad.txt": "café\nok", "long.txt": "é" * 5000}


def test_extract_errors_are_recorded(spark, folder):
    def fn(path):
        if path.endswith(".PNG"):
            raise ValueError("no parser")
        return "t"

    rows = extract_with(scan_files(spark, folder), fn).collect()
    assert {(r.text, r.error) for r in rows if r.path.endswith(".PNG")} == {("", "ValueError: no parser")}
    assert all(r.text == "t" and r.error is None for r in rows if not r.path.endswith(".PNG"))


def test_a_parser_that_hangs_or_crashes_costs_its_file_only(spark, folder):
    def fn(path):
        if path.endswith(".PNG"):
            time.sleep(1000)
        if path.endswith(".gz"):
            os._exit(3)
        if path.endswith(".CSV"):
            raise ValueError("no parser")
        return "é" * 100_000 if path.endswith("/a.txt") else None if path.endswith("_name") else "t"

    files = scan_files(spark, folder)
    found = {os.path.basename(r.path): (r.text, r.error) for r in extract_with(files, fn, seconds=2.0).collect()}
    assert found.pop("pic.PNG") == ("", "TimeoutError: no text within 2.0 s")
    assert found.pop("arch.tar.gz") == ("", "ChildProcessError: the parser ended with code 3")
    assert found.pop("b.CSV") == ("", "ValueError: no parser")
    assert found.pop("a.txt") == ("é" * 100_000, None) and found.pop("_name") == ("", None)
    assert set(found.values()) == {("t", None)}
    # files behind a bad one, in one task
    caller = _Apart(fn, 0.5)
    assert [caller(p)[1] is None for p in ("x.PNG", "x.gz", "x.txt", "y.gz", "y.txt")] == [False, False, True, False, True]
    caller.stop()


def test_organise_folder(spark, folder):
    os.remove(os.path.join(folder, "broken"))
    done = organise_folder(spark, folder)
    dest = default_destination(folder)
    assert dest == os.path.join(os.path.dirname(folder), "Organized_Files")
    copied = {os.path.relpath(p, dest) for p in walked(dest)}
    assert copied == {
        "Documents/a.txt", "Documents/a_1.txt", "Documents/b.CSV", "Documents/empty.txt", "Documents/bad.txt",
        "Images/pic.PNG", "Archives/arch.tar.gz", "Others/.hidden", "Others/_name",
    }
    for row in done.plan.collect():
        with open(row.path, "rb") as a, open(row.dest_path, "rb") as b:
            assert a.read() == b.read()
        assert os.path.getmtime(row.path) == pytest.approx(os.path.getmtime(row.dest_path))
    assert sorted(r.path for r in done.retire.collect()) == walked(folder)
    assert tuple(done.summary.first()) == (9, 9, 0, 9, 0, 9, True)
    assert [tuple(r) for r in done.breakdown.collect()] == [("Documents", 5), ("Others", 2), ("Archives", 1), ("Images", 1)]
    # a second run finds its own copies and numbers on
    again = organise_folder(spark, folder, include_subfolders=False)
    assert {os.path.relpath(r.dest_path, dest) for r in again.plan.collect()} == {
        "Documents/a_2.txt", "Documents/empty_1.txt", "Documents/bad_1.txt", "Images/pic_1.PNG", "Others/_name_1",
    }


def test_failed_copy_stops_retirement(spark, folder):
    done = organise_folder(spark, folder, dest=folder + "_out")
    assert done.retire.count() == 0
    row = done.summary.first()
    assert (row.processed, row.copied, row.copy_errors, row.originals_retired) == (10, 9, 1, False)


def test_organise_with_query(spark, folder):
    os.remove(os.path.join(folder, "broken"))
    lexicon = spark.createDataFrame([("organize", "organize", "VERB", False), ("by", "by", "ADP", True)], "token string, lemma string, tag string, is_stop boolean")
    vectors = spark.createDataFrame([("Legal", [1.0, 0.0]), ("contract", [0.9, 0.1]), ("x", [1.0, 0.0])], "term string, vec array<float>")
    images = spark.createDataFrame([(os.path.join(folder, "pic.PNG"), "a contract")], "path string, preview string")
    done = organise_folder(
        spark, folder, query="organize by Legal", lexicon=lexicon, term_vectors=vectors, images=images,
        extract=lambda path: "see contract" if path.endswith(".CSV") else "",
    )
    moved = {os.path.relpath(r.path, folder) for r in done.categorised.where("category = 'Legal'").collect()}
    assert moved == {"a.txt", "pic.PNG", "sub/deep/b.CSV"}
    assert done.summary.first().originals_retired


def test_corrupted_copy_is_found(spark, folder):
    os.remove(os.path.join(folder, "broken"))
    dest = folder + "_out"
    done = organise_folder(spark, folder, dest)
    os.remove(f"{dest}/Images/pic.PNG")
    with open(f"{dest}/Documents/bad.txt", "ab") as f:
        f.write(b"!")
    shutil.move(os.path.join(folder, "_name"), folder + "_moved")
    sources = scan_files(spark, folder)
    checked = verify_copies(done.plan, sources, scan_files(spark, dest))
    bad = {os.path.basename(r.path): r.status for r in failed_verifications(checked).collect()}
    assert bad == {"pic.PNG": "missing", "bad.txt": "size_mismatch", "_name": "error"}
    assert not retire_gate(done.plan, checked).first().passed
    assert retire_list(done.plan, checked, sources).count() == 0


def test_empty_run_passes_the_gate(spark):
    files = spark.createDataFrame([], "path string, filename string, parent string, length long, mtime timestamp, scan_seq long")
    done = organise(files, "/out")
    empty = files.select("path", "length")
    checked = verify_copies(done.plan, empty, empty)
    assert retire_gate(done.plan, checked).first().passed
    assert retire_list(done.plan, checked, empty).count() == 0
    assert done.breakdown.count() == 0
    assert tuple(run_summary(done.plan, checked, retire_list(done.plan, checked, empty)).first()) == (0, 0, 0, 0, 0, 0, True)


def test_vanished_source_takes_no_name(spark):
    files = spark.createDataFrame(
        [("/1/a.t", "Code", "a.t", 1, 0), ("/2/a.t", "Code", "a.t", 2, 1)], "path string, category string, filename string, length long, scan_seq long"
    )
    plan = plan_layout(files, "/out", sources=files.where("scan_seq = 1"))
    assert {(r.path, r.dest_path, r.status) for r in plan.collect()} == {
        ("/1/a.t", None, "missing_source"), ("/2/a.t", "/out/Code/a.t", "planned"),
    }


def test_names_in_layout(spark):
    paths = spark.createDataFrame([("/out/A/x",), ("/out/A/s/y",), ("/out/z",), ("/outer/A/w",)], "path string")
    assert [tuple(r) for r in names_in_layout(paths, "/out").collect()] == [("A", "x")]


def test_progress(spark):
    rows = spark.range(25).selectExpr("id", "id % 5 = 0 as broken", "'A' as category")
    watched, seen = with_progress(rows, "scan", rows["broken"])
    assert category_breakdown(watched).first().n_files == 25
    assert seen.get == {"n_rows": 25, "n_failed": 5}
