"""What a task holds stays the same when the input grows."""

import os
import re
import time

import pandas as pd
import pytest
from cataloom.operators import match
from cataloom.operators.keywords import top_keywords
from cataloom.plans.organise import categorise
from cataloom.session import REMOVE_SHUFFLES, materialise
from cataloom.sources import content, listing
from cataloom.sources.content import previews
from cataloom.workload import fixtures as fx
from cataloom.workload.registry import QUERIES
from pyspark.sql import functions as F


@pytest.fixture
def lexicon(spark):
    # as inline rows, whose size Spark knows: the look-up is a broadcast then
    return spark.sql("select * from values ('by', 'by', 'ADP', true), ('organize', 'organize', 'VERB', false) as lexicon(token, lemma, tag, is_stop)")


def library(spark, n=600):
    return spark.range(n).selectExpr("concat('/', id, '.md') as path", "concat('word some ', repeat('x', cast(id % 7 as int) + 3)) as text")


def test_keywords_are_counted_in_shares_of_bounded_size(spark, lexicon, monkeypatch):
    monkeypatch.setattr(content, "FILES_PER_COUNT", 10, raising=False)
    found = top_keywords(previews(library(spark)), lexicon)
    sizes = found.groupBy(F.spark_partition_id().alias("part")).agg(F.count_distinct("path").alias("n")).collect()
    assert sum(r.n for r in sizes) == 600
    assert max(r.n for r in sizes) < 40


def test_texts_that_count_are_dealt_by_number(spark, lexicon, monkeypatch):
    monkeypatch.setattr(content, "FILES_PER_COUNT", 10, raising=False)
    files = library(spark).select("path", F.lit("Documents").alias("category"))
    vectors = spark.createDataFrame([("word", [1.0]), ("Legal", [1.0])], "term string, vec array<double>")
    texts = previews(library(spark), placed=False)
    done = categorise(files, texts, "organize by Legal", lexicon, vectors)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(path#\d+, 60\), REPARTITION_BY_NUM", plan)
    assert done.where("category = 'Legal'").count() == 600


def test_many_folders_are_one_table(tmp_path):
    for i in range(300):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "a.txt").write_text(str(i))
    folders = pd.DataFrame({"folder": [str(tmp_path / str(i)) for i in range(300)] + [str(tmp_path / "nowhere")]})
    found = list(listing._list_folders(iter([folders[:200], folders[200:]])))
    assert len(found) == 1
    assert sorted(found[0]["parent"]) == sorted(folders["folder"][:300]) and set(found[0]["filename"]) == {"a.txt"}


def test_writers_hold_few_texts(spark, tmp_path, monkeypatch):
    rows = spark.range(40).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang", "'web' as source", "length(text) as n_chars")
    rows.unionAll(rows.where("doc_id < 5")).write.parquet(str(tmp_path / "documents.parquet"))
    frame, held = type(rows), []
    original, usual = frame.mapInArrow, spark.conf.get(fx.ARROW_ROWS)

    def seen(self, *args, **options):
        held.append(int(spark.conf.get(fx.ARROW_ROWS)))
        return original(self, *args, **options)

    monkeypatch.setattr(frame, "mapInArrow", seen)
    root = fx.file_tree(spark, str(tmp_path), flat=True)
    assert held == [fx.TEXTS_HELD] and spark.conf.get(fx.ARROW_ROWS) == usual
    found = [os.path.join(d, f) for d, _, files in os.walk(root) for f in files]
    assert sorted(open(p).read() for p in found) == sorted(f"text {i}" for i in range(40))


def test_matches_of_files_and_sentences_are_not_moved(spark, monkeypatch):
    monkeypatch.setattr(match, "FILE_BLOCK", 7, raising=False)
    monkeypatch.setattr(match, "SENTENCE_BLOCK", 3, raising=False)
    words = [f"w{i}" for i in range(6)]
    vectors = spark.createDataFrame([(w, [float(i == k) for k in range(6)]) for i, w in enumerate(words)], "term string, vec array<double>")
    keywords = spark.createDataFrame([(f"/{i}", words[(i + k) % 6]) for i in range(30) for k in range(2)] + [(None, "w0")], "path string, keyword string")
    targets = spark.createDataFrame([(f"q{i}", k, words[(i + k * 2) % 6]) for i in range(10) for k in range(2)], "query_id string, idx bigint, label string")
    found = match.match_sentences(keywords, targets, vectors)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+, path#\d+", plan)
    held, expected = {}, set()
    for path, word in ((r.path, r.keyword) for r in keywords.collect()):
        held.setdefault(path, set()).add(word)
    for i in range(10):
        for path, has in held.items():
            hits = [(k, words[(i + k * 2) % 6]) for k in range(2) if words[(i + k * 2) % 6] in has]
            if hits:
                expected.add((f"q{i}", path, 1.0, *min(hits)))
    assert {tuple(r) for r in found.collect()} == expected
    assert match.match_sentences(keywords.limit(0), targets, vectors).isEmpty()


def test_matches_are_counted_without_sorting(spark):
    plan = QUERIES["match_sentences"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[query_id" in plan.split("FlatMapCoGroupsInArrow")[0]
    assert "SortAggregate" not in plan.split("FlatMapCoGroupsInArrow")[0]


def crowd(spark):
    """30 files, 10 sentences and vectors with ties: ``(keywords, targets, vectors)``."""
    words = [f"w{i}" for i in range(12)]
    vectors = spark.createDataFrame([(w, [1.0, float(i % 5), float(i % 3)]) for i, w in enumerate(words)], "term string, vec array<double>")
    keywords = spark.createDataFrame([(f"/{i}", words[(i * 5 + k * 7) % 12]) for i in range(30) for k in range(3)] + [(None, "w0"), ("/x", "unknown")], "path string, keyword string")
    targets = spark.createDataFrame([(f"q{i}", k, words[(i + k * 5) % 12]) for i in range(10) for k in range(3)], "query_id string, idx bigint, label string")
    return keywords, targets, vectors


def test_blocks_meet_without_being_moved(spark, monkeypatch):
    for name, value in {"FILE_BLOCK": 7, "SENTENCE_BLOCK": 3, "TERM_BLOCK": 2, "TARGET_BLOCK": 2}.items():
        monkeypatch.setattr(match, name, value, raising=False)
    plan = match.match_sentences(*crowd(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # no copy of a block of files for each block of sentences, nor the other way round


def test_matches_in_blocks_of_any_size(spark, monkeypatch):
    frames = crowd(spark)
    expected = sorted(map(str, match.match_sentences(*frames, threshold=0.9).collect()))
    assert len({r.split(",")[0] for r in expected}) == 10
    for name, value in {"FILE_BLOCK": 4, "FILES_HELD": 2, "SENTENCE_BLOCK": 4, "TERM_BLOCK": 2, "TARGET_BLOCK": 2, "VECTORS_HELD": 1, "SHARD": 5, "CELLS_HELD": 9, "MATCHES_HELD": 3}.items():
        monkeypatch.setattr(match, name, value)
    assert sorted(map(str, match.match_sentences(*frames, threshold=0.9).collect())) == expected
    found = match.match_sentences(*frames, threshold=0.9, gathered=True).collect()
    rows = [(r.query_id, path, score, r.idx, r.label) for r in found for path, score in zip(r.paths, r.scores, strict=True)]
    assert sorted(str(type(row)(row)) for row in rows) == sorted(str((r.query_id, r.path, r.score, r.idx, r.label)) for r in match.match_sentences(*frames, threshold=0.9).collect())


def test_texts_are_written_where_they_are_read(spark, tmp_path, monkeypatch):
    rows = spark.range(80).selectExpr("id % 60 as doc_id", "concat('text ', id % 60) as text", "'en' as lang", "'web' as source", "length(text) as n_chars")
    rows.repartition(spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "documents.parquet"))
    frame, plans = type(rows), []
    original = frame.mapInArrow

    def seen(self, *args, **options):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return original(self, *args, **options)

    monkeypatch.setattr(frame, "mapInArrow", seen)
    root = fx.file_tree(spark, str(tmp_path), flat=True)
    assert len(plans) == 1 and "Exchange" not in plans[0]
    found = [os.path.join(d, f) for d, _, files in os.walk(root) for f in files]
    assert sorted(open(p).read() for p in found) == sorted(f"text {i}" for i in range(60))
    assert not os.path.exists(f"{root}-parts")


def test_a_checkpoint_leaves_no_shuffle_behind(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f for at in disk.localDirs() for d, _, files in os.walk(at.getPath()) for f in files if re.match(r"shuffle_\d+_.*\.data", f)}

    before, usual = shuffles(), spark.conf.get(REMOVE_SHUFFLES, "false")
    kept = materialise(spark.range(1000, numPartitions=4).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert kept.agg(F.sum("count")).first()[0] == 1000 and spark.conf.get(REMOVE_SHUFFLES, "false") == usual
