"""Physical plans: what moves, what is read, and that no pairs are built."""

import re

import pytest
from cataloom.operators.naming import _ranked
from cataloom.operators.keywords import rank_keywords, term_frequency, top_keywords
from cataloom.operators.tokens import lexicon_lookup, token_filter, tokens
from cataloom.sources.content import previews
from cataloom.workload import fixtures as fx
from cataloom.workload.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moves(df):
    """Exchanges, but for the one that gathers the lexicon's few entries by lower-case token."""
    found = re.findall(r"Exchange (?:hash|range|SinglePartition|RoundRobin)\w*[^,]*", plan_of(df))
    return [move for move in found if "_groupingexpression" not in move]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairs(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_keywords_move_the_previews_once(spark):
    assert len(moves(top_keywords(fx.library_texts(spark, SF_DIR), fx.lexicon(spark)))) == 1


def test_keywords_of_bucketed_texts_move_nothing(spark, tmp_path):
    texts = fx.table(spark, SF_DIR, "documents").selectExpr("cast(doc_id as string) as path", "text")
    texts.write.bucketBy(8, "path").option("path", str(tmp_path / "t")).saveAsTable("bucketed_texts")
    try:
        found = top_keywords(previews(spark.table("bucketed_texts"), placed=False), fx.lexicon(spark))
        assert moves(found) == []
        assert found.count() > 0
    finally:
        spark.sql("drop table bucketed_texts")


def test_keywords_of_any_partitioning_agree(spark):
    texts = fx.library_texts(spark, SF_DIR)
    counts = term_frequency(token_filter(lexicon_lookup(tokens(texts.coalesce(3)), fx.lexicon(spark))))
    a, b = rank_keywords(counts), top_keywords(texts, fx.lexicon(spark))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_one_lexicon_join(spark):
    rows = tokens(fx.library_texts(spark, SF_DIR))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(re.findall(r"\w+Join ", plan_of(lexicon_lookup(rows, fx.lexicon(spark))))) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_lexicon_is_joined_without_broadcast(spark):
    texts, words = fx.library_texts(spark, SF_DIR), fx.lexicon(spark)
    expected = top_keywords(texts, words).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = top_keywords(texts, words)
        assert "BroadcastHashJoin" not in plan_of(found)
        assert sorted(found.collect()) == sorted(expected)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["classify_by_extension", "category_breakdown", "collision_suffix", "destination_paths"])
def test_listing_queries_read_no_text(spark, name):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES[name](spark, SF_DIR)))
    assert schemas and all("text:" not in s for s in schemas)


def test_rows_move_once_where_nothing_contends(spark):
    plan = plan_of(QUERIES["collision_suffix"](spark, SF_DIR))
    wide = [line for line in plan.split("Exchange")[1:] if "AS row#" in line.split("Exchange")[0]]
    assert len(wide) == 1


def test_marks_are_sliced(spark):
    rows = spark.range(2).selectExpr("'C' as category", "'a.t' as filename", "id * 200000 as scan_seq")
    marks = spark.range(1, 100_001).selectExpr("'C' as category", "'a.t' as parent", "concat('a_', id, '.t') as filename", "id as first_seq")
    ranked = _ranked(rows, 6, marks)
    assert ranked.where("mark is not null").count() == 100_000
    assert ranked.where("ahead = 1 and mark is not null").count() == 100_000
    assert "slice" in plan_of(ranked).split("hashpartitioning(")[1].split(")")[0]


def test_cosines_are_worked_out_once(spark):
    plan = plan_of(QUERIES["organise_with_query"](spark, SF_DIR))
    assert not [line for line in plan.splitlines() if "Filter" in line and "zip_with" in line]
