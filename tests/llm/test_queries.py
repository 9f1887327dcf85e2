"""The registered queries against their SQL, contracts and held-out figures."""

import compare
import numpy as np
import pytest
from cataloom.llm.common import table, written
from cataloom.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert compare.difference(QUERIES[name](spark, SF_DIR), compare.connect(SF_DIR), ORACLE[name]) is None


def test_held_out_language(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "lang")
    found = QUERIES["op2_language_id"](spark, SF_DIR).join(docs, "doc_id").where("held_out").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() >= 0.98


def test_held_out_quality(spark):
    found = QUERIES["op10_quality"](spark, "/root/testdata/sf0.01")
    found = found.join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").toPandas()
    good, bad = (found[found["quality"] == k]["score"].to_numpy() for k in (1, 0))
    assert (good[:, None] > bad[None]).mean() >= 0.97


def test_edited_texts_are_nearer_than_neighbours(spark):
    found = QUERIES["op7_fingerprints"](spark, SF_DIR).toPandas()
    assert np.mean(found["near_edited"].to_numpy()[:, None] > found["near_next"].to_numpy()[None]) >= 0.97


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF_DIR, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), name)
        assert docs.columns[: len(columns)] == columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left and left <= ids
        ids = left
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == ids
