import random
import re
from collections import Counter

from cataloom.operators.keywords import keyword_eligible, keyword_strings, top_keywords
from cataloom.operators.tokens import query_targets
from cataloom.plans.organise import choose_branch, sentence_targets

LEXICON = "token string, lemma string, tag string, is_stop boolean"


def lexicon(spark, *rows):
    return spark.createDataFrame(list(rows), LEXICON)


def strings(spark, texts, words):
    df = spark.createDataFrame(list(texts.items()), "path string, preview string").repartition("path")
    return {r.path: r.keywords for r in keyword_strings(df, top_keywords(df, words)).collect()}


def test_equals_counter(spark):
    rnd = random.Random(11)
    vocabulary = ["run", "runs", "Run", "the", "page", "file", "Page", "ab", "abc", "quick", "Berlin", "berlin", *(f"w{c}{c}{d}" for c in "abcdef" for d in "xyz")]
    entries = [
        ("runs", "run", "VERB", False), ("Run", "Run", "PROPN", False), ("the", "the", "DET", True), ("quick", "quick", "ADV", False),
        ("Page", "Page", "PROPN", False), ("Berlin", "Berlin", "PROPN", False), ("abc", "date", "NOUN", False),
    ]
    table = {e[0]: e[1:] for e in entries}
    generic = {"page", "date", "file", "total", "text", "format", "number", "datum", "sheet"}
    texts, expected = {}, {}
    for i in range(60):
        text = " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 120)))
        kept = []
        for token in re.findall(r"[^\W\d_]+", text):
            lemma, tag, stop = table.get(token) or table.get(token.lower()) or (token.lower(), "NOUN", False)
            if tag in ("NOUN", "PROPN", "VERB", "ADJ") and not stop and len(token) > 2 and lemma not in generic:
                kept.append(lemma)
        texts[f"p{i}"] = text
        expected[f"p{i}"] = ", ".join(w for w, _ in Counter(kept).most_common(20))
    assert strings(spark, texts, lexicon(spark, *entries)) == expected


def test_first_occurrence_wins_ties(spark):
    names = ["z" + chr(97 + i) + "q" for i in range(21)]
    found = strings(spark, {"a": " ".join(names), "b": " ".join(names[:20]), "c": "ab"}, lexicon(spark))
    assert found == {"a": ", ".join(names[:20]), "b": ", ".join(names[:20]), "c": ""}


def test_eligible(spark):
    rows = spark.createDataFrame([("a", "x", "Documents"), ("b", "", "Documents"), ("c", "x", "Others")], "path string, preview string, category string")
    assert [r.path for r in keyword_eligible(rows).collect()] == ["a"]


def test_sample_sentences(spark):
    words = lexicon(
        spark, *[(v, v, "VERB", False) for v in ("organize", "sort", "categorize")], *[(v, v, "ADP", True) for v in ("by", "as")]
    )
    cases = {
        "organize by Invoice, Contract, Legal": ["Invoice", "Contract", "Legal"],
        "sort by Medical, Financial, Personal": ["Medical", "Financial", "Personal"],
        "categorize as Resume, Portfolio, Certificate": ["Resume", "Portfolio", "Certificate"],
        "Legal by legal page Legal": ["Legal", "legal", "page", "Legal"],
        "sort by": [],
    }
    queries = spark.createDataFrame(list(cases.items()), "text string, x array<string>").selectExpr("text as query_id", "text")
    found = {q: [] for q in cases}
    for r in query_targets(queries, words).orderBy("query_id", "idx").collect():
        assert r.idx == len(found[r.query_id])
        found[r.query_id].append(r.label)
    assert found == cases
    assert [tuple(r) for r in sentence_targets(spark, "sort by 'HR'", words).collect()] == [(0, "HR")]


def test_branch(spark):
    rows = spark.createDataFrame([("", "keep"), ("  ", "keep"), ("x", "match")], "text string, expected string")
    assert choose_branch(rows).where("branch <> expected").count() == 0
