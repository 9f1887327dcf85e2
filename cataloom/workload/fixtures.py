"""Listings, sidecar tables, lexicon and vectors derived from the given tables."""

from __future__ import annotations

import os
import re
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions.names import is_plain_text, join_path
from cataloom.functions.text import text_prefix
from cataloom.operators.classify import classify
from cataloom.session import new_shared_path
from cataloom.sources.assembled import assemble_ocr_text, assemble_slide_text, assemble_transcript, dispatch_text, text_bearing
from cataloom.sources.content import previews, task_count

SENTENCE = "organize by Invoice, Legal, Medical, HR"
DEST = "/out"

# A small lexicon of (token, lemma, tag, stop word?).
LEXICON = [
    ("the", "the", "DET", True), ("of", "of", "ADP", True), ("and", "and", "CCONJ", True),
    ("to", "to", "PART", True), ("in", "in", "ADP", True), ("a", "a", "DET", True),
    ("is", "be", "AUX", True), ("that", "that", "PRON", True), ("it", "it", "PRON", True),
    ("for", "for", "ADP", True), ("on", "on", "ADP", True), ("was", "be", "AUX", True),
    ("with", "with", "ADP", True), ("be", "be", "AUX", True), ("as", "as", "ADP", True),
    ("by", "by", "ADP", True), ("this", "this", "DET", True), ("are", "be", "AUX", True),
    ("from", "from", "ADP", True), ("at", "at", "ADP", True), ("than", "than", "ADP", True),
    ("then", "then", "ADV", True), ("des", "der", "DET", True), ("les", "le", "DET", True),
    ("und", "und", "CCONJ", True), ("que", "que", "SCONJ", True), ("una", "un", "DET", True),
    ("organize", "organize", "VERB", False), ("sort", "sort", "VERB", False),
    ("categorize", "categorize", "VERB", False), ("rewh", "rewh", "VERB", False),
    ("hehely", "hehely", "ADV", False), ("ononst", "onon", "ADJ", False),
    ("inoran", "inoran", "NOUN", False), ("Orre", "Orre", "PROPN", False),
    ("orre", "orr", "ADV", False), ("orantion", "page", "NOUN", False),
    ("Page", "Page", "PROPN", False), ("thatin", "thatin", "ADP", False),
    ("thing", "thing", "NOUN", False), ("things", "thing", "NOUN", False),
    ("thon", "thon", "X", False),
]

# The extension given to a document, by document number.
EXTENSIONS = [
    ".txt", ".csv", ".PDF", ".docx", ".png", ".jpg", ".mp3", ".mp4", ".zip", ".sh", ".py", ".html", "", ".xyz", ".tar.gz", ".pptx",
]
#: The first of the extensions, and how many, that pictures, sound and slide decks have.
PICTURES, SOUND, DECKS = (4, 2), (6, 2), (15, 1)
#: Whole texts that a task which writes files holds at a time.
ARROW_ROWS, TEXTS_HELD = "spark.sql.execution.arrow.maxRecordsPerBatch", 256
#: More turns than a conversation has.
TURNS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession) -> DataFrame:
    """As inline rows, whose size Spark knows."""
    rows = ", ".join(f"('{t}', '{l}', '{g}', {str(s).lower()})" for t, l, g, s in LEXICON)
    return spark.sql(f"select * from values {rows} as lexicon(token, lemma, tag, is_stop)")


def _folder() -> Column:
    sub = F.when(F.col("doc_id") % 2 == 1, "/sub").otherwise("")
    return F.concat(F.lit("/in/"), F.col("lang"), sub)


def _extension() -> Column:
    return F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))


def _listing(documents: DataFrame, parent: Column, filename: Column) -> DataFrame:
    return documents.withColumns({"parent": parent, "filename": filename}).select(
        join_path("parent", "filename").alias("path"),
        "filename",
        "parent",
        F.col("n_chars").alias("length"),
        F.col("doc_id").alias("scan_seq"),
    )


def _own_folder() -> Column:
    return F.concat(_folder(), F.lit("/"), F.col("doc_id").cast("string"))


def _name() -> Column:
    return F.concat(F.col("source"), _extension())


def _flat_name() -> Column:
    return F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("source"), _extension())


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of 16 kinds, each in its own folder; names repeat."""
    return _listing(table(spark, sf_dir, "documents"), _own_folder(), _name())


def flat_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, but many to a folder and with names of their own."""
    return _listing(table(spark, sf_dir, "documents"), _folder(), _flat_name())


def contended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose names look like numbered copies of one another."""
    number = F.element_at(F.array(F.lit(""), F.lit("_1"), F.lit("_1_1")), (F.col("doc_id") % 3 + 1).cast("int"))
    name = F.concat(F.col("source"), number, F.lit(".txt"))
    return _listing(table(spark, sf_dir, "documents"), _own_folder(), name)


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Markdown files."""
    return _listing(
        table(spark, sf_dir, "documents"), _own_folder(), F.concat(F.col("source"), F.lit(".md"))
    )


def library_texts(spark: SparkSession, sf_dir: str, placed: bool = True) -> DataFrame:
    """``(path, preview)`` of the library, every text read in full; ``categorise`` places the rows itself."""
    path = join_path(_own_folder(), F.concat(F.col("source"), F.lit(".md")))
    return previews(table(spark, sf_dir, "documents").select(path.alias("path"), "text"), placed)


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, category, text)`` of the catalogue: a prefix of plain text, all of the others."""
    filename = F.concat(F.col("source"), _extension())
    rows = table(spark, sf_dir, "documents").select(
        join_path(_own_folder(), filename).alias("path"), filename.alias("filename"), "text"
    )
    text = F.when(is_plain_text(F.col("path")), text_prefix(F.col("text").cast("binary"))).otherwise(F.col("text"))
    return classify(rows).select("path", "category", text.alias("text"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts: 50 s per turn, some clips untrimmed or of unknown length."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("path"),
        "conv_id",
        F.col("turn").alias("seq"),
        (F.col("turn") * 50).alias("start_s"),
        F.when(F.col("conv_id") % 7 != 0, F.lit(400) - F.col("conv_id") % 5 * 75).alias("duration_s"),
        (F.col("conv_id") % 11 == 0).alias("untrimmed"),
        "text",
    )


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as picture lines."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("path"), "conv_id", F.col("turn").alias("line_num"), "text"
    )


def slides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as decks: the opening turn is slide text, the others are picture lines."""
    rows = table(spark, sf_dir, "conversations").withColumn("path", F.col("conv_id").cast("string"))
    text = rows.where("turn = 0").select("path", "conv_id", "text")
    lines = rows.where("turn > 0").select(
        "path",
        "conv_id",
        (F.col("turn") % 2).alias("slide_num"),
        F.lit(0).cast("long").alias("shape_num"),
        F.col("turn").alias("line_num"),
        "text",
    )
    return text, lines


def _placed(spark: SparkSession, sf_dir: str, pieces: DataFrame, kind: tuple[int, int], *order: str) -> DataFrame:
    """Every conversation's pieces given to a file of a kind; files that get several read one after the other."""
    first, kinds = kind
    n = table(spark, sf_dir, "documents").agg(F.floor(F.count("*") / len(EXTENSIONS)).alias("n")).scalar()
    conv = F.col("conv_id")
    owner = F.floor(conv / kinds) % n * len(EXTENSIONS) + first + conv % kinds
    paths = catalogue(spark, sf_dir).select(F.col("scan_seq").alias("owner"), "path")
    rows = pieces.drop("path").withColumns({"owner": owner} | {c: conv * TURNS + F.col(c) for c in order})
    return rows.join(paths, "owner").drop("owner")


def catalogue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text-bearing catalogue with previews from documents, picture lines, transcripts and slide decks."""
    files = text_bearing(classify(catalogue(spark, sf_dir)))
    documents = document_texts(spark, sf_dir).where("category = 'Documents'")
    return dispatch_text(files, previews(documents, placed=False), *other_texts(spark, sf_dir))


def other_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(path, preview)`` of pictures, sound and slide decks of the catalogue; each conversation is in one file of each kind."""
    text, lines = slides(spark, sf_dir)
    text = _placed(spark, sf_dir, text, DECKS).groupBy("path").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("conv_id", "text"))).getField("text"), " ").alias("text")
    )
    return (
        assemble_ocr_text(_placed(spark, sf_dir, ocr_lines(spark, sf_dir), PICTURES, "line_num")),
        assemble_transcript(_placed(spark, sf_dir, segments(spark, sf_dir), SOUND, "seq")),
        assemble_slide_text(text, _placed(spark, sf_dir, lines, DECKS, "slide_num")),
    )


def toy_model():
    """A model for tests: the first bytes of a word's digest as its vector."""
    import hashlib

    import numpy as np

    def predict(words):
        rows = [list(hashlib.md5(str(w).encode()).digest()[:8]) for w in words]
        return np.array(rows, np.float32).reshape(len(rows), 8) - np.float32(127.5)

    return predict


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as user sentences."""
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "text"
    )


def sentences_and_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, and a blank sentence for each conversation."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    blank = ids.select(F.concat("conv_id", F.lit("-blank")).alias("query_id"), F.lit(" \t\n").alias("text"))
    return sentences(spark, sf_dir).unionByName(blank)


def every_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, preview)`` of the whole catalogue: the texts of ``catalogue_texts``, and document texts for all other kinds."""
    rest = document_texts(spark, sf_dir).where("category not in ('Documents', 'Images', 'Audio', 'Video')")
    return catalogue_texts(spark, sf_dir).select("path", "preview").unionByName(previews(rest, placed=False))


def file_tree(spark: SparkSession, sf_dir: str, flat: bool) -> str:
    """All documents as files below a new folder that the executors share; returns the folder.

    With ``flat`` many files lie in a folder, under names of their own; else each has its own folder and names repeat.
    """
    root = on_local_path(new_shared_path(spark, "tree"))
    parent, name = (_folder(), _flat_name()) if flat else (_own_folder(), _name())
    documents = table(spark, sf_dir, "documents").where("doc_id is not null")
    rows = documents.select(join_path(parent, name).alias("path"), "text")
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # else texts are written by the tasks that read them
        rows = rows.repartition(task_count(documents), "path")
    parts = f"{root}-parts"  # beside the tree: what a lost task leaves here is no file of it

    def write(batches):
        part = f"{parts}/{uuid.uuid4().hex}/text"  # one for each task
        os.makedirs(os.path.dirname(part))
        for batch in batches:
            for path, text in zip(batch.column("path"), batch.column("text")):  # one text at a time
                place = root + path.as_py()
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(part, "wb") as out:
                    out.write(text.as_py().encode())
                os.replace(part, place)  # whole, also where two tasks write the same path
            yield batch.select(["path"]).slice(0, 0)

    rows_held = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(TEXTS_HELD))
    try:
        rows.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set(ARROW_ROWS, rows_held)
    shutil.rmtree(parts, ignore_errors=True)
    return root


def on_local_path(folder: str) -> str:
    """The mounted path of a shared folder that is named by a ``file:`` address."""
    return re.sub("^file:/*", "/", folder)


def term_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("term"), F.col("embedding").alias("vec"))


def vector_key(spark: SparkSession, sf_dir: str):
    """A word's row of the vector table: a hash modulo the table's length."""
    n = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n")).scalar()
    return lambda word: F.conv(F.substring(F.md5(F.lower(word)), 1, 8), 16, 10).cast("long") % n


def _labelled(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(condition).select(F.col("doc_id").alias("scan_seq"))


def present_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later listing of the catalogue, in which the files labelled toxic are gone."""
    return catalogue(spark, sf_dir).join(_labelled(spark, sf_dir, "toxic = 1"), "scan_seq", "left_anti")


def existing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A destination that already holds a copy of each file labelled good, one per name."""
    files = classify(catalogue(spark, sf_dir)).join(_labelled(spark, sf_dir, "quality = 1"), "scan_seq", "left_semi")
    return files.select(join_path(F.lit(DEST), F.col("category"), F.col("filename")).alias("path")).distinct()


def sources_after_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources at verification time; some French files can no longer be sized."""
    gone = F.startswith(F.col("parent"), F.lit("/in/fr/sub/"))
    return present_sources(spark, sf_dir).where(~gone)


def damaged_copies(spark: SparkSession, sf_dir: str, plan: DataFrame) -> DataFrame:
    """Destination listing after the copy: bad-quality files missing, Spanish ones a byte too long."""
    kept = plan.where("status = 'planned'").join(_labelled(spark, sf_dir, "quality = 0"), "scan_seq", "left_anti")
    extra = F.when(F.startswith(F.col("path"), F.lit("/in/es/")), 1).otherwise(0)
    return kept.select(F.col("dest_path").alias("path"), (F.col("length") + extra).alias("length"))


def clean_copies(plan: DataFrame) -> DataFrame:
    return plan.where("status = 'planned'").select(F.col("dest_path").alias("path"), "length")
