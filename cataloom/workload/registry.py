"""One query per operator: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions.names import base_name, extension, is_plain_text, join_path, parent_of, stem
from cataloom.functions.text import capitalise, parse_keywords, text_prefix, word_count
from cataloom.functions.vectors import norm
from cataloom.operators import keywords as kw
from cataloom.operators import layout, match, summary, tokens, verify
from cataloom.operators.classify import classify
from cataloom.operators.naming import assign_names
from cataloom.plans.organise import categorise, choose_branch, organise_folder, sentence_targets
from cataloom.session import configure, materialise, new_shared_path
from cataloom.sources import assembled
from cataloom.sources.content import attach_extracted_text, read_text_prefix
from cataloom.sources.listing import below, scan_files, with_scan_seq
from cataloom.workload import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def score(column: str = "score"):
    """Scores as shown: both engines agree to far more than nine places."""
    return F.round(column, 9).alias("score")


# --- listing and names -------------------------------------------------------


@query
def scan_totals(spark, sf_dir):
    return summary.scan_totals(fx.catalogue(spark, sf_dir))


@query
def scan_recursive(spark, sf_dir):
    return below(fx.flat_catalogue(spark, sf_dir), "/in/en")


@query
def scan_top_level(spark, sf_dir):
    return below(fx.flat_catalogue(spark, sf_dir), "/in/en", recursive=False)


@query
def split_extension(spark, sf_dir):
    name = F.col("filename")
    files = fx.catalogue(spark, sf_dir).select("path", "filename")
    pages = fx.table(spark, sf_dir, "pages").select(F.col("url").alias("path"), base_name(F.col("url")).alias("filename"))
    return files.unionByName(pages).select("path", "filename", stem(name).alias("stem"), extension(name).alias("ext"))


@query
def path_parts(spark, sf_dir):
    url = F.col("url")
    return fx.table(spark, sf_dir, "pages").select(
        "page_id",
        parent_of(url).alias("parent"),
        base_name(url).alias("filename"),
        join_path(F.lit("/mirror"), base_name(parent_of(url)), base_name(url)).alias("joined"),
    )


@query
def classify_by_extension(spark, sf_dir):
    return classify(fx.catalogue(spark, sf_dir)).select("path", "filename", "ext", "category")


@query
def category_breakdown(spark, sf_dir):
    return summary.category_breakdown(classify(fx.catalogue(spark, sf_dir)))


# --- text --------------------------------------------------------------------


@query
def text_bearing(spark, sf_dir):
    return assembled.text_bearing(classify(fx.catalogue(spark, sf_dir))).select("path", "category")


@query
def keyword_eligible(spark, sf_dir):
    files = classify(fx.catalogue(spark, sf_dir))
    texts = fx.catalogue_texts(spark, sf_dir).select("path", "preview")
    everything = files.join(texts, "path", "left").withColumn("preview", F.coalesce("preview", F.lit("")))
    return kw.keyword_eligible(everything).select("path", "category")


@query
def text_prefix_(spark, sf_dir):
    content = F.col("text").cast("binary")
    return fx.table(spark, sf_dir, "documents").select("doc_id", text_prefix(content).alias("prefix"))


QUERIES["text_prefix"] = QUERIES.pop("text_prefix_")


@query
def word_preview(spark, sf_dir):
    return fx.library_texts(spark, sf_dir).select(
        "path", "preview", word_count(F.col("preview")).cast("long").alias("n_words")
    )


@query
def attach_extracted(spark, sf_dir):
    files = classify(fx.catalogue(spark, sf_dir)).select("path", "category")
    extracted = fx.document_texts(spark, sf_dir).where((F.col("category") == "Documents") & ~is_plain_text(F.col("path")))
    return attach_extracted_text(files, extracted)


QUERIES["attach_extracted_text"] = QUERIES.pop("attach_extracted")


@query
def assemble_ocr_text(spark, sf_dir):
    return assembled.assemble_ocr_text(fx.ocr_lines(spark, sf_dir))


@query
def assemble_slide_text(spark, sf_dir):
    return assembled.assemble_slide_text(*fx.slides(spark, sf_dir))


@query
def assemble_transcript(spark, sf_dir):
    return assembled.assemble_transcript(fx.segments(spark, sf_dir))


@query
def dispatch_text(spark, sf_dir):
    return fx.catalogue_texts(spark, sf_dir).select("path", "category", "preview")


# --- tokens and keywords -----------------------------------------------------


def _tokens(spark, sf_dir):
    return tokens.tokens(fx.library_texts(spark, sf_dir))


def _looked_up(spark, sf_dir):
    return tokens.lexicon_lookup(_tokens(spark, sf_dir), fx.lexicon(spark))


def _keywords(spark, sf_dir):
    return kw.top_keywords(fx.library_texts(spark, sf_dir), fx.lexicon(spark))


def _strings(spark, sf_dir):
    return kw.keyword_strings(fx.library(spark, sf_dir), _keywords(spark, sf_dir))


QUERIES["tokens"] = _tokens
QUERIES["lexicon_lookup"] = _looked_up
QUERIES["token_filter"] = lambda spark, sf_dir: tokens.token_filter(_looked_up(spark, sf_dir))
QUERIES["term_frequency"] = lambda spark, sf_dir: kw.term_frequency(tokens.token_filter(_looked_up(spark, sf_dir)))
QUERIES["top_keywords"] = _keywords
QUERIES["keyword_string"] = _strings


@query
def keywords_parsed(spark, sf_dir):
    return _strings(spark, sf_dir).select("path", F.posexplode(parse_keywords(F.col("keywords")))).select(
        "path", F.col("pos").cast("long").alias("pos"), F.col("col").alias("keyword")
    )


QUERIES["parse_keywords"] = QUERIES.pop("keywords_parsed")


@query
def query_targets(spark, sf_dir):
    return tokens.query_targets(fx.sentences(spark, sf_dir), fx.lexicon(spark))


@query
def capitalise_label(spark, sf_dir):
    found = query_targets(spark, sf_dir)
    return found.select("query_id", "idx", "label", capitalise(F.col("label")).alias("category"))


QUERIES["choose_branch"] = lambda spark, sf_dir: choose_branch(fx.sentences_and_blanks(spark, sf_dir)).select(
    "query_id", "branch"
)


# --- vectors -----------------------------------------------------------------


def _targets(spark):
    return sentence_targets(spark, fx.SENTENCE, fx.lexicon(spark))


def _vocabulary(spark, sf_dir):
    return _keywords(spark, sf_dir).select("keyword").distinct()


def _scored(spark, sf_dir):
    return match.score_terms(fx.term_vectors(spark, sf_dir), _targets(spark), fx.vector_key(spark, sf_dir))


def _with_norm(rows):
    return rows.withColumns(
        {"n_dims": F.size("vec").cast("long"), "norm": F.round(norm(F.col("vec")), 6)}
    ).drop("vec")


@query
def attach_target_vectors(spark, sf_dir):
    sources = fx.sentences(spark, sf_dir)
    found = tokens.query_targets(sources, fx.lexicon(spark))
    return _with_norm(
        match.attach_vectors(found, "label", fx.term_vectors(spark, sf_dir), fx.vector_key(spark, sf_dir))
    )


@query
def attach_keyword_vectors(spark, sf_dir):
    return _with_norm(
        match.attach_vectors(
            _vocabulary(spark, sf_dir), "keyword", fx.term_vectors(spark, sf_dir), fx.vector_key(spark, sf_dir)
        )
    )


@query
def pairwise_cosine(spark, sf_dir):
    key = fx.vector_key(spark, sf_dir)
    words = _vocabulary(spark, sf_dir).withColumn("term", key(F.col("keyword")))
    scored = words.join(_scored(spark, sf_dir), "term").select(F.col("keyword").alias("term"), "scores")
    return match.pairwise_cosine(scored).select("term", "idx", "label", score())


@query
def best_score(spark, sf_dir):
    best = match.best_per_file(_keywords(spark, sf_dir), _scored(spark, sf_dir), fx.vector_key(spark, sf_dir))
    return best.select("path", score())


@query
def best_target(spark, sf_dir):
    best = match.best_per_file(_keywords(spark, sf_dir), _scored(spark, sf_dir), fx.vector_key(spark, sf_dir))
    return best.select("path", "idx", "label")


# --- whole runs --------------------------------------------------------------


def _matched_catalogue(spark, sf_dir):
    # texts of all kinds of files: the match must keep to the kinds whose text counts
    texts = fx.every_text(spark, sf_dir).where("preview != ''")
    return categorise(
        classify(fx.catalogue(spark, sf_dir)), texts, fx.SENTENCE, fx.lexicon(spark), fx.term_vectors(spark, sf_dir),
        key=fx.vector_key(spark, sf_dir),
    )


@query
def match_sentences(spark, sf_dir):
    """The library against every turn of every conversation as a sentence: the files that go to each category."""
    keywords = materialise(_keywords(spark, sf_dir))
    # files go by their place in path order: so that the least of many is found without comparing texts
    places = with_scan_seq(keywords.select("path").where("path is not null").distinct())
    numbered = keywords.join(places, "path", "left").select(F.col("scan_seq").alias("path"), "keyword")
    found = match.match_sentences(
        numbered, tokens.query_targets(fx.sentences(spark, sf_dir), fx.lexicon(spark)),
        fx.term_vectors(spark, sf_dir), key=fx.vector_key(spark, sf_dir), gathered=True,
    )
    counts = found.groupBy("query_id", "idx", "label").agg(
        F.sum(F.size("paths")).alias("n_files"),
        F.round(F.max(F.array_max("scores")), 9).alias("best"),
        F.min(F.array_min("paths")).alias("scan_seq"),
    )
    return counts.join(places.withColumnRenamed("path", "first_path"), "scan_seq", "left").select(
        "query_id", "idx", "label", "n_files", "best", "first_path"
    )


@query
def match_categories(spark, sf_dir):
    return _matched_catalogue(spark, sf_dir).select("path", "ext_category", "category", score())


@query
def organise_with_query(spark, sf_dir):
    """Flagship: every document to the category of the sentence that its keywords come closest to."""
    files = classify(fx.library(spark, sf_dir))
    found = categorise(
        files,
        fx.library_texts(spark, sf_dir, placed=False),
        fx.SENTENCE,
        fx.lexicon(spark),
        fx.term_vectors(spark, sf_dir),
        key=fx.vector_key(spark, sf_dir),
    )
    return found.select("path", "ext_category", "category", score())


@query
def organise_with_model(spark, sf_dir):
    """The library with vectors from a model that is called for each distinct keyword and category name."""
    files = classify(fx.library(spark, sf_dir))
    found = categorise(files, fx.library_texts(spark, sf_dir, placed=False), fx.SENTENCE, fx.lexicon(spark), model=fx.toy_model)
    return found.select("path", "ext_category", "category", score())


def _plan_columns(plan):
    return plan.select("path", "category", "dest_path", "n_suffix", "status")


@query
def organise_no_query(spark, sf_dir):
    files = categorise(classify(fx.catalogue(spark, sf_dir)))
    return _plan_columns(layout.plan_layout(files, fx.DEST))


@query
def organise_layout(spark, sf_dir):
    return _plan_columns(layout.plan_layout(materialise(_matched_catalogue(spark, sf_dir)), fx.DEST))


# --- layout ------------------------------------------------------------------


@query
def destination_paths(spark, sf_dir):
    files = classify(fx.catalogue(spark, sf_dir))
    return layout.destination_paths(files, fx.DEST).select("path", "category", "dest_path")


@query
def missing_sources(spark, sf_dir):
    return layout.missing_sources(fx.catalogue(spark, sf_dir), fx.present_sources(spark, sf_dir)).select("path")


def _plan(spark, sf_dir):
    files = classify(fx.catalogue(spark, sf_dir))
    return layout.plan_layout(files, fx.DEST, sources=fx.present_sources(spark, sf_dir))


def _clean_plan(spark, sf_dir):
    return layout.plan_layout(classify(fx.catalogue(spark, sf_dir)), fx.DEST)


QUERIES["copy_status"] = lambda spark, sf_dir: layout.copy_status(_plan(spark, sf_dir))


@query
def collision_suffix(spark, sf_dir):
    named = assign_names(classify(fx.catalogue(spark, sf_dir)))
    return named.select("path", "category", "target", "n_suffix")


@query
def collision_existing(spark, sf_dir):
    taken = layout.names_in_layout(fx.existing_targets(spark, sf_dir), fx.DEST)
    named = assign_names(classify(fx.catalogue(spark, sf_dir)), taken)
    return named.select("path", "category", "target", "n_suffix")


@query
def collision_contended(spark, sf_dir):
    named = assign_names(classify(fx.contended(spark, sf_dir)))
    return named.select("path", "target", "n_suffix")


@query
def write_layout(spark, sf_dir):
    """Write into the shared folder, then read the table back."""
    configure(spark)
    contents = fx.document_texts(spark, sf_dir).select("path", F.col("text").cast("binary").alias("content"))
    folder = new_shared_path(spark, "layout")
    layout.write_layout(_plan(spark, sf_dir), contents, folder)
    return spark.read.parquet(folder).select(
        "path", "category", "dest_path", "length", F.col("content").cast("string").alias("content")
    )


# --- verification ------------------------------------------------------------


def _checked(spark, sf_dir):
    """Plan, verification and source listing of a run in which some copies went wrong."""
    plan = materialise(_plan(spark, sf_dir))
    sources = fx.sources_after_copy(spark, sf_dir)
    return plan, materialise(verify.verify_copies(plan, sources, fx.damaged_copies(spark, sf_dir, plan))), sources


def _checked_clean(spark, sf_dir):
    plan = materialise(_clean_plan(spark, sf_dir))
    sources = fx.catalogue(spark, sf_dir)
    return plan, materialise(verify.verify_copies(plan, sources, fx.clean_copies(plan))), sources


QUERIES["verify_copies"] = lambda spark, sf_dir: _checked(spark, sf_dir)[1]
QUERIES["failed_verifications"] = lambda spark, sf_dir: verify.failed_verifications(_checked(spark, sf_dir)[1])


@query
def retire_gate(spark, sf_dir):
    rows = [
        verify.retire_gate(*checked(spark, sf_dir)[:2]).select(F.lit(name).alias("run"), "passed")
        for name, checked in (("damaged", _checked), ("clean", _checked_clean))
    ]
    return rows[0].unionByName(rows[1])


@query
def retire_list(spark, sf_dir):
    rows = [
        verify.retire_list(*checked(spark, sf_dir)).select(F.lit(name).alias("run"), "path")
        for name, checked in (("damaged", _checked), ("clean", _checked_clean))
    ]
    return rows[0].unionByName(rows[1])


@query
def run_summary(spark, sf_dir):
    rows = []
    for name, checked in (("damaged", _checked), ("clean", _checked_clean)):
        plan, verification, sources = checked(spark, sf_dir)
        retired = verify.retire_list(plan, verification, sources)
        rows.append(summary.run_summary(plan, verification, retired).withColumn("run", F.lit(name)))
    return rows[0].unionByName(rows[1])


# --- real files --------------------------------------------------------------


def _relative(root, column="path"):
    return F.substring(F.col(column), F.lit(len(root) + 1), F.length(column))


@query
def scan_tree(spark, sf_dir):
    """A recursive scan of files that Spark has written."""
    root = fx.file_tree(spark, sf_dir, flat=True)
    return scan_files(spark, root).select(_relative(root).alias("path"), "filename", "length", "scan_seq")


@query
def scan_tree_top(spark, sf_dir):
    root = fx.file_tree(spark, sf_dir, flat=True)
    found = scan_files(spark, f"{root}/in/en", recursive=False)
    return found.select(_relative(root).alias("path"), "filename", "length", "scan_seq")


@query
def read_prefix(spark, sf_dir):
    root = fx.file_tree(spark, sf_dir, flat=True)
    return read_text_prefix(scan_files(spark, root)).select(_relative(root).alias("path"), "text", "error")


@query
def organise_tree(spark, sf_dir):
    """Scan, copy, verify and the list of originals to retire, over files that Spark has written."""
    root = fx.file_tree(spark, sf_dir, flat=False)
    done = organise_folder(spark, f"{root}/in", f"{root}/out")
    return _organised(done, root)


def _organised(done, root):
    rows = done.log.join(done.verification.select("path", F.col("status").alias("verified"), "dst_len"), "path")
    rows = rows.join(done.retire.select("path", F.lit(True).alias("retired")), "path", "left")
    return rows.select(
        _relative(root).alias("path"), _relative(root, "dest_path").alias("dest_path"), "status", "verified", "dst_len",
        F.coalesce("retired", F.lit(False)).alias("retired"),
    )


def _whole_run(spark, sf_dir):
    """A folder run with a sentence: files are read, extracted, ranked, matched, copied and verified; texts of other kinds come as tables."""
    root = fx.file_tree(spark, sf_dir, flat=False)
    others = [t.select(F.concat(F.lit(root), "path").alias("path"), "preview") for t in fx.other_texts(spark, sf_dir)]
    return root, organise_folder(
        spark, f"{root}/in", f"{root}/out", fx.SENTENCE, True, fx.lexicon(spark), fx.term_vectors(spark, sf_dir),
        _whole_text, *others, key=fx.vector_key(spark, sf_dir),
    )


def _whole_text(path: str) -> str:
    with open(path, encoding="utf-8") as text:
        return text.read()


@query
def organise_tree_with_query(spark, sf_dir):
    root, done = _whole_run(spark, sf_dir)
    return _organised(done, root)


@query
def run_progress(spark, sf_dir):
    """The counts that a run shows while it goes on, as they stand at its end."""
    done = _whole_run(spark, sf_dir)[1]
    rows = [(step, seen.get["n_rows"], seen.get["n_failed"]) for step, seen in done.progress.items()]
    return spark.createDataFrame(rows, "step string, n_rows bigint, n_failed bigint")
