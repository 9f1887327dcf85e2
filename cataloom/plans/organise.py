"""The whole run: categories, keywords, match, layout; and the same over a real folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cataloom.functions.names import TEXT_BEARING, is_plain_text
from cataloom.functions.text import is_blank, word_preview
from cataloom.operators.classify import classify
from cataloom.operators.keywords import keyword_eligible, top_keywords
from cataloom.operators.layout import PLANNED, SCAN_ERROR, copy_files, default_destination, plan_layout
from cataloom.operators.match import THRESHOLD, Key, itself, match_categories, vectors_from_model, without_vector
from cataloom.operators.summary import category_breakdown, run_summary, with_progress
from cataloom.operators.tokens import query_targets
from cataloom.operators.verify import OK, failed_verifications, retire_list, verify_copies
from cataloom.session import configure, materialise
from cataloom.sources.assembled import dispatch_text, text_bearing
from cataloom.sources.content import dealt_by_path, extract_with, read_text_prefix
from cataloom.sources.listing import scan, top_level, with_scan_seq


@dataclass(frozen=True)
class Organised:
    """Results of a run; ``targets`` and ``unmatched`` exist with a query only, those from ``log`` on after copying only.

    ``unmatched`` holds the targets without a vector, ``failed`` the copies that did not verify; ``progress`` the rows and failures of
    each step of a folder run.
    """

    categorised: DataFrame
    breakdown: DataFrame
    plan: DataFrame
    targets: DataFrame | None = None
    unmatched: DataFrame | None = None
    log: DataFrame | None = None
    failed: DataFrame | None = None
    verification: DataFrame | None = None
    retire: DataFrame | None = None
    summary: DataFrame | None = None
    progress: dict[str, Observation] | None = None


def choose_branch(queries: DataFrame) -> DataFrame:
    """Add ``branch``: ``match`` for a sentence with content, ``keep`` for a blank one."""
    return queries.withColumn("branch", F.when(is_blank(F.col("text")), "keep").otherwise("match"))


def sentence_targets(spark: SparkSession, sentence: str, lexicon: DataFrame) -> DataFrame:
    """``(idx, label)`` of the categories that a sentence names."""
    row = spark.sql("select 0 as query_id, :sentence as text", args={"sentence": sentence})
    return query_targets(row, lexicon).select("idx", "label")


def categorise(
    files: DataFrame,
    texts: DataFrame | None = None,
    query: str | None = None,
    lexicon: DataFrame | None = None,
    term_vectors: DataFrame | None = None,
    threshold: float = THRESHOLD,
    key: Key = itself,
    keywords: DataFrame | None = None,
    target_vectors: DataFrame | None = None,
    model: Callable | None = None,
) -> DataFrame:
    """Classified ``files`` with the category that the query gives them, if there is a query.

    ``texts`` is ``(path, preview)``. ``keywords`` are worked out only if a
    query is given and they are not passed in. Without a query no text is read.
    ``model`` (see ``vectors_from_model``) takes the place of ``term_vectors``:
    it is called once for each distinct keyword and target.
    """
    if not query or not query.strip():
        return files.withColumns(
            {"ext_category": F.col("category"), "score": F.lit(None).cast("double")}
        )
    if keywords is None:
        # texts of other kinds never count, so they are not ranked either
        counting = files.where(F.col("category").isin(TEXT_BEARING)).select("path")
        keywords = top_keywords(dealt_by_path(texts.join(counting, "path", "left_semi"), counting), lexicon)
    targets = sentence_targets(files.sparkSession, query, lexicon)
    if model is not None:
        keywords = materialise(keywords)
        terms = keywords.select(F.col("keyword").alias("term")).union(targets.select("label"))
        term_vectors = materialise(vectors_from_model(terms, model))
    return match_categories(files, keywords, targets, term_vectors, threshold, key, target_vectors)


def organise(
    files: DataFrame,
    dest: str,
    texts: DataFrame | None = None,
    query: str | None = None,
    lexicon: DataFrame | None = None,
    term_vectors: DataFrame | None = None,
    existing: DataFrame | None = None,
    sources: DataFrame | None = None,
    **options,
) -> Organised:
    """Classify, match and plan the layout.

    With a query the categories are checkpointed, since breakdown and plan
    read them several times; without one they are a projection of ``files``.
    """
    categorised = categorise(classify(files), texts, query, lexicon, term_vectors, **options)
    if query and query.strip():
        categorised = materialise(categorised)
    plan = plan_layout(categorised, dest, existing, sources)
    return Organised(categorised, category_breakdown(categorised), plan, *_named(files.sparkSession, query, lexicon, term_vectors, options))


def _named(spark, query, lexicon, term_vectors, options) -> tuple[DataFrame | None, DataFrame | None]:
    """The targets that a query names, and those without a vector in a given table."""
    if not query or not query.strip():
        return None, None
    targets = sentence_targets(spark, query, lexicon)
    vectors = options.get("target_vectors") or term_vectors
    return targets, None if vectors is None else without_vector(targets, "label", vectors, options.get("key", itself))


def organise_folder(
    spark: SparkSession,
    folder: str,
    dest: str | None = None,
    query: str | None = None,
    include_subfolders: bool = True,
    lexicon: DataFrame | None = None,
    term_vectors: DataFrame | None = None,
    extract: Callable[[str], str] | None = None,
    images: DataFrame | None = None,
    media: DataFrame | None = None,
    decks: DataFrame | None = None,
    extract_seconds: float | None = None,
    **options,
) -> Organised:
    """Scan, categorise, copy, verify and list the originals that may be retired.

    Plain text is read from the files. Other documents go through ``extract``
    (a function from path to text, run on the executors, for at most
    ``extract_seconds`` a file if given); pictures and sound
    come as ``(path, preview)`` tables, slide decks too. Originals are never
    removed here. Folders that cannot be read stop the run at the destination,
    and keep the gate closed at the source.
    """
    configure(spark)
    folder = folder.rstrip("/")
    dest = (dest or default_destination(folder)).rstrip("/")
    depth = None if include_subfolders else 1
    found = scan(spark, folder, depth)
    files = classify(with_scan_seq(found.files() if include_subfolders else top_level(found)))
    texts = None
    if query and query.strip():
        plain = read_text_prefix(files)
        documents = plain
        if extract is not None:
            others = files.where((F.col("category") == "Documents") & ~is_plain_text(F.col("path")))
            documents = plain.unionByName(extract_with(others, extract, extract_seconds))
        # checkpointed, because every extractor call is worth keeping
        cut = materialise(documents.select("path", word_preview(F.col("text")).alias("preview")))
        texts = keyword_eligible(dispatch_text(text_bearing(files), cut, images, media, decks))
    progress = {}

    def watched(df: DataFrame, step: str, failed: Column | None = None) -> DataFrame:
        df, progress[step] = with_progress(df, step, failed)
        return materialise(df)

    categorised = watched(categorise(files, texts, query, lexicon, term_vectors, **options), "categorised")
    # names are taken by files, folders and links to folders directly in dest/<category>/; a broken link takes none
    there = scan(spark, dest, 2)
    if not there.errors.isEmpty():
        raise RuntimeError(f"cannot read {there.errors.first().path} at the destination")
    existing = there.entries.where("kind <> 'broken'")
    plan = plan_layout(categorised, dest, existing, scan(spark, folder, depth).files(broken=False))
    plan = watched(plan, "planned", F.col("status") != PLANNED)
    log = copy_files(plan)
    after = scan(spark, folder, depth)
    unread = found.errors.unionAll(after.errors).distinct()
    log = log.unionByName(unread.select("path", F.lit(SCAN_ERROR).alias("status"), "error"), allowMissingColumns=True)
    sources = after.files(broken=False)
    # read by the gate, the list and the counts
    verification = watched(verify_copies(log, sources, scan(spark, dest, 2).files()), "verified", F.col("status") != OK)
    retire = retire_list(log, verification, sources)
    targets, unmatched = _named(spark, query, lexicon, term_vectors, options)
    return Organised(
        categorised,
        category_breakdown(categorised),
        plan,
        targets,
        unmatched,
        log,
        failed_verifications(verification),
        verification,
        retire,
        run_summary(log, verification, retire),
        progress,
    )
