"""Listing of a folder tree on storage that every executor can reach.

``binaryFile`` drops empty files and names that begin with ``.`` or ``_``, all
of which belong in the catalogue, so the listing is made here: one table of
directories per level, listed in parallel by ``mapInPandas``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cataloom.functions.names import as_shown, join_path, on_disk
from cataloom.session import materialise

ENTRIES = "parent string, filename string, kind string, length long, mtime timestamp, error string"
BATCH = 10_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def _entry(folder: str, entry: os.DirEntry) -> tuple:
    name = as_shown(entry.name)
    if entry.is_dir():
        return folder, name, "link" if entry.is_symlink() else "dir", 0, None, None
    kind = "file" if entry.is_file() else "other"
    try:
        stat = entry.stat()
        return folder, name, kind, stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc), None
    except OSError:  # a broken link stays in the catalogue
        return folder, name, "broken", 0, None, None


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["parent", "filename", "kind", "length", "mtime", "error"]
    rows = []  # of any number of folders: a table for each folder costs far more than listing it
    for batch in batches:
        for folder in batch["folder"]:
            try:
                with os.scandir(on_disk(folder)) as entries:
                    for entry in entries:
                        rows.append(_entry(folder, entry))
                        if len(rows) == BATCH:  # a huge folder streams through, it is never held whole
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
            except FileNotFoundError:  # it is not, or no longer, there
                pass
            except OSError as problem:  # keep what was listed, and say so
                rows.append((folder, "", "error", 0, None, f"{type(problem).__name__}: {problem.strerror}"))
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _list_level(folders: DataFrame) -> DataFrame:
    tasks = 4 * folders.sparkSession.sparkContext.defaultParallelism
    return materialise(folders.repartition(tasks, "folder").mapInPandas(_list_folders, ENTRIES))


def with_scan_seq(files: DataFrame) -> DataFrame:
    """Number the files 0, 1, 2, ... in path order without a single-task window.

    Rows are range-sorted and checkpointed, which fixes the partitions; each
    row number is then its partition's start (one row per partition, hence
    broadcast) plus its place within the partition.
    """
    ordered = materialise(files.sort("path"))
    placed = ordered.withColumns(
        {
            "part": F.spark_partition_id(),
            "place": F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1),
        }
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("part")
        .count()
        .select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    )
    return (
        placed.join(F.broadcast(starts), "part")
        .withColumn("scan_seq", F.col("start") + F.col("place"))
        .drop("part", "place", "start")
    )


@dataclass(frozen=True)
class Scan:
    """What a scan found: all entries (folders too), and the folders that could not be read, with their errors."""

    entries: DataFrame
    errors: DataFrame

    def files(self, broken: bool = True) -> DataFrame:
        """Files, without numbers; ``broken`` links count unless they are left out."""
        kinds = ["file", "other", "broken"] if broken else ["file", "other"]
        return self.entries.where(F.col("kind").isin(kinds)).select("path", "filename", "parent", "length", "mtime")


def scan(spark: SparkSession, root: str, depth: int | None = None) -> Scan:
    """List ``root`` and the folders below it, ``depth`` levels of them or all. Links to folders are not followed.

    An absent folder has no entries. One folder is listed by one task.
    """
    root = root.rstrip("/") or "/"
    levels = [_list_level(spark.createDataFrame([(root,)], "folder string"))]
    while depth is None or len(levels) < depth:
        deeper = levels[-1].where("kind = 'dir'")
        if deeper.isEmpty():
            break
        levels.append(_list_level(deeper.select(join_path("parent", "filename").alias("folder"))))
    found = reduce(DataFrame.unionAll, levels)
    entries = found.where("kind <> 'error'").select(
        join_path("parent", "filename").alias("path"), "filename", "parent", "kind", "length", "mtime"
    )
    return Scan(entries, found.where("kind = 'error'").select(F.col("parent").alias("path"), "error"))


def scan_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Every file below ``root`` (or only directly in it), numbered in path order.

    The schema is the same for an absent or empty folder. ``scan`` also tells
    which folders could not be read.
    """
    return with_scan_seq(scan(spark, root).files() if recursive else top_level(scan(spark, root, 1)))


def top_level(found: Scan) -> DataFrame:
    """The regular files (or links to some) of a scan of one level."""
    files = found.entries.where("kind = 'file'")
    return files.select("path", "filename", "parent", "length", "mtime")


def below(listing: DataFrame, root: str, recursive: bool = True) -> DataFrame:
    """The part of a listing table that a scan of ``root`` would return."""
    root = root.rstrip("/")
    if recursive:
        return listing.where(F.startswith(F.col("path"), F.lit(root + "/")))
    return listing.where(F.col("parent") == root)
