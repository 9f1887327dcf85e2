"""Target layout: where each file goes, and the two ways of putting it there."""

from __future__ import annotations

import errno
import filecmp
import os
import shutil
import stat
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.functions.names import join_path, on_disk
from cataloom.operators.naming import assign_names
from cataloom.schemas import COPY_LOG
from cataloom.session import materialise
from cataloom.sources.content import task_count

PLANNED = "planned"
MISSING_SOURCE = "missing_source"
COPIED = "copied"
FAILED = "failed"
#: A source folder that could not be listed: no copy, and no retirement either.
SCAN_ERROR = "scan_error"


def default_destination(folder: str) -> str:
    """A folder beside the source folder."""
    return os.path.join(os.path.dirname(folder.rstrip("/")), "Organized_Files")


def destination_paths(files: DataFrame, dest: str) -> DataFrame:
    """Where each file would go if no name were taken."""
    return files.withColumn("dest_path", join_path(F.lit(dest), F.col("category"), F.col("filename")))


def with_presence(files: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Flag the files that a fresh listing of the sources still has."""
    if sources is None:
        return files.withColumn("present", F.lit(True))
    now = sources.select("path", F.lit(True).alias("present"))
    return files.join(now, "path", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def missing_sources(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files that vanished since the scan."""
    return files.join(sources.select("path"), "path", "left_anti")


def names_in_layout(listing: DataFrame, dest: str) -> DataFrame:
    """``(category, filename)`` of the files already in ``dest/<category>/``."""
    rest = F.substring(F.col("path"), F.lit(len(dest) + 2), F.length("path"))
    return (
        listing.where(F.startswith(F.col("path"), F.lit(dest + "/")))
        .select(F.split(rest, "/").alias("parts"))
        .where(F.size("parts") == 2)
        .select(F.col("parts")[0].alias("category"), F.col("parts")[1].alias("filename"))
    )


def plan_layout(
    files: DataFrame, dest: str, existing: DataFrame | None = None, sources: DataFrame | None = None
) -> DataFrame:
    """``(path, category, filename, length, dest_path, n_suffix, status)``, one row per file.

    A vanished source takes no name and counts as a copy error. ``existing``
    is a listing of the destination, ``sources`` a fresh one of the sources.
    """
    columns = ["path", "category", "filename", "length", "scan_seq"]
    checked = with_presence(files.select(*columns), sources)
    taken = None if existing is None else names_in_layout(existing, dest)
    named = assign_names(checked.where("present").drop("present"), taken).select(
        *columns,
        join_path(F.lit(dest), F.col("category"), F.col("target")).alias("dest_path"),
        "n_suffix",
        F.lit(PLANNED).alias("status"),
    )
    gone = checked.where("not present").select(
        *columns,
        F.lit(None).cast("string").alias("dest_path"),
        F.lit(None).cast("long").alias("n_suffix"),
        F.lit(MISSING_SOURCE).alias("status"),
    )
    return named.unionByName(gone)


def copy_status(plan: DataFrame) -> DataFrame:
    """``(status, n_files)`` over the plan or the copy log."""
    return plan.groupBy("status").agg(F.count("*").alias("n_files"))


def write_layout(plan: DataFrame, contents: DataFrame, folder: str, mode: str = "errorifexists") -> DataFrame:
    """Write the planned files with their bytes as a table partitioned by category; return the log.

    ``contents`` is ``(path, content)``. The bytes move once at most, for the
    join on ``path``, which spreads evenly because paths are unique. They are
    written from there: a hot category is written by all tasks, and nothing is
    gathered by category. A planned file without content is not written, and
    ``failed`` in the log.
    """
    held = contents.where("content is not null")
    (
        plan.where(F.col("status") == PLANNED)
        .select("path", "category", "dest_path", "length")
        .join(held.select("path", "content"), "path")
        .write.mode(mode)
        .partitionBy("category")
        .parquet(folder)
    )
    there = plan.join(held.select("path", F.lit(True).alias("there")), "path", "left")
    lacking = (F.col("status") == PLANNED) & F.col("there").isNull()
    status = F.when(lacking, FAILED).when(F.col("status") == PLANNED, COPIED).otherwise(F.col("status"))
    return there.select("path", "dest_path", status.alias("status"), F.when(lacking, "no content").alias("error"))


def _publish(part: str, target: str) -> None:
    """Give a finished copy its name, which must be free."""
    try:
        os.link(part, target)
    except OSError as problem:
        if problem.errno not in (errno.EPERM, errno.ENOTSUP, errno.EOPNOTSUPP, errno.ENOSYS, errno.EMLINK):
            raise
        with open(part, "rb") as bytes_in, open(target, "xb") as bytes_out:
            shutil.copyfileobj(bytes_in, bytes_out)
        shutil.copystat(part, target)


def _own_earlier_try(source: str, target: str) -> bool:
    """Whether the file at the target is a finished copy of this source: same bytes and time, a file and no link."""
    a, b = os.stat(source), os.lstat(target)
    alike = stat.S_ISREG(b.st_mode) and a.st_size == b.st_size and abs(a.st_mtime - b.st_mtime) < 1e-3
    return alike and filecmp.cmp(source, target, shallow=False)


def _copy_one(source: str, target: str) -> None:
    """Copy without ever replacing a file: a name that has been taken since planning is an error."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}.part")
    try:
        shutil.copy2(source, part)
        _publish(part, target)
    except FileExistsError:
        if not _own_earlier_try(source, target):
            raise
    finally:
        if os.path.exists(part):
            os.remove(part)


def _copy_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for source, target, status in zip(batch["path"], batch["dest_path"], batch["status"]):
            error = None
            if status == PLANNED:
                try:
                    _copy_one(on_disk(source), on_disk(target))
                    status = COPIED
                except Exception as problem:  # noqa: BLE001 - recorded, and the run goes on
                    status, error = FAILED, f"{type(problem).__name__}: {problem}"
            rows.append((source, target, status, error))
        yield pd.DataFrame(rows, columns=["path", "dest_path", "status", "error"])


def copy_files(plan: DataFrame) -> DataFrame:
    """Copy the planned files, bytes and metadata, and return the copy log.

    The plan must be materialised: a plan worked out again halfway would see
    its own copies as names taken. The log is checkpointed, so that reading it
    never copies a second time.
    """
    work = plan.select("path", "dest_path", "status").repartition(task_count(plan), "path")
    return materialise(work.mapInPandas(_copy_batches, COPY_LOG))
