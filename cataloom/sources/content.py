"""Text read from the files themselves."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.functions.names import is_plain_text, on_disk
from cataloom.functions.text import PREFIX_CHARS, word_preview
from cataloom.schemas import EXTRACTED


#: A task handles so many files or bytes at most, on average; a lost one repeats no more.
FILES_PER_TASK, BYTES_PER_TASK = 10_000, 4 << 30
#: Files whose words one task counts: counts take many times the room of their text, so a task's share may not grow with the input.
FILES_PER_COUNT = 2048
#: Characters of text that a task holds before it hands them on.
CHARS_HELD = 8 << 20


def task_count(files: DataFrame) -> int:
    """Tasks for work whose cost lies in the files, not in the bytes of the rows; ``files`` may have a ``length``."""
    spark = files.sparkSession
    length = F.sum("length") if "length" in files.columns else F.lit(0)
    n, size = files.agg(F.count("*"), F.coalesce(length, F.lit(0))).first()
    return max(
        4 * spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        n // FILES_PER_TASK,
        int(size) // BYTES_PER_TASK,
    )


def _called(fn: Callable[[str], str], path: str) -> tuple[str, str | None]:
    try:
        return fn(path) or "", None
    except Exception as problem:  # noqa: BLE001 - any failure means no text
        return "", f"{type(problem).__name__}: {problem}"


class _Apart:
    """Calls ``fn`` in a child process of the task, which is replaced when a file has hung or crashed it."""

    def __init__(self, fn: Callable[[str], str], seconds: float):
        self.fn, self.seconds, self.child = fn, seconds, None

    def _serve(self, theirs, ours) -> None:
        ours.close()  # so that the end of the task is seen as the end of the pipe
        while True:
            try:
                path = theirs.recv()
            except EOFError:
                return
            theirs.send(_called(self.fn, path))

    def __call__(self, path: str) -> tuple[str, str | None]:
        if self.child is None:
            fork = multiprocessing.get_context("fork")  # the function need not be pickled again
            self.pipe, theirs = fork.Pipe()
            self.child = fork.Process(target=self._serve, args=(theirs, self.pipe), daemon=True)
            self.child.start()
            theirs.close()
        try:
            self.pipe.send(path)
            if self.pipe.poll(self.seconds):
                return self.pipe.recv()
            error = f"TimeoutError: no text within {self.seconds} s"
        except (EOFError, OSError):
            self.child.join(1)
            error = f"ChildProcessError: the parser ended with code {self.child.exitcode}"
        self.stop()
        return "", error

    def stop(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


def extract_with(files: DataFrame, fn: Callable[[str], str], seconds: float | None = None) -> DataFrame:
    """Call ``fn(path)`` for each file on the executors.

    A failing file yields the empty text and its error, so one bad file never
    stops the run and failures can still be counted. With ``seconds``, a file
    has that long: a parser that hangs, or takes its process down, costs its
    file and not its task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "text", "error"]
        apart = None if seconds is None else _Apart(fn, seconds)
        try:
            for batch in batches:
                rows, held = [], 0
                for path in batch["path"]:
                    found = _called(fn, on_disk(path)) if apart is None else apart(on_disk(path))
                    rows.append((path, *found))
                    held += len(found[0])
                    if held > CHARS_HELD:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)
        finally:
            if apart is not None:
                apart.stop()

    # an explicit number of tasks: paths are few bytes, and AQE would merge them into one task
    return files.select("path").repartition(task_count(files), "path").mapInPandas(run, EXTRACTED)


def read_text_prefix(files: DataFrame, max_chars: int = PREFIX_CHARS) -> DataFrame:
    """First characters of the ``.txt`` and ``.csv`` files; no file is read further than that."""

    def head(path: str) -> str:
        with open(path, encoding="utf-8", errors="ignore") as text:
            return text.read(max_chars)

    return extract_with(files.where(is_plain_text(F.col("path"))), head)


def attach_extracted_text(files: DataFrame, extracted: DataFrame) -> DataFrame:
    """Left join of a ``(path, text)`` table; a file without a row gets the empty text."""
    return files.join(extracted.select("path", "text"), "path", "left").withColumn(
        "text", F.coalesce("text", F.lit(""))
    )


def dealt_by_path(texts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``texts`` hash-partitioned by ``path``, in so many partitions that the words of each can be counted in place.

    ``files`` has a row for each text, or more, and is counted in place of ``texts`` if given. The number is explicit: by the bytes
    of previews, Spark would merge partitions whose counts then outgrow a task's memory.
    """
    n = (texts if files is None else files).count()
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-n // FILES_PER_COUNT))
    return texts.repartition(tasks, "path")


def previews(texts: DataFrame, placed: bool = True) -> DataFrame:
    """``(path, preview)`` from ``(path, text)``, dealt by ``path`` (``dealt_by_path``) if ``placed``.

    The rows move once at most, after the cut to the first words, when they are
    small. For ``dispatch_text``, whose join places the rows itself, use
    ``placed=False``.
    """
    cut = texts.select("path", word_preview(F.col("text")).alias("preview"))
    return dealt_by_path(cut) if placed else cut
