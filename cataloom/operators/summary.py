"""Counts for the user: breakdown, totals, run summary, progress metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cataloom.operators.layout import COPIED, PLANNED
from cataloom.operators.verify import OK, retire_gate


def category_breakdown(files: DataFrame) -> DataFrame:
    """``(category, n_files)``, the most frequent category first."""
    return files.groupBy("category").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "category")


def scan_totals(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("n_bytes")
    )


def run_summary(log: DataFrame, verification: DataFrame, retired: DataFrame) -> DataFrame:
    """One row of counts; ``originals_retired`` tells whether the gate let them go."""
    copied = F.col("status").isin(PLANNED, COPIED)
    checks = verification.agg(
        F.count_if(F.col("status") == OK).alias("n_verified"),
        F.count_if(F.col("status") != OK).alias("n_failed"),
    )
    return log.agg(
        F.count("*").alias("processed"),
        F.count_if(copied).alias("copied"),
        F.count_if(~copied).alias("copy_errors"),
    ).select(
        "processed",
        "copied",
        "copy_errors",
        checks.select("n_verified").scalar().alias("verified"),
        checks.select("n_failed").scalar().alias("failed_verifications"),
        retired.agg(F.count("*").alias("n")).scalar().alias("retired"),
        retire_gate(log, verification).scalar().alias("originals_retired"),
    )


def with_progress(df: DataFrame, name: str, failed: Column | None = None) -> tuple[DataFrame, Observation]:
    """Row and failure counts that fill in while the frame is being computed."""
    seen = Observation(name)
    test = F.lit(False) if failed is None else failed
    return df.observe(seen, F.count("*").alias("n_rows"), F.count_if(test).alias("n_failed")), seen
