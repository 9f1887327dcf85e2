"""Verification of copies, the all-or-nothing gate and the list of originals to retire."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.operators.layout import COPIED, PLANNED

OK = "ok"


def _copied(log: DataFrame) -> DataFrame:
    return log.where(F.col("status").isin(PLANNED, COPIED))


def verify_copies(log: DataFrame, src_listing: DataFrame, dst_listing: DataFrame) -> DataFrame:
    """``(path, dest_path, src_len, dst_len, status)`` for every copy made.

    Checked in this order: the copy is ``missing``; its source can no longer be
    sized (``error``); the sizes differ (``size_mismatch``); else ``ok``.
    """
    src = src_listing.select("path", F.col("length").alias("src_len"))
    dst = dst_listing.select(F.col("path").alias("dest_path"), F.col("length").alias("dst_len"))
    return (
        _copied(log)
        .select("path", "dest_path")
        .join(dst, "dest_path", "left")
        .join(src, "path", "left")
        .select(
            "path",
            "dest_path",
            "src_len",
            "dst_len",
            F.when(F.col("dst_len").isNull(), "missing")
            .when(F.col("src_len").isNull(), "error")
            .when(F.col("src_len") != F.col("dst_len"), "size_mismatch")
            .otherwise(OK)
            .alias("status"),
        )
    )


def failed_verifications(verification: DataFrame) -> DataFrame:
    return verification.where(F.col("status") != OK)


def retire_gate(log: DataFrame, verification: DataFrame) -> DataFrame:
    """One row, ``passed``: every copy verified and no copy error; nothing copied passes too."""
    errors = log.agg(F.count_if(~F.col("status").isin(PLANNED, COPIED)).alias("n")).scalar()
    verified = F.coalesce(F.bool_and(F.col("status") == OK), F.lit(True))
    return verification.agg(verified.alias("verified")).select(
        (F.col("verified") & (errors == 0)).alias("passed")
    )


def retire_list(log: DataFrame, verification: DataFrame, src_listing: DataFrame) -> DataFrame:
    """``path`` of the originals that may be removed: all copied ones still there, or none."""
    present = _copied(log).select("path").join(src_listing.select("path"), "path", "left_semi")
    return present.where(retire_gate(log, verification).scalar())
