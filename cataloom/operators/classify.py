"""Category by extension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.functions.names import EXTENSION_MAP, category_of, extension


def classify(files: DataFrame, ext_map: Mapping[str, Sequence[str]] = EXTENSION_MAP) -> DataFrame:
    """Add ``ext`` and ``category``; unknown extensions are ``Others``."""
    return files.withColumn("ext", extension(F.col("filename"))).withColumn(
        "category", category_of(F.col("ext"), ext_map)
    )
