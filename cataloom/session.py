"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on; cluster sizing stays with the user.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # categories such as "007" must come back as text, not as the number 7
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}

#: Whether the shuffles of a query are removed when it ends.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings above to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder on storage that all executors share"
            )
        # local mode has one machine only, as in tests
        folder = tempfile.mkdtemp(prefix="cataloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage at a reliable checkpoint, so lost executors cost no re-listing or re-copying.

    The shuffles behind it are removed at once, since nothing reads them again; else they would stay until the driver happens to
    collect its garbage.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    usual = spark.conf.get(REMOVE_SHUFFLES, "false")
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame of its own, made under this setting
    finally:
        spark.conf.set(REMOVE_SHUFFLES, usual)
