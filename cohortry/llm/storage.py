"""Where intermediate tables of this subpackage live."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortry.sources.tables import remove_folder, shared_folder

_roots: set[str] = set()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share; all of an application's go when it ends.

    Taken from ``spark.checkpoint.dir``; a session without that setting uses its warehouse folder.
    """
    root = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_forget, spark, root)
    return f"{root}/{uuid.uuid4().hex}"


def _forget(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has been stopped
        remove_folder(spark, root)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: later reads need neither its lineage nor its executors."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
