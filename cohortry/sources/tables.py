"""Named tables under one root folder: lazy reads, views, and the ways to write them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    ``spark.checkpoint.dir`` where it is set, else the session's warehouse, which a cluster shares too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library, wherever it lies; one that is not there is fine."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def settle(df: DataFrame) -> DataFrame:
    """Compute once and read back from a checkpoint, which outlives a lost executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_folder(df.sparkSession)}/checkpoints")
    return df.checkpoint()


def read_or_none(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The parquet table at ``path``, its newest version if it has any; None when nothing has been written there."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(current_folder(spark, path))
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition: str | None = None,
    sort: Sequence[str] = (),
    derived: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write parquet; with ``partition``, one folder per value and rows clustered by ``sort``.

    Rows are gathered by ``partition``, a value holding many rows is spread over several tasks (the rebalance
    hint), and each task sorts what it writes. Without ``partition``, rows are range-partitioned on ``sort``, which
    computes ``df`` twice. ``derived`` adds columns last, so that they are neither exchanged nor sorted.
    """
    order = [c for c in [partition, *sort] if c]
    if partition:
        df = df.hint("rebalance", partition).sortWithinPartitions(*order)
    elif order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if derived is not None:
        df = derived(df)
    writer = df.write.mode(mode)
    if partition:
        writer = writer.partitionBy(partition)
    writer.parquet(path)


class OutdatedError(Exception):
    """Someone else has replaced the table since this replacement began."""


_POINTER = "_current-"


def _pointers(spark: SparkSession, path: str) -> dict[int, str]:
    """Version folders by number, as the pointer files of a table name them."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return {}
    found = {}
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if name.startswith(_POINTER):
            stream = files.open(status.getPath())
            try:
                found[int(name.removeprefix(_POINTER))] = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
    return found


def current_folder(spark: SparkSession, path: str) -> str:
    """Folder with the files of a table: its newest version, or ``path`` itself where no version was published.

    Resolved once per read: a DataFrame keeps the version that it began with.
    """
    versions = _pointers(spark, path)
    return f"{path}/{versions[max(versions)]}" if versions else path


def publish(
    df: DataFrame,
    path: str,
    partition: str | None = None,
    sort: Sequence[str] = (),
    derived: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Replace the table at ``path``: write a version folder, then a small pointer file that makes it the table.

    Until the pointer is there, readers see the version before; a job that fails leaves it as it was. ``df`` may be
    computed from the same table. Pointers are numbered and never overwritten, so of two replacements that began
    with the same version the second one fails (``OutdatedError``). The version before stays for its readers,
    older ones go.
    """
    spark = df.sparkSession
    number = max(_pointers(spark, path), default=0) + 1
    version = f"version-{uuid.uuid4().hex}"
    try:
        write_table(df, f"{path}/{version}", "errorifexists", partition, sort, derived)
        _point(spark, path, number, version)
    except BaseException:
        remove_folder(spark, f"{path}/{version}")
        raise
    for old, folder in sorted(_pointers(spark, path).items()):
        if old < number - 1:
            remove_folder(spark, f"{path}/{folder}")
            remove_folder(spark, f"{path}/{_POINTER}{old:09d}")


def _point(spark: SparkSession, path: str, number: int, version: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written, pointer = place(f"{path}/_{version}"), place(f"{path}/{_POINTER}{number:09d}")
    stream = files.create(written, True)
    stream.writeBytes(version)
    stream.close()
    # local file systems would put one file in the place of another
    if files.exists(pointer) or not files.rename(written, pointer):
        files.delete(written, False)
        raise OutdatedError(f"{path} was replaced by another job; run this one again")


def replace_partitions(df: DataFrame, path: str, *partition: str) -> None:
    """Overwrite exactly the partitions that occur in ``df`` and leave the others alone.

    Spark writes to a staging folder first, so ``df`` may be computed from the same table. The
    rebalance hint gathers each partition into few files and splits those that are too large.
    """
    (
        df.hint("rebalance", *partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition)
        .parquet(path)
    )


class TableSet:
    """Tables by name below one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(current_folder(self.spark, self.path(name)))

    def exists(self, name: str) -> bool:
        return read_or_none(self.spark, self.path(name)) is not None

    def write(self, name: str, df: DataFrame, **layout) -> DataFrame:
        """Replace the table as a whole (``publish``, with its layout) and return it read back."""
        publish(df, self.path(name), **layout)
        return self.read(name)

    def write_if_absent(self, name: str, df: DataFrame) -> DataFrame:
        """Keep a table that is already there; ``df`` is not evaluated then."""
        if not self.exists(name):
            try:
                publish(df, self.path(name))
            except OutdatedError:
                pass  # another job has written it meanwhile: that one stays
        return self.read(name)

    def remove(self, name: str) -> None:
        remove_folder(self.spark, self.path(name))

    def view(self, name: str, df: DataFrame) -> DataFrame:
        """Lazy definition under a name usable from SQL."""
        df.createOrReplaceTempView(name)
        return self.spark.table(name)
