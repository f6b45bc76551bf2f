"""Admission counts over a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.requests import client_counts, counts_per_bucket
from cohortry.sources.tables import TableSet


def run_admission_counts(requests: DataFrame, tables: TableSet, name: str, ts: str, client: str, bucket: str) -> None:
    """Count what has arrived since the last run, per bucket and client, into table ``name``.

    Every batch overwrites its own part of the table, so a repeated batch counts once. There is no
    watermark: late rows count in their bucket whenever they come, and the newest bucket is there too.
    """

    def write(batch: DataFrame, number: int) -> None:
        counts = client_counts(batch, ts, client, bucket)
        counts.write.mode("overwrite").parquet(tables.path(f"{name}/batch={number}"))

    query = (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", tables.path(f"{name}_checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_admission_counts(tables: TableSet, name: str, per_client: int, global_cap: int) -> DataFrame:
    """Per bucket: requests, those within the client cap, those admitted, over all batches."""
    clients = tables.read(name).groupBy("bucket", "client").agg(F.sum("n").alias("n"))
    return counts_per_bucket(clients, per_client, global_cap)
