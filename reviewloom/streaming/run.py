"""Run a streaming query over what has landed so far and read its table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.sources.shared import new_path


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process all landed files into a parquet table in the shared folder."""
    spark = stream.sparkSession
    table, state = new_path(spark, name), new_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", table)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)


def run_latest(stream: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Process all landed files of an aggregating stream; the latest row of each key, of open groups too.

    Every batch writes the rows it changed below its own number, so a batch that
    runs again replaces itself, and a later row replaces an earlier one of its key.
    """
    spark = stream.sparkSession
    table, state = new_path(spark, name), new_path(spark, f"{name}-state")
    spark.createDataFrame([], stream.schema).write.parquet(f"{table}/batch=-1")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    written = spark.read.schema(stream.schema.add("batch", "long")).parquet(table)
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last")).select(*keys, "__last.*")
