"""Tables that streams write batch by batch, each batch once."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.operators.stored import shared_folder, stored

def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that were written whole, in order."""
    at, fs = _path(spark, folder)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    numbers = [int(n[6:]) for n in names if re.fullmatch(r"batch=\d+", n)]
    return sorted(n for n in numbers if fs.exists(_path(spark, f"{folder}/batch={n}/_SUCCESS")[0]))


def put(df: DataFrame, folder: str, batch: int) -> None:
    """Writes a batch, in place of what an attempt before may have left of it."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/batch={batch}")


def read(spark: SparkSession, folder: str, batches: list[int], schema) -> DataFrame:
    """The rows of these batches."""
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/batch={n}" for n in batches])


def drop(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def pieces(df: DataFrame, name: str, n: int, *by: str) -> DataFrame:
    """The rows as a stream of ``n`` files, dealt by ranges of ``by`` and read one after the other."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    bound = stored(df.repartitionByRange(n, *by).withColumn("__file", F.spark_partition_id()), name)  # ranges are drawn once
    for k in range(n):  # modification times give the order
        bound.filter(F.col("__file") == k).drop("__file").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """What a stream puts out over all that its sources hold now, as a table in the shared folder."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def feed(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands every batch of a stream to a sink, over all that its sources hold now; a later call goes on from there."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
