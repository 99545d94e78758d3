"""DataFrame building blocks shared by the operators that use no Python on the executors."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillguard.llm.session import quoted

#: Rows that one ordered bucket should hold.
BUCKET_ROWS = 20_000

WHITE_RUN = r"[^\x20\x09-\x0D]+"


def bits_for(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    """Leading hash bits that split so many rows into buckets of the wanted size."""
    return max(0, ceil(log2(max(1, rows) / per_bucket))) if rows > per_bucket else 0


def spread(*cols: Column, seed: int) -> Column:
    """A 63-bit hash, uniform over its range, that the seed and the columns decide."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)


def leading(hash_col: Column, bits: Column | int) -> Column:
    """The first bits of a 63-bit hash; shifting the range keeps the order of the hash."""
    n = bits if isinstance(bits, Column) else F.lit(bits)
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(F.expr("1L").cast("long") * F.floor(hash_col / F.pow(F.lit(2.0), F.lit(63) - n)))


def rank_in(df: DataFrame, keys: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Adds the row's rank from 1 among the rows of ``keys``, whose order must follow ``bucket``.

    No key meets in one task: rows are numbered inside a bucket, and the rows of
    the buckets before it come from a table of one count per bucket.
    """
    counts = df.groupBy(*keys, bucket).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long"))).drop("__n")
    inside = df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)))
    return inside.join(starts, [*keys, bucket]).withColumn(out, F.col("__before") + F.col("__at")).drop("__at", "__before")


def null_last(col: str) -> Column:
    """A string key that is never null and sorts by code point with null after all values."""
    c = F.col(quoted(col))
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c.cast("string")))
