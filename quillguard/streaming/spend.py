"""A durable ledger of periods, added to by a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.operators import ledger
from quillguard.streaming import tables

PERIOD = "tenant string, period timestamp, requests long, prompt_tokens long, completion_tokens long, baseline_tokens long"
#: Batches after which a snapshot takes the place of the sums of each.
SNAPSHOT_EVERY = 20


def writer(folder: str, unit: str = "MONTH", zone: str = "Asia/Tokyo", snapshot_every: int = SNAPSHOT_EVERY) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: every batch's sums by tenant and period are one table, written over on a second attempt.

    What is added depends on the number of the batch alone, so a batch that is
    sent twice counts once.  A batch whose write fails is no part of the ledger;
    the stream keeps it and sends it again.  Now and then a snapshot of all
    before is written, so that a reader opens few tables.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tables.put(ledger.per_period(batch, unit, zone), f"{folder}/sums", number)
        if snapshot_every and (number + 1) % snapshot_every == 0:
            tables.put(_merged(spark, folder, number), f"{folder}/snapshots", number)

    return sink


def _merged(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    inside = lambda n: upto is None or n <= upto
    taken = [n for n in tables.committed(spark, f"{folder}/snapshots") if upto is None or n < upto][-1:]
    after = taken[0] if taken else -1
    sums = tables.read(spark, f"{folder}/sums", [n for n in tables.committed(spark, f"{folder}/sums") if n > after and inside(n)], PERIOD)
    return ledger.merge_periods(tables.read(spark, f"{folder}/snapshots", taken, PERIOD), sums)


def periods(spark: SparkSession, folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """All periods on record in the order of tenant and period, of the tenants between two names if given."""
    out = _merged(spark, folder)
    if first is not None:
        out = out.filter(F.col("tenant") >= first)
    if last is not None:
        out = out.filter(F.col("tenant") <= last)
    return out.orderBy("tenant", "period")


def consumed(spark: SparkSession, folder: str, since: Column, pending: DataFrame | None = None, unit: str = "MONTH", zone: str = "Asia/Tokyo") -> DataFrame:
    """Tokens of each tenant in the period of ``since``, those of a batch that isn't written yet included."""
    rows = _merged(spark, folder)
    if pending is not None:
        rows = rows.unionByName(ledger.per_period(pending, unit, zone))
    return rows.filter(F.col("period") == ledger.period_start(since, unit, zone)).groupBy("tenant").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
