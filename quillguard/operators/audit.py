"""Audit events, the hash chain, retention, metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], partition: str) -> DataFrame:
    """Adds seq from 1 in order, within each chain; one chain per partition value keeps it parallel."""
    over = Window.partitionBy(partition).orderBy(*order)
    return df.withColumn("seq", F.row_number().over(over).cast("long"))


def event_json(cols: list[str]) -> Column:
    """The event as JSON; null fields are left out."""
    return F.to_json(F.struct(*cols))


def record_hash(seq: Column, ts: Column, kind: Column, prev: Column, event: Column, dropped: Column) -> Column:
    """SHA-256 over NUL-terminated fields."""
    nul = F.char(F.lit(0))
    fields = [seq.cast("string"), ts.cast("string"), kind, prev, dropped.cast("string"), event]
    return F.sha2(F.concat(*[x for f in fields for x in (F.coalesce(f, F.lit("")), nul)]), 256)


def chain(df: DataFrame, by: str) -> DataFrame:
    """Adds prev and hash to records of seq, ts, kind, event, dropped: each hash covers the one before.

    A chain is sequential by nature; chains of different ``by`` values run in
    parallel.  Null fields are hashed as nothing, and null keys are one chain.
    """
    names, n = df.columns, len(df.columns)
    picked = [F.col(by), F.col("seq"), *[F.col(c).cast("string") for c in ("ts", "kind", "event", "dropped")]]
    source = df.select("*", *[c.alias(f"__p{i}") for i, c in enumerate(picked)])
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "prev string, hash string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, prev = object(), ""
        for batch in batches:
            before, after = [], []
            for k, *values in zip(*[c.to_pylist() for c in batch.columns[n:]]):
                k = "nan" if k != k else k
                if k != key:
                    key, prev = k, ""
                seq, ts, kind, event, dropped = ("" if x is None else x for x in values)
                before.append(prev)
                prev = hashlib.sha256("".join(f"{x}\0" for x in (seq, ts, kind, prev, dropped, event)).encode()).hexdigest()
                after.append(prev)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*names, "prev", "hash"])

    return source.repartition("__p0").sortWithinPartitions("__p0", "__p1").mapInArrow(run, fields)


def segments(records: DataFrame, by: str, most_bytes: int = 64 << 20, checkpoint_every: int = 1000) -> DataFrame:
    """Adds segment (a new one whenever the bytes of a chain pass another ``most_bytes``) and checkpoint marks."""
    size = F.octet_length("event").cast("long") + 200
    before = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("segment", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / most_bytes).cast("long")).withColumn("checkpoint", F.col("seq") % checkpoint_every == 0)


def verify(records: DataFrame, by: str) -> DataFrame:
    """Adds problem: null for a sound record, else what is wrong with its number, link or hash."""
    order = Window.partitionBy(by).orderBy("seq")
    expected_seq = F.coalesce(F.lag("seq").over(order) + 1, F.lit(1))
    expected_prev = F.coalesce(F.lag("hash").over(order), F.lit(""))
    again = record_hash(F.col("seq"), F.col("ts"), F.col("kind"), F.col("prev"), F.col("event"), F.col("dropped"))
    problem = F.when(F.col("seq") != expected_seq, "sequence").when(F.col("prev") != expected_prev, "link").when(F.col("hash") != again, "hash")
    return records.withColumn("problem", problem)


def report(verified: DataFrame, by: str) -> DataFrame:
    """Per chain: records, gaps, first break, head."""
    return verified.groupBy(by).agg(
        F.count("*").alias("records"), F.sum("dropped").alias("dropped"), F.min(F.when(F.col("problem").isNotNull(), F.col("seq"))).alias("first_break"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("head"),
    )


def prune(records: DataFrame, segment: str, at: str, cutoff: Column, active: Column) -> DataFrame:
    """Segments that stay: the newest record is after the cutoff, or it is the active one."""
    newest = records.groupBy(segment).agg(F.max(at).alias("__newest"))
    keep = newest.filter((F.col("__newest") > cutoff) | (F.col(segment) == active)).select(segment)
    return records.join(keep, segment, "left_semi")


def metrics(df: DataFrame, name: str, labels: list[str], value: str | None = None) -> DataFrame:
    """A counter as exposition lines: name{label="value",...} n."""
    counted = df.groupBy(*labels).agg((F.sum(value) if value else F.count("*")).alias("__n"))
    escape = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escape(c), F.lit('"')) for c in labels])
    return counted.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col("__n").cast("string")).alias("line"))


def exposition(df: DataFrame, name: str, labels: list[str], help_text: str, kind: str = "counter", value: str | None = None) -> DataFrame:
    """no, line of a whole metric: what it is, its type, then its lines in order of their labels."""
    lines = metrics(df, name, labels, value)
    told = help_text.replace("\\", "\\\\").replace("\n", "\\n")
    head = df.sparkSession.createDataFrame([(0, f"# HELP {name} {told}"), (1, f"# TYPE {name} {kind}")], "no long, line string")
    # few lines: one per label set, already summed
    return head.unionByName(lines.select((F.row_number().over(Window.orderBy("line")) + 1).cast("long").alias("no"), "line"))
