"""A tamper-evident chain that a stream appends to, batch by batch."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillguard.streaming import tables

CHECKPOINT_EVERY, SEGMENT_BYTES = 1000, 64 << 20


@dataclass
class Head:
    """Where a chain stands: enough to go on with it."""

    seq: int = 0
    hash: str = ""
    #: Events since the last checkpoint, the segment that is open and its bytes, events lost and not yet recorded.
    since: int = 0
    segment: int = 1
    bytes: int = 0
    lost: int = 0


RECORD = "seq long, ts string, kind string, event string, dropped long, prev string, hash string, segment long"
HEAD = "seq long, hash string, since long, segment long, bytes long, lost long"


def digest(seq: int, ts: str | None, kind: str, prev: str, dropped: int, event: str | None) -> str:
    """SHA-256 over NUL-terminated fields, as ``audit.record_hash``."""
    return hashlib.sha256("".join(f"{'' if x is None else x}\0" for x in (seq, ts, kind, prev, dropped, event)).encode()).hexdigest()


def append(head: Head, kind: str, ts: str | None, event: str | None, dropped: int, segment_bytes: int) -> tuple:
    """The next record of a chain; a segment that would grow too large is closed before it, and the count starts anew."""
    head.seq += 1
    prev, head.hash = head.hash, digest(head.seq, ts, kind, head.hash, dropped, event)
    size = len(json.dumps([head.seq, ts, kind, prev, event, dropped, head.hash], ensure_ascii=False).encode())
    if head.bytes and head.bytes + size > segment_bytes:
        head.segment, head.bytes = head.segment + 1, 0
    head.bytes += size
    return head.seq, ts, kind, event, dropped, prev, head.hash, head.segment


def accept(head: Head, ts: str | None, event: str | None, every: int, segment_bytes: int) -> Iterator[tuple]:
    """The records of one event: what was lost before it, the event, and a checkpoint when it is due."""
    if head.lost:
        yield append(head, "gap", ts, None, head.lost, segment_bytes)
        head.lost = 0
    yield append(head, "event", ts, event, 0, segment_bytes)
    head.since += 1
    if every > 0 and head.since >= every:
        head.since = 0
        yield append(head, "checkpoint", ts, None, 0, segment_bytes)


def writer(folder: str, by: str, order: tuple[str, ...], ts: str = "ts", event: str = "event", queue: int | None = None, every: int = CHECKPOINT_EVERY, segment_bytes: int = SEGMENT_BYTES) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: one chain for each value of ``by``, in the order of ``order`` within a batch.

    Records of a batch and the heads after it are tables of their own, written
    over on a second attempt; the heads come last and make the batch count.  A
    batch starts from the heads of the one before, so sending it twice leaves one
    chain, and a restart goes on where the newest batch ended.  Every event is taken, unless ``queue``
    says how many of one batch a chain takes at most; how many were lost is then
    recorded in front of the chain's next event.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in tables.committed(spark, f"{folder}/heads") if n < number]
        kind = batch.schema[by].dataType
        heads = tables.read(spark, f"{folder}/heads", before[-1:], T.StructType([T.StructField("by", kind), *T._parse_datatype_string(HEAD).fields]))
        rows = batch.select(F.col(by).alias("by"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.col(ts).cast("string").alias("ts"), F.col(event).cast("string").alias("event"), F.lit(True).alias("real"))
        # one row of each chain carries its head in front of its events, those without events too
        fronts = heads.select("by", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[1:-1]], F.lit(False).alias("real"), *[F.col(c).alias(f"h_{c}") for c in HEAD_NAMES])
        all_rows = rows.select("*", *[F.lit(None).cast(d).alias(f"h_{c}") for c, d in zip(HEAD_NAMES, HEAD_TYPES)]).unionByName(fronts)
        ordered = all_rows.repartition("by").sortWithinPartitions("by", "real", *[f"o{k}" for k in range(len(order))])
        made = ordered.select("by", "real", "ts", "event", *[f"h_{c}" for c in HEAD_NAMES]).mapInArrow(_fold(queue, every, segment_bytes), f"by {kind.simpleString()}, last boolean, {RECORD}, {', '.join(f'h_{c} {d}' for c, d in zip(HEAD_NAMES, HEAD_TYPES))}")
        tables.put(made, f"{folder}/work", number)
        work = spark.read.parquet(f"{folder}/work/batch={number}")
        tables.put(work.filter("not last").select("by", *RECORD_NAMES), f"{folder}/records", number)
        tables.put(work.filter("last").select("by", *[F.col(f"h_{c}").alias(c) for c in HEAD_NAMES]), f"{folder}/heads", number)
        tables.drop(spark, f"{folder}/work/batch={number}")

    return sink


RECORD_NAMES = [x.split()[0] for x in RECORD.split(", ")]
HEAD_NAMES = [x.split()[0] for x in HEAD.split(", ")]
HEAD_TYPES = [x.split()[1] for x in HEAD.split(", ")]


def _fold(queue: int | None, every: int, segment_bytes: int):
    """Records of sorted rows, and after each chain a row with its head; what is kept between batches of rows is one head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value, head, taken, started = None, None, Head(), 0, False
        kind = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * (2 + len(RECORD_NAMES) + len(HEAD_NAMES))
            types = [kind, pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4]
            names = ["by", "last", *RECORD_NAMES, *[f"h_{c}" for c in HEAD_NAMES]]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

        nothing = (None,) * len(RECORD_NAMES)
        unset = (None,) * len(HEAD_NAMES)
        for part in batches:
            kind = part.column(0).type
            out = []
            for row in zip(*[c.to_pylist() for c in part.columns]):
                this = "nan" if row[0] != row[0] else row[0]
                if not started or this != key:
                    if started:
                        out.append((value, True, *nothing, *astuple(head)))
                    key, value, head, taken, started = this, row[0], Head(), 0, True
                if not row[1]:
                    head = Head(*row[4:])
                elif queue is not None and taken >= queue:
                    head.lost += 1
                else:
                    taken += 1
                    out += [(value, False, *r, *unset) for r in accept(head, row[2], row[3], every, segment_bytes)]
            yield batch(out)
        if started:
            yield batch([(value, True, *nothing, *astuple(head))])

    return run


def records(spark: SparkSession, folder: str, by_type: str = "string") -> DataFrame:
    """All records of the committed batches: by, then RECORD; ``audit.verify(…, "by")`` judges them."""
    return tables.read(spark, f"{folder}/records", tables.committed(spark, f"{folder}/heads"), f"by {by_type}, {RECORD}")


def heads(spark: SparkSession, folder: str, by_type: str = "string") -> DataFrame:
    """Where each chain stands after the newest batch."""
    return tables.read(spark, f"{folder}/heads", tables.committed(spark, f"{folder}/heads")[-1:], f"by {by_type}, {HEAD}")
