"""Rate limits, budgets and breakers as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillguard.operators import ledger

#: Milliseconds of event time after which a key without news is forgotten, where nothing nearer is known.
IDLE_MS = 24 * 3600 * 1000


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "EventTime") -> DataFrame:
    """The output of a processor by key.  Such state needs a store on disk, which is chosen where the session names none."""
    spark = stream.sparkSession
    if spark.conf.get(PROVIDER, None) is None or "HDFSBacked" in spark.conf.get(PROVIDER):
        spark.conf.set(PROVIDER, ROCKSDB)
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "append", mode)


def gathered(rows: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """The rows of a key in one frame, under the names the columns had: Spark renames those with leading underscores."""
    frame = pd.concat(list(rows))
    frame.columns = columns
    return frame


class _Folded(StatefulProcessor):
    """A recurrence per key; ``forget`` says at what time (in seconds) a state is the same as none."""

    def __init__(self, columns: list[str], order: list[str], used: list[str], carried: list[str], out: str, schema: str, step, forget):
        self.columns, self.order, self.used, self.carried, self.out, self.schema, self.step, self.forget = columns, order, used, carried, out, schema, step, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get()
        frame = gathered(rows, self.columns).sort_values(self.order, kind="stable")
        values = []
        for row in zip(*[[None if x is None or x != x else x for x in frame[c]] for c in self.used]):
            state, value = self.step(state, *row)
            values.append(value)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is not None:
            self.state.update(tuple(state))
            at = self.forget(state, *row)
            if at is not None:
                self.handle.registerTimer(int(at * 1000) + 1)
        yield frame[self.carried].assign(**{self.out: values})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _folded(df: DataFrame, keys: list[str], at: str, tie: str, used: list[Column], out: str, kind: str, schema: str, step, forget, late: str) -> DataFrame:
    carried = list(df.columns)
    whole = F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]))  # one key of plain text
    source = df.select("*", whole.alias("__key"), *[c.alias(f"__u{i}") for i, c in enumerate(used)]).withWatermark(at, late)
    processor = _Folded(source.columns, [at, tie], [f"__u{i}" for i in range(len(used))], carried, out, schema, step, forget)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{out} {kind}"])
    return keyed(source, "__key", processor, fields)


def rate_limit_stream(df: DataFrame, key: str, at: str, tie: str, per_minute: float | Column, burst: float | Column | None = None, late: str = "1 hour") -> DataFrame:
    """``ledger.rate_limit`` over a stream: ``allowed`` for every row as it comes.

    Limits may be columns, joined from a table that changes: a bucket that was
    filled under other limits is cut to the new burst.  A bucket is forgotten when
    it would be full again.
    """
    limits = [x if isinstance(x, Column) else F.lit(x) for x in (per_minute, burst)]
    used = [ledger.seconds(F.col(at)), *[x.cast("double") for x in limits]]

    def full_at(state, now, per_minute_, burst_):
        most = burst_ if burst_ is not None and burst_ > 0 else per_minute_
        return state[1] + (most - state[0]) / per_minute_ * 60 if state[1] is not None and per_minute_ and per_minute_ > 0 else None

    return _folded(df, [key], at, tie, used, "allowed", "boolean", "level double, at double", ledger.take_token, full_at, late)


def budget_stream(df: DataFrame, key: str, period: str, at: str, tie: str, spend: str, limit: int | Column, late: str = "1 hour", keep: float = 40 * 24 * 3600.0) -> DataFrame:
    """``ledger.budget`` over a stream: refused once what was spent before has reached the limit; no limit admits all.

    The state of a key and period goes ``keep`` seconds after its last request.
    """
    used = [ledger.seconds(F.col(at)), F.col(spend).cast("double"), (limit if isinstance(limit, Column) else F.lit(limit)).cast("double")]

    def admit(state, now, amount, most):
        spent, last = state or (0.0, None)
        last = last if now is None else now if last is None else max(last, now)
        good = most is None or most <= 0 or spent < most
        return (spent + (amount or 0.0) * good, last), good

    return _folded(df, [key, period], at, tie, used, "admitted", "boolean", "spent double, at double", admit, lambda s, *_: None if s[1] is None else s[1] + keep, late)


def breaker_stream(df: DataFrame, key: str, at: str, tie: str, ok: str, threshold: int = 5, cooldown: float = 30.0, late: str = "1 hour") -> DataFrame:
    """``ledger.breaker`` over a stream; a backend that has gone on without a failure keeps no state for long."""
    used = [ledger.seconds(F.col(at)), F.col(ok)]

    def step(state, now, good):
        held = None if state is None else (int(state[0]), state[1])
        (failures, opened), name = ledger.call(held, now, good, threshold, cooldown)
        return (failures, opened, now), name

    def forget(state, now, good):
        return None if state[0] or state[1] is not None or now is None else now + IDLE_MS / 1000

    return _folded(df, [key], at, tie, used, "state", "string", "failures long, opened double, at double", step, forget, late)
