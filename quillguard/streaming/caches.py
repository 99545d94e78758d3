"""Bounded caches and session stores, and what an answer tells of a dictionary, as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillguard.functions.text import placeholders
from quillguard.operators import cache
from quillguard.operators.ledger import seconds
from quillguard.operators.mask import enumeration
from quillguard.streaming.limits import gathered, keyed


class _Shards(StatefulProcessor):
    """One shard a key; its entries in order of use are one value, as many as the bound at most."""

    def __init__(self, columns: list[str], carried: list[str], order: list[str], bound: int, ttl: float, renew: bool):
        self.columns, self.carried, self.order, self.bound, self.ttl, self.renew = columns, carried, order, bound, ttl, renew

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("shard", "keys array<string>, answers array<string>, tokens array<long>, since array<double>, now double")

    def _shard(self) -> cache.Shard:
        held = self.state.get()
        return cache.Shard(self.bound, self.ttl, self.renew, zip(*held[:4]), held[4]) if held else cache.Shard(self.bound, self.ttl, self.renew)

    def _keep(self, shard: cache.Shard) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        rows = shard.entries()
        columns = [list(c) for c in zip(*rows)] if rows else [[], [], [], []]
        self.state.update((*columns, shard.now))
        if shard.aged:
            self.handle.registerTimer(int((next(iter(shard.aged.values())) + self.ttl) * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = gathered(rows, self.columns).sort_values(self.order, kind="stable")
        shard = self._shard()
        plain = lambda x: None if x is None or x != x else x
        out = []
        for kind, k, now, given, cost in zip(*[map(plain, frame[f"__u{i}"]) for i in range(5)]):
            out.append(cache.operate(shard, kind, k, now, given, None if cost is None else int(cost)) if k is not None else (False, None, 0, 0))
        self._keep(shard)
        yield pd.concat([frame[self.carried].reset_index(drop=True), pd.DataFrame(out, columns=["hit", "found", "evicted", "avoided"])], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        shard = self._shard()
        shard.expire(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self._keep(shard)
        yield from ()

    def close(self) -> None:
        pass


def bounded_stream(ops: DataFrame, key: str, at: str, tie: str, op: str, answer: str, tokens: str, bound: int, ttl: float, shards: int = 64, renew: bool = False, late: str = "1 hour") -> DataFrame:
    """``cache.bounded`` over a stream: what a shard holds is its state, and a timer drops what has outlived its time."""
    carried = list(ops.columns)
    used = [F.col(op), F.col(key).cast("string"), seconds(F.col(at)), F.col(answer), F.col(tokens).cast("long")]
    source = ops.select("*", cache.shard_of(F.col(key), shards).alias("__s"), *[c.alias(f"__u{i}") for i, c in enumerate(used)]).withWatermark(at, late)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ops.schema.fields), cache.OPERATED])
    return keyed(source, "__s", _Shards(source.columns, carried, [at, tie], bound, ttl, renew), fields)


class _Recited(StatefulProcessor):
    """The distinct known tokens of an answer so far, and whether they are too many of its dictionary's."""

    def __init__(self, stream: str, session: str, seq: str, done: str, at: str, idle_ms: int):
        self.stream, self.session, self.seq, self.done, self.at, self.idle_ms = stream, session, seq, done, at, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.tail = handle, handle.getValueState("tail", "text string")
        self.seen = handle.getMapState("seen", "token string", "known boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = gathered(rows, [self.stream, self.seq, self.done, self.at, "__known", "__size"]).sort_values(self.seq, kind="stable")
        for found in frame["__known"]:
            for token in found:
                if not self.seen.containsKey((token,)):
                    self.seen.updateValue((token,), (True,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        n = sum(1 for _ in self.seen.keys())
        yield pd.DataFrame({self.stream: [key[0]], "n_distinct": [n], "size": [int(frame["__size"].max())]})
        if frame[self.done].fillna(False).any():
            self.seen.clear()
        elif (newest := frame[self.at].max()) == newest:
            self.handle.registerTimer(int(newest.timestamp() * 1000) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def enumeration_stream(lines: DataFrame, words: DataFrame, stream: str = "stream_id", session: str = "conv_id", seq: str = "seq", text: str = "released", done: str = "done", at: str = "ts", least: int = 12, share: float = 0.8, idle: float = 1800.0, late: str = "10 minutes") -> DataFrame:
    """stream, n_distinct, size, stop: after every batch of an answer, how much of its session's dictionary it has recited.

    Lines come as the guard releases them, which never splits a token.  The
    dictionary is a static table, joined by (session, token), so no session's
    dictionary is ever one value; a token counts once an answer.
    """
    kind = lines.schema[stream].dataType.simpleString()
    sizes = words.groupBy(session).agg(F.count("*").alias("__size"))
    marked = lines.withWatermark(at, late)
    # tokens of a line that its session knows; lines without any stay, with nothing
    told = marked.withColumn("__token", F.explode_outer(F.array_distinct(placeholders(F.col(text)))))
    known = told.join(words.select(F.col(session).alias("__session"), F.col("token").alias("__word")), F.col(session).eqNullSafe(F.col("__session")) & (F.col("__token") == F.col("__word")), "left")
    sized = known.join(sizes.withColumnRenamed(session, "__of"), F.col(session).eqNullSafe(F.col("__of")), "left")
    rows = sized.select(stream, seq, done, at, F.when(F.col("__word").isNotNull(), F.array("__word")).otherwise(F.array().cast("array<string>")).alias("__known"), F.coalesce("__size", F.lit(0)).alias("__size"))
    out = keyed(rows, stream, _Recited(stream, session, seq, done, at, int(idle * 1000)), f"{stream} {kind}, n_distinct long, size long")
    return out.withColumn("stop", enumeration(F.col("n_distinct"), F.col("size"), least, share))
