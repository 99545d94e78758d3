"""Stateful streams: guarded answers, chains, ledgers, limits, caches, sessions, spend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.operators.stored import shared_folder
from quillguard.streaming import chain, spend
from quillguard.streaming.caches import bounded_stream, enumeration_stream
from quillguard.streaming.guard import Scanner, guard_stream, released
from quillguard.streaming.limits import breaker_stream, budget_stream, rate_limit_stream
from quillguard.streaming.tables import feed, pieces, run_to_end

__all__ = ["Scanner", "bounded_stream", "breaker_stream", "budget_stream", "cached_stream", "chain", "enumeration_stream", "feed", "guard_stream", "pieces", "rate_limit_stream", "released", "run_to_end", "session_stream", "shared_folder", "spend", "spend_stream"]


def spend_stream(events: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Tokens by tenant and minute, with late events up to the watermark."""
    return events.withWatermark(at, late).groupBy("tenant", F.window(at, "1 minute").alias("w")).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")).select("tenant", F.col("w.start").alias("minute"), "prompt_tokens", "completion_tokens")


def session_stream(events: DataFrame, key: str, at: str = "ts", idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after an idle time."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, idle).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def cached_stream(ops: DataFrame, key: str = "cache_key", ttl_ms: int = 900_000, bound: int = 10_000, shards: int = 64) -> DataFrame:
    """The operations (ts, seq, op, answer, tokens) of a bounded cache with hit, found, evicted, avoided."""
    return bounded_stream(ops, key, "ts", "seq", "op", "answer", "tokens", bound, ttl_ms / 1000, shards)
