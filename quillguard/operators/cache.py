"""Shape-keyed cache: hit rates of a corpus and look-ups in time."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillguard.functions.rules import Rule, fingerprint
from quillguard.functions.text import shape
from quillguard.operators.ledger import seconds


def shaped_lines(df: DataFrame, file_col: str, masked_col: str) -> DataFrame:
    """file, masked line, shape of every line that isn't blank."""
    lines = df.select(file_col, F.explode(F.split(F.col(masked_col), "\n", -1)).alias("line")).filter(F.trim("line") != "")
    return lines.withColumn("shape", F.get(shape(F.array("line")), 0))


def hit_rates(lines: DataFrame, file_col: str) -> DataFrame:
    """Per file and over all: lines, distinct texts and shapes, shapes seen once, hit rates.

    The row ALL sums the files' counts; a shape of two files counts twice.  Texts
    are counted under their shape, so one aggregation serves both counts.
    """
    by_text = lines.groupBy(file_col, "shape", "line").agg(F.count("*").alias("n"))
    by_shape = by_text.groupBy(file_col, "shape").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    by_file = by_shape.groupBy(F.col(file_col).cast("string").alias("file")).agg(F.sum("n").alias("lines"), F.sum("texts").alias("texts"), F.count("*").alias("shapes"), F.count_if(F.col("n") == 1).alias("singletons"))
    every = by_file.agg(F.lit("ALL").alias("file"), *[F.sum(c).alias(c) for c in ("lines", "texts", "shapes", "singletons")])
    rate = lambda c: F.round((F.col("lines") - F.col(c)) / F.col("lines"), 6)
    return by_file.unionByName(every).filter("lines > 0").withColumn("text_hit_rate", rate("texts")).withColumn("shape_hit_rate", rate("shapes")).withColumn("headroom", F.round(F.col("singletons") / F.col("lines"), 6))


def lookups(ops: DataFrame, key: str, at: str, is_put: str, ttl_seconds: float, tie: str) -> DataFrame:
    """The get rows with the time of the put that answers them, if one is in time.

    A put lives for ttl from when it was made; reading doesn't renew it.  At equal
    times a put comes before a get.
    """
    upto = Window.partitionBy(key).orderBy(at, F.desc(is_put), tie).rowsBetween(Window.unboundedPreceding, 0)
    seen = ops.withColumn("put_at", F.last(F.when(F.col(is_put), F.col(at)), ignorenulls=True).over(upto))
    age = F.unix_micros(at) - F.unix_micros("put_at")
    return seen.filter(~F.col(is_put)).withColumn("hit", F.coalesce(age <= int(ttl_seconds * 1_000_000), F.lit(False)))


def statistics(gets: DataFrame) -> DataFrame:
    n = F.count("*")
    hits = F.count_if("hit")
    return gets.agg(hits.alias("hits"), (n - hits).alias("misses"), F.round(F.when(n > 0, hits / n).otherwise(0.0), 6).alias("hit_rate"))


def two_level(requests: DataFrame, local: DataFrame, shared: DataFrame, key: str, answer: str) -> DataFrame:
    """The local entry, else the shared one; ``tier`` says which."""
    joined = requests.join(local.select(key, F.col(answer).alias("__l")), key, "left").join(shared.select(key, F.col(answer).alias("__s")), key, "left")
    return joined.withColumn(answer, F.coalesce("__l", "__s")).withColumn("tier", F.when(F.col("__l").isNotNull(), "local").when(F.col("__s").isNotNull(), "shared").otherwise("miss")).drop("__l", "__s")


def least_recent(df: DataFrame, used_at: str, keep: int, within: str) -> DataFrame:
    """The entries that an LRU bound of ``keep`` for each ``within`` leaves."""
    order = Window.partitionBy(within).orderBy(F.desc(used_at))
    return df.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= keep).drop("__r")


class Shard:
    """A bounded cache: entries in order of use, the least recent goes first; entries end with their time to live.

    ``renew`` counts the time to live from the last use instead of the last put.
    Time never runs backwards.
    """

    def __init__(self, bound: int, ttl: float, renew: bool = False, entries: Iterable[tuple] = (), now: float | None = None):
        self.bound, self.ttl, self.renew, self.now = bound, ttl, renew, now
        #: key -> (answer, tokens, since), by use; and key -> since, by time.
        self.used = OrderedDict((k, (answer, tokens, since)) for k, answer, tokens, since in entries)
        self.aged = OrderedDict(sorted(((k, e[2]) for k, e in self.used.items()), key=lambda x: x[1]))

    def entries(self) -> list[tuple]:
        return [(k, *e) for k, e in self.used.items()]

    def drop(self, key: str) -> None:
        if self.used.pop(key, None) is not None:
            del self.aged[key]

    def expire(self, now: float | None) -> None:
        """Time goes on to ``now``; what is older than its time to live goes."""
        if now is not None:
            self.now = now if self.now is None else max(self.now, now)
        while self.aged and self.now is not None:
            key, since = next(iter(self.aged.items()))
            if self.now - since <= self.ttl:
                break
            self.drop(key)

    def _set(self, key: str, answer: str | None, tokens: int, since: float) -> None:
        self.used[key] = (answer, tokens, since)
        self.used.move_to_end(key)
        self.aged[key] = since
        self.aged.move_to_end(key)

    def put(self, key: str, answer: str | None, tokens: int) -> int:
        """Entries that had to go for this one; an answer of nothing isn't kept."""
        if not answer or self.bound <= 0 or self.ttl <= 0:
            return 0
        self._set(key, answer, tokens, self.now or 0.0)
        evicted = 0
        while len(self.used) > self.bound:
            self.drop(next(iter(self.used)))
            evicted += 1
        return evicted

    def get(self, key: str) -> tuple[str | None, int] | None:
        """Answer and tokens of an entry, which becomes the most recent."""
        if key not in self.used:
            return None
        answer, tokens, since = self.used[key]
        if self.renew:
            self._set(key, answer, tokens, self.now or 0.0)
        else:
            self.used.move_to_end(key)
        return answer, tokens


def operate(shard: Shard, op: str | None, key: str, now: float | None, answer: str | None, tokens: int | None) -> tuple[bool, str | None, int, int]:
    """hit, answer, evicted, tokens avoided of one operation: ``get``, ``put``, ``drop``, or ``use`` (get, else put the answer)."""
    shard.expire(now)
    if op == "drop":
        shard.drop(key)
        return False, None, 0, 0
    if op in ("get", "use"):
        found = shard.get(key)
        if found:
            return True, found[0], 0, found[1]
    if op in ("put", "use"):
        return False, None, shard.put(key, answer, tokens or 0), 0
    return False, None, 0, 0


OPERATED = "hit boolean, found string, evicted int, avoided long"


def keyed(key: Column, rules: list[Rule]) -> Column:
    """A key that a change of the rules leaves without entries."""
    return F.concat_ws(":", key, F.lit(fingerprint(rules)[:16]))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def bounded(ops: DataFrame, key: str, at: str, tie: str, op: str, answer: str, tokens: str, bound: int, ttl: float, shards: int = 64, renew: bool = False) -> DataFrame:
    """Every operation with hit, found, evicted, avoided, of a cache in shards of at most ``bound`` entries each.

    A shard is sequential; its state is one bounded table, carried over batches
    of sorted rows.  Null keys hit nothing and are kept by nothing.
    """
    names, n = ops.columns, len(ops.columns)
    used = [F.col(op), F.col(key).cast("string"), seconds(F.col(at)), F.col(answer), F.col(tokens).cast("long")]
    source = ops.select("*", shard_of(F.col(key), shards).alias("__s"), *[c.alias(f"__u{i}") for i, c in enumerate(used)])
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ops.schema.fields), OPERATED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, shard = None, None
        for batch in batches:
            out = []
            for s, kind, k, now, given, cost in zip(*[c.to_pylist() for c in batch.columns[n:]]):
                if s != which:
                    which, shard = s, Shard(bound, ttl, renew)
                out.append(operate(shard, kind, k, now, given, cost) if k is not None else (False, None, 0, 0))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.bool_(), pa.string(), pa.int32(), pa.int64()))] if out else [pa.array([], t) for t in (pa.bool_(), pa.string(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=[*names, "hit", "found", "evicted", "avoided"])

    return source.repartition("__s").sortWithinPartitions("__s", at, tie).mapInArrow(run, fields)


def bounded_statistics(operated: DataFrame, op: str) -> DataFrame:
    """Hits, misses, evictions, tokens avoided and the hit rate."""
    asked = F.col(op).isin("get", "use")
    hits, misses = F.count_if("hit"), F.count_if(asked & ~F.col("hit"))
    return operated.agg(hits.alias("hits"), misses.alias("misses"), F.coalesce(F.sum("evicted"), F.lit(0)).cast("long").alias("evictions"), F.coalesce(F.sum("avoided"), F.lit(0)).alias("tokens_avoided"), F.round(F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0), 6).alias("hit_rate"))
