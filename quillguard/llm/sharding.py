"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the
fractional rank (2 r - 1) / (2 n) spreads every source evenly over 0 to 1.
Sorting all rows by it interleaves the sources in proportion, and cutting that
order into equal runs gives shards that all match the mixture, with row counts
at most one apart (law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.llm.native import bits_for, leading, null_last, rank_in, spread
from quillguard.llm.session import cut, quoted

SHARDS, SEED = 16, 20240301


def interleave(df: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, source, fraction.

    Null text has size 1 and the checksum of no bytes; null sources form a source
    of their own, after all others; rows with equal id and text are
    interchangeable, so any order among them is the same result.  An empty table
    gives an empty result; very long texts only count by their size.  Other
    columns of the input are ignored, whatever their names.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    base = cut(
        df.select(
            F.col(quoted(id_col)).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.col(quoted(source_col)).cast("string").alias("source"), null_last(source_col).alias("__s"),
        ).withColumn("__h", spread(F.col("doc_id"), F.col("text_crc32"), F.col("size"), seed=seed))
    )
    total = base.count()
    bits = bits_for(total)
    order = [F.col("__h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = rank_in(base.withColumn("__b", leading(F.col("__h"), bits)), ["__s"], "__b", order, "__r").drop("__b")
    sizes = base.groupBy("__s").agg(F.count("*").alias("__n"))
    mixed = cut(ranked.join(sizes, "__s").withColumn("fraction", (2 * F.col("__r") - 1) / (2 * F.col("__n"))).drop("__r", "__n", "__h"))
    pieces = 1 << bits
    placed = rank_in(mixed.withColumn("__all", F.lit(0)).withColumn("__b", F.floor(F.col("fraction") * pieces)), ["__all"], "__b", [F.col("fraction"), F.col("__s")], "__p")
    position = F.col("__p") - 1
    return (
        placed.withColumn("shard", F.expr(f"(__p - 1) * {shards} div {max(1, total)}").cast("int"))
        .withColumn("slot", position - F.expr(f"(shard * {max(1, total)}L + {shards - 1}) div {shards}"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "fraction")
    )
