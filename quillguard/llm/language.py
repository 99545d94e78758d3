"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: counts of every byte after the
last 0 to ORDER bytes.  The code length of a text is the sum, over its bytes, of
minus log2 of the byte's frequency in the longest known context, or of that
context's escape probability (distinct bytes / (bytes + distinct bytes)) and
then the next shorter context, down to 8 bits for a byte never seen.  The
statistics are frozen after training; the language of the shortest code wins.

The classifier is fitted on a bounded sample: TRAIN_DOCUMENTS different labelled
texts of each language, chosen by a seeded hash.  Every document is scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillguard.llm import textbytes as tb
from quillguard.llm.native import spread
from quillguard.llm.session import quoted
from quillguard.llm.suffix_tree import fold, grams, stream

ORDER, TRAIN_DOCUMENTS, SEED = 3, 1500, 20240305
UNKNOWN = "und"


class ContextTree:
    """The frozen statistics of one language."""

    def __init__(self, keys: np.ndarray, times: np.ndarray, order: int = ORDER):
        self.levels = []
        for k in range(order, -1, -1):
            cut = keys & np.uint64((1 << 8 * (k + 1)) - 1)
            nodes, inverse = np.unique(cut, return_inverse=True)
            n = np.bincount(inverse, times, minlength=len(nodes))
            contexts, of = np.unique(nodes >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(of, n, minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
            bits = -np.log2(n / (total + distinct)[of]) if len(nodes) else np.zeros(0)
            escape = -np.log2(distinct / (total + distinct)) if len(contexts) else np.zeros(0)
            self.levels.append((k, nodes, bits, contexts, escape))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, at

    def bits(self, wanted: np.ndarray) -> np.ndarray:
        """Code length of each n-gram's last byte after the bytes before it."""
        out = np.zeros(len(wanted))
        left = np.arange(len(wanted))
        for k, nodes, bits, contexts, escape in self.levels:
            key = wanted[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            hit, at = self._find(nodes, key)
            out[left[hit]] += bits[at[hit]]
            left, key = left[~hit], key[~hit]
            hit, at = self._find(contexts, key >> np.uint64(8))
            out[left[hit]] += escape[at[hit]]
        out[left] += 8.0
        return out


def train(df: DataFrame, lang_col: str, text_col: str, per_language: int = TRAIN_DOCUMENTS, order: int = ORDER) -> dict[str, ContextTree]:
    """A tree for every language of the labelled rows."""
    labelled = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), spread(F.col(text_col), seed=SEED).alias("h"))
    # one number per language, as there is one tree per language later
    counts = {r["lang"]: r["n"] for r in labelled.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 2.0 * per_language / n))])
    # about twice the wanted texts pass the hash's threshold, wherever they lie; only those are ranked, copies once
    drawn = labelled.filter(F.col("h") / 2.0**63 <= F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "text"])
    sample = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= per_language).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, codes = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object), return_inverse=True) if batch.num_rows else (np.array([]), np.array([], int))
            for block in tb.blocks(batch.column("text")):
                data, begin = stream(block, tb.words(block))
                key = grams(data, begin, order)
                owner = np.repeat(codes[block.lo : block.hi], np.diff(begin) - 1)
                unique, times = np.unique(key | owner.astype(np.uint64) << np.uint64(8 * (order + 1)), return_counts=True)
                of = (unique >> np.uint64(8 * (order + 1))).astype(int)
                gram = unique & np.uint64((1 << 8 * (order + 1)) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(names[of].tolist(), pa.string()), pa.array(gram.astype(np.int64)), pa.array(times)], names=["lang", "gram", "n"])

    rows = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return {lang: ContextTree(part["gram"].to_numpy(np.uint64), part["n"].to_numpy(float), order) for lang, part in sorted(rows.groupby("lang"))}


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held: int = 2, per_language: int = TRAIN_DOCUMENTS) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, bits (code length per byte of the winner).

    Null text or text without a letter gives ``und`` and score 0, as does a table
    without labelled training rows.  The score is the winner's share of the
    likelihood; equal code lengths go to the first language by name.  Null ids
    count as empty text in the fold; repeated rows are predicted alike and learned
    from once; very long texts are read whole.  Other columns of the input are
    ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).cast("string").alias("lang"), (fold(quoted(id_col), parts) == held).alias("held_out"))
    trees = train(rows.filter("not held_out"), "lang", "text", per_language)
    names = list(trees)
    shared = spark.sparkContext.broadcast([trees[n] for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column("text")):
                part = batch.slice(block.lo, block.size)
                data, begin = stream(block, tb.words(block))
                lettered = np.asarray(part.column("lettered").to_pylist(), bool)
                size = np.diff(begin) - 1
                if names:
                    unique, inverse = np.unique(grams(data, begin, ORDER), return_inverse=True)
                    first = begin[:-1] - np.arange(block.size)
                    lengths = np.stack([np.add.reduceat(tree.bits(unique)[inverse], first) for tree in shared.value], 1)
                    best = lengths.argmin(1)
                    share = 1 / np.exp2(np.minimum(0, lengths.min(1)[:, None] - lengths)).sum(1)
                    per_byte = lengths.min(1) / size
                else:
                    best, share, per_byte, lettered = np.zeros(block.size, int), np.zeros(block.size), np.zeros(block.size), np.zeros(block.size, bool)
                lang = [names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(np.where(lettered, share, 0.0)), pa.array(np.where(lettered, per_byte, 0.0))], names=["doc_id", "held_out", "lang_pred", "score", "bits"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    return rows.select("doc_id", "held_out", "text", lettered).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits double")
