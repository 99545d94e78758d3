"""Exact top-k inner products with a vector-approximation file.

Every component is quantised to a cell of a grid per dimension; a vector's
approximation is its cell numbers, one byte each.  A scan of the approximations
bounds every inner product from both sides.  What cannot be among a query's k
best by its bounds is dropped; the rest is read exactly in the order of the
bound, in two rounds: first those with the best bounds, then all whose bound
still reaches the k-th exact score.  After that the result is certain.

Vectors of equal content can only win with their smallest ids, so no more than
k + 1 of them enter the search.  Queries and approximations meet in blocks of
fixed size on a grid: a block of queries goes to every block of the file, which
itself is sent once, so no key holds more than one file block (two or three by
chance) and what is sent is the smaller side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillguard.llm.session import cut, quoted

K, SCALE, CELLS = 10, 1024, 256
#: Rows of a block of approximations and of a block of queries.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 256


def _quantised(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array<long>) of the vectors that take part."""
    whole = F.transform(F.col(quoted(vec_col)), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    good = F.col(quoted(vec_col)).isNotNull() & (F.size(quoted(vec_col)) > 0) & ~F.exists(F.col(quoted(vec_col)), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return df.filter(good & F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).cast("long").alias("vec_id"), whole.alias("v")).distinct()


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; floats carry them where they are exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(float) @ rows.T.astype(float)).astype(np.int64)
    return queries @ rows.T


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each query with any vector between low and high."""
    up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    slack = 1e-9 * (np.abs(queries).astype(float) @ np.maximum(np.abs(low), np.abs(high)).T.astype(float)) + 1
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def search(df: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for every row of ``queries``.

    Scores are integer inner products of floor(1024 x); ties go to smaller ids.
    Rows whose vector is null, empty or holds a null or non-finite component, or
    whose id is null, take no part; vectors of another length than the query's
    are no candidates; repeated rows count once.  Scores must fit 64 bits.
    An empty table or query set gives an empty result.  Other columns are ignored.
    """
    spark = df.sparkSession
    rows = cut(_quantised(df, id_col, vec_col).withColumn("dim", F.size("v")))
    asked = _quantised(queries, id_col, vec_col).withColumn("dim", F.size("v"))
    # the k + 1 smallest ids of each content; Spark limits each rank before the shuffle
    content = Window.partitionBy("v").orderBy("vec_id")
    useful = cut(rows.withColumn("__r", F.row_number().over(content)).filter(F.col("__r") <= k + 1).drop("__r"))
    dims = [r[0] for r in useful.select("dim").distinct().collect()]
    n_queries, n_rows = asked.count(), useful.count()
    query_blocks, file_blocks = max(1, -(-n_queries // BLOCK_QUERIES)), max(1, -(-n_rows // BLOCK_ROWS))
    parts = [_search_dim(spark, useful.filter(F.col("dim") == d), asked.filter(F.col("dim") == d), d, k, query_blocks, file_blocks) for d in sorted(dims)]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _search_dim(spark, rows: DataFrame, asked: DataFrame, dim: int, k: int, query_blocks: int, file_blocks: int) -> DataFrame:
    ends = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("d").collect()
    low = np.array([r["lo"] for r in ends], np.int64)
    width = np.array([max(1, -(-(r["hi"] - r["lo"] + 1) // CELLS)) for r in ends], np.int64)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                v = np.array(part.column("v").flatten()).reshape(-1, dim)
                codes = ((v - low) // width).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("vec_id").to_numpy().tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], names=["ids", "codes"])

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(frame["v"].to_numpy()).astype(np.int64)
        return pd.DataFrame({"qb": [frame["qb"].iloc[0]], "qids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "qv": [v.tobytes()]})

    file = cut(rows.select("vec_id", "v").mapInArrow(approximate, "ids binary, codes binary").withColumn("fb", F.pmod(F.xxhash64("ids"), F.lit(file_blocks)).cast("int")))
    # a block of queries holds BLOCK_QUERIES rows on average; each goes to every block of the file
    packed = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).groupBy("qb").applyInPandas(pack, "qb int, qids binary, qv binary")
    copies = packed.withColumn("fb", F.explode(F.sequence(F.lit(0), F.lit(file_blocks - 1))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(-1, dim).astype(np.int64)
                qids = np.frombuffer(batch.column("qids")[i].as_py(), np.int64)
                q = np.frombuffer(batch.column("qv")[i].as_py(), np.int64).reshape(-1, dim)
                at = low + codes * width
                least, most = bounds(q, at, at + width - 1)
                least[qids[:, None] == ids[None, :]] = -np.inf
                keep = min(k, len(ids))
                bar = np.partition(least, len(ids) - keep, 1)[:, len(ids) - keep]
                a, b = np.nonzero((most >= bar[:, None]) & (qids[:, None] != ids[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(qids[a]), pa.array(ids[b]), pa.array(least[a, b]), pa.array(most[a, b])], names=["query_id", "vec_id", "least", "most"])

    near = file.join(copies, "fb").select("ids", "codes", "qids", "qv").mapInArrow(scan, "query_id long, vec_id long, least double, most double")
    near = cut(near)
    place = Window.partitionBy("query_id").orderBy(F.desc("least"), "vec_id")
    bar = near.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("least")).alias("bar"))
    left = cut(near.join(bar, "query_id").filter(F.col("bar").isNull() | (F.col("most") >= F.col("bar"))).select("query_id", "vec_id", "most"))

    q = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    score = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x)
    read = lambda pairs: pairs.join(rows.select("vec_id", "v"), "vec_id").join(q, "query_id").select("query_id", "vec_id", score.alias("score"))
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("most"), "vec_id")
    # only the first 2 k of a query are ranked, and cut to as many before they are sent
    first = cut(read(left.withColumn("r", F.row_number().over(by_bound)).filter(F.col("r") <= 2 * k)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
    unread = left.join(first.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
    rest = unread.join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("most") >= F.col("kth")))
    scored = first.unionByName(read(rest))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = r"""
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10
"""
