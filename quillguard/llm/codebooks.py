"""Vector compression by product codes, trained on all vectors.

Components become integers; a vector is cut into equal consecutive parts, each
of which is replaced by the number of the nearest entry of its codebook.
Vectors lie in blocks, part by part and dimension by dimension (columns of
numpy arrays), in a table of the shared folder.  A round of training sends the
codebooks out and runs one ``treeAggregate`` over the blocks: distances to all
entries accumulate dimension by dimension, ``np.add.at`` adds the parts to
integer sums and counts of their entries, and these tensors merge through a
tree, so that what meets anywhere is a few tensors of one fixed size.
Everything is in integers: results don't depend on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.llm.session import quoted, written
from quillguard.sources import spread

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bytes of a block of vectors, and rows whose distances are held at a time.
BLOCK_BYTES, CHUNK = 1 << 22, 2048
#: Levels of the tree in which sums merge, and keys among which the rows of one label are dealt.
DEPTH, SALT = 3, 32

Book = dict[int, np.ndarray]  # dimension of the vectors -> (parts, entries, dimension / parts)


def quantise(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the vectors (-1: takes no part), and floor(scale * x) of all components with their offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    at = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=at[1:])
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
    bad = np.zeros(len(x) + 1, np.int64)
    np.cumsum(~np.isfinite(x), out=bad[1:])
    size = np.where(bad[at[1:]] > bad[at[:-1]], -1, np.where(length > 0, length, -1))
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(np.where(np.isfinite(x), x, 0.0) * scale)
    return size, whole, at


def _limit(dim: int, parts: int) -> int:
    """Largest absolute component for which squared distances and sums surely fit 64 bits."""
    return int(min(2**40, (2**61 / max(1, dim)) ** 0.5 / 2))


def blocks(df: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """dim, rows, ids, labels, data: vectors of one length, as integers, dimension by dimension."""
    source = df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(label_col)).alias("label"), F.col(quoted(vec_col)).alias("vec"))
    kind = source.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, whole, at = quantise(batch.column(2), scale)
            for dim in np.unique(size[(size > 0) & (size % parts == 0)]).tolist():
                rows = np.flatnonzero(size == dim)
                step = max(1, BLOCK_BYTES // (8 * dim))
                for lo in range(0, len(rows), step):
                    some = rows[lo : lo + step]
                    v = whole[at[some][:, None] + np.arange(dim)]
                    if np.abs(v).max() > _limit(dim, parts):
                        raise OverflowError(f"components above {_limit(dim, parts) / scale} have distances beyond 64 bits")
                    ids, labels = (batch.column(k).take(pa.array(some)) for k in (0, 1))
                    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                    data = np.ascontiguousarray(v.T.astype(np.int64)).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(some)], pa.int32()), one(ids), one(labels), pa.array([data], pa.binary())], names=["dim", "n", "ids", "labels", "data"])

    return source.mapInArrow(run, f"dim int, n int, ids array<bigint>, labels array<{kind}>, data binary")


def nearest(data: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance (parts x rows) of columnar vectors (dimension x rows); ties go to lower entries."""
    parts, entries, width = book.shape
    n = data.shape[1]
    code, error = np.empty((parts, n), np.int64), np.empty((parts, n), np.int64)
    spread_of = int(max(data.max(initial=0), book.max(initial=0))) - int(min(data.min(initial=0), book.min(initial=0)))
    kind = np.int32 if width * spread_of * spread_of < 2**31 else np.int64
    data, book = data.astype(kind), book.astype(kind)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        total, step = np.empty((hi - lo, entries), kind), np.empty((hi - lo, entries), kind)
        for p in range(parts):
            total[:] = 0
            for d in range(width):
                np.subtract(data[p * width + d, lo:hi, None], book[p, None, :, d], out=step)
                np.multiply(step, step, out=step)
                np.add(total, step, out=total)
            code[p, lo:hi] = total.argmin(1)
            error[p, lo:hi] = total[np.arange(hi - lo), code[p, lo:hi]]
    return code, error


#: A null id comes after all others.
NO_ID = 2**63

Smallest = dict[int, list[tuple[int, tuple[int, ...]]]]


def _smallest(a: Smallest, b: Smallest, entries: int) -> Smallest:
    """Of each dimension the vectors of the smallest distinct ids; of one id, the least vector."""
    out = {}
    for dim in a.keys() | b.keys():
        least = {}
        for i, v in sorted(a.get(dim, []) + b.get(dim, [])):
            least.setdefault(i, v)
        out[dim] = sorted(least.items())[:entries]
    return out


def start(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Book:
    """The parts of the vectors of the smallest ids, ascending."""

    def add(best: Smallest, row) -> Smallest:
        ids = [NO_ID if i is None else i for i in row.ids]
        chosen = set(sorted(set(ids))[:entries])
        v = np.frombuffer(row.data, np.int64).reshape(row.dim, row.n)
        return _smallest(best, {row.dim: [(i, tuple(v[:, k].tolist())) for k, i in enumerate(ids) if i in chosen]}, entries)

    best = table.rdd.treeAggregate({}, add, lambda a, b: _smallest(a, b, entries), DEPTH)
    return {dim: np.array([v for _, v in rows], np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2) for dim, rows in best.items()}


def refine(table: DataFrame, book: Book) -> Book:
    """One round: all parts move to their nearest entries, entries to the floored means of their parts."""
    sent = table.sparkSession.sparkContext.broadcast(book)

    def add(sums: dict, row) -> dict:
        b = sent.value[row.dim]
        data = np.frombuffer(row.data, np.int64).reshape(row.dim, row.n)
        code, _ = nearest(data, b)
        if row.dim not in sums:
            sums[row.dim] = (np.zeros(b.shape, np.int64), np.zeros(b.shape[:2], np.int64))
        total, count = sums[row.dim]
        for p, part in enumerate(data.reshape(b.shape[0], b.shape[2], row.n)):
            np.add.at(total[p], code[p], part.T)
            np.add.at(count[p], code[p], 1)
        return sums

    def merge(a: dict, b: dict) -> dict:
        for dim, (total, count) in b.items():
            a[dim] = (a[dim][0] + total, a[dim][1] + count) if dim in a else (total, count)
        return a

    sums = table.select("dim", "n", "data").rdd.treeAggregate({}, add, merge, DEPTH)
    sent.destroy()
    out = dict(book)
    for dim, (total, count) in sums.items():
        out[dim] = np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], book[dim])
    return out


def train(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Book:
    """Codebooks after so many rounds over a table of ``blocks``."""
    book = start(table.select("dim", "n", "ids", "data"), parts, entries)
    for _ in range(rounds):
        book = refine(table, book)
    return book


def digest(book: np.ndarray) -> str:
    """All components in decimal by part, entry and place, joined by commas, hashed."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row per row that takes part.

    Rows whose vector is null, empty or holds a null or non-finite component, or
    whose length isn't a multiple of ``parts``, take no part.  Vectors of each
    length have codebooks of their own.  Repeated rows all count and come out
    each; of the rows of one id the one with the least vector starts an entry.
    A null id counts as one id after all others.  With fewer ids than entries a
    codebook is shorter.  ``error`` sums squared distances over the parts,
    ``label_error`` over the rows of an equal label, nulls together, whatever
    their length.  Components must keep squared distances below 2^63 (at the
    given scale and 64 dimensions: below 80,000), else an OverflowError is raised.
    An empty table gives an empty result; other columns are ignored.
    """
    if entries > 256:
        raise ValueError("codes have two hex digits a part: 256 entries at most")
    table = written(blocks(spread(df), id_col, vec_col, label_col, parts, scale), "blocks")
    book = train(table, parts, entries, rounds)
    return codes(table, book)


def codes(table: DataFrame, book: Book) -> DataFrame:
    """The result of ``compress`` for a table of ``blocks`` and trained codebooks."""
    kind = table.schema["labels"].dataType.elementType.simpleString()
    marks = {dim: digest(b) for dim, b in book.items()}
    sent = table.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dim, n = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                code, error = nearest(np.frombuffer(batch.column(4)[k].as_py(), np.int64).reshape(dim, n), sent.value[dim])
                text = [row.tobytes().hex() for row in code.T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(2)[k].values, batch.column(3)[k].values, pa.array(text, pa.string()), pa.array(error.sum(0), pa.int64()), pa.array([marks[dim]] * n, pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    coded = written(table.mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint, codebooks_sha256 string"), "codes")
    # a label may hold most rows: its sum goes to every one of the keys among which its rows are dealt
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select("label", "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int"))
    same = dealt["label"].eqNullSafe(sums["label"]) & (dealt["salt"] == sums["salt"])
    return dealt.join(sums, same).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql(rounds: int = ROUNDS) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, part, min({{'d': d, 'idx': idx}}) AS best FROM (SELECT p.vec_id, p.part, c.idx, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{k} c ON c.part = p.part) GROUP BY 1, 2)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT part, idx, pos, sum(x) AS s, count(*) AS n FROM (SELECT p.part, a.best.idx AS idx, unnest(p.v) AS x, unnest(range(len(p.v))) AS pos FROM p JOIN a{k} a ON a.vec_id = p.vec_id AND a.part = p.part) GROUP BY 1, 2, 3),
m{k} AS (SELECT part, idx, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS v FROM s{k} GROUP BY 1, 2),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.idx, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.idx = c.idx)""")
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[1 + part * len(v) // {PARTS} : (part + 1) * len(v) // {PARTS}] AS v FROM e, (SELECT unnest(range({PARTS})) AS part)),
c0 AS MATERIALIZED (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id)) - 1 AS idx, v FROM p WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT {ENTRIES})),
{(',' + chr(10)).join(steps)},
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, idx, pos)) AS codebooks_sha256 FROM (SELECT part, idx, unnest(v) AS x, unnest(range(len(v))) AS pos FROM c{rounds})),
f AS (SELECT e.vec_id, e.label, string_agg(printf('%02x', a.best.idx), '' ORDER BY a.part) AS code, sum(a.best.d)::BIGINT AS error FROM e JOIN a{rounds} a USING (vec_id) GROUP BY 1, 2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, h
"""


SQL = _sql()
