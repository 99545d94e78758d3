"""Near-duplicate documents by SetSketch registers.

A document's set of 5-word shingles is summarised by registers that hold
exponentially spaced, truncated minima: register j is floor(1 - log_b h_j),
where h_j is the least of one exponential variate per shingle.  Registers merge
by maximum and two sets agree in a register with about their Jaccard
similarity, so bands of registers find candidates.  A candidate's similarity is
estimated by the joint likelihood of both register lists given the exact set
sizes; what cannot be excluded is verified on the full sets.

Documents with equal sets form one class before any pairing.  A bucket compares
its classes with one hub, not all pairs; components of the confirmed links then
show which buckets still hold classes of different components, and only those
buckets are compared in full, in cells of fixed size that give out a spanning set of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.llm import textbytes as tb
from quillguard.llm.graph import components, spanning
from quillguard.llm.session import cut, fresh, quoted

WORDS, PERCENT = 5, 75
#: With 30 bands of 3 registers a pair of similarity 0.75 is missed once in 14 million times.
BANDS, WIDTH = 30, 3
REGISTERS = BANDS * WIDTH
BASE, RATE, LIMIT = 1.001, 20.0, 65_534
#: Standard errors below the threshold at which an estimate excludes a candidate.
MARGIN = 6.0
#: Classes of one side of a cell in which a bucket is compared, and shingles that are counted at a time.
CELL, COLUMNS = 512, 4096

_MULTIPLIERS = np.random.default_rng(20240303).integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(block: tb.Block, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shingle hash, document) of a block, ordered by document and hash."""
    w = tb.words(block)
    hashes = tb.span_hash(tb.prefix_hash(block.data, lower=True), w.start, w.end)
    return tb.distinct(*tb.shingles(hashes, w.first, k))


def sketch(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers (documents x REGISTERS, uint16) of the sets keys[first[i]:first[i + 1]]; 0 for an empty set."""
    n = len(first) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    filled = np.flatnonzero(np.diff(first))
    if not len(filled):
        return out
    starts, buffer = first[:-1][filled], np.empty(len(keys), np.uint64)
    log_base = np.log(BASE)
    for j in range(REGISTERS):
        np.multiply(keys, _MULTIPLIERS[j], out=buffer)
        least = np.minimum.reduceat(buffer, starts)
        share = (least.astype(np.float64) + 1.0) / 2.0**64
        h = -np.log1p(-np.minimum(share, 1 - 1e-16)) / RATE
        out[filled, j] = np.clip(np.floor(1.0 - np.log(h) / log_base), 0, LIMIT + 1)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    bands = registers.reshape(len(registers), BANDS, WIDTH).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for j in range(WIDTH):
        key = tb.mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j])
    return key


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair of register rows, given the set sizes."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    likely = above * log(up) + below * log(down) + equal * log(1 - up - down)
    return np.take_along_axis(j, likely.argmax(1)[:, None], 1)[:, 0]


FEATURES = "n_shingles long, cid long, fp long, regs binary"


def features(df: DataFrame, keep: tuple[str, ...], text_col: str = "text", k: int = WORDS) -> DataFrame:
    """Kept columns and FEATURES: set size, two independent hashes of the set, registers."""
    source = df.select(*keep, F.col(text_col).alias("__text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            for block in tb.blocks(batch.column(n), tb.SMALL_BLOCK):
                part = batch.slice(block.lo, block.size)
                keys, owner = shingle_sets(block, k)
                first = np.searchsorted(owner, np.arange(block.size + 1))
                count = np.diff(first)
                sums = []
                for salt in (0x51ED270B9D1C2F35, 0xA0761D6478BD642F):
                    total = np.zeros(len(keys) + 1, np.uint64)
                    np.cumsum(tb.mix(keys ^ np.uint64(salt)), out=total[1:])
                    sums.append(tb.mix(total[first[1:]] - total[first[:-1]] + count.astype(np.uint64)).view(np.int64))
                regs = sketch(keys, first)
                arrays = [*part.columns[:n], pa.array(count, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array([r.tobytes() for r in regs], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:n], "n_shingles", "cid", "fp", "regs"])

    return source.mapInArrow(run, ", ".join([*kept, FEATURES]))


def _buckets(classes: DataFrame) -> DataFrame:
    """cid, n_shingles, bk: one row for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                regs = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                times = np.full(part.num_rows, BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(part.column(0)), times)), pa.array(np.repeat(np.asarray(part.column(1)), times)), pa.array(band_keys(regs).reshape(-1).view(np.int64))], names=["cid", "n_shingles", "bk"])

    return classes.select("cid", "n_shingles", "regs").mapInArrow(run, "cid long, n_shingles long, bk long")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose similarity may reach the threshold."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    j = percent / 100
    floor = j - MARGIN * (j * (1 - j) / REGISTERS) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                regs = [np.frombuffer(b"".join(part.column(x).to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in ("r_a", "r_b")]
                good = estimate(*regs, *(np.asarray(part.column(x)).astype(float) for x in ("n_a", "n_b"))) >= floor
                yield part.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """a, b, inter, uni for every pair, from the full shingle sets."""
    side = lambda x: texts.select(F.col("cid").alias(x), F.col("text").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_b, at_b = tb.column_bytes(batch.column("t_b"))
            for block in tb.blocks(batch.column("t_a"), tb.SMALL_BLOCK // 2):
                lo = block.lo
                while lo < block.hi:  # the other side may be longer
                    hi = max(lo + 1, min(block.hi, int(np.searchsorted(at_b, at_b[lo] + tb.SMALL_BLOCK, "right")) - 1))
                    i, j = lo - block.lo, hi - block.lo
                    left = tb.Block(0, hi - lo, block.data[block.offsets[i] : block.offsets[j]], block.offsets[i : j + 1] - block.offsets[i])
                    right = tb.Block(0, hi - lo, raw_b[at_b[lo] : at_b[hi]], at_b[lo : hi + 1] - at_b[lo])
                    (ka, da), (kb, db) = shingle_sets(left, k), shingle_sets(right, k)
                    keys, owner = np.concatenate([ka, kb]), np.concatenate([da, db])
                    _, distinct = tb.distinct(keys, owner)
                    uni = np.bincount(distinct, minlength=hi - lo)
                    inter = np.bincount(owner, minlength=hi - lo) - uni
                    part = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(inter, pa.int64()), pa.array(uni, pa.int64())], names=["a", "b", "inter", "uni"])
                    lo = hi

    return both.mapInArrow(run, "a long, b long, inter long, uni long")


def _text_key(text: F.Column) -> list[F.Column]:
    return [F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2")]


def components_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, t1, t2 (hashes of the text).

    Rows are linked when 100 x intersection >= percent x union of their sets;
    component_id is the smallest doc_id of the component.  Rows without words
    have an empty set and are linked with nothing.  Rows with a null doc_id take
    part but lend no id: a component of nothing else has a null component_id, and
    its rows are kept.  Repeated rows are one class.  An empty table gives an
    empty result.  Other columns of the input are ignored.
    """
    text = F.col(quoted(text_col)).cast("string")
    plain = df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text.alias("text"), *_text_key(text))
    rows = cut(features(plain, ("doc_id", "t1", "t2"), "text", k))
    filled = rows.filter("n_shingles > 0")
    heads = filled.groupBy("cid", "fp", "n_shingles").agg(F.min("doc_id").alias("least"), F.min(F.struct("t1", "t2", "regs")).alias("head"))
    # a class has a number of its own from here on; its hashes and size only lead rows back to it
    same = ["h1", "fp", "n_shingles"]
    classes = cut(heads.select(F.monotonically_increasing_id().alias("cid"), F.col("cid").alias("h1"), "fp", "n_shingles", "least", "head.t1", "head.t2", "head.regs"))

    buckets = _buckets(classes)
    shared = buckets.groupBy("bk").agg(F.count("*").alias("size"), F.min("cid").alias("hub")).filter("size > 1")
    members = cut(buckets.join(shared, "bk"))
    pairs = members.filter("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    texts = _text_table(plain, classes, members)
    tested = _verified(_likely(pairs, classes, percent), texts, k)
    links = cut(tested.filter(F.lit(100) * F.col("inter") >= F.lit(percent) * F.col("uni")).select("a", "b"))
    label = components(links)
    extra = cut(_open_links(members, label, texts, k, percent))
    if not extra.isEmpty():
        label = components(links.unionByName(extra))
    named = classes.select("cid", *same, "least").join(label, classes["cid"] == label["node"], "left").withColumn("label", F.coalesce("label", "cid")).drop("node")
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = named.join(lowest, "label").select(*same, "component_id")
    out = rows.withColumnRenamed("cid", "h1").join(by_class, same, "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "t1", "t2")


def _text_table(plain: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """cid, text of every class that shares a bucket."""
    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "t1", "t2", F.col("least").alias("__id"))
    held = plain.join(wanted, ["t1", "t2"]).select("cid", "text")
    return cut(held.groupBy("cid").agg(F.first("text").alias("text")))


def _open_links(members: DataFrame, label: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links between classes of one bucket that the links found so far leave in different components.

    Buckets of equal content are compared once.  A bucket is compared in cells
    of at most 2 x CELL classes, so no task holds more; pairs are counted inside
    a cell as products of shingle matrices, and only as many links come out as
    join its labels.
    """
    labelled = members.filter("size > 2").join(label, members["cid"] == label["node"], "left").select("bk", "size", "cid", F.coalesce("label", "cid").alias("label"))
    mixed = labelled.groupBy("bk").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum(F.xxhash64("cid").cast("decimal(30,0)")).alias("content"), F.count("*").alias("n"))
    chosen = mixed.filter("lo <> hi").groupBy("content", "n").agg(F.min("bk").alias("bk")).select("bk")
    blocks = F.ceil(F.col("size") / CELL).cast("int")
    own = F.pmod(F.xxhash64(F.lit(9), "cid"), blocks).cast("int")
    cells = labelled.join(chosen, "bk").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = cells.select("bk", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", "label").join(texts, "cid")

    def compare(table: pa.Table) -> pa.Table:
        found = linked_pairs(np.asarray(table.column("label")), table.column("text").combine_chunks(), k, percent)
        cid = np.asarray(table.column("cid"))
        return pa.table({"a": pa.array(cid[found[0]], pa.int64()), "b": pa.array(cid[found[1]], pa.int64())})

    return placed.groupBy("bk", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def linked_pairs(label: np.ndarray, text: pa.Array, k: int = WORDS, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs of texts whose labels differ: enough to join all labels that links join."""
    keys, owner = [], []
    for block in tb.blocks(text, tb.SMALL_BLOCK):
        a, b = shingle_sets(block, k)
        keys.append(a)
        owner.append(b + block.lo)
    key, row = np.concatenate(keys), np.concatenate(owner)
    n = len(label)
    size = np.bincount(row, minlength=n).astype(np.float32)
    _, column, times = np.unique(key, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    row = row[shared]
    inter = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = column[-1] + 1 if len(column) else 0
    for lo in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((n, min(COLUMNS, width - lo)), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        inter += part @ part.T
    link = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    link &= np.triu(np.ones((n, n), bool), 1) & (label[:, None] != label[None, :])
    return spanning(label, *np.nonzero(link))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with its columns as they were, whatever their names; repeated rows of one id leave one."""
    verdict = components_of(df, id_col, text_col).filter("kept").select(F.col("doc_id").alias("__id"), "t1", "t2").distinct()
    k1, k2, kid = fresh(df, "t1", "t2", "id")
    t1, t2 = _text_key(F.col(quoted(text_col)).cast("string"))
    keyed = df.withColumns({k1: t1, k2: t2, kid: F.col(quoted(id_col)).cast("long")})
    same = keyed[quoted(kid)].eqNullSafe(verdict["__id"]) & (keyed[quoted(k1)] == verdict["t1"]) & (keyed[quoted(k2)] == verdict["t2"])
    return keyed.join(verdict, same, "left_semi").dropDuplicates([kid, k1, k2]).select(*[F.col(quoted(c)) for c in df.columns])


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
u AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, w.doc_id = c.m AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = w.doc_id
"""
