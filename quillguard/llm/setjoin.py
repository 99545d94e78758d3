"""N-gram Jaccard join with skips by set relations.

Shingles have one global order, rare ones first (by a table of counts of fixed
size), so that two sets of the wanted similarity share a shingle among their
first ones.  Those are the keys of index lists.  A list is kept in blocks by
size and by the place of the shingle in its set: an entry meets the first entry
that it may be similar to by both, and blocks that can't hold partners are
skipped.  What meets is tested by bitmaps of the sets, whose difference bounds
that of the sets, and survivors are joined exactly: in a chunk of sets, the
answers of a set are derived from those of the set before it by the shingles
in which the two differ.

Documents of equal sets form one class before any pairing.  Components of the
links show which lists still hold classes of different components; only these
are compared in full, in cells of fixed size, blocks of too different sizes
skipped again.  Every decision before the last is a bound, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillguard.llm import textbytes as tb
from quillguard.llm.graph import components, merged, spanning
from quillguard.llm.neardup import shingle_sets
from quillguard.llm.session import cut, quoted, removed, shared_folder, written

WORDS, PERCENT = 4, 85
#: The table of counts has 2^COUNT_BITS numbers, whatever the corpus.
COUNT_BITS = 20
#: A list of more entries than this (above the table's mean) is dealt out in parts of about so many.
LIST = 512
#: Sets of a chunk, and of one side of a cell.
CHUNK, CELL = 256, 1024
#: Candidates per row above which a cell is joined exactly instead of pair by pair.
FEW = 4

_LOW = np.uint64((1 << 58) - 1)
_SALTS = (0x51ED270B9D1C2F35, 0xA0761D6478BD642F)


def prefix_length(n, percent: int = PERCENT):
    """First shingles of a set of n, one of which it shares with every set it is similar to."""
    return n - (n * percent + 99) // 100 + 1


def overlap(n_a, n_b, percent: int = PERCENT):
    """Least intersection of similar sets of these sizes."""
    return (percent * (n_a + n_b) + 99 + percent) // (100 + percent)


# -- the order of shingles ---------------------------------------------------


def shingle_counts(df: DataFrame, text_col: str, k: int) -> np.ndarray:
    """How many documents' shingles fall on each number of the table; merged through a tree."""
    size = 1 << COUNT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for block in tb.blocks(batch.column(0)):
                keys, _ = shingle_sets(block, k)
                total += np.bincount((keys & np.uint64(size - 1)).astype(np.int64), minlength=size)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([total[at].tobytes()], pa.binary())], names=["at", "n"])

    def merge(a, b):  # 32 bits a number, and no further
        return a if b is None else b if a is None else np.minimum(a.astype(np.int64) + b, 2**32 - 1).astype(np.uint32)

    def add(a, row):
        one = np.zeros(size, np.uint32)
        one[np.frombuffer(row.at, np.int32)] = np.minimum(np.frombuffer(row.n, np.int64), 2**32 - 1)
        return merge(a, one)

    counts = df.select(F.col(quoted(text_col)).cast("string")).mapInArrow(run, "at binary, n binary").rdd.treeAggregate(None, add, merge, 3)
    return np.zeros(size, np.int64) if counts is None else counts


def levels(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of a number in the order (log of its count), and log of the parts of its lists."""
    log = lambda x: np.floor(np.log2(np.maximum(x, 1))).astype(np.uint8)
    return log(counts), log((counts - 2 * counts.mean()) / LIST)


# -- sets, classes, lists ----------------------------------------------------

FEATURES = "n_shingles long, s1 long, s2 long, pre binary, bits binary"


def bitmaps(keys: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A bitmap of each set, of 2 to 4 bits a shingle; a wider one folds to a narrower by ``or``."""
    n = np.diff(first)
    width = 1 << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64)
    start = np.zeros(len(n) + 1, np.int64)
    np.cumsum(width, out=start[1:])
    bits = np.zeros(start[-1], bool)
    owner = np.repeat(np.arange(len(n)), n)
    bits[start[owner] + (tb.mix(keys ^ np.uint64(0x2545F4914F6CDD1D)).astype(np.int64) & (width[owner] - 1))] = True
    packed = np.packbits(bits, bitorder="little")
    return [packed[start[i] // 8 : start[i + 1] // 8].tobytes() for i in range(len(n))]


def features(df: DataFrame, level: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, t1, t2 and FEATURES: size, two hashes of the set, its first shingles in order, its bitmap."""
    sent = df.sparkSession.sparkContext.broadcast(level)
    low = np.uint64((1 << COUNT_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column(3)):
                keys, owner = shingle_sets(block, k)
                first = np.searchsorted(owner, np.arange(block.size + 1))
                n = np.diff(first)
                sums = []
                for salt in _SALTS:
                    total = np.zeros(len(keys) + 1, np.uint64)
                    np.cumsum(tb.mix(keys ^ np.uint64(salt)), out=total[1:])
                    sums.append(tb.mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)).view(np.int64))
                token = (sent.value[(keys & low).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (keys & _LOW)
                token = token[np.lexsort((token, owner))]
                size = np.where(n > 0, prefix_length(n, percent), 0)
                pre = [token[a : a + s].tobytes() for a, s in zip(first[:-1].tolist(), size.tolist())]
                part = batch.slice(block.lo, block.size)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64()), *map(pa.array, sums), pa.array(pre, pa.binary()), pa.array(bitmaps(keys, first), pa.binary())], names=["doc_id", "t1", "t2", "n_shingles", "s1", "s2", "pre", "bits"])

    return df.select("doc_id", "t1", "t2", "text").mapInArrow(run, f"doc_id long, t1 long, t2 long, {FEATURES}")


def entries(classes: DataFrame, parts: np.ndarray) -> DataFrame:
    """key, part, cid, n, pos: an entry for each of the first shingles of a class; pos counts from 1."""
    sent = classes.sparkSession.sparkContext.broadcast(parts)
    low = np.uint64((1 << COUNT_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                raw, at = tb.column_bytes(some.column(2))
                token = np.frombuffer(raw[at[0] : at[-1]].tobytes(), np.uint64)
                times = np.diff(at) // 8
                cid = np.repeat(np.asarray(some.column(0)), times)
                pos = np.arange(len(token)) - np.repeat((at[:-1] - at[0]) // 8, times) + 1
                many = (np.uint64(1) << sent.value[(token & low).astype(np.int64)].astype(np.uint64)) - np.uint64(1)
                part = tb.mix(cid.astype(np.uint64)) & many
                names = ["key", "part", "parts", "cid", "n", "pos"]
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(cid), pa.array(np.repeat(np.asarray(some.column(1)), times).astype(np.int32)), pa.array(pos.astype(np.int32))], names=names)

    return classes.select("cid", "n_shingles", "pre").mapInArrow(run, "key long, part int, parts int, cid long, n int, pos int")


def possible(n_a, i, n_b, j, percent: int):
    """Whether sets of these sizes that share a shingle at these places (from 1) may be similar, if it is the first they share."""
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (1 + np.minimum(n_a - i, n_b - j) >= overlap(n_a, n_b, percent))


def with_hubs(lists: DataFrame, percent: int) -> DataFrame:
    """key, parts, cid, n, hub of all lists of two entries or more (and of all dealt out in parts), sorted lists given.

    The hub is the first entry of the list that the entry may be similar to by
    size and place, itself if there is none.
    """

    def assign(key, part, n, pos):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        run = np.cumsum(new) - 1
        hub, left = np.empty(len(key), np.int64), np.arange(len(key))
        while len(left):
            r = run[left]
            head = np.ones(len(left), bool)
            head[1:] = r[1:] != r[:-1]
            first = left[np.flatnonzero(head)[np.cumsum(head) - 1]]
            taken = possible(n[first], pos[first], n[left], pos[left], percent) | head
            hub[left[taken]] = first[taken]
            left = left[~taken]
        return hub, np.bincount(run)[run]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = _emitted(assign, [np.asarray(c) for c in batch.columns], held, False)
            if held[0] is not None:
                yield held[0]
            held = held[1]
        if held is not None and len(held[0]):
            last = _emitted(assign, held, None, True)[0]
            if last is not None:
                yield last

    return lists.mapInArrow(run, "key long, parts int, cid long, n int, hub long")


def _emitted(assign, columns: list[np.ndarray], held: list[np.ndarray] | None, end: bool):
    """The rows of all complete lists, and those of the last list, which may go on."""
    if held is not None:
        columns = [np.concatenate(x) for x in zip(held, columns)]
    key, part = columns[0], columns[1]
    stop = len(key)
    if not end and stop:
        same = (key == key[-1]) & (part == part[-1])
        stop = int(np.argmax(same)) if same.any() else stop
    rest = [c[stop:] for c in columns]
    key, part, parts, cid, n, pos = (c[:stop] for c in columns)
    if not stop:
        return None, rest
    hub, size = assign(key, part, n.astype(np.int64), pos.astype(np.int64))
    keep = (size > 1) | (parts > 0)
    out = pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, parts, cid, n, cid[hub])], names=["key", "parts", "cid", "n", "hub"])
    return out, rest


# -- bitmaps -----------------------------------------------------------------


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to so many bytes each."""
    out = np.zeros((len(bits), width // 8), np.uint64)
    for i, b in enumerate(bits):
        out[i] = np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), 0)
    return out


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose bitmaps allow the similarity."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bits").alias(f"b_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "b_a", "b_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            b_a, b_b = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            width = np.array([min(len(x), len(y)) for x, y in zip(b_a, b_b)])
            good = np.zeros(batch.num_rows, bool)
            for w in np.unique(width).tolist():
                rows = np.flatnonzero(width == w)
                for lo in range(0, len(rows), max(1, (1 << 23) // w)):
                    some = rows[lo : lo + max(1, (1 << 23) // w)]
                    apart = np.bitwise_count(folded([b_a[i] for i in some], w) ^ folded([b_b[i] for i in some], w)).sum(1, dtype=np.int64)
                    good[some] = apart <= n_a[some] + n_b[some] - 2 * overlap(n_a[some], n_b[some], percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a long, b long")


def near_pairs(label: np.ndarray, n: np.ndarray, bits: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of different labels whose sizes and bitmaps allow the similarity."""
    widths = np.array([len(b) for b in bits])
    found = []
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        mine = folded([bits[i] for i in rows], w)
        for v in np.unique(widths[widths >= w]).tolist():
            others = np.flatnonzero(widths == v)
            theirs = folded([bits[i] for i in others], w)
            for k, i in enumerate(rows.tolist()):
                fit = (label[others] != label[i]) & (100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others]))
                if v == w:
                    fit &= others > i
                some = np.flatnonzero(fit)
                if len(some):
                    apart = np.bitwise_count(theirs[some] ^ mine[k]).sum(1, dtype=np.int64)
                    good = others[some[apart <= n[i] + n[others[some]] - 2 * overlap(n[i], n[others[some]], percent)]]
                    if len(good):
                        found.append((np.full(len(good), i), good))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


# -- exact answers -----------------------------------------------------------


def answers(column: np.ndarray, first: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places a < b of all similar sets; set i has the columns column[first[i]:first[i + 1]], ascending, and size[i] shingles in all.

    Intersections of a set with all others are those of the set before it, less
    the lists of the columns it lacks, plus those of the columns it adds; where
    that is more work, its own lists are counted.
    """
    n = len(size)
    row = np.repeat(np.arange(n), np.diff(first))
    order = np.argsort(column, kind="stable")
    listed, at = row[order], np.searchsorted(column[order], np.arange((column.max() if len(column) else 0) + 2))
    found = []

    def count(columns: np.ndarray) -> np.ndarray:
        length = at[columns + 1] - at[columns]
        before = np.cumsum(length) - length
        return np.bincount(listed[np.repeat(at[columns] - before, length) + np.arange(length.sum())], minlength=n)

    inter, last = np.zeros(n, np.int64), np.zeros(0, column.dtype)
    for s in range(n):
        mine = column[first[s] : first[s + 1]]
        more, less = np.setdiff1d(mine, last, True), np.setdiff1d(last, mine, True)
        inter = inter + count(more) - count(less) if len(more) + len(less) < len(mine) else count(mine)
        last = mine
        later = inter[s + 1 :]
        hit = np.flatnonzero(100 * later >= percent * (size[s] + size[s + 1 :] - later)) + s + 1
        if len(hit):
            found.append((np.full(len(hit), s), hit))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def joined(text: pa.Array, label: np.ndarray, k: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of similar texts: as many pairs as join the same labels."""
    keys, owner = [], []
    for block in tb.blocks(text):
        a, b = shingle_sets(block, k)
        keys.append(a)
        owner.append(b + block.lo)
    key, row = np.concatenate(keys), np.concatenate(owner)
    size = np.bincount(row, minlength=len(label))
    _, column, times = np.unique(key, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, row = column[shared], row[shared]
    order = np.lexsort((column, row))
    column, row = column[order], row[order]
    a, b = answers(column, np.searchsorted(row, np.arange(len(label) + 1)), size, percent)
    apart = label[a] != label[b]
    return spanning(label, a[apart], b[apart])


def _answered(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links that join what the candidate pairs join, from full sets.

    Pairs are joined in chunks by their first class; one with many partners goes
    to several chunks.
    """
    total = pairs.count()
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("many"))
    group = F.pmod(F.xxhash64("a"), F.lit(max(1, -(-total // CHUNK)))).cast("int")
    dealt = pairs.join(many, "a").select("a", "b", group.alias("g"), F.when(F.col("many") > 1, F.col("a")).alias("own"), F.pmod(F.xxhash64(F.lit(3), "b"), F.col("many")).cast("int").alias("chunk"))
    wanted = dealt.select("g", "own", "chunk", F.explode(F.array("a", "b")).alias("cid"), "a").groupBy("g", "own", "chunk", "cid").agg(F.min("a").alias("a"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("a", "ascending"), ("cid", "ascending")])
        cid = np.asarray(table.column("cid"))
        a, b = joined(table.column("text").combine_chunks(), np.arange(len(cid)), k, percent)
        return pa.table({"a": pa.array(cid[a], pa.int64()), "b": pa.array(cid[b], pa.int64())})

    return wanted.join(texts, "cid").select("g", "own", "chunk", "cid", "a", "text").groupBy("g", "own", "chunk").applyInArrow(run, "a long, b long")


# -- lists that stay open ----------------------------------------------------


def _cells(members: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """key, cell, cid, label of lists with several labels, in cells of blocks whose sizes may match.

    Lists of equal content are taken once.  A block holds sizes of one step (1 /
    threshold), and at most about CELL classes; it meets blocks of its own step
    and of the next.
    """
    labelled = members.join(label, members["cid"] == label["node"], "left").select("key", "cid", "n", F.coalesce("label", "cid").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum(F.xxhash64("cid").cast("decimal(30,0)")).alias("content"), F.count("*").alias("size"))
    chosen = mixed.filter("lo <> hi and size > 2").groupBy("content", "size").agg(F.min("key").alias("key")).select("key")
    stepped = labelled.join(chosen, "key").withColumn("s", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int"))
    counts = stepped.groupBy("key", "s").agg(F.ceil(F.count("*") / CELL).cast("int").alias("own"))
    near = Window.partitionBy("key").orderBy("s")
    beside = lambda f, d: F.when(f("s").over(near) == F.col("s") + d, f("own").over(near)).otherwise(0)
    counts = counts.withColumn("up", beside(F.lead, 1)).withColumn("down", beside(F.lag, -1))
    placed = stepped.join(counts, ["key", "s"]).withColumn("b", F.pmod(F.xxhash64(F.lit(9), "cid"), "own").cast("int"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda s, i, t, j: F.struct(s.alias("s"), i.alias("i"), t.alias("t"), j.alias("j"))
    s, b = F.col("s"), F.col("b")
    met = F.concat(
        F.transform(upto("own"), lambda o: cell(s, F.least(b, o), s, F.greatest(b, o))),
        F.transform(upto("up"), lambda o: cell(s, b, s + 1, o)),
        F.transform(upto("down"), lambda o: cell(s - 1, o, s, b)),
    )
    return placed.select("key", "cid", "n", "label", F.explode(met).alias("cell"))


def _open_links(members: DataFrame, label: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links between classes of one list that the links found so far leave apart."""
    cells = cut(_cells(members, label, percent))

    def compare(table: pa.Table) -> pa.Table:
        cid = np.asarray(table.column("cid"))
        a, b = near_pairs(np.asarray(table.column("label")), np.asarray(table.column("n")).astype(np.int64), table.column("bits").to_pylist(), percent)
        if len(a) > FEW * len(cid):  # the cell itself stands for its pairs
            return pa.table({"key": table.column("key")[:1], "cell": table.column("cell")[:1], "a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64())})
        return pa.table({"key": pa.array(np.asarray(table.column("key"))[a], pa.int64()), "cell": table.column("cell").take(pa.array(a)), "a": pa.array(cid[a], pa.int64()), "b": pa.array(cid[b], pa.int64())})

    kind = cells.schema["cell"].dataType.simpleString()
    found = cut(cells.join(classes.select("cid", "bits"), "cid").select("key", "cell", "cid", "n", "label", "bits").groupBy("key", "cell").applyInArrow(compare, f"key long, cell {kind}, a long, b long"))
    pairs = cut(found.filter("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = _answered(pairs, texts, k, percent)
    dense = found.filter("a is null").select("key", "cell").distinct()

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("cid", "ascending")])
        cid = np.asarray(table.column("cid"))
        a, b = joined(table.column("text").combine_chunks(), np.asarray(table.column("label")), k, percent)
        return pa.table({"a": pa.array(cid[a], pa.int64()), "b": pa.array(cid[b], pa.int64())})

    full = cells.join(dense, ["key", "cell"]).join(texts, "cid").select("key", "cell", "cid", "label", "text").groupBy("key", "cell").applyInArrow(answer, "a long, b long")
    return links.unionByName(full).distinct()


# -- the operator ------------------------------------------------------------


def components_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row.

    A row's set holds the distinct k-word shingles of its lowered text; with
    fewer words, the whole sequence as one.  Rows are linked when 100 x
    intersection >= percent x union; component_id is the smallest doc_id that
    links reach.  Rows without words have an empty set and are linked with
    nothing.  Rows of a null doc_id take part but lend no id: a component of
    nothing else has a null component_id.  Repeated rows are one class.  Texts
    are taken whole, however long.  An empty table gives an empty result; other
    columns are ignored.
    """
    text = F.col(quoted(text_col)).cast("string")
    plain = df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"))
    level, parts = levels(shingle_counts(plain, "text", k))
    spark, same = df.sparkSession, ["s1", "s2", "n_shingles"]
    path = shared_folder(spark, "sets")
    sets = written(features(plain, level, k, percent), "sets", path)
    rows = written(sets.select("doc_id", *same), "rows")
    heads = sets.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("least"), F.min(F.struct("t1", "t2", "pre", "bits")).alias("head"))
    classes = written(heads.select(*same, "least", "head.*", F.monotonically_increasing_id().alias("cid")), "classes")
    removed(spark, path)

    lists = entries(classes, parts).repartition("key", "part").sortWithinPartitions("key", "part", "cid")
    members = written(with_hubs(lists, percent), "lists")
    over = members.filter("parts > 0 and hub = cid").select("key", "cid", "n").distinct()
    top = over.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("top"))
    risen = over.join(top, "key").filter("cid <> top.cid").filter(100 * F.least("n", "top.n") >= percent * F.greatest("n", "top.n")).select(F.col("top.cid").alias("a"), F.col("cid").alias("b"))
    pairs = members.filter("hub <> cid").select(F.col("hub").alias("a"), F.col("cid").alias("b")).unionByName(risen).distinct()
    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "t1", "t2")
    texts = written(plain.join(wanted, ["t1", "t2"]).select("cid", "text").groupBy("cid").agg(F.first("text").alias("text")), "texts")
    links = cut(_answered(cut(_near(pairs, classes, percent)), texts, k, percent))
    label = components(links)
    extra = cut(_open_links(members, label, classes, texts, k, percent))
    if not extra.isEmpty():
        label = merged(label, extra)
    named = classes.select(*same, "least", "cid").join(label, F.col("cid") == label["node"], "left").withColumn("label", F.coalesce("label", "cid"))
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = named.join(lowest, "label").select(*same, "component_id")
    out = rows.select("doc_id", *same).join(by_class, same, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
u AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = w.doc_id
"""
