"""Language-model scores by a probabilistic suffix tree.

The tree predicts a document as the bytes of its lowered words, each followed by
a space, and one end mark.  Contexts are the last bytes read, up to DEPTH of
them.  A context stays if it occurs often enough in the training text, ROOT times
the square root of the text's bytes and LEAST times at least, and if its next-byte
distribution diverges from that of its own suffix by DIVERGENCE nats for each of
those occurrences, over all its own.  Both are tested on the executors, on counts of
all the training text: the tree grows with the corpus, though more slowly.  A distribution is smoothed
towards that of the longest suffix that stayed, with PULL imagined occurrences
for each byte seen after the context; the root's towards uniform.  Scoring uses
the longest suffix of what was read that stayed.

Only the contexts that stayed leave the executors.  The tree is sent out in parts
of about PART_NODES nodes: a part has all contexts that end in some pairs of
bytes, so every position of a document belongs to one part, and a document's
score is the sum over the parts.  A tree of more parts costs more passes, not
more memory.

The unigram base needs the count of every word.  Words above 1 / HEAD of all
tokens (at most HEAD of them) are looked up in a table that every worker holds;
the others are joined, so no frequent word meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.llm import textbytes as tb
from quillguard.llm.session import quoted, written

DEPTH, LEAST, ROOT, DIVERGENCE, PULL = 7, 8, 0.02, 0.3, 3.0
HEAD = 1_000_000
END = 0x0A
#: Nodes of the tree that a worker holds at a time.
PART_NODES = 2_000_000
#: Contexts that share so many of their nearest bytes are tested in one task.
NEAR = 3
#: n-grams, repeats included, that a worker gathers before it counts them and hands them on; distinct words likewise.
GATHER, GATHER_WORDS = 12_000_000, 500_000
#: Distinct n-grams are handed on in so many pieces, each with some of the buckets.
PIECES = 16


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def stream(block: tb.Block, w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all documents as the tree reads them, and where each begins (with a mark that is not predicted)."""
    size = w.end - w.start + 1
    count = np.diff(w.first)
    per = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=per[1:])
    length = per[w.first[1:]] - per[w.first[:-1]] + 2
    begin = np.zeros(block.size + 1, np.int64)
    np.cumsum(length, out=begin[1:])
    out = np.full(begin[-1], 0x20, np.uint8)
    out[begin[:-1]] = END
    out[begin[1:] - 1] = END
    owner = np.repeat(np.arange(block.size), count)
    to = begin[owner] + 1 + per[:-1] - per[w.first[owner]]
    index = np.repeat(to - w.start, size - 1) + (black := np.flatnonzero(~tb.WHITE[block.data]))
    out[index] = tb.LOWER[block.data[black]]
    return out, begin


def grams(data: np.ndarray, begin: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Every predicted byte with its context as a big-endian number: context bytes, nearest last, then the byte.

    Places before a document's mark hold zero.
    """
    if not len(data):
        return np.zeros(0, np.uint64)
    # every place reads the 8 bytes that end there; only the first places of a document see beyond its mark
    padded = np.concatenate([np.zeros(7, np.uint8), data])
    out = np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)
    if depth < 7:
        out &= np.uint64((1 << 8 * (depth + 1)) - 1)
    for k in range(1, depth):
        place = begin[:-1] + k
        out[place[place < begin[1:]]] &= np.uint64((1 << 8 * (k + 1)) - 1)
    at = np.ones(len(data), bool)
    at[begin[:-1]] = False
    return out[at]


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    times = np.concatenate([p[1] for p in parts])
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse, times).astype(np.int64)


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often they occur; sorts the keys in place."""
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first, kept = np.flatnonzero(new), keys[new]
    del new
    times = np.empty(len(kept), np.uint32)
    np.subtract(first[1:], first[:-1], out=times[:-1], casting="unsafe")
    times[-1:] = len(keys) - first[-1:]
    return kept, times


def _family(keys: np.ndarray) -> np.ndarray:
    """The nearest NEAR bytes of the keys' contexts, mixed."""
    return tb.mix((keys >> np.uint64(8)) & np.uint64((1 << 8 * NEAR) - 1))


def _planes(keys: np.ndarray) -> bytes:
    """The keys byte by byte, first all first bytes: equal bytes lie together and compress."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def counts(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind, key, n, keys, times of the training rows, which have one column text.

    kind 0: a word's hash and its count; kind 2: ends, in n; kind 1: n-grams and
    counts as bytes, many in a row, whose families share the bucket in ``key``, and
    the sum of the counts in n; one n-gram may come in several rows.
    """
    # a bucket holds what a quarter of an input partition brings, however large the table
    buckets = max(64, 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * texts.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, held, ends = [], np.zeros(0, np.uint64), 0, 0

        def rows(kind: int, keys: np.ndarray, n: np.ndarray, packed: list[tuple[bytes, bytes]] | None = None) -> pa.RecordBatch:
            packed = packed or [(None, None)] * len(keys)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n), *(pa.array([p[i] for p in packed], pa.binary()) for i in (0, 1))], names=["kind", "key", "n", "keys", "times"])

        def grams_of(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            keys, n = _tally(keys)
            bucket = np.empty(len(keys), np.uint16 if buckets < 1 << 16 else np.int64)
            for a in range(0, len(keys), tb.BLOCK):
                bucket[a : a + tb.BLOCK] = _family(keys[a : a + tb.BLOCK]) % np.uint64(buckets)
            step = -(-buckets // PIECES)
            for low in range(0, buckets, step):
                at = np.flatnonzero((bucket >= low) & (bucket < low + step))
                if not len(at):
                    continue
                at = at[np.argsort(bucket[at], kind="stable")]
                mine, some, times = bucket[at], keys[at], n[at]
                cut = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
                ends_at = np.append(cut[1:], len(some))
                yield rows(1, mine[cut].astype(np.int64), np.add.reduceat(times, cut, dtype=np.int64), [(_planes(some[a:b]), times[a:b].tobytes()) for a, b in zip(cut, ends_at)])

        for batch in batches:
            for block in tb.blocks(batch.column(0)):
                w = tb.words(block)
                ends += block.size
                words.append(np.unique(tb.span_hash(tb.prefix_hash(block.data, lower=True), w.start, w.end), return_counts=True))
                if sum(len(p[0]) for p in words) > GATHER_WORDS:
                    words[:] = [_counted(words)]
                    if len(words[0][0]) > GATHER_WORDS // 2:
                        yield rows(0, *words.pop())
                found = grams(*stream(block, w), depth)
                if held and held + len(found) > max(len(seen), GATHER):
                    yield from grams_of(seen[:held])
                    held = 0
                if held + len(found) > len(seen):  # the buffer grows up to GATHER, or to the longest text
                    seen = np.concatenate([seen[:held], np.empty(max(len(found), min(GATHER, 3 * held + len(found))), np.uint64)])
                seen[held : held + len(found)] = found
                held += len(found)
        if words:
            yield rows(0, *_counted(words))
        if held:
            yield from grams_of(seen[:held])
        if ends:
            yield rows(2, np.zeros(1, np.uint64), np.array([ends]))

    return texts.mapInArrow(run, "kind int, key long, n long, keys binary, times binary")


def _level(depth: int) -> int:
    """Bits of a key that hold a context of so many bytes and the byte after it."""
    return -1 if depth == 7 else (1 << 8 * (depth + 1)) - 1


def _near_levels(low: DataFrame, depth: int, least: float, divergence: float) -> DataFrame:
    """d, key, n, total, distinct of the contexts of up to ``depth`` bytes that stay, by joins of each level with the one below; low has key, n."""
    parent, out = None, None
    for d in range(depth + 1):
        level = low.groupBy(F.col("key").bitwiseAND(F.lit(_level(d))).alias("key")).agg(F.sum("n").alias("n"))
        if d:  # a zero byte in front marks a context that reaches over the begin of its document
            level = level.filter(F.shiftrightunsigned("key", 8 * d) != 0)
        level = level.withColumn("context", F.shiftrightunsigned("key", 8))
        sums = level.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
        level = kept = level.join(sums.filter(F.col("total") >= least) if d else sums, "context")
        if d:
            up = parent.select(F.col("key").alias("up"), F.col("n").alias("n_up"), F.col("total").alias("total_up"))
            both = level.withColumn("up", F.col("key").bitwiseAND(F.lit(_level(d - 1)))).join(up, "up")
            gain = F.sum(F.col("n") * F.ln((F.col("n") / F.col("total")) / (F.col("n_up") / F.col("total_up"))))
            kept = level.join(both.groupBy("context").agg(gain.alias("gain")).filter(F.col("gain") >= divergence).select("context"), "context", "left_semi")
        kept = kept.select(F.lit(d).cast("tinyint").alias("d"), "key", F.col("n").cast("float").alias("n"), F.col("total").cast("float").alias("total"), F.col("distinct").cast("smallint").alias("distinct"))
        out = kept if out is None else out.unionByName(kept)
        parent = level
    return out


def kept_contexts(table: DataFrame, depth: int = DEPTH, least: float | None = None, divergence: float | None = None) -> DataFrame:
    """d, key, n, total, distinct: a row for every (context, next byte) of the contexts that stay; table: ``counts``.

    Contexts are dealt out by their nearest NEAR bytes, so a context and the suffix
    that it is tested against meet in one task, which adds up the counts of all
    levels by itself.  Counts of NEAR bytes and the byte after them come out as
    level -1, and the shorter contexts are tested by joins.  Unless given, least and
    divergence follow from the size of the training text.
    """
    near = min(depth, NEAR)
    if least is None:
        least = max(LEAST, ROOT * (table.filter("kind = 1").agg(F.sum("n")).first()[0] or 0) ** 0.5)
    divergence = DIVERGENCE * least if divergence is None else divergence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for b in batches:
            for bucket, k, t in zip(*(b.column(x).to_pylist() for x in ("key", "keys", "times"))):
                held.setdefault(bucket, []).append((k, t))
        for bucket in list(held):  # a task may have several, and unpacks one at a time
            yield from tested(*_counted([(_from_planes(k), np.frombuffer(t, np.uint32)) for k, t in held.pop(bucket)]))

    def rows(d: int, keys: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        n, total, distinct = columns or (np.zeros(0), np.zeros(0), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), d, np.int8)), pa.array(keys.view(np.int64)), pa.array(n, pa.float64()), pa.array(total, pa.float64()), pa.array(distinct.astype(np.int16))], names=["d", "key", "n", "total", "distinct"])

    def tested(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        nodes = []
        for d in range(depth, near - 1, -1):
            if d < depth:
                keys, inverse = np.unique(keys & np.uint64(_level(d)), return_inverse=True)
                n = np.bincount(inverse, n)
            # a zero byte in front marks a context that reaches over the begin of its document
            whole = keys >> np.uint64(8 * d) != 0
            _, of = np.unique(keys[whole] >> np.uint64(8), return_inverse=True)
            nodes.append((d, keys[whole], n[whole].astype(np.float64), np.bincount(of, n[whole]), np.bincount(of), of))
        yield rows(-1, keys, n.astype(np.float64), np.zeros(len(keys)), np.zeros(len(keys)))
        for (d, keys, n, total, distinct, of), (_, up, n_up, total_up, _, of_up) in zip(nodes, nodes[1:]):
            if len(keys):
                _, at = _find(up, keys & np.uint64(_level(d - 1)))
                gain = np.bincount(of, n * np.log((n / total[of]) / (n_up[at] / total_up[of_up[at]])))
                stay = ((total >= least) & (gain >= divergence))[of]
                yield rows(d, keys[stay], n[stay], total[of][stay], distinct[of][stay])

    dealt = table.filter("kind = 1").select("key", "keys", "times").repartition("key")
    far = written(dealt.mapInArrow(run, "d tinyint, key long, n double, total double, distinct smallint"), "levels")
    low = far.filter("d = -1").select("key", F.col("n").cast("long").alias("n"))
    return written(_near_levels(low, near, least, divergence).unionByName(far.filter("d >= 0").select("d", "key", F.col("n").cast("float").alias("n"), F.col("total").cast("float").alias("total"), "distinct")), "tree")


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


class Tree:
    """Nodes of the frozen tree, sorted by level: what a byte costs after its context, and what it costs to fall back."""

    def __init__(self, d: np.ndarray, key: np.ndarray, n: np.ndarray, total: np.ndarray, distinct: np.ndarray, depth: int = DEPTH):
        self.levels: list[tuple[np.ndarray, ...]] = []
        for level in range(depth + 1):
            mine = np.flatnonzero(d == level)
            mine = mine[np.argsort(key[mine])]
            keys, pull = key[mine], PULL * distinct[mine].astype(np.float64)
            up = 10.0 ** self.logs(keys)
            logs = np.log10((n[mine] + pull * up) / (total[mine] + pull))
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            back = np.log10(pull[first] / (total[mine][first] + pull[first]))
            self.levels.append((keys, logs.astype(np.float32), contexts, back.astype(np.float32)))

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each n-gram after the bytes before it."""
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        for d in range(len(self.levels) - 1, -1, -1):
            nodes, logs, contexts, back = self.levels[d]
            key = keys[left] if d == 7 else keys[left] & np.uint64(_level(d))
            held, at = _find(contexts, key >> np.uint64(8))
            held = np.flatnonzero(held)  # only these can have the node
            hit, node = _find(nodes, key[held])
            out[left[held[hit]]] += logs[node[hit]]
            out[left[held[~hit]]] += back[at[held[~hit]]]
            rest = np.ones(len(left), bool)
            rest[held[hit]] = False
            left = left[rest]
        out[left] += np.log10(1 / 256)
        return out

    def score(self, data: np.ndarray, begin: np.ndarray, mine: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each document of a stream; with ``mine``, of the positions after its pairs of bytes."""
        if len(begin) < 2:
            return np.zeros(0)
        keys, inverse = np.unique(grams(data, begin, len(self.levels) - 1), return_inverse=True)
        logs = self.logs(keys)
        if mine is not None:
            logs[~mine[(keys >> np.uint64(8)).astype(np.int64) & 0xFFFF]] = 0.0
        return np.add.reduceat(logs[inverse], begin[:-1] - np.arange(len(begin) - 1))


def grow(table: DataFrame, depth: int = DEPTH) -> Iterator[tuple[Tree, np.ndarray | None]]:
    """The tree's parts, one after the other, each with the pairs of bytes whose positions it scores (none: all)."""
    nodes = kept_contexts(table, depth)
    pair = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFF))
    sizes = {r["pair"]: r["n"] for r in nodes.filter("d > 1").groupBy(pair.alias("pair")).agg(F.count("*").alias("n")).collect()}  # 65,536 at most
    part_of, part, held = np.zeros(1 << 16, np.int64), 0, 0
    for k in sorted(sizes):
        if held and held + sizes[k] > PART_NODES:
            part, held = part + 1, 0
        part_of[k] = part
        held += sizes[k]
    spark = table.sparkSession
    if part:
        dealt = spark.createDataFrame([(int(k), int(part_of[k])) for k in sizes], "pair int, part int")
        nodes = nodes.withColumn("pair", pair).join(F.broadcast(dealt), "pair", "left")
    for p in range(part + 1):
        mine = (nodes.filter((F.col("d") < 2) | (F.col("part") == p)) if part else nodes).select("d", "key", "n", "total", "distinct").toArrow()
        d, key, n, total, distinct = (mine.column(x).to_numpy() for x in mine.column_names)
        del mine
        yield Tree(d, key.view(np.uint64), n, total, distinct, depth), (part_of == p) if part else None


def _part_score(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("rk").slice(block.lo, block.size), pa.array(tree.value[0].score(*stream(block, tb.words(block)), tree.value[1]))], names=["rk", "more"])

    return run


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty: one token, the end.  Null ids count as empty text in the
    fold.  Repeated rows score alike.  With no training rows every count is 0 and
    the tree is uniform.  Very long texts are read whole.  An empty table gives an
    empty result.  Other columns of the input are ignored, whatever their names.
    """
    spark = df.sparkSession
    named = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    rows = named.select(F.col("id").cast("long").alias("doc_id"), "text", (fold("id", parts) == held).alias("held_out"), F.xxhash64(F.lit(5), "id", "text").alias("rk"))
    table = written(counts(rows.filter("not held_out").select("text")), "counts")
    words = written(table.filter("kind = 0").groupBy("key").agg(F.sum("n").alias("n")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = table.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = total + ends, distinct + (ends > 0)
    scale = float(np.log10(total + distinct + 1))
    head = words.filter(F.col("n") >= max(1.0, total / HEAD)).select("key", "n").toArrow().sort_by("key")
    known = spark.sparkContext.broadcast((head.column("key").to_numpy(), head.column("n").to_numpy()))
    trees = [spark.sparkContext.broadcast(x) for x in grow(table)]
    tree = trees[0]

    def lookup(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, n = known.value
        signed = hashes.view(np.int64)
        if not len(keys):
            return np.zeros(len(signed), bool), np.zeros(len(signed), np.int64)
        at = np.minimum(np.searchsorted(keys, signed), len(keys) - 1)
        hit = keys[at] == signed
        return hit, np.where(hit, n[at], 0)

    def head_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column("text")):
                w = tb.words(block)
                hashes = tb.span_hash(tb.prefix_hash(block.data, lower=True), w.start, w.end)
                unique, inverse = np.unique(hashes, return_inverse=True)
                hit, n = lookup(unique)
                sums = np.zeros(len(hashes) + 1)
                np.cumsum(np.log10(n + 1.0)[inverse], out=sums[1:])
                hits = np.zeros(len(hashes) + 1, np.int64)
                np.cumsum(hit[inverse], out=hits[1:])
                first = w.first
                value = np.array([sums[b] - sums[a] for a, b in zip(first[:-1], first[1:])]) if block.size else sums[:0]
                part = batch.slice(block.lo, block.size)
                count = np.diff(first) + 1
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), part.column("rk"), pa.array(count), pa.array(hits[first[1:]] - hits[first[:-1]] + int(ends > 0)), pa.array(value + np.log10(ends + 1.0)), pa.array(tree.value[0].score(*stream(block, w), tree.value[1]))], names=["doc_id", "held_out", "rk", "n_tokens", "head_known", "head_sum", "score"])

    def tail_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rk = np.asarray(batch.column("rk"))
            for block in tb.blocks(batch.column("text")):
                w = tb.words(block)
                hashes = tb.span_hash(tb.prefix_hash(block.data, lower=True), w.start, w.end)
                unique, inverse = np.unique(hashes, return_inverse=True)
                rare = ~lookup(unique)[0][inverse]
                document, key = w.document[rare], hashes[rare]
                order = np.lexsort((key, document))
                document, key = document[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (document[1:] != document[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(rk[block.lo : block.hi][document[at]]), pa.array(key[at].view(np.int64)), pa.array(times.astype(np.int32))], names=["rk", "key", "times"])

    whole = rows.mapInArrow(head_part, "doc_id long, held_out boolean, rk long, n_tokens long, head_known long, head_sum double, score double")
    rare = rows.select("rk", "text").mapInArrow(tail_part, "rk long, key long, times int")
    tail = rare.join(words.select("key", "n"), "key").groupBy("rk").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("tail_sum"))
    same = rows.groupBy("rk").agg(F.count("*").alias("copies"))
    per_row = tail.join(same, "rk").select("rk", F.expr("tail_known div copies").alias("tail_known"), (F.col("tail_sum") / F.col("copies")).alias("tail_sum"))
    joined = whole.join(per_row, "rk", "left")
    if len(trees) > 1:  # repeated rows have one sum in each part
        others = None
        for k, t in enumerate(trees[1:]):
            one = rows.select("rk", "text").mapInArrow(_part_score(t), "rk long, more double").withColumn("part", F.lit(k))
            others = one if others is None else others.unionByName(one)
        sums = others.groupBy("rk", "part").agg(F.first("more").alias("more")).groupBy("rk").agg(F.sum("more").alias("more"))
        joined = joined.join(sums, "rk").withColumn("score", F.col("score") + F.col("more"))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"), "score",
    )
