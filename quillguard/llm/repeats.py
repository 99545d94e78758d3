"""Exact removal of repeated byte strings by a range-partitioned sparse suffix array.

Sorting every suffix of 100 TB is neither possible nor needed: a string of
LENGTH bytes that occurs twice has the same minimiser (the least hash of its
GRAM-byte grams) at the same offset in both places.  So only suffixes that
start at minimisers enter the array, and of these only those whose gram occurs
again.  A suffix's *context* is the span of all strings it is the minimiser of.

1. Minimisers of every document; their grams are counted over all documents, and
   those that occur once are out.
2. Equal contexts become one entry with a multiplicity.  They are told by 128
   bits: the hash of the gram and one of all their bytes, over different units.
3. Entries whose gram has other contexts too are sorted: sampled splitters
   range-partition them by the leading bytes of their suffix, buckets sort
   locally by multikey quicksort on 8-byte words, once the suffixes and once the
   bytes before them, read backwards.  A string with o bytes before its minimiser
   occurs again if another entry shares LENGTH - o bytes with its suffix and o
   bytes before it; the bytes that neighbours in the two orders share decide that.
   Equal suffixes may fall into several buckets, so a bucket's size is bounded
   even if one passage follows on very many texts.  Strings that a bucket shares
   with its first or last suffix are compared across its boundary: first what all
   strings of BLOCK neighbouring offsets have in common, and where another bucket
   has that too, the strings themselves.
4. Repeated strings are joined into spans per row and cut out.

Rows are known by their id and text, so copies of a text never meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.llm import textbytes as tb
from quillguard.llm.session import quoted, written

LENGTH, GRAM = 200, 40
SPAN = LENGTH - GRAM + 1
#: Contexts that a bucket should hold, and neighbouring offsets that are compared across buckets at once.
BUCKET_CONTEXTS, BLOCK = 20_000, 16


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of values[i:i + width] for every i, by prefix and suffix minima of blocks."""
    n = len(values)
    if n < width:
        return np.zeros(0, values.dtype)
    pad = -n % width
    full = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    prefix = np.minimum.accumulate(full, 1).reshape(-1)
    suffix = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


def minimisers(block: tb.Block, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """document, position, first and last string start, gram hash, context hash of every minimiser of a block."""
    span = length - gram + 1
    data, offsets = block.data, block.offsets
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    prefix = tb.prefix_hash(data)
    starts = np.arange(n - gram + 1)
    grams = tb.span_hash(prefix, starts, starts + gram)
    least = sliding_least(grams, span)
    # only strings inside one document
    valid = np.zeros(len(least) + 1, np.int8)
    size = np.diff(offsets)
    fits = np.flatnonzero(size >= length)
    np.add.at(valid, offsets[fits], 1)
    np.add.at(valid, offsets[fits + 1] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    # a run of strings with one least value and the same leftmost place of it is one minimiser
    value = least[at]
    place = _leftmost(grams, value, at, span)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    first, last, position = at[head], at[tail], place[head]
    document = np.searchsorted(offsets, position, "right") - 1
    context = tb.mix(tb.span_hash(tb.prefix_hash_8(data), first, last + length - 7) * np.uint64(31) + (position - first).astype(np.uint64))
    base = offsets[document]
    return document, position - base, first - base, last - base, grams[position], context


def _leftmost(grams: np.ndarray, value: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Leftmost place in grams[at:at + span] of its least value, for rising ``at``."""
    place = np.full(len(at), -1, np.int64)
    if not len(at):
        return place
    # positions that are the least of a string that starts or ends there are the only candidates
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    run = np.ones(len(at), bool)
    run[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(run)
    ends = np.append(heads[1:], len(at))
    lo = np.searchsorted(ranked, value[heads], "left")
    hi = np.searchsorted(ranked, value[heads], "right")
    single = hi - lo == 1
    length = ends - heads
    place = np.repeat(np.where(single, order[np.minimum(lo, len(order) - 1)], -1), length)
    for h in np.flatnonzero(~single):
        spots = order[lo[h] : hi[h]]  # rising, as the sort is stable
        rows = np.arange(heads[h], ends[h])
        place[rows] = spots[np.searchsorted(spots, at[rows], "left")]
    return place


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of big-endian words: multikey quicksort, one level for all open parts at a time.

    At each depth only rows that still tie with a neighbour are split by their next word.
    """
    n, depth = words.shape
    order = np.arange(n)
    part = np.zeros(n, np.int64)  # first place of the part that a place belongs to
    for d in range(depth):
        size = np.bincount(part, minlength=n)
        open_ = np.flatnonzero(size[part] > 1)
        if not len(open_):
            break
        token = words[order[open_], d]
        sub = np.lexsort((token, part[open_]))
        order[open_] = order[open_][sub]
        token, parts = token[sub], part[open_]
        new = np.ones(len(open_), bool)
        new[1:] = (token[1:] != token[:-1]) | (parts[1:] != parts[:-1])
        part[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
    return order


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that rows of words share from the start."""
    differs = a != b
    word = np.where(differs.any(1), differs.argmax(1), a.shape[1])
    clipped = np.minimum(word, a.shape[1] - 1)
    rows = np.arange(len(a))
    x = (a[rows, clipped] ^ b[rows, clipped]).astype(np.uint64)
    zero = np.zeros(len(a), np.int64)
    for shift in (56, 48, 40, 32, 24, 16, 8):
        zero += ((x >> np.uint64(shift)) == 0).astype(np.int64)
    return np.where(word == a.shape[1], a.shape[1] * 8, word * 8 + zero)


def _words(pieces: list[bytes], length: int) -> np.ndarray:
    raw = b"".join(x[:length].ljust(length, b"\0") for x in pieces)
    return np.frombuffer(raw, ">u8").reshape(len(pieces), length // 8).astype(np.uint64)


def compare_bucket(times: np.ndarray, data: list[bytes], place: np.ndarray, edges: bool = True, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, int, list[int], list[int]]]]:
    """Rows and offsets of the repeated strings of a bucket, and what other buckets may hold too.

    Row k is a context: its bytes, where its minimiser is, and how often it
    occurs.  The third result has, for one row and BLOCK neighbouring numbers of
    bytes before the minimiser, a digest of the bytes that all their strings
    share, the row, the offsets of strings to be compared, and how often the bucket
    holds each; a string that it holds twice is compared once.
    """
    n = len(data)
    order = multikey_sort(_words([d[p:] for d, p in zip(data, place.tolist())], length))
    words = _words([data[k][place[k] :] for k in order.tolist()], length)
    shared = common_prefix(words[1:], words[:-1])
    reach = np.maximum(common_prefix(words, np.broadcast_to(words[:1], words.shape)), common_prefix(words, np.broadcast_to(words[-1:], words.shape))) if edges else np.zeros(n, np.int64)
    before = _words([data[k][: place[k]][::-1] for k in order.tolist()], -(-(length - gram) // 8) * 8)
    backwards = multikey_sort(before)
    before = before[backwards]
    shared_before = common_prefix(before[1:], before[:-1])
    at, weight = place[order], times[order]
    lowest = at - (np.array([len(data[k]) for k in order.tolist()]) - length)  # the fewest bytes that its strings have before it
    alone = np.ones(n, bool)
    alone[1:] &= shared < gram
    alone[:-1] &= shared < gram
    taking_part = ~alone | (reach >= gram)
    rows, offsets, beyond = [], [], {}
    after_id, before_id = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(length - gram + 1):
        mine = np.flatnonzero(taking_part & (lowest <= o) & (o <= at))
        if not len(mine):
            continue
        np.cumsum(shared < length - o, out=after_id[1:])
        before_id[backwards[1:]] = np.cumsum(shared_before < o)
        before_id[backwards[0]] = 0
        _, first, group = np.unique(after_id[mine] * n + before_id[mine], return_index=True, return_inverse=True)
        total = np.bincount(group, weight[mine])
        again = total[group] > 1
        rows.append(order[mine[again]])
        offsets.append(at[mine[again]] - o)
        for g in np.flatnonzero(reach[mine[first]] >= length - o).tolist():
            beyond.setdefault((int(order[mine[first[g]]]), o // BLOCK), []).append((o, int(total[g])))
    out = []
    for (k, b), found in beyond.items():
        p = int(place[k])
        core = data[k][p - b * BLOCK : p + length - b * BLOCK - BLOCK + 1]
        out.append((_digest(core + b"%d" % b), k, [p - o for o, _ in found], [n for _, n in found]))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *rows]), np.concatenate([empty, *offsets]), out


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _runs(row: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last offset of runs of offsets."""
    order = np.lexsort((offset, row))
    row, offset = row[order], offset[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
    head = np.flatnonzero(new)
    return row[head], offset[head], offset[np.append(head[1:], len(row)) - 1] if len(head) else offset


def _anchor_table(rows: DataFrame) -> DataFrame:
    """rk1, rk2, position, first, last, gram, context of every minimiser; rows has rk1, rk2, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.asarray(batch.column(x)) for x in ("rk1", "rk2")]
            for block in tb.blocks(batch.column("text")):
                document, position, first, last, gram, context = minimisers(block)
                yield pa.RecordBatch.from_arrays([*(pa.array(k[block.lo : block.hi][document]) for k in keys), *(pa.array(x.astype(np.int32)) for x in (position, first, last)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], names=["rk1", "rk2", "position", "first", "last", "gram", "context"])

    return rows.select("rk1", "rk2", "text").mapInArrow(run, "rk1 long, rk2 int, position int, first int, last int, gram long, context long")


def _context_bytes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, context, times, place, data, head (the suffix) of the wanted contexts."""
    lists = wanted.groupBy("rk1", "rk2").agg(F.collect_list(F.struct("gram", "context", "times", "position", "first", "last")).alias("all"))
    held = rows.select("rk1", "rk2", "text").join(lists, ["rk1", "rk2"]).withColumn("b", F.col("text").cast("binary")).select(F.explode("all").alias("c"), "b")
    out = held.select("c.gram", "c.context", "c.times", (F.col("c.position") - F.col("c.first")).alias("place"), F.expr(f"substring(b, c.first + 1, c.last - c.first + {LENGTH})").alias("data"))
    # rows that repeat with id and text bring the same bytes
    return out.withColumn("head", F.expr(f"substring(data, place + 1, {LENGTH})"))


def _sorted_repeats(contexts: DataFrame) -> DataFrame:
    """gram, context, lo, hi: runs of offsets of strings that occur again, by sorting the contexts in buckets."""
    contexts = written(contexts, "contexts")
    buckets = max(1, -(-contexts.count() // BUCKET_CONTEXTS))
    edges = buckets > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        ids = {}  # rows that repeat bring a context twice
        for k, x in enumerate(zip(table.column("gram").to_pylist(), table.column("context").to_pylist())):
            ids.setdefault(x, k)
        table = table.take(pa.array(list(ids.values())))
        gram, context = table.column("gram").to_numpy(), table.column("context").to_numpy()
        data = table.column("data").to_pylist()
        row, offset, beyond = compare_bucket(table.column("times").to_numpy(), data, table.column("place").to_numpy().astype(np.int64), edges)
        row, lo, hi = _runs(row, offset)
        out, none = np.array([x[1] for x in beyond], np.int64), [None] * len(row)
        bases = [min(x[2]) for x in beyond]
        columns = [
            pa.array(np.concatenate([gram[row], gram[out]])), pa.array(np.concatenate([context[row], context[out]])), pa.array([*lo.tolist(), *bases], pa.int32()), pa.array([*hi.tolist(), *bases], pa.int32()),
            pa.array([*none, *(x[0] for x in beyond)], pa.binary()), pa.array(np.full(len(row) + len(out), gram[0] ^ context[0])), pa.array([*none, *(x[2] for x in beyond)], pa.list_(pa.int32())), pa.array([*none, *(x[3] for x in beyond)], pa.list_(pa.int64())),
            pa.array([*none, *(data[x[1]][base : max(x[2]) + LENGTH] for x, base in zip(beyond, bases))], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["gram", "context", "lo", "hi", "core", "bucket", "offsets", "times", "piece"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(g, c, o, n, _digest(piece[o - base : o - base + LENGTH])) for g, c, base, offsets, times, piece in zip(*(batch.column(x).to_pylist() for x in ("gram", "context", "lo", "offsets", "times", "piece"))) for o, n in zip(offsets, times)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["gram", "context", "lo", "times", "digest"])

    dealt = contexts.repartitionByRange(buckets, "head", "gram", "context").select("gram", "context", "times", "place", "data")
    found = written(dealt.mapInArrow(run, "gram long, context long, lo int, hi int, core binary, bucket long, offsets array<int>, times array<long>, piece binary"), "found")
    inside = found.filter("core is null").select("gram", "context", "lo", "hi")
    if not edges:
        return inside
    across = found.filter("core is not null")
    shared = written(across.groupBy("core").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).filter("a <> b").select("core"), "cores")
    late = written(across.join(shared, "core", "left_semi").select("gram", "context", "lo", "offsets", "times", "piece").mapInArrow(strings, "gram long, context long, lo int, times long, digest binary"), "across")
    again = written(late.groupBy("digest").agg(F.sum("times").alias("n")).filter("n > 1").select("digest"), "again")
    return inside.unionByName(late.filter("times = 1").join(again, "digest", "left_semi").select("gram", "context", "lo", F.col("lo").alias("hi")))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Null counts as empty; texts under LENGTH bytes lose nothing; repeated rows are
    repeats of each other; strings are judged on the input, overlaps count.  Very
    long texts are read whole.  An empty table gives an empty result.  Other
    columns of the input are ignored, whatever their names.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("rk1", F.xxhash64(F.lit(3), "doc_id", "text")).withColumn("rk2", F.hash(F.lit(4), "text", "doc_id"))
    anchors = written(_anchor_table(rows.filter(F.octet_length("text") >= LENGTH)), "anchors")
    # each filter is a table of its own, so that Spark can split the join of a gram that very many rows hold
    again = written(anchors.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "again")
    live = written(anchors.join(again, "gram", "left_semi"), "live")
    one = [F.first(x).alias(x) for x in ("rk1", "rk2", "position", "first", "last")]
    contexts = written(live.groupBy("gram", "context").agg(F.count("*").alias("times"), *one), "entries")
    several = written(contexts.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "several")
    part = _sorted_repeats(_context_bytes(rows, contexts.join(several, "gram", "left_semi")))
    whole = contexts.filter("times > 1").select("gram", "context", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    known = written(part.unionByName(whole), "known")
    runs = live.join(known, ["gram", "context"]).select("rk1", "rk2", (F.col("first") + F.coalesce("lo", F.lit(0))).alias("start"), (F.coalesce(F.col("first") + F.col("hi"), F.col("last")) + LENGTH).alias("end"))
    hits = runs.groupBy("rk1", "rk2").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    joined = rows.join(hits, ["rk1", "rk2"], "left").select("doc_id", "text", "starts", "ends")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = tb.column_bytes(batch.column("text"))
            starts, ends = batch.column("starts"), batch.column("ends")
            out = []
            for i in range(batch.num_rows):
                data = raw[at[i] : at[i + 1]]
                if not starts[i].is_valid:
                    kept = data.tobytes()
                    out.append((len(data), 0, 0, hashlib.sha256(kept).hexdigest(), kept))
                    continue
                # runs' starts and ends are counted apart, so their order in the two lists does not matter
                edge = np.bincount(np.asarray(starts[i].values), minlength=len(data) + 1) - np.bincount(np.asarray(ends[i].values), minlength=len(data) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                kept = data[~gone].tobytes()
                out.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(clean, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
