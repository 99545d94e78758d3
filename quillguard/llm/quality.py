"""Quality rules by cross-document line frequency.

Every line is normalised (A-Z lowered, white space between words ignored),
hashed and counted: in how many documents of a host does it occur.  Documents
with equal text count once, so copies of one page do not make its own lines
common.  Lines above the limit are boilerplate, in a host of any size; a document
that loses too large a share of its words with them is depleted and rejected,
the others lose the lines.

The documents are read once; what later steps need of them (counts and line
hashes, a few bytes a line) is written to the shared folder.  Lines and verdicts
meet by (host, line) and by (host, text), never by host alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.llm import textbytes as tb
from quillguard.llm.session import fresh, quoted, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is common above this many documents of its host.
LINE_MAX_DOCUMENTS = 10
#: A document is depleted below this share of its words.
LEAST_LEFT_PERCENT = 25

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_key long, lines array<long>, line_words array<int>"


def _ragged(values: np.ndarray, document: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    at = np.searchsorted(document, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _line_spans(block: tb.Block, w: tb.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end (its line feed not included), document, first word and end of words of every line that holds a word."""
    data, n = block.data, block.size
    feed = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([block.offsets[:-1], feed + 1]))
    owner = np.searchsorted(block.offsets, begin, "right") - 1
    begin, owner = begin[owner < n], owner[owner < n]
    stop = np.minimum(np.append(feed, len(data))[np.searchsorted(feed, begin)], block.offsets[owner + 1])
    from_word, to_word = np.searchsorted(w.start, begin), np.searchsorted(w.start, stop)
    held = (to_word > from_word) & (stop > begin)
    return begin[held], stop[held], owner[held], from_word[held], to_word[held]


def _normal(block: tb.Block, w: tb.Words, from_word: np.ndarray, to_word: np.ndarray) -> np.ndarray:
    """Hashes of the lines' lowered words."""
    low = tb.span_hash(tb.prefix_hash(block.data, lower=True), w.start, w.end)
    sequence = np.zeros(len(low) + 1, np.uint64)
    up, down = tb.powers(len(low) + 1)
    np.cumsum(low * up[: len(low)], out=sequence[1:])
    return tb.mix((sequence[to_word] - sequence[from_word]) * down[from_word])


def block_features(block: tb.Block) -> list[pa.Array]:
    """The columns of FEATURES for the documents of a block."""
    data, n = block.data, block.size
    w = tb.words(block)
    document = w.document
    count = np.diff(w.first)
    letters = tb.per_document(block, ~tb.WHITE[data] & tb.LEAD[data])
    symbols = tb.per_document(block, _SYMBOL[data])
    raw = tb.prefix_hash(data)

    # Words in 3-word windows that are found twice or more in their document.
    hashes = tb.span_hash(raw, w.start, w.end)
    covered = np.zeros(len(hashes) + 2, bool)
    if len(hashes) > 2:
        window = tb.mix(tb.mix(tb.mix(hashes[:-2]) + hashes[1:-1]) + hashes[2:])
        same = document[:-2] == document[2:]
        place = np.flatnonzero(same)
        key = tb.mix(window[place] + document[place].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        order = np.argsort(key, kind="stable")
        key = key[order]
        twice = np.zeros(len(key), bool)
        if len(key) > 1:
            equal = key[1:] == key[:-1]
            twice[1:] |= equal
            twice[:-1] |= equal
        at = place[order[twice]]
        for j in range(3):
            covered[at + j] = True
    repeats = np.bincount(document[covered[: len(hashes)]], minlength=n)

    # Lines that hold a word: raw bytes for repeats within the document, words for the normalised form.
    begin, stop, owner, from_word, to_word = _line_spans(block, w)
    line_raw = tb.span_hash(raw, begin, stop)
    keys, owners = tb.distinct(line_raw, owner)
    lines_all = np.bincount(owner, minlength=n)
    duplicates = lines_all - np.bincount(owners, minlength=n)

    normal = _normal(block, w, from_word, to_word)
    weight = (to_word - from_word).astype(np.int64)
    order = np.lexsort((normal, owner))
    normal, own, weight = normal[order], owner[order], weight[order]
    if len(normal):
        new = np.ones(len(normal), bool)
        new[1:] = (normal[1:] != normal[:-1]) | (own[1:] != own[:-1])
        group = np.cumsum(new) - 1
        weight = np.bincount(group, weight).astype(np.int64)
        normal, own = normal[new], own[new]
    key = tb.span_hash(raw, block.offsets[:-1], block.offsets[1:])
    return [
        pa.array(count, pa.int64()), pa.array(letters, pa.int64()), pa.array(symbols, pa.int64()), pa.array(duplicates, pa.int64()), pa.array(repeats, pa.int64()), pa.array(key.view(np.int64)),
        _ragged(normal.view(np.int64), own, n, pa.int64()), _ragged(weight, own, n, pa.int32()),
    ]


def features(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and FEATURES of every row."""
    source = df.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text_col)).alias("__text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            for block in tb.blocks(batch.column(n), tb.SMALL_BLOCK):
                part = batch.slice(block.lo, block.size)
                names = [*batch.schema.names[:n], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_key", "lines", "line_words"]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *block_features(block)], names=names)

    return source.mapInArrow(run, ", ".join([*kept, FEATURES]))


def _host(col: str) -> F.Column:
    """The host as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(quoted(col)).cast("string")), F.lit(""))


def common_lines(seen: DataFrame, max_documents: int = LINE_MAX_DOCUMENTS) -> DataFrame:
    """host, line above the limit; seen has host and line once for every different text."""
    return seen.groupBy("host", "line").agg(F.count("*").alias("documents")).filter(F.col("documents") > max_documents).select("host", "line")


def _judged(df: DataFrame, text_col: str, host_col: str, keep: tuple[str, ...], max_documents: int, least_left_percent: int) -> DataFrame:
    """The columns of ``judge``, and ``hit``: the common lines of the row, or null; keep must not hold the names used here."""
    plain = df.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text_col)).alias("__t"), _host(host_col).alias("host"))
    rows = written(features(plain, "__t", (*keep, "host")), "lines")
    text = ["host", "text_key", "n_words", "word_chars"]
    # a line counts once for each different text of a host
    seen = rows.select(*text, F.explode(F.arrays_zip(F.col("lines").alias("line"), F.col("line_words").alias("words"))).alias("l")).select(*text, "l.line", "l.words").groupBy(*text, "line").agg(F.first("words").alias("words"))
    hits = seen.join(common_lines(seen, max_documents), ["host", "line"]).groupBy(*text).agg(F.sum("words").alias("lost"), F.collect_list("line").alias("hit"))
    joined = rows.drop("lines", "line_words").join(hits, text, "left")
    out = joined.withColumn("n_common_lines", F.when(F.col("hit").isNull(), F.lit(0)).otherwise(F.size("hit")).cast("long")).withColumn("n_common_words", F.coalesce("lost", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_common_words")
    return out.withColumn("base_failed", failed).select(*[F.col(quoted(c)) for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (100 * left >= least_left_percent * F.col("n_words"))).alias("kept"), "n_common_lines", "n_common_words", "hit")


def judge(df: DataFrame, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id", max_documents: int = LINE_MAX_DOCUMENTS, least_left_percent: int = LEAST_LEFT_PERCENT) -> DataFrame:
    """One row per input row: doc_id, the counts, lines and words lost to common lines, base_failed, kept.

    Null or empty text has no words, fails the base rule and is not kept.  A null
    host is a host of its own.  Repeated rows are judged alike.  Very long texts
    are read whole.  An empty table gives an empty result.  Other columns of the
    input are ignored, whatever their names.
    """
    rows = df.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(host_col)).alias("source"))
    return _judged(rows, "text", "source", ("doc_id",), max_documents, least_left_percent).drop("hit")


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text's other lines, joined by line feeds."""
    pieces, at = [], 0
    for begin, stop in spans:
        pieces.append(text[at:begin])
        at = min(stop + 1, len(text))
    out = b"".join(pieces) + text[at:]
    return out[:-1] if spans and spans[-1][1] == len(text) and out.endswith(b"\n") else out


def cut_lines(df: DataFrame, text_col: str, lines_col: str) -> DataFrame:
    """The rows without the lines whose hashes ``lines_col`` holds, and without that column; no text is null."""
    names = df.columns
    at_text, at_lines = names.index(text_col), names.index(lines_col)
    kept = [c for c in names if c != lines_col]
    source = df.toDF(*[f"c{k}" for k in range(len(names))])
    schema = source.drop(f"c{at_lines}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column(at_text), tb.SMALL_BLOCK):
                part = batch.slice(block.lo, block.size)
                wanted = part.column(at_lines)
                w = tb.words(block)
                begin, stop, owner, from_word, to_word = _line_spans(block, w)
                normal = _normal(block, w, from_word, to_word).view(np.int64)
                first = np.searchsorted(owner, np.arange(block.size + 1))
                texts = [block.text(k) for k in range(block.size)]
                for k in np.flatnonzero(np.asarray(wanted.value_lengths())):
                    at = slice(first[k], first[k + 1])
                    gone = np.isin(normal[at], np.asarray(wanted[int(k)].values))
                    base = block.offsets[k]
                    texts[k] = _without(texts[k], list(zip((begin[at][gone] - base).tolist(), (stop[at][gone] - base).tolist())))
                clean = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([clean if k == at_text else c for k, c in enumerate(part.columns) if k != at_lines], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*kept)


def keep_good(df: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows that the rules keep, their texts without common lines, other columns as they were.

    Rows are matched to their verdict by text and host, so null or repeated ids
    do no harm; columns may have any names.  An empty table gives an empty result.
    """
    key, host, hit = fresh(df, "k", "h", "hit")
    text = F.col(quoted(text_col))
    keyed = df.withColumn(key, F.struct(F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)).cast("string")).withColumn(host, _host(host_col))
    plain = keyed.select(F.col(key).alias("k"), F.col(host).alias("h"), text.alias("text"), F.col(quoted(host_col)).alias("source"))
    verdict = _judged(plain, "text", "source", ("k", "h"), LINE_MAX_DOCUMENTS, LEAST_LEFT_PERCENT).filter("kept").groupBy("k", "h").agg(F.first("hit").alias("hit"))
    verdict = verdict.select(F.col("k").alias(key), F.col("h").alias(host), F.coalesce("hit", F.expr("array()").cast("array<bigint>")).alias(hit))
    return cut_lines(keyed.join(verdict, [key, host]).select(*[F.col(quoted(c)) for c in df.columns], hit), text_col, hit)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS ls FROM d),
g AS (SELECT r, i, struct_pack(a := words[i], b := words[i + 1], c := words[i + 2]) AS k FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
g2 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g2) GROUP BY r),
ln AS (SELECT r, host, text, line, regexp_extract_all(lower_az, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT r, host, text, line, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM (SELECT r, host, text, unnest(ls) AS line FROM w)) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY r),
nl AS (SELECT r, host, text, array_to_string(lw, ' ') AS norm, sum(len(lw)) AS nw FROM ln GROUP BY r, host, text, norm),
com AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS n FROM nl GROUP BY host, norm) WHERE n > 10),
lost AS (SELECT r, count(*) AS n_common_lines, sum(nw) AS n_common_words FROM nl JOIN com USING (host, norm) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  (len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words)) AS base_failed,
  (len(words) >= 50 AND 100 * coalesce(n_repeat_words, 0) <= 50 * len(words) AND 100 * (len(words) - coalesce(n_common_words, 0)) >= 25 * len(words)) AS kept,
  coalesce(n_common_lines, 0)::BIGINT AS n_common_lines, coalesce(n_common_words, 0)::BIGINT AS n_common_words
FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)
"""
