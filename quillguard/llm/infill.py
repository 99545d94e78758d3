"""Fill-in-the-middle forms of documents, by one numpy kernel over Arrow's UTF-8 buffers.

A document is cut at two line boundaries into prefix, middle and suffix, which
are put in another order behind markers.  A block of documents is handled as
one run of bytes: a lookup table gives each byte its class, masks of adjacent
bytes find line ends and markers, running sums that start anew at each document
count code points, and one binary search places the cuts of all documents.  The
pieces of all outputs are then gathered at once.  The same kernel, run the
other way, rebuilds the text from output and form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.llm import textbytes as tb
from quillguard.llm.session import fresh, quoted

SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
# The markers of prefix, suffix and middle.
MARKERS = np.frombuffer(b"<P><S><M>", np.uint8)
FORMS = np.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM = range(3)

#: Classes of bytes: what may stand at each place of a marker, line feeds, and bytes that start a code point.
OPEN, CLOSE, LINE, LEAD = 1, 2, 4, 8
LETTER = {0x50: 16, 0x53: 32, 0x4D: 64}
CLASS = np.zeros(256, np.uint8)
CLASS[tb.LEAD] = LEAD
for _byte, _bit in ((0x3C, OPEN), (0x3E, CLOSE), (0x0A, LINE), *LETTER.items()):
    CLASS[_byte] |= _bit


def _marks(cls: np.ndarray, offsets: np.ndarray, letter: int) -> np.ndarray:
    """Where a marker with one of the letters starts; markers never cross documents."""
    n = len(cls)
    at = np.zeros(n, bool)
    if n > 2:
        at[:-2] = (cls[:-2] & OPEN > 0) & (cls[1:-1] & letter > 0) & (cls[2:] & CLOSE > 0)
        for back in (1, 2):  # the two last bytes of a document start none
            ends = offsets[1:] - back
            at[ends[ends >= 0]] = False
    return at


def line_ends(block: tb.Block, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all lines of a block in order, and the first line of each document (and the end)."""
    is_end = cls & LINE > 0
    last = block.offsets[1:][np.diff(block.offsets) > 0] - 1
    is_end[last] = True
    ends = np.flatnonzero(is_end) + 1
    return ends, np.searchsorted(ends, block.offsets, "right")


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of all pieces, one after the other."""
    total = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=total[1:])
    return data[np.repeat(start - total[:-1], length) + np.arange(total[-1])]


def strings(data: np.ndarray, length: np.ndarray) -> pa.Array:
    at = np.zeros(len(length) + 1, np.int32)
    np.cumsum(length, out=at[1:])
    return pa.StringArray.from_buffers(len(length), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)))


def _joined(source: np.ndarray, pieces: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Strings of the pieces (start and length by document) in the order given."""
    start, length = (np.stack(x, 1) for x in zip(*pieces))
    return strings(gather(source, start.reshape(-1), length.reshape(-1)), length.sum(1))


def transform_block(block: tb.Block, h: np.ndarray, fim_percent: int, spm_percent: int) -> tuple[np.ndarray, ...]:
    """n, form, prefix and middle code points, and output of each document; h holds four numbers a document."""
    cls, begin, end = CLASS[block.data], block.offsets[:-1], block.offsets[1:]
    ends, first = line_ends(block, cls)
    n = np.diff(first)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    held = tb.per_document(block, _marks(cls, block.offsets, sum(LETTER.values())))
    form = np.where((n == 0) | (held > 0) | (h[:, 2] % 100 >= fim_percent), PLAIN, np.where(h[:, 3] % 100 < spm_percent, SPM, PSM))
    bounded = np.append(ends, 0)  # documents without lines cut at their start
    place = lambda k: np.where(k > 0, bounded[first[:-1] + k - 1], begin)
    a, b = place(np.minimum(one, two)), place(np.maximum(one, two))
    points = np.zeros(len(cls) + 1, np.int64)
    np.cumsum(cls & LEAD > 0, out=points[1:])

    source = np.concatenate([block.data, MARKERS])
    whole, marked = len(block.data), (form != PLAIN) * 3
    marker = lambda k: (np.full(block.size, whole + 3 * k), marked)
    plain, spm = form == PLAIN, form == SPM
    nothing = np.zeros_like(begin)
    pre, mid = (begin, a - begin), (a, b - a)
    suf = (b, end - b)
    pick = lambda if_spm, if_psm, if_plain=(begin, nothing): tuple(np.where(plain, z, np.where(spm, x, y)) for x, y, z in zip(if_spm, if_psm, if_plain))
    out = _joined(source, [pick(marker(1), marker(0)), pick(suf, pre, (begin, end - begin)), pick(marker(0), marker(1)), pick(pre, suf), marker(2), pick(mid, mid)])
    return n, form, points[a] - points[begin], points[b] - points[a], out


def restore_block(block: tb.Block, form: np.ndarray) -> pa.Array:
    """The texts that outputs of the forms stand for."""
    cls, begin, end = CLASS[block.data], block.offsets[:-1], block.offsets[1:]
    made = form != PLAIN

    def at(letter: int) -> np.ndarray:
        """Where the document's own marker starts: its first one, as texts with markers stay plain."""
        found = np.flatnonzero(_marks(cls, block.offsets, letter))
        return np.where(made, np.append(found, 0)[np.searchsorted(found, begin)], begin)

    p, s, m = (at(bit) for bit in LETTER.values())
    psm, spm = form == PSM, form == SPM
    pre = (np.where(made, p + 3, begin), np.where(psm, s - p - 3, np.where(spm, m - p - 3, end - begin)))
    mid = (np.where(made, m + 3, begin), np.where(made, end - m - 3, 0))
    suf = (np.where(made, s + 3, begin), np.where(psm, m - s - 3, np.where(spm, p - s - 3, 0)))
    return _joined(block.data, [pre, mid, suf])


def draws(id_col: Column, seed: int = SEED) -> Column:
    """Four numbers below 2^32 that seed and id decide: from the digest of ``seed:id``; a null id reads as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """All columns but the text, then n, form, prefix_chars, middle_chars, output, one row per input row.

    Lines end with a line feed or with the text; n counts them.  Two draws give
    the cuts, a third whether a text is changed at all, a fourth the form: psm is
    ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, spm is ``<S>`` suffix ``<P>``
    prefix ``<M>`` middle.  Empty and null texts and texts that hold a marker
    stay plain, with null counts.  Rows are independent, so repeated rows give
    repeated results, an empty table an empty one, and nothing is shuffled; long
    texts are handled whole.  A new column whose name is taken, whatever its
    case, gets underscores in front.
    """
    others = [c for c in df.columns if c != text_col]
    source = df.select(*[F.col(quoted(c)) for c in others], F.col(quoted(text_col)).cast("string"), draws(F.col(quoted(id_col)), seed))
    source = source.toDF(*[f"c{k}" for k in range(len(others) + 2)])
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-2])
    new = fresh(df.drop(quoted(text_col)) if text_col in df.columns else df, "n", "form", "prefix_chars", "middle_chars", "output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.num_columns - 2
            numbers = np.asarray(batch.column(width + 1).flatten()).reshape(-1, 4)
            for block in tb.blocks(batch.column(width)):
                n, form, pre, mid, out = transform_block(block, numbers[block.lo : block.hi], fim_percent, spm_percent)
                plain = form == PLAIN
                columns = [pa.array(n, pa.int64()), pa.array(FORMS[form], pa.string()), pa.array(pre, pa.int64(), mask=plain), pa.array(mid, pa.int64(), mask=plain), out]
                names = ["n", "form", "prefix_chars", "middle_chars", "output"]
                yield pa.RecordBatch.from_arrays([*batch.slice(block.lo, block.size).columns[:width], *columns], names=[*batch.schema.names[:width], *names])

    made = source.mapInArrow(run, ", ".join(x for x in (kept, "n long, form string, prefix_chars long, middle_chars long, output string") if x))
    return made.toDF(*others, *new)


def restore(df: DataFrame, out: str = "restored", output_col: str = "output", form_col: str = "form") -> DataFrame:
    """Adds the text that was transformed, rebuilt from output and form alone; null outputs give empty texts."""
    source = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    output, form = (df.columns.index(c) for c in (output_col, form_col))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = np.array([PSM if f == "psm" else SPM if f == "spm" else PLAIN for f in batch.column(form).to_pylist()], np.int64)
            for block in tb.blocks(batch.column(output)):
                part = batch.slice(block.lo, block.size)
                yield pa.RecordBatch.from_arrays([*part.columns, restore_block(block, forms[block.lo : block.hi])], names=[*part.schema.names, "restored"])

    return source.mapInArrow(run, f"{kept}, restored string").toDF(*df.columns, *fresh(df, out))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of output and rebuilt text."""
    made = restore(transform(df.select("doc_id", "text")))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
