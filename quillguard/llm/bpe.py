"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that ends the
prefix's BPE encoding.  Storing that *last token* per prefix gives the whole
encoding by walking back from the end.  It also makes appending exact (only the
new prefixes are computed) and lets an edit re-encode from the edit on, until
the stored table agrees again.

A candidate token t may end prefix i when the token that ends prefix i - len(t)
and t stay two tokens under the merge ranks; exactly one candidate can.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.llm.session import quoted

DEFAULT_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: What a worker remembers: encodings of chunks (a space and what follows), of other pieces, and token pairs.  A memory
#: that is full becomes the older half of what is known, so what is in use stays.  Longer keys, in characters, aren't remembered.
CACHE_CHUNKS, CACHE_PIECES, CACHE_PAIRS, CACHE_CHARS = 400_000, 50_000, 500_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    ranks = {}
    with open(path, "rb") as file:
        for line in file:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class PrefixTable:
    """The last token of every prefix of a growing byte string."""

    def __init__(self, coder: "Coder", data: bytes = b""):
        self.coder, self.data, self.last = coder, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        begin = len(self.data)
        self.data += more
        self._fill(begin + 1, None, 0)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace data[start:end]; prefixes before the edit keep their tokens.

        Computing stops once a run of longest-token length agrees with the old
        table: every later prefix then has the same candidates as before.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        self._fill(start + 1, old, shift, start + len(new))

    def _fill(self, begin: int, old: list[int] | None, shift: int, safe: int = 0) -> None:
        coder, last = self.coder, self.last
        width, fine, check, stays, pair = coder.width, coder.fine, coder.check, coder.known_pairs, coder.stays
        base, agreed = max(0, begin - coder.longest), 0
        for at, token in coder.found_in(self.data[base:].decode("latin-1")):
            end = base + at + 1
            if end < len(last) or not (fine[token] or check(token)):
                continue
            before = last[end - width[token]]
            if before >= 0:
                known = stays.get(before << 32 | token)
                if not (known or known is None and pair(before, token)):
                    continue
            last.append(token)
            if old is not None and end > safe:
                agreed = agreed + 1 if old[end - shift] == token else 0
                if agreed >= coder.longest:
                    last.extend(old[end - shift + 1 :])
                    return
        if len(last) != len(self.data) + 1:
            raise ValueError("the vocabulary lacks a single byte")

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end]
            out.append(token)
            end -= len(self.coder.tokens[token])
        return out[::-1]


class Coder:
    """Encodes and decodes with one vocabulary; remembers what it has worked out."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = regex.compile(pattern).findall
        self.cuts = pattern == public_tokenizers.PATTERN  # what is said of white space in ``encode`` holds for this one
        self.odd = regex.compile(r"\s\s|[^\S\n ]|^\s|\s$").search
        self.known_pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pieces: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}
        self._heads: dict[str, bytes] = {}
        self._older: dict[int, dict[str, bytes]] = {id(cache): {} for cache in (self._pieces, self._chunks, self._heads)}
        self.table = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        self.width = [len(x) for x in self.table]
        self.bytes_of = pa.array(self.table, pa.large_binary())
        #: 1 for tokens that are known to be what merges make of their bytes.
        self.fine = bytearray(int(len(x) == 1) for x in self.table)
        automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            automaton.add_word(token.decode("latin-1"), rank)
        automaton.make_automaton()
        self.found_in = automaton.iter

    def check(self, token: int) -> bool:
        good = self.halves(token) is not None
        self.fine[token] = good
        return good

    def merged(self, data: bytes) -> list[int]:
        """Reference merging: repeatedly join the adjacent pair of lowest rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a token that no merge makes."""
        if token not in self._halves:
            data, rank = self.tokens[token], token
            if len(data) == 1:
                self._halves[token] = None
            else:
                parts = [data[i : i + 1] for i in range(len(data))]
                while len(parts) > 2:
                    best, at = None, -1
                    for i in range(len(parts) - 1):
                        r = self.ranks.get(parts[i] + parts[i + 1])
                        if r is not None and r < rank and (best is None or r < best):
                            best, at = r, i
                    if best is None:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def stays(self, left: int, right: int) -> bool:
        """True if the bytes of two tokens encode as just these two tokens."""
        if len(self.known_pairs) >= CACHE_PAIRS:
            self.known_pairs.clear()
        known = self.known_pairs[left << 32 | right] = self._pair(left, right)
        return known

    def _pair(self, left: int, right: int) -> bool:
        # Undo merges from the latest on; at each stage the pair across the seam
        # must not be a token that would have been merged before that stage.
        limit = 1 << 62
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit, parts = left, self.halves(left)
                if parts is None:
                    limit, parts = right + 1, self.halves(right)
                    if parts is None:
                        return True
                    right = parts[0]
                else:
                    left = parts[1]
            else:
                limit, parts = right + 1, self.halves(right)
                if parts is None:
                    limit, parts = left, self.halves(left)
                    if parts is None:
                        return True
                    left = parts[1]
                else:
                    right = parts[0]

    def piece(self, data: bytes) -> list[int]:
        token = self.ranks.get(data)
        if token is not None:
            return [token]
        # as PrefixTable fills its table, without what appends and edits need
        width, fine, stays, last, filled = self.width, self.fine, self.known_pairs, [-1], 0
        for at, token in self.found_in(data.decode("latin-1")):
            if at < filled or not (fine[token] or self.check(token)):
                continue
            before = last[at + 1 - width[token]]
            if before >= 0:
                known = stays.get(before << 32 | token)
                if not (known or known is None and self.stays(before, token)):
                    continue
            last.append(token)
            filled += 1
        if filled != len(data):
            raise ValueError("the vocabulary lacks a single byte")
        out = []
        while filled:
            token = last[filled]
            out.append(token)
            filled -= width[token]
        return out[::-1]

    def pack_piece(self, piece: str) -> bytes:
        """The ids of one match of the pattern as little-endian unsigned 32-bit integers."""
        packed = self._older[id(self._pieces)].get(piece)
        if packed is not None:
            return self._remember(self._pieces, piece, packed)
        data = piece.encode("utf-8")
        ids = self.piece(data)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        return self._remember(self._pieces, piece, packed)

    def _remember(self, cache: dict[str, bytes], key: str, packed: bytes, most: int = CACHE_PIECES) -> bytes:
        if len(key) <= CACHE_CHARS:
            if len(cache) >= most:
                self._older[id(cache)] = cache.copy()
                cache.clear()
            cache[key] = packed
        return packed

    def pack(self, text: str) -> bytes:
        known, pack = self._pieces.get, self.pack_piece
        return b"".join([known(p) or pack(p) for p in self.split(text)])

    def pack_chunk(self, chunk: str) -> bytes:
        packed = self._older[id(self._chunks)].get(chunk)
        if packed is None:
            word = " " + chunk
            # the pattern takes a space and plain letters as one match
            packed = (self._pieces.get(word) or self.pack_piece(word)) if self.cuts and chunk.isascii() and chunk.isalpha() else self.pack(word)
        return self._remember(self._chunks, chunk, packed, CACHE_CHUNKS)

    def pack_head(self, chunk: str) -> bytes:
        packed = self._older[id(self._heads)].get(chunk)
        return self._remember(self._heads, chunk, self.pack(chunk) if packed is None else packed)

    def encode(self, text: str) -> bytes:
        """The packed ids of a text.

        With the shipped pattern, where every white space is one space or one line feed between other
        characters, the pattern always splits before a space and around a line
        feed; such texts are cut there first and the chunks looked up.
        """
        if not text or not self.cuts or self.odd(text):
            return self.pack(text)
        known, pack, head, pack_head = self._chunks.get, self.pack_chunk, self._heads.get, self.pack_head
        out = []
        feed = self._heads.get("\n") or self.pack_head("\n")
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(feed)
            first, *rest = line.split(" ")
            out.append(head(first) or pack_head(first))
            out += [known(p) or pack(p) for p in rest]
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        values = self.bytes_of.take(pa.array(np.frombuffer(packed, "<u4"))).buffers()[2]
        return values.to_pybytes() if values is not None else b""


_coders: dict[tuple[str, str], Coder] = {}


def coder_for(name: str, pattern: str) -> Coder:
    """The worker's coder for a vocabulary file that was sent with addFile."""
    key = (name, pattern)
    if key not in _coders:
        _coders[key] = Coder(load_ranks(SparkFiles.get(name)), pattern)
    return _coders[key]


def encode_documents(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """One row per input row: the kept columns, n_tokens, the two digests and, if asked for, the ids.

    ``vocabulary`` is the path of a rank file on the driver; Spark ships it to
    every executor.  Narrow: no shuffle, rows are independent, a lost task is
    simply run again.  Texts are encoded whole, however long.  Null text counts as empty (no tokens, digests of nothing);
    repeated rows give repeated results; an empty table gives an empty result;
    other columns of the input are ignored.
    """
    spark = df.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    source = df.select(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(keep)], F.col(quoted(text_col)).alias("text"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    schema = ", ".join([*fields, "n_tokens long, ids_sha256 string, decoded_sha256 string", *(["token_ids binary"] if with_ids else [])])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(name, pattern)
        for batch in batches:
            n = batch.num_columns - 1
            texts = batch.column(n)
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                count, ids, decoded, packed_ids = [], [], [], []
                for value in texts.slice(lo, 512):
                    packed = coder.encode(value.as_py() or "")
                    count.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(packed)).hexdigest())
                    if with_ids:
                        packed_ids.append(packed)
                columns = [*part.columns[:n], pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                names = [*batch.schema.names[:n], "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(packed_ids, pa.binary()))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    made = source.mapInArrow(encode, schema)
    return made.toDF(*keep, *made.columns[len(keep) :])


def decode_ids(df: DataFrame, vocabulary: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that a column of packed ids stands for; null ids give null."""
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    @F.pandas_udf("binary")
    def decode(ids):
        coder = coder_for(name, r".+")
        return ids.map(lambda x: None if x is None else coder.decode(bytes(x)))

    return df.withColumn(out_col, decode(F.col(ids_col)))
