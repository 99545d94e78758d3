"""Compression stages: template clustering, code skeletons, and the stage report."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillguard.functions.text import holds_any, token_estimate

# White space of Unicode, and tokens that stand for earlier substitutions.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SUBSTITUTE = r"^(<(\*|id|str|int|type)>$|#REF|<V[0-9]+>)"
SIMILAR = 0.5

Stage = Callable[[DataFrame], DataFrame]


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, f"[{SPACE}]+"), lambda t: t != "")


def bucket_of(words: Column) -> Column:
    """Lines can only share a template if they agree in this: word count and first literal word."""
    first = F.get(words, 0)
    literal = F.when(~first.rlike(SUBSTITUTE), first).otherwise(F.get(F.filter(words, lambda t: ~t.rlike(SUBSTITUTE)), 0))
    return F.concat_ws("|", F.size(words).cast("string"), F.coalesce(literal, F.lit("*")))


def line_buckets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line number, words, bucket of every line that isn't blank."""
    lines = df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    words = lines.withColumn("words", tokens(F.col("line"))).filter(F.size("words") > 0)
    return words.select(id_col, "line_no", "words", bucket_of(F.col("words")).alias("bucket"))


def templates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, first_line, template, n: one row per cluster of a payload's lines.

    Clusters never cross a bucket, so each (payload, bucket) is folded alone, in
    line order: a line joins the first template with which at least half of the
    words agree (a wildcard agrees with all, two substitutes with each other) and
    turns every differing word into a wildcard.  A blank line is its own cluster.
    Lines travel as their words joined by blanks, and are taken apart only where
    a bucket holds more than one.
    """
    mark = re.compile(SUBSTITUTE)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, clusters, kind = None, [], None

        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (kind, pa.int32(), pa.string(), pa.int64()))], names=[id_col, "first_line", "template", "n"])

        ended = lambda: [(key[0], c[0], c[1] if isinstance(c[1], str) else " ".join(c[1]), c[2]) for c in clusters]
        for batch in batches:
            kind, done = batch.column(0).type, []
            for this, bucket, no, line in zip(*[c.to_pylist() for c in batch.columns]):
                if (this, bucket) != key:
                    done += ended()
                    key, clusters = (this, bucket), [[no, line, 1]]
                    continue
                if isinstance(clusters[0][1], str):
                    clusters[0][1] = clusters[0][1].split(" ")
                words = line.split(" ")
                held = [mark.match(w) is not None for w in words]
                for c in clusters:
                    same = sum(t == "<*>" or t == w or (h and mark.match(t) is not None) for t, w, h in zip(c[1], words, held))
                    if same / len(words) >= SIMILAR:
                        c[1] = [t if t == w else "<*>" for t, w in zip(c[1], words)]
                        c[2] += 1
                        break
                else:
                    clusters.append([no, words, 1])
            yield told(done)
        if clusters:
            yield told(ended())

    kind = df.schema[id_col].dataType.simpleString()
    lines = line_buckets(df, id_col, text_col).select(id_col, "bucket", "line_no", F.array_join("words", " ").alias("line"))
    folded = lines.repartition(id_col, "bucket").sortWithinPartitions(id_col, "bucket", "line_no").mapInArrow(fold, f"{id_col} {kind}, first_line int, template string, n long")
    blank = df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("first_line", "line")).filter(~F.col("line").rlike(f"[^{SPACE}]"))
    return folded.unionByName(blank.select(id_col, "first_line", F.lit("").alias("template"), F.lit(1).cast("long").alias("n")))


def templated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with ``templated``: templates in the order of their first line, repeats marked (xN)."""
    line = F.when(F.col("n") > 1, F.concat("template", F.lit(" (x"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("template"))
    parts = templates(df, id_col, text_col).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("first_line", line.alias("line")))).alias("parts"))
    joined = df.join(parts, id_col, "left")
    return joined.withColumn("templated", F.coalesce(F.array_join(F.transform("parts", lambda p: p["line"]), "\n"), F.col(text_col))).drop("parts")


# What marks a text as code of one of two languages, Go first.
GO_MARK = r"(?m)^\s*package\s+\w+|\bfunc\s|:="
PYTHON_MARK = r"(?m)^\s*(?:def|class|import|from)\s|\bprint\(|\belif\b"
#: One of these stands in every text that has the mark.
GO_HINTS, PYTHON_HINTS = ("package", "func", ":="), ("def", "class", "import", "from", "print(", "elif")


def code_language(text: Column) -> Column:
    return F.when(holds_any(text, GO_HINTS) & text.rlike(GO_MARK), "go").when(holds_any(text, PYTHON_HINTS) & text.rlike(PYTHON_MARK), "python")


_KEYWORDS = {
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
    "python": frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield True False None".split()),
}
_TYPES = frozenset("bool byte error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr any".split())
_LEX = {
    "go": re.compile(r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<str>`[^`]*`|\"(?:[^\"\\\n]|\\.)*\")|(?P<rune>'(?:[^'\\]|\\.)+')|(?P<float>\d+\.\d*(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>0[xX][0-9a-fA-F]+|\d+)|(?P<id>[^\W\d]\w*)|(?P<op>:=|<-|&&|\|\||[=!<>]=|\+\+|--|<<|>>|\.\.\.|[^\s\w])", re.S),
    "python": re.compile(r"(?P<comment>\#[^\n]*)|(?P<str>[rbfuRBFU]{0,2}(?:\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))|(?P<float>\d+\.\d*(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>0[xX][0-9a-fA-F]+|\d+)|(?P<id>[^\W\d]\w*)|(?P<op>->|\*\*|//|[=!<>]=|:=|<<|>>|[^\s\w])", re.S),
}


def skeleton(source: str, language: str) -> str:
    """Code with its values replaced by their kind and its comments dropped, on one line.

    Works on tokens, not on a syntax tree, so text that doesn't parse is treated
    like text that does.
    """
    out: list[str] = []
    for m in _LEX[language].finditer(source):
        kind, text = m.lastgroup, m[0]
        if kind == "comment":
            continue
        if kind == "id":
            text = text if text in _KEYWORDS[language] else "<type>" if language == "go" and text in _TYPES else "<id>"
        elif kind != "op":
            text = f"<{kind}>"
        out.append(text)
    line = ""
    for word in out:
        glue = not line or word in ") ] } , : ; .".split() or line[-1] in "([.@"
        line += word if glue else " " + word
    return line


def values_of(source: str, language: str) -> list[str]:
    """The values of code in their order: what a skeleton shows by its kind, names aside."""
    return [m[0] for m in _LEX[language].finditer(source) if m.lastgroup in ("str", "rune", "float", "int")]


def code_values(text: Column, language: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([values_of(t, lang) if t and lang else [] for t, lang in zip(texts, languages)])

    return run(text, language)


def pruned(text: Column) -> Column:
    """Texts that look like code as skeletons, others unchanged."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([t if not lang else skeleton(t, lang) for t, lang in zip(texts, languages)])

    language = code_language(text)
    return F.when(language.isNull(), text).otherwise(run(F.when(language.isNotNull(), text), language))


def pipeline(df: DataFrame, stages: list[Stage]) -> DataFrame:
    """The stages one after another; an error in one ends the query."""
    for stage in stages:
        df = df.transform(stage)
    return df


def stage_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Estimated tokens of each stage's column, with the saving against the stage before and against the first."""
    sums = df.select(*[token_estimate(F.col(c)).alias(c) for c in columns]).agg(*[F.sum(c).alias(c) for c in columns])
    rows = sums.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("tokens")) for c in columns])).alias("no", "s")).select("no", "s.*")
    order = Window.orderBy("no")
    share = lambda base: F.round(100.0 * (base - F.col("tokens")) / base, 6)
    return rows.select("no", "stage", "tokens", F.coalesce(share(F.lag("tokens").over(order)), F.lit(0.0)).alias("marginal"), share(F.first("tokens").over(order)).alias("cumulative"))
