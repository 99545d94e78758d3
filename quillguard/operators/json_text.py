"""JSON as text: leaves, masked descriptions, first object of an answer."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.functions.rules import Rule
from quillguard.operators.detect import findings
from quillguard.operators.stored import stored


#: Numbers travel as marked strings, so they are written back as they were read.
_MARK = "\0number:"
_MARKED = re.compile(r'"\\u0000number:([^"]*)"')


def _load(text: str):
    return json.loads(text, parse_float=lambda n: _MARK + n, parse_int=lambda n: _MARK + n)


def _dump(value) -> str:
    return _MARKED.sub(r"\1", json.dumps(value, ensure_ascii=False, separators=(",", ":")))


#: A string of JSON text with its quotes.
_STRING = r'"(?:[^"\\]|\\.)*+"'


def string_leaves(text: Column) -> Column:
    """All strings of a JSON text in their order, keys included; what doesn't parse is one string as a whole.

    In text that parses, strings are what stands between quotes, so one scan finds them.
    """
    quoted = F.regexp_extract_all(text, F.lit(f"({_STRING})"), F.lit(1))
    strings = F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>")
    return F.when(text.isNull(), F.lit(None).cast("array<string>")).when(F.try_parse_json(text).isNull(), F.array(text)).otherwise(strings)


def strings_of(df: DataFrame, keys: tuple[str, ...], text_col: str, deepest: int = 200) -> DataFrame:
    """keys, under, is_key, depth, text: one row for every string of a JSON text, with the key it stands under.

    The value is taken apart level by level as variants; a string in a list stands
    under the list's key.  Texts that don't parse give nothing.
    """
    level = df.select(*keys, F.lit("").alias("under"), F.try_parse_json(F.col(text_col)).alias("v")).filter(F.col("v").isNotNull())
    out = None
    for depth in range(deepest + 1):
        kind = F.schema_of_variant(F.col("v"))
        told = stored(level.withColumn("kind", F.when(kind == "STRING", "s").when(kind.startswith("OBJECT"), "o").when(kind.startswith("ARRAY"), "a")).filter("kind is not null"), "level")
        found = told.filter("kind = 's'").select(*keys, "under", F.lit(False).alias("is_key"), F.lit(depth).alias("depth"), F.variant_get("v", "$", "string").alias("text"))
        inner = told.filter("kind <> 's'")
        if inner.isEmpty():
            return found if out is None else out.unionByName(found)
        opened = inner.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
        named = opened.filter("kind = 'o'").select(*keys, "under", F.lit(True).alias("is_key"), F.lit(depth).alias("depth"), F.col("key").alias("text"))
        found = found.unionByName(named)
        out = found if out is None else out.unionByName(found)
        level = opened.select(*keys, F.coalesce("key", "under").alias("under"), F.col("value").alias("v"))
    raise ValueError(f"JSON deeper than {deepest} levels")


def classified(df: DataFrame, keys: tuple[str, ...], text_col: str, rules: list[Rule] | None = None) -> DataFrame:
    """Findings in the strings of a tools block that are not masked: keys, and values under other keys than ``description``.

    They count for the session's level, but take no place in its dictionary.
    """
    other = strings_of(df, keys, text_col).filter("is_key or under <> 'description'").filter("text <> ''")
    return findings(other, (*keys, "under", "is_key"), "text", rules)


def rewrite_descriptions(text: Column, rewrite: Callable[[str], str]) -> Column:
    """A tools block with every ``description`` rewritten; the rest, numbers included, stays as written."""

    def walk(value, key: str = ""):
        if isinstance(value, dict):
            return {k: walk(v, k) for k, v in value.items()}
        if isinstance(value, list):
            return [walk(v, key) for v in value]
        return rewrite(value) if key == "description" and isinstance(value, str) else value

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return t if t is None else _dump(walk(_load(t)))
            except ValueError:
                return t

        return texts.map(one)

    return run(text)


def first_object(text: Column, schema: str) -> Column:
    """The JSON object from the first brace to the last one."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)
