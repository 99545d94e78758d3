"""Detection: every rule over the original text, entropy candidates, overlap resolution."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillguard.functions import checks
from quillguard.functions.rules import ENTROPY_PRIORITY, ENTROPY_RULE, SENSITIVITY, Rule, build, to_java

FINDING = "struct<start:int,end:int,text:string,rule:string,category:string>"
#: A literal without which a rule can't match; texts that lack it skip the rule.
NEEDS = {
    "email": "@", "url": "://", "mac_address": ":", "ipv6": ":", "timestamp_iso8601": ":", "timestamp_syslog": ":", "unix_path": "/", "uuid": "-",
    "jp_phone_intl": "+81", "jp_postal_code": "〒", "private_key_block": "-----BEGIN", "gcp_api_key": "AIza", "slack_token": "xox", "npm_token": "npm_",
    "llm_api_key": "sk-", "jwt": "eyJ", "dsn_password": "://", "jp_phone_mobile": "0", "jp_phone_landline": "0",
}
#: What a text must hold for a rule to match: one of some characters (in brackets), one of some literals, or a pattern
#: for Java's matcher (a string); rules not named here look at every text.
HINTS: dict[str, list[str] | tuple[str, ...] | str] = {
    **dict.fromkeys(("ipv4", "timestamp_iso8601", "timestamp_syslog", "large_integer", "credit_card", "jp_mynumber", "jp_corporate_number", "jp_passport", "jp_phone_intl", "jp_phone_mobile", "jp_phone_landline", "jp_postal_code"), ["0-9"]),
    "email": ["@"], "mac_address": [":"], "ipv6": [":"], "url": [":"], "uuid": ["\\-"], "unix_path": ["/"], "jp_address": ["都道府県"], "dsn_password": [":"], "key_value": [":="], "github_token": ["_"], "stripe_key": ["_"], "npm_token": ["_"], "llm_api_key": ["\\-"], "slack_token": ["\\-"], "private_key_block": ["\\-"],
    "aws_access_key": ("AKIA", "ASIA"), "gcp_api_key": ("AIza",), "jwt": ("eyJ",), "auth_header": ("earer", "asic"),
    "hex_blob": r"[0-9]|(?<![A-Fa-f])[A-Fa-f]{16}", "internal_hostname": r"[.]\S", ENTROPY_RULE: r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/=_.-]{24}",
}
_NO_CITY = re.compile("[都道府県]")


def resolve(candidates: list[tuple]) -> list[tuple]:
    """Greedy choice of spans that don't overlap: (priority, byte length, start, order) first come.

    Chosen spans are kept sorted, so a candidate looks at its two neighbours only.
    """
    starts: list[int] = []
    chosen: dict[int, tuple] = {}
    for c in sorted(candidates, key=lambda c: (-c[5], -len(c[2].encode()), c[0], c[6])):
        at = bisect_left(starts, c[0])
        if at < len(starts) and starts[at] < c[1]:
            continue
        if at and chosen[starts[at - 1]][1] > c[0]:
            continue
        insort(starts, c[0])
        chosen[c[0]] = c
    return [chosen[s] for s in starts]


#: Texts whose findings a worker holds at once.
ROWS_AT_ONCE = 256


def in_parts(batches: Iterator[pd.Series], most: int = ROWS_AT_ONCE) -> Iterator[pd.Series]:
    """The batches in smaller ones, so that what is made of one is small too, however many rows come at once."""
    for texts in batches:
        for lo in range(0, max(len(texts), 1), most):
            yield texts.iloc[lo : lo + most]


class Detector:
    """Rules compiled for a worker."""

    def __init__(self, rules: list[Rule], entropy: bool = True):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), checks.CHECKS.get(r.validator), NEEDS.get(r.name)) for r in rules]
        self.entropy = re.compile(checks.TOKEN) if entropy else None

    def candidates(self, text: str) -> list[tuple]:
        out = []
        for order, (r, pattern, good, needs) in enumerate(self.rules):
            if needs and needs not in text or r.name == "jp_address" and not _NO_CITY.search(text):
                continue
            for m in pattern.finditer(text):
                start, end = m.span(r.group)
                if end > start and (good is None or good(text[start:end])):
                    out.append((start, end, text[start:end], r.name, r.category, r.priority, order))
        if self.entropy:
            for m in self.entropy.finditer(text):
                if m.end() - m.start() >= checks.ENTROPY_MIN_LENGTH:
                    value = checks.value_part(m[0])
                    if checks.is_secret(value):
                        out.append((m.end() - len(value), m.end(), value, ENTROPY_RULE, "secret", ENTROPY_PRIORITY, len(self.rules)))
        return out

    def detect(self, text: str | None) -> list[dict]:
        if not text:
            return []
        return [{"start": c[0], "end": c[1], "text": c[2], "rule": c[3], "category": c[4]} for c in resolve(self.candidates(text))]


def may_hold(text: Column, rules: list[Rule], entropy: bool = True) -> Column:
    """False only for texts in which no rule can find anything."""
    names = [r.name for r in rules] + [ENTROPY_RULE] * entropy
    if any(n not in HINTS for n in names):
        return F.lit(True)
    hints = [HINTS[n] for n in names]
    chars = "".join(dict.fromkeys(h[0] for h in hints if isinstance(h, list)))
    tests = [text.rlike(f"[{chars}]")] if chars else []
    tests += [F.contains(text, F.lit(x)) for h in hints if isinstance(h, tuple) for x in h] + [text.rlike(h) for h in hints if isinstance(h, str)]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def findings_column(text: Column, rules: list[Rule] | None = None, entropy: bool = True) -> Column:
    """Array of findings of a text, by one pass of an Arrow UDF; offsets are code points.

    Texts without any rule's hint do not go to Python at all.
    """
    detector_rules = build() if rules is None else rules

    @F.pandas_udf(f"array<{FINDING}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detector = Detector(detector_rules, entropy)
        for texts in in_parts(batches):
            yield texts.map(detector.detect)

    return run(F.when(may_hold(text, detector_rules, entropy), text))


def with_findings(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, entropy: bool = True) -> DataFrame:
    return df.withColumn("findings", findings_column(F.col(text_col), rules, entropy))


def findings(df: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", rules: list[Rule] | None = None, entropy: bool = True) -> DataFrame:
    """One row per finding."""
    found = df.select(*id_cols, findings_column(F.col(text_col), rules, entropy).alias("f"))
    return found.select(*id_cols, F.explode("f").alias("f")).select(*id_cols, "f.*")


def rule_matches(df: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches of one rule alone, without Python: (id, start, end, value)."""
    java = to_java(rule.pattern)
    text = F.col(text_col)
    able = df.filter(F.contains(text, F.lit(NEEDS[rule.name]))) if rule.name in NEEDS else df
    zipped = F.arrays_zip(F.split(text, java, -1).alias("before"), F.regexp_extract_all(text, F.lit(f"({java})"), F.lit(1)).alias("value"))
    rows = able.select(id_col, F.posexplode(zipped).alias("i", "m")).filter("m.value is not null").select(id_col, "i", F.char_length("m.before").alias("gap"), F.col("m.value").alias("value"))
    upto = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.char_length("value")).over(upto)).select(id_col, (F.col("end") - F.char_length("value")).alias("start"), "end", "value")


def sensitivity(category: Column) -> Column:
    out = F.lit(0)
    for name, level in SENSITIVITY.items():
        if level:
            out = F.when(category == name, F.lit(level)).otherwise(out)
    return out


def max_sensitivity(found: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(found, lambda f: sensitivity(f["category"]))), F.lit(0))


def redact(text: Column, found: Column, replace) -> Column:
    """The text with every finding replaced by ``replace(finding)``; nothing is scanned twice."""
    return redact_at(text, found, lambda f, i: replace(f))


def redact_at(text: Column, found: Column, replace) -> Column:
    """The same with ``replace(finding, place)``."""
    before = F.transform(found, lambda f, i: F.concat(F.substring(text, F.when(i == 0, F.lit(1)).otherwise(F.get(found, i - 1)["end"] + 1), f["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(found, i - 1)["end"])), replace(f, i)))
    last = F.when(F.size(found) > 0, F.element_at(found, -1)["end"]).otherwise(F.lit(0))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(F.array_join(before, ""), F.substring(text, last + 1, F.char_length(text))))


def leak_sweep(df: DataFrame, by: str, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Findings by category or rule."""
    return findings(df, (), text_col, rules).groupBy(by).agg(F.count("*").alias("n"))


def entropy_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens that look like key material, with their entropy; expressions only."""
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(f"({checks.TOKEN})"), F.lit(1))
    value = F.regexp_extract("token", r"^(?:.*=)?([^=]+=*)$", 1)
    rows = df.select(id_col, F.explode(F.filter(tokens, lambda t: F.length(t) >= checks.ENTROPY_MIN_LENGTH)).alias("token"))
    values = rows.withColumn("value", F.regexp_replace(value, r"^[.:=]+|[.:=]+$", "")).filter((F.length("value") >= checks.ENTROPY_MIN_LENGTH) & F.col("value").rlike(r"^[A-Za-z0-9+/=_\-]+$"))
    classes = sum((F.col("value").rlike(c).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))
    mixed = values.filter((classes >= 2) & (3 * F.length(F.regexp_replace("value", r"[^+/=_\-]", "")) <= F.length("value")))
    chars = F.split("value", "")
    n = F.length("value")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = -F.aggregate(F.filter(F.array_distinct(chars), lambda c: c != ""), F.lit(0.0), lambda a, c: a + share(c) * F.log2(share(c)))
    return mixed.withColumn("bits", F.round(bits, 6)).filter(F.col("bits") >= checks.ENTROPY_MIN_BITS).select(id_col, "value", "bits")
