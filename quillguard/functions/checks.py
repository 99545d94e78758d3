"""Value checks of the detection rules: as plain functions and as column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Issuer prefixes with the card lengths they use, as (first, last, prefix length, lengths).
ISSUERS = (
    (4, 4, 1, (13, 16, 19)),
    (51, 55, 2, (16,)),
    (2221, 2720, 4, (16,)),
    (34, 34, 2, (15,)),
    (37, 37, 2, (15,)),
    (6011, 6011, 4, (16, 17, 18, 19)),
    (65, 65, 2, (16, 17, 18, 19)),
    (644, 649, 3, (16, 17, 18, 19)),
    (3528, 3589, 4, (16, 17, 18, 19)),
    (300, 305, 3, (14, 15, 16, 17, 18, 19)),
    (36, 36, 2, (14, 15, 16, 17, 18, 19)),
    (38, 39, 2, (14, 15, 16, 17, 18, 19)),
    (62, 62, 2, (16, 17, 18, 19)),
)
# Words that stand in for a secret.
PLACEHOLDER_WORDS = ("none", "null", "nil", "true", "false", "empty", "unset", "redacted", "<redacted>", "changeme", "xxxx", "****", "...", "***")

MY_NUMBER_WEIGHTS = (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
ENTROPY_MIN_LENGTH, ENTROPY_MIN_BITS = 24, 4.0
TOKEN = r"""[^ \t\n\r"'`,;()\[\]{}<>|\\]+"""


def digits(value: str) -> str:
    return re.sub(r"[^0-9]", "", value)


def not_all_same(value: str) -> bool:
    return len(set(digits(value))) > 1


def luhn(value: str) -> bool:
    d = digits(value)
    if not 13 <= len(d) <= 19 or not not_all_same(d) or (len(d) == 19 and len(value.strip()) == 19):
        return False
    if not any(first <= int(d[:n]) <= last and len(d) in lengths for first, last, n, lengths in ISSUERS):
        return False
    doubled = [sum(divmod(2 * int(c), 10)) for c in d[-2::-2]]
    return (sum(doubled) + sum(int(c) for c in d[::-2])) % 10 == 0


def jp_mynumber(value: str) -> bool:
    d = digits(value)
    if len(d) != 12 or not not_all_same(d):
        return False
    rest = sum(int(c) * w for c, w in zip(d, MY_NUMBER_WEIGHTS)) % 11
    return int(d[-1]) == (0 if rest <= 1 else 11 - rest)


def jp_corporate_no(value: str) -> bool:
    d = digits(value)
    if len(d) != 13 or not not_all_same(d):
        return False
    return int(d[0]) == 9 - (2 * sum(map(int, d[1::2])) + sum(map(int, d[2::2]))) % 9


def plausible_secret(value: str) -> bool:
    t = value.strip().strip("\"'")
    if len(t.encode()) < 4 or t.lower() in PLACEHOLDER_WORDS:
        return False
    if (t.startswith("<") and t.endswith(">")) or t.startswith(("${", "$(")):
        return False
    return bool(t.strip("*xX."))


CHECKS = {"luhn": luhn, "jp_mynumber": jp_mynumber, "jp_corporate_no": jp_corporate_no, "not_all_same": not_all_same, "plausible_secret": plausible_secret}


def shannon(value: str) -> float:
    """Bits per byte."""
    raw = value.encode()
    return -sum(n / len(raw) * math.log2(n / len(raw)) for n in (raw.count(b) for b in set(raw))) if raw else 0.0


def value_part(token: str) -> str:
    """What follows the last = that has anything but = after it."""
    cut = token.rstrip("=").rfind("=")
    return token[cut + 1 :]


def is_secret(token: str, least: int = ENTROPY_MIN_LENGTH, bits: float = ENTROPY_MIN_BITS) -> bool:
    t = token.strip(".:=")
    if len(t) < least or not re.fullmatch(r"[A-Za-z0-9+/=_\-]+", t):
        return False
    if sum(bool(re.search(c, t)) for c in ("[a-z]", "[A-Z]", "[0-9]")) < 2:
        return False
    return 3 * len(re.findall(r"[+/=_\-]", t)) <= len(t) and shannon(t) >= bits


def luhn_column(value: Column) -> Column:
    """The card check as an expression."""
    d = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(d)
    issued = F.lit(False)
    for first, last, k, lengths in ISSUERS:
        issued = issued | (F.substring(d, 1, k).try_cast("int").between(first, last) & n.isin(*lengths))
    bare = (n == 19) & (F.length(F.trim(value)) == 19)
    return n.between(13, 19) & ~d.rlike(r"^(.)\1*$") & ~bare & F.coalesce(issued, F.lit(False)) & F.call_function("luhn_check", F.when(n > 0, d).otherwise(F.lit("1")))


def _weighed(d: Column, weights: tuple[int, ...], first: int) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.coalesce(F.substring(d, first + i, 1).try_cast("int"), F.lit(0)) * w
    return total


def jp_mynumber_column(value: Column) -> Column:
    d = F.regexp_replace(value, "[^0-9]", "")
    rest = _weighed(d, MY_NUMBER_WEIGHTS, 1) % 11
    return (F.length(d) == 12) & ~d.rlike(r"^(.)\1*$") & (F.substring(d, 12, 1).try_cast("int") == F.when(rest <= 1, 0).otherwise(11 - rest))


def jp_corporate_no_column(value: Column) -> Column:
    d = F.regexp_replace(value, "[^0-9]", "")
    return (F.length(d) == 13) & ~d.rlike(r"^(.)\1*$") & (F.substring(d, 1, 1).try_cast("int") == 9 - _weighed(d, (2, 1) * 6, 2) % 9)
