"""Column expressions over text: token estimates, placeholders, shapes, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges whose characters count as one token each.
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}"
_LETTERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_'", "0123456789"
#: Other letters and digits; what most characters fail comes first.
_ODD_LETTERS, _ODD_DIGITS = (rf"[[^\x00-\x7F]&&\p{{{kind}}}&&[^{CJK}]]" for kind in ("L", "Nd"))
#: Runs of four letters, then what is left of them, of three digits likewise, each as one character; blanks go last.
_RUNS = (("aaaa", "A"), ("aaa", "A"), ("aa", "A"), ("ddd", "D"), ("dd", "D"), (" ", ""))
PLACEHOLDER = r"<V[0-9]+>|#REF[0-9]+"


def token_estimate(text: Column) -> Column:
    """Estimated tokens: 4 letters, 3 digits, or any other character but a space make one.

    A text of spaces counts 1, an empty or null one 0.  Characters become classes
    and runs become single characters by plain replacements, so no match is ever
    copied out of the text.
    """
    plain = F.regexp_replace(F.regexp_replace(text, _ODD_LETTERS, "a"), _ODD_DIGITS, "0")
    out = F.translate(F.when(F.octet_length(text) == F.char_length(text), text).otherwise(plain), _LETTERS + _DIGITS, "a" * len(_LETTERS) + "d" * len(_DIGITS))
    for run, one in _RUNS:
        out = F.replace(out, F.lit(run), F.lit(one))
    n = F.char_length(out).cast("long")
    return F.when(text.isNull() | (text == ""), F.lit(0).cast("long")).when(n == 0, F.lit(1).cast("long")).otherwise(n)


def holds_any(text: Column, literals: tuple[str, ...]) -> Column:
    """True for texts that hold one of the literals: a cheap test in front of a pattern that can't match without them."""
    out = F.contains(text, F.lit(literals[0]))
    for x in literals[1:]:
        out = out | F.contains(text, F.lit(x))
    return out


def message_tokens(texts: Column) -> Column:
    """Of an array of messages: 4 more each, and 3 more if there are any."""
    total = F.aggregate(texts, F.lit(0).cast("long"), lambda a, t: a + token_estimate(t) + 4)
    return F.when(F.size(texts) > 0, total + 3).otherwise(F.lit(0).cast("long"))


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PLACEHOLDER})"), F.lit(1))


def rewrite_placeholders(text: Column, replace) -> Column:
    """One pass over the placeholders; what ``replace`` gives is not looked at again."""
    pieces = F.split(text, PLACEHOLDER, -1)
    mapped = F.transform(placeholders(text), replace)
    return F.array_join(F.zip_with(pieces, F.concat(mapped, F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def canonical_token(token: Column, number: Column) -> Column:
    return F.when(F.startswith(token, F.lit("#")), F.concat(F.lit("#REF"), number.cast("string"))).otherwise(F.concat(F.lit("<V"), number.cast("string"), F.lit(">")))


def shape_order(texts: Column) -> Column:
    """Placeholders of all texts of a payload in the order of their first use."""
    return F.array_distinct(F.flatten(F.transform(texts, placeholders)))


def shape(texts: Column) -> Column:
    """The texts with their placeholders renumbered by first use over the whole payload."""
    order = shape_order(texts)
    return F.transform(texts, lambda t: rewrite_placeholders(t, lambda p: canonical_token(p, F.array_position(order, p))))


def shape_map(texts: Column) -> Column:
    """Canonical token to original token."""
    order = shape_order(texts)
    return F.map_from_arrays(F.transform(order, lambda p, i: canonical_token(p, i + 1)), order)


def restore(text: Column, to_original: Column) -> Column:
    return rewrite_placeholders(text, lambda p: F.coalesce(F.try_element_at(to_original, p), p))


def cache_key(model: Column, texts: Column, temperature: Column | None = None, max_tokens: Column | None = None) -> Column:
    """SHA-256 of all that can change an answer."""
    nul = F.char(F.lit(0))
    parts = [model, nul, F.array_join(F.transform(texts, lambda t: F.concat(t, nul)), "")]
    if temperature is not None:
        parts.append(F.coalesce(F.concat(F.lit("t="), F.format_string("%.4f", temperature)), F.lit("")))
    if max_tokens is not None:
        parts.append(F.coalesce(F.concat(F.lit("m="), max_tokens.cast("string")), F.lit("")))
    return F.sha2(F.concat(*parts), 256)


def payload_hash(texts: Column) -> Column:
    return F.sha2(F.array_join(texts, "\n"), 256)


def trim_for_log(text: Column, limit: int) -> Column:
    """Texts of more characters than the limit are cut to as many, white space at the ends taken off, and marked."""
    head = F.regexp_replace(F.left(text, F.lit(limit)), r"(?U)^\s+|\s+$", "")
    return F.when(F.char_length(text) > limit, F.concat(head, F.lit("…"))).otherwise(text)


def non_blank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"\S")))
