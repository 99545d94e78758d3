"""Parts of the SQL counterparts that are built from the rule data."""

from __future__ import annotations

from quillguard.functions.checks import ISSUERS, MY_NUMBER_WEIGHTS, PLACEHOLDER_WORDS, TOKEN
from quillguard.functions.rules import ENTROPY_PRIORITY, ENTROPY_RULE, SENSITIVITY, Rule, build
from quillguard.functions.text import CJK


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def _luhn(v: str) -> str:
    d = _digits(v)
    issued = " OR ".join(f"(try_cast({d}[1:{k}] AS INTEGER) BETWEEN {a} AND {b} AND length({d}) IN ({', '.join(map(str, n))}))" for a, b, k, n in ISSUERS)
    digit = f"{d}[length({d}) - i : length({d}) - i]::INTEGER"
    total = f"list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END))"
    return f"(length({d}) BETWEEN 13 AND 19 AND length(replace({d}, {d}[1:1], '')) > 0 AND NOT (length({d}) = 19 AND length(trim({v})) = 19) AND ({issued}) AND {total} % 10 = 0)"


def _mynumber(v: str) -> str:
    d = _digits(v)
    rest = "(" + " + ".join(f"coalesce(try_cast({d}[{i + 1}:{i + 1}] AS INTEGER), 0) * {w}" for i, w in enumerate(MY_NUMBER_WEIGHTS)) + ") % 11"
    return f"(length({d}) = 12 AND length(replace({d}, {d}[1:1], '')) > 0 AND try_cast({d}[12:12] AS INTEGER) = CASE WHEN {rest} <= 1 THEN 0 ELSE 11 - {rest} END)"


def _corporate(v: str) -> str:
    d = _digits(v)
    total = "(" + " + ".join(f"coalesce(try_cast({d}[{i + 2}:{i + 2}] AS INTEGER), 0) * {2 - i % 2}" for i in range(12)) + ")"
    return f"(length({d}) = 13 AND length(replace({d}, {d}[1:1], '')) > 0 AND try_cast({d}[1:1] AS INTEGER) = 9 - {total} % 9)"


def _plausible(v: str) -> str:
    t = f"trim(trim({v}), '\"''')"
    words = ", ".join(quote(w) for w in PLACEHOLDER_WORDS)
    return f"(octet_length(encode({t})) >= 4 AND lower({t}) NOT IN ({words}) AND NOT (starts_with({t}, '<') AND ends_with({t}, '>')) AND NOT starts_with({t}, '${{') AND NOT starts_with({t}, '$(') AND regexp_matches({t}, '[^*xX.]'))"


CHECKS = {"luhn": _luhn, "jp_mynumber": _mynumber, "jp_corporate_no": _corporate, "plausible_secret": _plausible}


def _pieces(source: str, ids: str, pattern: str, group: int) -> str:
    p = quote(pattern)
    at = "coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"SELECT {ids}, m[i] AS hit, v[i] AS val, ({at})::BIGINT AS pos FROM (SELECT {ids}, p, m, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {ids}, regexp_split_to_array(text, {p}) AS p, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS v FROM {source} WHERE regexp_matches(text, {p})))"


def candidates(source: str, ids: str, rules: list[Rule]) -> str:
    parts = []
    for order, r in enumerate(rules):
        good = CHECKS[r.validator]("val") if r.validator else "true"
        shift = f" + length(hit) - length(val) - {r.tail}" if r.group else ""
        parts.append(f"SELECT {ids}, {quote(r.name)} AS rule, {quote(r.category)} AS category, {r.priority} AS prio, {order} AS ord, pos{shift} AS s, pos{shift} + length(val) AS e, val FROM ({_pieces(source, ids, r.pattern, r.group)}) WHERE length(val) > 0 AND {good}")
    parts.append(f"SELECT {ids}, {quote(ENTROPY_RULE)}, 'secret', {ENTROPY_PRIORITY}, {len(rules)}, pos + length(hit) - length(value) AS s, pos + length(hit) AS e, value FROM ({entropy(source, ids)})")
    return " UNION ALL ".join(parts)


def entropy(source: str, ids: str) -> str:
    """ids, hit, at, value, t (trimmed), bits of the tokens that look like key material."""
    tokens = f"SELECT *, regexp_extract(hit, '^(?:.*=)?([^=]+=*)$', 1) AS value FROM ({_pieces(source, ids, TOKEN, 0)}) WHERE length(hit) >= 24"
    trimmed = f"SELECT *, trim(value, '.:=') AS t FROM ({tokens})"
    able = rf"SELECT *, list_filter(string_split(t, ''), lambda c: c <> '') AS cs FROM ({trimmed}) WHERE length(t) >= 24 AND regexp_matches(t, '^[A-Za-z0-9+/=_\-]+$') AND regexp_matches(t, '[a-z]')::INT + regexp_matches(t, '[A-Z]')::INT + regexp_matches(t, '[0-9]')::INT >= 2 AND 3 * length(regexp_replace(t, '[^+/=_\-]', '', 'g')) <= length(t)"
    share = "(len(list_filter(cs, lambda x: x = c)) / length(t))"
    return f"SELECT * FROM (SELECT *, round(-list_sum(list_transform(list_distinct(cs), lambda c: {share} * log2({share}))), 6) AS bits FROM ({able})) WHERE bits >= 4.0"


def resolved(source: str, ids: str, rules: list[Rule] | None = None) -> str:
    """ids, s, e, val, rule, category of the findings that stay."""
    found = candidates(source, ids, build() if rules is None else rules)
    fold = "list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN a ELSE list_concat(a, x) END)"
    ranked = f"SELECT {ids}, list(struct_pack(s := s, e := e, val := val, rule := rule, category := category) ORDER BY prio DESC, octet_length(encode(val)) DESC, s, ord) AS l FROM ({found}) GROUP BY ALL"
    return f"SELECT {ids}, f.s AS s, f.e AS e, f.val AS val, f.rule AS rule, f.category AS category FROM (SELECT {ids}, unnest({fold}) AS f FROM ({ranked}))"


LEVEL = "CASE " + " ".join(f"WHEN category = '{c}' THEN {n}" for c, n in SENSITIVITY.items()) + " END"


def tokens(text: str) -> str:
    """The estimate, by another route: each CJK character as a line feed, runs as ceilings."""
    plain = f"regexp_replace({text}, '[{CJK}]', chr(10), 'g')"
    runs = lambda p, k: f"coalesce(list_sum(list_transform(regexp_extract_all({plain}, '{p}'), lambda x: ceil(length(x) / {k}.0))), 0)"
    other = f"len(regexp_extract_all({plain}, '[^\\p{{L}}_''\\p{{Nd}} ]'))"
    letters, digits = runs(r"[\p{L}_'']+", 4), runs(r"\p{Nd}+", 3)
    return f"CASE WHEN {text} IS NULL OR {text} = '' THEN 0 ELSE greatest(1, {letters} + {digits} + {other}) END::BIGINT"
