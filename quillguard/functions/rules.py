"""Detection rules as data, and the translation of their dialect for Java's matcher.

Rules are written for a matcher whose ``\\b \\d \\w \\s`` are ASCII.  Python's
``re.ASCII`` agrees; in Java only ``\\b`` differs and is rewritten.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CATEGORIES = ("secret", "pii", "network", "identifier", "temporal", "path")
SENSITIVITY = {"secret": 3, "pii": 2, "network": 1, "path": 1, "identifier": 0, "temporal": 0}
LEVELS = ("low", "internal", "confidential", "restricted")
VALIDATORS = ("luhn", "jp_mynumber", "jp_corporate_no", "not_all_same", "plausible_secret")
ENTROPY_RULE, ENTROPY_PRIORITY = "entropy_secret", 60


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    priority: int
    pattern: str
    validator: str | None = None
    group: int = 0
    #: Characters of a match after its group, for SQL that has no group offsets.
    tail: int = 0
    disabled: bool = False


# Names, categories, priorities, patterns and checks of the detection rules.
CORE = (
    Rule("email", "pii", 80, r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    Rule("mac_address", "network", 68, r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b"),
    Rule("ipv6", "network", 67, r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b"),
    Rule("ipv4", "network", 66, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d{1,5})?\b"),
    Rule("url", "network", 62, r"""\bhttps?://[^\s"'<>]+"""),
    Rule("uuid", "identifier", 50, r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    Rule("timestamp_iso8601", "temporal", 46, r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"),
    Rule("timestamp_syslog", "temporal", 45, r"\b[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b"),
    Rule("hex_blob", "identifier", 30, r"\b[0-9a-fA-F]{16,}\b"),
    Rule("large_integer", "identifier", 20, r"\b\d{4,}"),
    Rule("unix_path", "path", 10, r"(?:/[A-Za-z0-9._\-]+){2,}/?"),
)
JP = (
    Rule("credit_card", "pii", 88, r"\b(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,4}|\d{4}[ \-]\d{6}[ \-]\d{5})\b", "luhn"),
    Rule("jp_mynumber", "pii", 86, r"\b\d{4}[ \-]?\d{4}[ \-]?\d{4}\b", "jp_mynumber"),
    Rule("jp_corporate_number", "pii", 85, r"\b\d{13}\b", "jp_corporate_no"),
    Rule("jp_passport", "pii", 84, r"\b[A-Z]{2}\d{7}\b"),
    Rule("jp_phone_intl", "pii", 83, r"\+81[ \-]?\d{1,4}[ \-]?\d{1,4}[ \-]?\d{4}\b"),
    Rule("jp_phone_mobile", "pii", 82, r"\b0[789]0[ \-]?\d{4}[ \-]?\d{4}\b"),
    Rule("jp_phone_landline", "pii", 81, r"\b0\d{1,4}[ \-]\d{1,4}[ \-]\d{4}\b"),
    Rule("jp_postal_code", "pii", 80, r"〒\s*\d{3}[ \-]?\d{4}"),
    Rule(
        "jp_address", "pii", 79,
        r"(?:北海道|青森県|岩手県|宮城県|秋田県|山形県|福島県|茨城県|栃木県|群馬県|埼玉県|千葉県|東京都|神奈川県|新潟県|富山県|石川県|福井県|山梨県|長野県|岐阜県|静岡県|愛知県|三重県|滋賀県|京都府|大阪府|兵庫県|奈良県|和歌山県|鳥取県|島根県|岡山県|広島県|山口県|徳島県|香川県|愛媛県|高知県|福岡県|佐賀県|長崎県|熊本県|大分県|宮崎県|鹿児島県|沖縄県)[^\s、。，,]{0,40}",
    ),
    Rule("jp_postal_code_bare", "pii", 78, r"\b\d{3}-\d{4}\b", disabled=True),
    Rule("jp_name_kanji", "pii", 77, r"(?:氏名|お名前|担当者|申請者)\s*[:：]\s*\S{2,20}", disabled=True),
)

#: Our own credential rules; they outrank all others so that a credential is never split by one.
SECRETS = (
    Rule("private_key_block", "secret", 99, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("aws_access_key", "secret", 98, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    Rule("gcp_api_key", "secret", 97, r"\bAIza[0-9A-Za-z_\-]{35}"),
    Rule("github_token", "secret", 97, r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack_token", "secret", 97, r"\bxox[abprs]-[A-Za-z0-9\-]{10,}"),
    Rule("stripe_key", "secret", 97, r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("npm_token", "secret", 97, r"\bnpm_[A-Za-z0-9]{36}"),
    Rule("llm_api_key", "secret", 96, r"\bsk-[A-Za-z0-9_\-]{20,}"),
    Rule("jwt", "secret", 96, r"\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"),
    Rule("auth_header", "secret", 94, r"\b[Bb](?:earer|asic)\s+([A-Za-z0-9+/_\-.=]{12,})", "plausible_secret", 1),
    Rule("dsn_password", "secret", 93, r"\b[a-z][a-z0-9+.\-]*://[^\s:/@]+:([^\s@/]+)@", "plausible_secret", 1, 1),
    Rule("key_value", "secret", 92, r"""\b(?:[Pp]assword|[Pp]asswd|[Pp]wd|[Ss]ecret|[Tt]oken|[Aa]pi_?[Kk]ey|[Aa]ccess_?[Kk]ey)["']?\s*[:=]\s*["']?([^\s"',;]{4,})""", "plausible_secret", 1),
)
PACKS = {"core": CORE, "jp": JP, "secrets": SECRETS}
INTERNAL_SUFFIXES = ("internal", "corp", "local", "lan", "intra")

_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def to_java(pattern: str) -> str:
    """The pattern with every ASCII word boundary spelled out, for Java's matcher."""
    return re.sub(r"(\\\\)|\\b", lambda m: m[1] or _EDGE, pattern)


def internal_hostname(suffixes: tuple[str, ...] = INTERNAL_SUFFIXES) -> Rule | None:
    clean = [re.escape(s) for s in (x.strip().removeprefix(".").strip() for x in suffixes) if s]
    if not clean:
        return None
    return Rule("internal_hostname", "network", 75, r"\b[A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9][A-Za-z0-9\-]*)*\.(?:" + "|".join(clean) + r")\b")


def load_packs(names: tuple[str, ...] = ()) -> list[Rule]:
    """Rules of the built-in packs; no names mean all; blank names are skipped, unknown ones are an error."""
    wanted = [n.strip() for n in names if n.strip()] or list(PACKS)
    unknown = [n for n in wanted if n not in PACKS]
    if unknown:
        raise ValueError(f"unknown rule pack: {', '.join(unknown)}; there are {', '.join(PACKS)}")
    return [r for n in wanted for r in PACKS[n]]


def load_pack_dir(folder: str) -> list[Rule]:
    """Rules of all JSON packs of a folder, in the order of the packs' names."""
    packs = []
    for file in Path(folder).glob("*.json"):
        data = json.loads(file.read_text(encoding="utf-8"))
        packs.append((data.get("name") or file.stem, data.get("rules", [])))
    fields = ("name", "category", "priority", "pattern", "validator", "group", "disabled")
    return [Rule(**{k: r[k] for k in fields if r.get(k) is not None}) for _, rules in sorted(packs, key=lambda p: p[0]) for r in rules]


def build(packs: tuple[str, ...] = (), disable: tuple[str, ...] = (), extra: tuple[Rule, ...] = (), suffixes: tuple[str, ...] = INTERNAL_SUFFIXES) -> list[Rule]:
    """The active rules, checked: names once, patterns that compile, known categories and validators."""
    host = internal_hostname(suffixes)
    rules = [*load_packs(packs), *([host] if host else []), *extra]
    seen = set()
    for r in rules:
        if r.name in seen:
            raise ValueError(f"duplicate rule: {r.name}")
        seen.add(r.name)
        if r.category not in CATEGORIES:
            raise ValueError(f"rule {r.name}: unknown category {r.category}")
        if r.validator and r.validator not in VALIDATORS:
            raise ValueError(f"rule {r.name}: unknown validator {r.validator}")
        try:
            re.compile(r.pattern, re.ASCII)
        except re.error as error:
            raise ValueError(f"rule {r.name}: {error}") from error
    return [r for r in rules if not r.disabled and r.name not in disable]


def fingerprint(rules: list[Rule]) -> str:
    """Changes when any rule, or their order, does; part of a cache's key, so a change empties the cache."""
    return hashlib.sha256("\0".join(repr(r) for r in rules).encode()).hexdigest()


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The active rules as a table."""
    rows = [(r.name, r.category, SENSITIVITY[r.category], r.priority, r.validator, r.pattern) for r in rules]
    return spark.createDataFrame(rows, "name string, category string, sensitivity int, priority int, validator string, pattern string")
