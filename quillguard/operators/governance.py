"""Policy, routing, input screening, and the flagship per-document decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.functions.rules import LEVELS, Rule, to_java
from quillguard.functions.text import holds_any, non_blank_lines, token_estimate
from quillguard.operators.detect import findings_column, max_sensitivity

# What sends a payload to the larger model, and the known simple errors.
CODE_MARKERS = r"<id>|<type>|<str>|\b(func|def|class|return|import)\b"
#: One of these stands in every text that has a marker.
CODE_HINTS = ("<id>", "<type>", "<str>", "func", "def", "class", "return", "import")
SIMPLE_SIGNALS = r"(?i)\b(connection refused|timed? out|timeout|disk (is )?full|no space left|out of memory|oomkilled|permission denied|no such file|cannot connect|refused to connect|502|503|504|gateway timeout|connection reset)\b"
SIMPLE_SIGNALS_JA = r"接続(が)?(拒否|できません|失敗|リセット)|接続拒否|タイムアウト|(ディスク|ディスク容量|空き容量|容量)(が)?(不足|いっぱい|足りません)|メモリ(ー)?(が)?不足|(アクセス)?(権限|パーミッション)(が)?(ありません|拒否|エラー)|ファイルが(見つかりません|存在しません)|応答(が)?(ありません|しません)|起動(でき|し)ません"
MAX_LOCAL_LINES, MAX_LOCAL_TOKENS = 3, 120
# Marks of an attempt to steer the model.
INJECTION = (
    ("instruction_override", r"(?i)\b(?:ignore|disregard|forget)\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above|earlier|preceding)\s+(?:instructions?|prompts?|rules?|directions?)"),
    ("system_prompt_probe", r"(?i)\b(?:reveal|print|show|repeat|output|disclose)\s+(?:me\s+)?(?:your|the)\s+(?:system\s+prompt|instructions|initial\s+prompt|rules)"),
    ("role_reassignment", r"(?i)\byou\s+are\s+now\s+(?:a|an|the)\b|\bnew\s+(?:instructions?|system\s+prompt)\s*:"),
    ("guardrail_bypass", r"(?i)\b(?:developer|debug|god|admin)\s+mode\b|\bdo\s+anything\s+now\b|\bwithout\s+(?:any\s+)?(?:restrictions?|filters?|safety)\b"),
    ("placeholder_enumeration", r"(?i)(?:list|print|output|show|reveal|expand|enumerate|decode|restore)[^\n]{0,40}(?:<V\d+>|\bplaceholders?\b|\ball\s+(?:the\s+)?(?:tokens?|variables?|values?)\b|#REF\d+)"),
    ("placeholder_sweep", r"(?:<V\d+>[^\w<]{0,4}){8,}"),
    ("jp_instruction_override", r"(?:これまでの|以前の|上記の)(?:指示|命令|ルール)[^\n]{0,10}(?:無視|忘れ)"),
)
#: In lower case, what a text must hold for a rule to match: one of these.
INJECTION_HINTS = {
    "instruction_override": ("ignore", "disregard", "forget"),
    "system_prompt_probe": ("prompt", "instructions", "rules"),
    "role_reassignment": ("now", "instruction", "prompt"),
    "guardrail_bypass": ("mode", "anything", "restriction", "filter", "safety"),
    "placeholder_enumeration": ("<v", "placeholder", "token", "variable", "value", "#ref"),
    "placeholder_sweep": ("<v",),
    "jp_instruction_override": ("無視", "忘れ"),
}


def parse_level(name: str) -> int:
    """Sensitivity by name, in any case; a typo is an error."""
    try:
        return LEVELS.index(name.strip().lower())
    except ValueError:
        raise ValueError(f"unknown sensitivity {name!r}; one of {', '.join(LEVELS)}") from None


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level + 1)


def policy(level: Column, cloud_max: int = 1, deny_above: int | None = None) -> Column:
    """action and reason: deny above one level, keep local above another, else allow."""
    denied = level > F.lit(deny_above) if deny_above is not None else F.lit(False)
    action = F.when(denied, "deny").when(level > cloud_max, "local_only").otherwise("allow")
    reason = F.when(denied, F.concat(level_name(level), F.lit(" data may not be sent"))).when(level > cloud_max, F.concat(level_name(level), F.lit(" data stays local"))).otherwise(F.concat(level_name(level), F.lit(" data may leave")))
    return F.struct(action.alias("action"), reason.alias("reason"))


def narrow(cloud_max: int, tenant_cloud_max: int | None) -> int:
    """A tenant may tighten the policy, never loosen it."""
    if tenant_cloud_max is None:
        return cloud_max
    if tenant_cloud_max > cloud_max:
        raise ValueError("a tenant's cloud_max is above the global one")
    return tenant_cloud_max


def cloud_fallback(action: Column) -> Column:
    return action == "allow"


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\n\x0b\f\r"))


def route(text: Column, tokens: Column | None = None) -> Column:
    """target and reason; the first test that holds decides.  tokens: the estimate of the trimmed text, if known."""
    t = trimmed(text)
    lines, tokens = non_blank_lines(t), token_estimate(t) if tokens is None else tokens
    code, many, large = holds_any(t, CODE_HINTS) & t.rlike(to_java(CODE_MARKERS)), lines > MAX_LOCAL_LINES, tokens > MAX_LOCAL_TOKENS
    known = t.rlike(to_java(SIMPLE_SIGNALS)) | t.rlike(SIMPLE_SIGNALS_JA)
    reason = (
        F.when(code, F.lit("code or configuration"))
        .when(many, F.format_string("many templates (%d lines)", lines))
        .when(large, F.format_string("large payload (~%d tokens)", tokens))
        .when(known, F.lit("known simple error"))
        .otherwise(F.lit("small payload"))
    )
    return F.struct(F.when(code | many | large, "cloud").otherwise("local").alias("target"), reason.alias("reason"))


def override(routed: Column, action: Column) -> Column:
    """Policy wins over the router."""
    return F.struct(
        F.when(action == "local_only", "local").otherwise(routed["target"]).alias("target"),
        F.when(action == "local_only", F.concat(routed["reason"], F.lit("; policy: local only"))).otherwise(routed["reason"]).alias("reason"),
    )


def screen(text: Column) -> Column:
    """Names of the injection rules that a text meets, in the rules' order."""
    return F.coalesce(F.filter(_met(text, lambda n, p: F.when(text.rlike(p), F.lit(n))), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def _met(text: Column, told: Callable[[str, str], Column]) -> Column:
    """``told(name, pattern)`` of each injection rule, null where the text lacks what the rule needs; the text is lowered once."""
    low = F.array(F.lower(text))
    return F.get(F.transform(low, lambda t: F.array(*[F.when(holds_any(t, INJECTION_HINTS[n]), told(n, to_java(p))) for n, p in INJECTION])), 0)


def screened(text: Column, limit: int = 120) -> Column:
    """suspicious, rules, excerpt: the names of all injection rules that are met, and what the first of them found."""
    found = F.filter(_met(text, lambda _, p: F.regexp_extract(text, p, 0)), lambda x: x != "")
    excerpt = F.get(F.transform(found, lambda x: F.when(F.char_length(x) > limit, F.concat(F.left(x, F.lit(limit)), F.lit("…"))).otherwise(x)), 0)
    rules = screen(text)
    return F.struct((F.size(rules) > 0).alias("suspicious"), rules.alias("rules"), excerpt.alias("excerpt"))


def screen_notice(rules: Column) -> Column:
    """What a reader is told of an input that was screened; null for one without a hit."""
    return F.when(F.size(rules) > 0, F.concat(F.lit("⚠️ The input may try to steer the model ("), F.array_join(rules, ", "), F.lit("). Read the answer with that in mind.")))


#: What may take the place of the tests above: a column of target and reason, and an estimate of tokens, of a text.
Router = Callable[[Column], Column]
Counter = Callable[[Column], Column]


def decide(df: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", rules: list[Rule] | None = None, cloud_max: int = 1, deny_above: int | None = None, router: Router | None = None, counter: Counter | None = None) -> DataFrame:
    """What a payload holds, where it may go and which tier takes it; policy has the last word, whoever routes."""
    text, t = F.col(text_col), F.col("__t")
    count = counter or token_estimate
    # one estimate a row: the untrimmed text is counted again only where trimming took more than blanks
    read = df.select(*id_cols, text.alias("__t"), findings_column(text, rules).alias("__f"), count(trimmed(text)).alias("__n"))
    routed = router(t) if router else route(t, F.col("__n"))
    decided = read.withColumn("max_sensitivity", max_sensitivity(F.col("__f"))).withColumn("__p", policy(F.col("max_sensitivity"), cloud_max, deny_above)).withColumn("__r", override(routed, F.col("__p.action")))
    tokens = F.when(trimmed(t) == t, F.col("__n")).otherwise(count(t))
    return decided.select(*id_cols, F.size("__f").cast("long").alias("n_findings"), "max_sensitivity", F.col("__p.action").alias("action"), F.col("__r.target").alias("target"), F.col("__r.reason").alias("reason"), tokens.alias("baseline_tokens"))
