"""The output guard as DataFrame operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.functions import shell
from quillguard.functions.rules import to_java
from quillguard.operators.compress import SPACE

#: Without one of these characters or words a text has nothing to execute.
_MAY_RUN = r"(?im)`|~~~|:\s*\(|^\s*(?:[$#>%]\s+)?(?:[-*+]\s+)?(?:[\w./-]+=\S*\s+)?\S*(?:" + "|".join(sorted(shell.BINARIES | shell.WRAPPERS | {"drop", "truncate", "delete", "update", "alter", "grant", "revoke"})) + r")"
FINDING = "struct<rule:string,severity:string,match:string,scope:string,line:int,end_line:int>"


def rule_table(spark: SparkSession, overrides: dict[str, str] | None = None) -> DataFrame:
    """name, severity of the rules as they are enforced."""
    return spark.createDataFrame([(r.name, (overrides or {}).get(r.name, r.severity)) for r in shell.RULES], "name string, severity string")


READING = "array<struct<text:string,scope:string,line:int,end_line:int,commands:array<struct<argv:array<string>,name:string,flags:array<string>,operands:array<string>,piped:string>>>>"
#: White space that Python's strip takes away, in Java's words.
_SPACE = SPACE + r"\x1c-\x1f"


def reading(text: Column) -> Column:
    """What a text would execute: its segments and their commands, words unquoted; no judgement.

    A command has its words, its real name, the flags before ``--``, its operands,
    and the name of the command that is piped into it.
    """

    @F.pandas_udf(READING)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_read)

    return run(F.when(text.rlike(_MAY_RUN), text))


def _read(text: str | None) -> list[dict]:
    out = []
    for s in shell.segments(text) if text else []:
        commands = []
        for c in shell.split_commands(s.text):
            args = c.args
            flags = args[: args.index("--")] if "--" in args else args
            commands.append({"argv": c.argv, "name": c.name, "flags": [a for a in flags if a.startswith("-")], "operands": c.operands, "piped": shell.Command(c.piped_from).name if c.piped_from else None})
        out.append({"text": s.text, "scope": s.scope, "line": s.line, "end_line": s.end_line, "commands": commands})
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _among(value: str, words: tuple[str, ...] | list[str]) -> str:
    return f"{value} IN ({', '.join(map(_quoted, words))})" if words else "false"


def _stripped(value: str) -> str:
    return f"regexp_replace({value}, {_quoted(f'^[{_SPACE}]+|[{_SPACE}]+$')}, '')"


def _dangerous(path: str) -> str:
    roots = sorted({r.rstrip("/") for r in shell.DANGEROUS_ROOTS} | {"/"})
    p = _stripped(path)
    clean = f"coalesce(nullif(regexp_replace({p}, '/+$', ''), ''), '/')"
    return f"({p} <> '' AND ({_among(p, shell.DANGEROUS_ROOTS)} OR {_among(clean, roots)} OR (endswith({p}, '/*') AND {_among(f'left({p}, char_length({p}) - 2)', roots)})))"


def _has_flag(shorts: str, longs: tuple[str, ...]) -> str:
    short = f"a RLIKE {_quoted(f'^-.*[{shorts}]')}" if shorts else "false"
    return f"exists(c.flags, a -> if(startswith(a, '--'), {_among(chr(115) + 'plit_part(substring(a, 3), ' + _quoted('=') + ', 1)', longs)}, {short}))"


def command_test(rule: shell.GuardRule) -> str:
    """A row of the rule table as a predicate over a command ``c`` of ``reading``."""
    if rule.alternatives:
        return " OR ".join(f"({command_test(r)})" for r in rule.alternatives)
    if rule.regex:
        return "false"
    operands = f"slice(c.operands, {rule.skip + 1}, greatest(size(c.operands) - {rule.skip}, 0))"
    tests = ["(" + _among("c.name", rule.names) + (f" OR startswith(c.name, {_quoted(rule.prefix)})" if rule.prefix else "") + ")"]
    tests += [_has_flag(shorts, longs) for shorts, longs in rule.flags]
    tests += [f"array_contains(c.argv, {_quoted(w)})" for w in rule.words]
    if rule.any_word:
        tests.append(f"exists(c.argv, a -> {_among('a', rule.any_word)})")
    if rule.word_prefix:
        tests.append(f"exists(c.argv, a -> startswith(a, {_quoted(rule.word_prefix)}))")
    if rule.text:
        tests.append("(" + " OR ".join(f"contains(lower(array_join(c.argv, ' ')), {_quoted(t)})" for t in rule.text) + ")")
    if rule.next_after:
        ends = " OR ".join(f"endswith(get(c.argv, i + 1), {_quoted(e)})" for e in rule.next_ends)
        tests.append(f"exists(transform(c.argv, (a, i) -> {_among('a', rule.next_after)} AND coalesce({ends}, false)), x -> x)")
    if rule.operand == "root":
        tests.append(f"exists({operands}, o -> {_dangerous('o')})")
    elif rule.operand == "device":
        tests.append(f"exists({operands}, o -> startswith(o, '/dev/'))")
    elif rule.operand == "halt":
        tests.append(f"coalesce(get({operands}, 0) IN ('0', '6'), false)")
    if rule.piped_from:
        tests.append(f"coalesce({_among('c.piped', rule.piped_from)}, false)")
    return " AND ".join(tests)


def segment_test(rule: shell.GuardRule) -> str:
    """A row of the rule table as a predicate over a segment ``s``."""
    if rule.regex == "sql_write":
        return f"exists(regexp_extract_all(s.text, {_quoted('(?is)' + to_java(shell.SQL_WRITE.pattern))}, 0), m -> NOT m RLIKE {_quoted('(?i)' + to_java(shell.SQL_WHERE.pattern))})"
    return f"s.text RLIKE {_quoted('(?is)' + to_java(rule.regex))}" if rule.regex else "false"


def _hits(read: str, overrides: dict[str, str] | None) -> str:
    """Every hit in the order it is met: by segment, rule, and within a rule by command."""

    def of_rule(rule: shell.GuardRule) -> str:
        severity = _quoted((overrides or {}).get(rule.name, rule.severity))
        made = lambda text: f"named_struct('rule', {_quoted(rule.name)}, 'severity', {severity}, 'match', {text}, 'scope', s.scope, 'line', s.line, 'end_line', s.end_line)"
        if rule.regex:
            return f"transform(filter(array(s.text), t -> {segment_test(rule)}), t -> {made('t')})"
        return f"transform(filter(s.commands, c -> {command_test(rule)}), c -> {made(f'array_join(c.argv, {_quoted(chr(32))})')})"

    every = f"flatten(transform({read}, s -> flatten(array({', '.join(map(of_rule, shell.RULES))}))))"
    match = _stripped("h.match")
    return f"transform({every}, h -> named_struct('rule', h.rule, 'severity', h.severity, 'match', if(char_length({match}) <= 200, {match}, concat(left({match}, 200), '…')), 'scope', h.scope, 'line', h.line, 'end_line', h.end_line))"


def with_hits(df: DataFrame, text_col: str = "text", overrides: dict[str, str] | None = None, out: str = "hits") -> DataFrame:
    """The rows with every hit of a guard rule; null where nothing can be executed.

    Python reads the text into segments and commands; which rules they break is
    decided by expressions that are made from the rule table.
    """
    read = df.withColumn("__read", reading(F.col(text_col)))
    return read.withColumn(out, F.expr(_hits("__read", overrides))).drop("__read")


def findings_of(hits: str) -> Column:
    """Findings, each (rule, match) once, the severest first and otherwise in the order they were met."""
    once = f"aggregate({hits}, CAST(array() AS array<{FINDING}>), (kept, h) -> if(exists(kept, k -> k.rule = h.rule AND k.match = h.match), kept, array_append(kept, h)))"
    by = ", ".join(f"filter(f, x -> x.severity = '{s}')" for s in reversed(shell.SEVERITIES))
    return F.expr(f"coalesce(get(transform(array({once}), f -> concat({by})), 0), CAST(array() AS array<{FINDING}>))")


def verdict(findings: Column) -> Column:
    """blocked, severity, rule and match of the first finding of the highest severity."""
    first = F.get(findings, 0)
    return F.struct(F.coalesce(first["severity"] == "block", F.lit(False)).alias("blocked"), F.coalesce(first["severity"], F.lit("info")).alias("severity"), first["rule"].alias("rule"), first["match"].alias("match"))


def inspect(df: DataFrame, text_col: str = "text", overrides: dict[str, str] | None = None) -> DataFrame:
    """The rows with ``guard_findings`` and their ``verdict``."""
    found = with_hits(df, text_col, overrides, "__hits").withColumn("guard_findings", findings_of("__hits")).drop("__hits")
    return found.withColumn("verdict", verdict(F.col("guard_findings")))


#: What each rule stands for, as a reader is told.
REASONS = {
    "rm_recursive_force_root": "deletes a system or home folder with all it holds", "rm_recursive_force": "deletes a folder without asking", "find_delete_root": "deletes what it finds below a system folder",
    "mkfs": "formats a disk", "dd_to_device": "writes over a disk", "write_block_device": "writes over a disk", "disk_partitioning": "changes the partitions of a disk without asking", "fork_bomb": "starts processes without end",
    "recursive_perm_root": "changes owners or rights of a whole system folder", "pipe_to_shell": "runs what it downloads unseen", "kubectl_delete_all": "deletes all objects of a cluster or namespace", "firewall_flush": "takes the firewall down",
    "sql_drop": "drops a table, database or schema", "sql_truncate": "empties a table", "sql_write_without_where": "changes all rows of a table", "credential_exfiltration": "sends credentials away", "history_tampering": "removes traces",
    "user_deletion": "deletes an account or group", "host_power_state": "stops or restarts a machine", "service_stop": "stops a service", "container_prune": "removes containers or images", "terraform_destroy": "destroys infrastructure without asking",
    "git_force_push": "writes over the history of a branch",
}
#: Notices of a guarded answer, by what has happened to it.
NOTICES = {
    "warned": "⚠️ This answer holds an operation that can't easily be undone (%s): it %s.",
    "cut": "⛔ Part of this answer was withheld (%s): it %s. The rest is as the model wrote it.",
    "dropped": "⛔ The tool calls of this answer were dropped (%s): one %s. Its text is as the model wrote it.",
    "cut_and_dropped": "⛔ Part of this answer was withheld and its tool calls were dropped (%s): it %s.",
    "sealed": "⛔ This answer was stopped here (%s): it %s. What stands above was judged before it was sent.",
    "recited": "⛔ This answer was withheld: it repeats most of what was masked in this session.",
}


def notice(kind: str, rule: Column) -> Column:
    """What a reader is told of an answer; kind is one of NOTICES."""
    reason = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), rule), F.lit("may do harm"))
    return F.lit(NOTICES[kind]) if kind == "recited" else F.format_string(NOTICES[kind], rule, reason)


def answer_notice(found: Column, calls: Column | None = None) -> Column:
    """The notice of a whole answer from the verdicts of its text and, if it has any, of its tool calls; null if there is nothing to say."""
    cut = found["blocked"]
    dropped = F.coalesce(calls["blocked"], F.lit(False)) if calls is not None else F.lit(False)
    told = F.when(cut & dropped, notice("cut_and_dropped", found["rule"])).when(cut, notice("cut", found["rule"]))
    told = told.when(dropped, notice("dropped", calls["rule"])) if calls is not None else told
    return told.when(found["severity"] == "warn", notice("warned", found["rule"]))


def withheld(df: DataFrame, text_col: str = "text", out: str = "withheld", overrides: dict[str, str] | None = None) -> DataFrame:
    """The rows with their text, every blocked range of lines replaced by one notice, which itself is never blocked."""
    found = with_hits(df, text_col, overrides, "__hits").withColumn("__blocked", F.expr("filter(__hits, h -> h.severity = 'block')")).withColumn("__lines", F.split(F.col(text_col), "\n", -1))
    starts = "filter(__blocked, h -> h.line = i)"
    n = f"(array_max(transform({starts}, h -> h.end_line)) - i + 1)"
    notice = f"concat('⛔ [withheld ', {n}, if({n} > 1, ' lines', ' line'), '; rule ', get({starts}, 0).rule, ']')"
    line = f"CASE WHEN size({starts}) > 0 THEN {notice} WHEN exists(__blocked, h -> h.line < i AND i <= h.end_line) THEN CAST(NULL AS string) ELSE row END"
    rest = F.expr(f"array_join(filter(transform(__lines, (row, i) -> {line}), x -> x IS NOT NULL), '\\n')")
    return found.withColumn(out, F.when(F.size("__blocked") > 0, rest).otherwise(F.col(text_col))).drop("__hits", "__blocked", "__lines")


def segments(df: DataFrame, id_cols: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """One row per executable segment."""

    @F.pandas_udf("array<struct<text:string,scope:string,lang:string,line:int,end_line:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if not t else [{"text": s.text, "scope": s.scope, "lang": s.lang, "line": s.line, "end_line": s.end_line} for s in shell.segments(t)])

    return df.select(*id_cols, F.explode(run(F.col(text_col))).alias("s")).select(*id_cols, "s.*")


def commands(df: DataFrame, id_cols: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """One row per command of a script, with the command it is piped from."""

    @F.pandas_udf("array<struct<name:string,argv:array<string>,piped_from:array<string>>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if not t else [{"name": c.name, "argv": c.argv, "piped_from": c.piped_from} for c in shell.split_commands(t)])

    return df.select(*id_cols, F.posexplode(run(F.col(text_col))).alias("no", "c")).select(*id_cols, "no", "c.*")
