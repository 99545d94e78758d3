"""Finding what a text would execute: segments, commands, and a declarative rule table.

A rule is a row: names the command must have, and requirements on its flags,
words, operands or source pipe.  One function reads the table, so a site can
add rows without code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Roots whose recursive change is destructive.
DANGEROUS_ROOTS = (
    "/", "/*", "/.", "/bin", "/boot", "/dev", "/etc", "/home", "/lib", "/lib64", "/opt", "/proc", "/root", "/sbin", "/srv", "/sys", "/usr", "/var",
    "/var/lib", "/var/log", "/data", "/tmp", "/mnt", "/media", "/usr/local", "~", "~/", "$HOME", "C:\\", "C:/",
)
# First words that make a line a command.
BINARIES = frozenset(
    "rm rmdir dd mkfs shred chmod chown chgrp truncate shutdown reboot poweroff halt init systemctl service killall pkill kill find xargs curl wget sh bash zsh kubectl helm docker podman"
    " iptables nft ufw firewall-cmd mysql psql mongo redis-cli terraform aws gcloud az git npm pip apt yum dnf mv cp ln tar unzip echo cat printf tee history journalctl nc ncat sfdisk deluser"
    " parted fdisk mkswap wipefs crontab at userdel groupdel".split()
)
# Words that make a line a sentence.
SENTENCE_WORDS = frozenset(
    "the then this that your you should will would can could and but with from into after before once when if because which there these those please make sure node pod server service cluster"
    " instance machine host container".split()
)
WRAPPERS = frozenset("sudo doas env nohup time exec command busybox".split())
SEVERITIES = ("info", "warn", "block")

FORK_BOMB = re.compile(r":\s*\(\s*\)\s*\{.*:\s*\|\s*:.*\}", re.S)
SQL_START = re.compile(r"^\s*(?:drop|truncate|delete\s+from|update|alter|grant|revoke)\s+\S", re.I)
SQL_WRITE = re.compile(r"""\b(?:delete\s+from|update)\s+[a-z_][\w."`]*\s*(?:set\s+[^;]*?)?;""", re.I | re.S | re.A)
SQL_WHERE = re.compile(r"\bwhere\b", re.I)


@dataclass(frozen=True)
class Segment:
    text: str
    scope: str
    line: int
    end_line: int
    lang: str = ""


@dataclass
class Command:
    argv: list[str]
    piped_from: list[str] = field(default_factory=list)

    @property
    def _name_at(self) -> int:
        """Place of the real command: after assignments in front and wrappers; -1 if there is none."""
        first = True
        for i, word in enumerate(self.argv):
            if first and re.match(r"[A-Za-z_]\w*=", word):
                first = False
                continue
            first = False
            if word.rsplit("/", 1)[-1] not in WRAPPERS:
                return i
        return -1

    @property
    def name(self) -> str:
        at = self._name_at
        return self.argv[at].rsplit("/", 1)[-1] if at >= 0 else ""

    @property
    def args(self) -> list[str]:
        at = self._name_at
        return self.argv[at + 1 :] if at >= 0 else []

    def has_flag(self, shorts: str, *longs: str) -> bool:
        for a in self.args:
            if a == "--":
                return False
            if a.startswith("--"):
                if a[2:].split("=", 1)[0] in longs:
                    return True
            elif a.startswith("-") and set(a[1:]) & set(shorts):
                return True
        return False

    @property
    def operands(self) -> list[str]:
        flags, _, rest = (self.args, "", []) if "--" not in self.args else (self.args[: self.args.index("--")], "--", self.args[self.args.index("--") + 1 :])
        return [a for a in flags if not (a.startswith("-") and len(a) > 1)] + [a for a in rest if a != "--"]


def dangerous(path: str) -> bool:
    p = path.strip()
    if not p:
        return False
    roots = {r.rstrip("/") for r in DANGEROUS_ROOTS} | {"/"}
    clean = p.rstrip("/") or "/"
    return p in DANGEROUS_ROOTS or clean in roots or (p.endswith("/*") and p[:-2] in roots)


LEXER = re.compile(r"""(?P<space>[ \t\r]+)|(?P<end>&&|\|\||[;&\n])|(?P<pipe>\|)|'(?P<single>[^']*)(?:'|$)|"(?P<double>(?:[^"\\]|\\.)*)(?:"|$)|\\(?P<escaped>.?)|(?P<plain>[^ \t\r;&|\n'"\\]+)""", re.S)


def split_commands(source: str) -> list[Command]:
    """Commands of a line or script: words unquoted, split at ; & && || | and line ends, pipes linked."""
    out: list[Command] = []
    argv: list[str] = []
    word: str | None = None
    piped = False

    def close(is_pipe: bool) -> None:
        nonlocal argv, word, piped
        if word is not None and word != "":
            argv.append(word)
        word = None
        if argv:
            out.append(Command(argv, out[-1].argv if piped and out else []))
            piped = is_pipe
        elif not is_pipe:
            piped = False
        argv = []

    for m in LEXER.finditer(source):
        kind = m.lastgroup
        if kind == "space":
            if word:
                argv.append(word)
            word = None
        elif kind in ("end", "pipe"):
            close(kind == "pipe")
        else:
            piece = m[kind]
            word = (word or "") + (re.sub(r"\\(.)", r"\1", piece, flags=re.S) if kind == "double" else piece)
    close(False)
    return out


def sentence(line: str) -> bool:
    hits = sum(w.strip(".,;:!?()\"'") in SENTENCE_WORDS for w in line.lower().split())
    return hits >= 2 or (hits >= 1 and (line[-1] in ".?!" or line.encode()[-1] == 0x82))


def command_line(line: str) -> str:
    """The command that a line of prose is, or nothing."""
    s = line.strip()
    prompted = s[:2] in ("$ ", "# ", "> ", "% ")
    s = s[2:].strip() if prompted else s
    s = s[2:].strip() if s[:2] in ("- ", "* ", "+ ") else s
    if not s:
        return ""
    if FORK_BOMB.search(s) or SQL_START.search(s):
        return s
    commands = split_commands(s)
    name = commands[0].name if commands else ""
    if name not in BINARIES and not name.startswith("mkfs."):
        return ""
    return s if prompted or not sentence(s) else ""


def segments(text: str) -> list[Segment]:
    """Fenced blocks, inline code spans and command lines; line ranges include the fences."""
    out: list[Segment] = []
    lines = text.split("\n")
    fence, lang, opened, body = "", "", 0, []
    for i, line in enumerate(lines):
        bare = line.strip()
        if fence:
            if bare.startswith(fence) and not bare.strip("`~"):
                if body:
                    out.append(Segment("\n".join(body), "code", opened, i, lang))
                fence, body = "", []
            else:
                body.append(line)
            continue
        if bare[:3] in ("```", "~~~"):
            fence, lang, opened = bare[:3], bare.lstrip("`~").strip().lower(), i
            continue
        out += [Segment(s.strip(), "code", i, i) for s in re.findall(r"`([^`]*)`", line) if s.strip()]
        if command := command_line(line):
            out.append(Segment(command, "command_line", i, i))
    if body:
        out.append(Segment("\n".join(body), "code", opened, len(lines) - 1, lang))
    return out


@dataclass(frozen=True)
class GuardRule:
    """All given requirements must hold; a regex rule looks at the segment, others at each command."""

    name: str
    severity: str
    names: tuple[str, ...] = ()
    prefix: str = ""
    flags: tuple[tuple[str, tuple[str, ...]], ...] = ()
    words: tuple[str, ...] = ()
    any_word: tuple[str, ...] = ()
    word_prefix: str = ""
    text: tuple[str, ...] = ()
    next_after: tuple[str, ...] = ()
    next_ends: tuple[str, ...] = ()
    operand: str = ""
    skip: int = 0
    piped_from: tuple[str, ...] = ()
    regex: str = ""
    alternatives: tuple["GuardRule", ...] = ()

    def command(self, c: Command) -> bool:
        if self.alternatives:
            return any(r.command(c) for r in self.alternatives)
        if self.regex:
            return False
        named = c.name in self.names or bool(self.prefix) and c.name.startswith(self.prefix)
        joined = " ".join(c.argv).lower()
        operands = c.operands[self.skip :]
        return (
            named
            and all(c.has_flag(s, *longs) for s, longs in self.flags)
            and all(w in c.argv for w in self.words)
            and (not self.any_word or any(w in c.argv for w in self.any_word))
            and (not self.word_prefix or any(a.startswith(self.word_prefix) for a in c.argv))
            and (not self.text or any(t in joined for t in self.text))
            and (not self.next_after or any(a in self.next_after and b.endswith(self.next_ends) for a, b in zip(c.argv, c.argv[1:])))
            and (self.operand != "root" or any(map(dangerous, operands)))
            and (self.operand != "device" or any(o.startswith("/dev/") for o in operands))
            and (self.operand != "halt" or operands[:1] in (["0"], ["6"]))
            and (not self.piped_from or bool(c.piped_from) and Command(c.piped_from).name in self.piped_from)
        )

    def segment(self, s: Segment) -> bool:
        if not self.regex:
            return False
        if self.regex == "sql_write":
            return any(not SQL_WHERE.search(m[0]) for m in SQL_WRITE.finditer(s.text))
        return bool(re.search(self.regex, s.text, re.I | re.S | re.A))


def _either(name: str, severity: str, *rules: GuardRule) -> GuardRule:
    return GuardRule(name, severity, alternatives=rules)


def _part(**need) -> GuardRule:
    return GuardRule("", "", **need)


_RECURSIVE, _FORCE = ("rR", ("recursive",)), ("f", ("force",))

# Names, severities and what each rule looks for.
RULES = (
    GuardRule("rm_recursive_force_root", "block", ("rm",), flags=(_RECURSIVE,), operand="root"),
    GuardRule("rm_recursive_force", "warn", ("rm",), flags=(_RECURSIVE, _FORCE)),
    _either("find_delete_root", "block", _part(names=("find",), words=("-delete",), operand="root"), _part(names=("find",), next_after=("-exec", "-execdir", "-ok"), next_ends=("rm", "shred"), operand="root")),
    _either("mkfs", "block", _part(names=("mkswap",), prefix="mkfs", operand="device"), _part(names=("wipefs",))),
    GuardRule("dd_to_device", "block", ("dd",), word_prefix="of=/dev/"),
    GuardRule("write_block_device", "block", regex=r">\s*/dev/(?:sd|nvme|hd|vd|mmcblk|disk)"),
    _either("disk_partitioning", "block", _part(names=("parted", "fdisk"), flags=(("s", ("script",)),)), _part(names=("sfdisk",))),
    GuardRule("fork_bomb", "block", regex=FORK_BOMB.pattern),
    _either("recursive_perm_root", "block", _part(names=("chmod",), flags=(("R", ("recursive",)),), operand="root"), _part(names=("chown", "chgrp"), flags=(("R", ("recursive",)),), operand="root", skip=1)),
    GuardRule("pipe_to_shell", "block", ("sh", "bash", "zsh", "dash", "ksh"), piped_from=("curl", "wget", "fetch")),
    _either("kubectl_delete_all", "block", _part(names=("kubectl",), words=("delete",), flags=(("", ("all",)),)), _part(names=("kubectl",), words=("delete",), any_word=("--all-namespaces", "-A"))),
    _either("firewall_flush", "block", _part(names=("iptables", "ip6tables", "nft"), flags=(("F", ("flush",)),)), _part(names=("iptables", "ip6tables", "nft"), words=("flush",)), _part(names=("ufw",), any_word=("disable", "reset")), _part(names=("firewall-cmd",), words=("--panic-on",))),
    GuardRule("sql_drop", "block", regex=r"\bdrop\s+(?:table|database|schema)\b"),
    GuardRule("sql_truncate", "block", regex=r"\btruncate\s+table\b"),
    GuardRule("sql_write_without_where", "block", regex="sql_write"),
    GuardRule("credential_exfiltration", "block", ("curl", "wget", "nc", "ncat"), text=("/etc/shadow", "/etc/passwd", "id_rsa", ".aws/credentials", ".ssh/", ".kube/config", ".env")),
    _either("history_tampering", "block", _part(names=("history",), flags=(("c", ("clear",)),)), _part(names=("journalctl",), text=("--vacuum-time=1s", "--rotate")), _part(names=("shred",), text=("/var/log",))),
    GuardRule("user_deletion", "warn", ("userdel", "groupdel", "deluser")),
    _either("host_power_state", "warn", _part(names=("shutdown", "poweroff", "halt", "reboot")), _part(names=("init",), operand="halt"), _part(names=("systemctl",), any_word=("poweroff", "reboot", "halt"))),
    GuardRule("service_stop", "warn", ("systemctl", "service"), any_word=("stop", "disable", "mask")),
    _either("container_prune", "warn", _part(names=("docker", "podman"), words=("prune",)), _part(names=("docker", "podman"), words=("rm",), flags=(_FORCE,))),
    GuardRule("terraform_destroy", "block", ("terraform",), words=("destroy", "-auto-approve")),
    _either("git_force_push", "warn", _part(names=("git",), words=("push",), flags=(("f", ("force",)),)), _part(names=("git",), words=("push", "--force-with-lease"))),
)


def inspect(text: str, overrides: dict[str, str] | None = None, rules: tuple[GuardRule, ...] = RULES) -> list[dict]:
    """Findings, each (rule, match) once, the severest first and otherwise in the order they were met."""
    return inspect_segments(segments(text), overrides, rules)


def inspect_segments(parts: list[Segment], overrides: dict[str, str] | None = None, rules: tuple[GuardRule, ...] = RULES) -> list[dict]:
    out, seen = [], set()
    for s in parts:
        commands = split_commands(s.text)
        for r in rules:
            severity = (overrides or {}).get(r.name, r.severity)
            hits = [s.text] if r.segment(s) else []
            hits += [" ".join(c.argv) for c in commands if r.command(c)]
            for hit in hits:
                match = hit.strip() if len(hit.strip()) <= 200 else hit.strip()[:200] + "…"
                entry = {"rule": r.name, "severity": severity, "match": match, "scope": s.scope, "line": s.line, "end_line": s.end_line}
                if (r.name, match) not in seen:
                    seen.add((r.name, match))
                    out.append(entry)
                elif severity == "block":
                    out.append(entry | {"repeat": True})
    return sorted(out, key=lambda f: -SEVERITIES.index(f["severity"]))


def withhold(text: str, overrides: dict[str, str] | None = None) -> str:
    """The text with every blocked range of lines replaced by one notice, which itself is never blocked."""
    reach: dict[int, tuple[int, str]] = {}
    for f in inspect(text, overrides):
        if f["severity"] == "block" and f["end_line"] >= reach.get(f["line"], (-1, ""))[0]:
            reach[f["line"]] = (f["end_line"], reach.get(f["line"], (0, f["rule"]))[1])
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        if i not in reach:
            out.append(lines[i])
            i += 1
            continue
        end, rule = reach[i]
        out.append(f"⛔ [withheld {end - i + 1} line{'s' if end > i else ''}; rule {rule}]")
        i = end + 1
    return "\n".join(out)


