"""Guarded answers: text is released as soon as no continuation can change its verdict."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillguard.functions import shell
from quillguard.streaming.limits import gathered, keyed

#: Characters of an open fence after which it is judged early, and characters that a stream may hold in all.
BUFFER, HARD_LIMIT = 1 << 20, 1 << 22
COMMIT, STRICT = "commit", "strict"
UNBOUNDED = "stream_unbounded_hold"

_PROMPTS, _LISTS = ("$ ", "# ", "> ", "% "), ("- ", "* ", "+ ")
_SQL_WORDS = ("drop", "truncate", "delete", "update", "alter", "grant", "revoke")
_POINTS = re.compile(r"[`:<#]")
_TOKEN_TAIL = re.compile(r"<(?:V\d*)?|#(?:R(?:E(?:F\d*)?)?)?")
_BOMB = ":(){"


def mode(name: str) -> str:
    """The release policy that a setting names."""
    known = {"": COMMIT, "commit": COMMIT, "default": COMMIT, "strict": STRICT, "buffer": STRICT, "whole": STRICT}
    try:
        return known[name.strip().lower()]
    except KeyError:
        raise ValueError(f"no release mode {name!r}") from None


def reading(start: str) -> str:
    """What the start of a line shows: ``open`` (nothing yet), ``hold`` (may be a command), ``prose`` (can't become one)."""
    s = start.lstrip()
    if not s:
        return "open"
    if s[0] in "`~" or s[:2] in _PROMPTS + _LISTS:
        return "hold"
    if s in "$#>%-*+":
        return "open"
    word = re.match(r"\S+", s)[0].lower()
    if any(k.startswith(word) for k in _SQL_WORDS):
        return "hold" if len(word) < len(s) and word in _SQL_WORDS else "open" if len(word) == len(s) else _command(s)
    return _command(s)


def _command(s: str) -> str:
    """``prose`` once the first command has a whole name that is no known one."""
    words: list[str] = []
    word = None
    for m in shell.LEXER.finditer(s):
        kind = m.lastgroup
        if kind in ("space", "end", "pipe"):
            if word:
                words.append(word)
            word = None
            name = shell.Command(words).name
            if name:
                return "hold" if name in shell.BINARIES or name.startswith("mkfs.") else "prose"
            if words and kind != "space":
                return "prose"
        else:
            word = (word or "") + m[kind]
    return "open"


@dataclass
class Line:
    """What is held of the current line and how far it is understood."""

    held: str = ""
    reading: str = "open"
    #: Characters of ``held`` that have been scanned, place of an open backtick, and of a fork bomb's start.
    scanned: int = 0
    tick: int = -1
    bomb: int = -1
    stage: int = 0
    #: Marker of the fence that is open.
    fence: str = ""
    #: Characters released early from a fence that doesn't end.
    forced: int = 0
    sealed: str = ""
    policy: str = COMMIT


class Scanner:
    """Releases what is safe of a growing answer; a part that is blocked seals it.

    Prose goes out at once, up to an open inline code span, the start of a fork
    bomb or half a placeholder; a line that may be a command waits for its end, a
    fence for its closing mark.  The scan goes character by character, so what
    comes out in all doesn't depend on how the answer is split.  Under the policy
    ``strict`` everything waits for the end.
    """

    def __init__(self, policy: str = COMMIT, state: Line | None = None, buffer: int = BUFFER, hard_limit: int = HARD_LIMIT):
        self.line = state or Line(policy=policy)
        self.buffer, self.hard_limit = buffer, hard_limit

    @property
    def sealed(self) -> str:
        return self.line.sealed

    def write(self, delta: str) -> str:
        if self.line.sealed:
            return ""
        self.line.held += delta
        out = [] if self.line.policy == STRICT else self._advance()
        return "".join(out) + self._bound()

    def close(self) -> str:
        s = self.line
        if s.sealed:
            return ""
        rest, s.held = s.held, ""
        part = f"{s.fence}\n{rest}" if s.fence and s.forced else rest
        if s.reading == "prose":
            return rest if self._spans(rest) else ""
        return rest if self._vetted(part) else ""

    def _seal(self, rule: str) -> None:
        self.line.sealed, self.line.held = rule, ""

    def _vetted(self, part: str) -> bool:
        hit = next((f for f in shell.inspect(part) if f["severity"] == "block"), None)
        if hit:
            self._seal(hit["rule"])
        return not hit

    def _spans(self, part: str) -> bool:
        """Whether the inline code of a piece of prose, and what it may hold of a fork bomb, is allowed."""
        found = [shell.Segment(x.strip(), "code", 0, 0) for x in re.findall(r"`([^`]*)`", part) if x.strip()]
        if shell.FORK_BOMB.search(part):
            found.append(shell.Segment(part.strip(), "command_line", 0, 0))
        hit = next((f for f in shell.inspect_segments(found) if f["severity"] == "block"), None) if found else None
        if hit:
            self._seal(hit["rule"])
        return not hit

    def _bound(self) -> str:
        """Judges an endless fence early; seals what holds too much without being judged."""
        s = self.line
        if len(s.held) + s.forced > self.hard_limit:
            self._seal(UNBOUNDED)
        elif s.fence and len(s.held) > self.buffer:
            part = s.held if not s.forced else f"{s.fence}\n{s.held}"
            if self._vetted(part):
                out, s.held, s.scanned = s.held, "", 0
                s.forced += len(out)
                return out
        return ""

    def _advance(self) -> list[str]:
        out = []
        s = self.line
        while s.held and not s.sealed:
            if s.fence:
                end = self._fence_end()
                if end < 0:
                    break
                part, rest = s.held[:end], s.held[end:]
                if self._vetted(f"{s.fence}\n{part}" if s.forced else part):
                    out.append(part)
                    self.line = s = Line(rest, policy=s.policy)
                continue
            stop = s.held.find("\n") + 1
            mark = s.held[:stop].strip()[:3] if stop and s.reading != "prose" else ""
            if mark in ("```", "~~~"):
                s.fence, s.scanned = mark, stop
                continue
            out += self._prose(stop or len(s.held))
            if not stop or s.sealed:
                break
            stop = s.held.find("\n") + 1
            part, rest = s.held[:stop], s.held[stop:]
            if self._spans(part) if s.reading == "prose" else self._vetted(part):
                out.append(part)
                self.line = s = Line(rest, policy=s.policy)
        return out

    def _fence_end(self) -> int:
        """End of the closing line of the fence, or -1; whole lines are looked at once."""
        s = self.line
        while True:
            stop = s.held.find("\n", s.scanned) + 1
            if not stop:
                return -1
            line = s.held[s.scanned : stop].strip()
            s.scanned = stop
            if line.startswith(s.fence) and not line.strip("`~"):
                return stop

    def _prose(self, end: int) -> list[str]:
        """What can be released of the line's first ``end`` characters; the line end itself stays."""
        s = self.line
        end -= s.held[end - 1] == "\n"
        if s.reading == "open":
            lead = len(s.held) - len(s.held.lstrip())
            k = max(s.scanned, lead)
            while s.reading == "open" and k < end:  # a reading can only change with white space, a separator or the first characters
                if k < lead + 4 or s.held[k] in " \t\r;&|" or s.held[k].isspace() or s.held[k - 1].isspace():
                    s.reading = reading(s.held[: k + 1])
                k += 1
            s.scanned = 0 if s.reading != "open" else k
        if s.reading != "prose":
            return []
        out = []
        while s.scanned < end:
            if s.bomb < 0:  # only some characters matter outside the start of a fork bomb
                at = _POINTS.search(s.held, s.scanned, end)
                s.scanned = at.start() if at else end
                if not at:
                    break
            c = s.held[s.scanned]
            if s.bomb >= 0 and s.stage < len(_BOMB) and not c.isspace():
                if c == _BOMB[s.stage]:
                    s.stage += 1
                else:
                    s.bomb, s.stage = -1, 0
            if c == ":" and s.bomb < 0:
                s.bomb, s.stage = s.scanned, 1
            if c == "`":
                if s.tick < 0:
                    s.tick = s.scanned
                else:
                    s.tick = -1
                    if s.bomb < 0:
                        cut = s.scanned + 1
                        part = s.held[:cut]
                        if not self._spans(part):
                            # what stood before the span is prose
                            before = part.rfind("`", 0, cut - 1)
                            return [*out, part[:before]] if "`" not in part[:before] else out
                        out.append(part)
                        s.held, s.scanned, end = s.held[cut:], 0, end - cut
                        continue
            s.scanned += 1
        limit = min([end] + [x for x in (s.tick, s.bomb) if x >= 0])
        tail = max(s.held.rfind("<", 0, limit), s.held.rfind("#", 0, limit))
        if tail >= 0 and s.held.find("\n") < 0 and _TOKEN_TAIL.fullmatch(s.held, tail, limit):
            limit = tail
        if limit > 0:
            out.append(s.held[:limit])
            s.held, s.scanned = s.held[limit:], max(0, s.scanned - limit)
            s.tick, s.bomb = (x - limit if x >= 0 else -1 for x in (s.tick, s.bomb))
        return out


STATE = "held string, reading string, scanned int, tick int, bomb int, stage int, fence string, forced int, sealed string, policy string"


class _Guarded(StatefulProcessor):
    def __init__(self, names: tuple[str, ...], policy: str, idle_ms: int):
        self.stream, self.seq, self.text, self.done, self.at = names
        self.policy, self.idle_ms = policy, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("line", STATE)

    def _row(self, key, out: str, sealed: str, ended: bool) -> pd.DataFrame:
        return pd.DataFrame({self.stream: [key[0]], "released": [out], "sealed": [sealed], "ended": [ended]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        scanner = Scanner(self.policy, Line(*held) if held else None)
        frame = gathered(rows, [x for x in (self.stream, self.seq, self.text, self.done, self.at) if x]).sort_values(self.seq, kind="stable")
        out, ended = "".join([scanner.write(x) for x in frame[self.text] if isinstance(x, str)]), bool(frame[self.done].fillna(False).any())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ended:
            out += scanner.close()
            self.state.clear()
        else:
            self.state.update(tuple(asdict(scanner.line).values()))
            newest = frame[self.at].max() if self.at else None
            if not self.at:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
            elif newest == newest:
                self.handle.registerTimer(int(newest.timestamp() * 1000) + self.idle_ms)
        yield self._row(key, out, scanner.sealed, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        if held:
            scanner = Scanner(self.policy, Line(*held))
            out = scanner.close()
            self.state.clear()
            yield self._row(key, out, scanner.sealed, True)

    def close(self) -> None:
        pass


def guard_stream(deltas: DataFrame, stream: str = "stream_id", seq: str = "seq", text: str = "delta", done: str = "done", at: str = "ts", policy: str = COMMIT, idle: float = 1800.0, late: str = "10 minutes") -> DataFrame:
    """stream, released, sealed, ended for every batch of a stream's deltas, and when a stream falls silent.

    The state of a stream is what it holds of its current line or fence.  One
    without news for ``idle`` seconds (of event time; of the clock where the deltas have none) is closed like one that has
    ended: what it holds is judged and released, nothing is lost.
    """
    kind = deltas.schema[stream].dataType.simpleString()
    timed = at in deltas.columns
    names = (stream, seq, text, done, at if timed else "")
    rows = deltas.select(*[n for n in names if n])
    processor = _Guarded(names, mode(policy), int(idle * 1000))
    return keyed(rows.withWatermark(at, late) if timed else rows, stream, processor, f"{stream} {kind}, released string, sealed string, ended boolean", "EventTime" if timed else "ProcessingTime")


def released(df: DataFrame, text_col: str = "text", policy: str = COMMIT) -> DataFrame:
    """The rows with what a stream of their text would release in all, and the rule that seals it (empty: none)."""

    @F.pandas_udf("struct<released:string,sealed:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            scanner = Scanner(policy)
            out = scanner.write(t or "") + scanner.close()
            rows.append((out, scanner.sealed))
        return pd.DataFrame(rows, columns=["released", "sealed"])

    return df.withColumn("__r", run(F.col(text_col))).select("*", "__r.released", "__r.sealed").drop("__r")
