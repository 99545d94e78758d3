"""Names of people: a gazetteer proposes, a recogniser confirms, base findings always stay."""

from __future__ import annotations

import queue
import re
import threading
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.functions.rules import Rule, build
from quillguard.operators.detect import FINDING, Detector, in_parts

NAME_RULE = "jp_name"
#: Candidates of one question to the recogniser; a text with more of them takes several questions.
CANDIDATES_AT_ONCE = 64
#: Our own short list of common family names; callers bring a longer one.
SURNAMES = ("佐藤", "鈴木", "高橋", "田中", "伊藤", "渡辺", "山本", "中村", "小林", "加藤", "吉田", "山田", "佐々木", "山口", "松本", "井上", "木村", "林", "清水", "山崎")
# What a given name is made of, how long it gets, and hiragana that can't start one.
GIVEN = 4
_RUNE = "[一-鿿゠-ヿ々ヶ]|(?![はがをにへとでものやかねよまだな])[぀-ゟ]"

#: Takes a text and candidate strings and gives the places of those that are names.
Recogniser = Callable[[str, list[str]], list[int]]


def everyone(text: str, candidates: list[str]) -> list[int]:
    """A recogniser that believes the gazetteer."""
    return list(range(len(candidates)))


def nobody(text: str, candidates: list[str]) -> list[int]:
    return []


class Timed:
    """A recogniser with a deadline: one that is late counts as failed, and one that was late too often isn't asked again.

    A late call can't be stopped; it ends in a thread of its own, of which a
    worker gathers ``most_late`` at most.
    """

    def __init__(self, recognise: Recogniser, seconds: float, most_late: int = 3):
        self.recognise, self.seconds, self.most_late, self.late = recognise, seconds, most_late, 0

    def __call__(self, text: str, candidates: list[str]) -> list[int]:
        if self.late >= self.most_late:
            raise TimeoutError("the recogniser was late too often")
        answer: queue.Queue = queue.Queue(1)

        def ask() -> None:
            try:
                answer.put((self.recognise(text, candidates), None))
            except Exception as error:  # noqa: BLE001  handed on to the caller
                answer.put(([], error))

        threading.Thread(target=ask, daemon=True).start()
        try:
            chosen, error = answer.get(timeout=self.seconds)
        except queue.Empty:
            self.late += 1
            raise TimeoutError(f"the recogniser took more than {self.seconds} s") from None
        if error:
            raise error
        return chosen


def candidates(text: str, surnames: tuple[str, ...] = SURNAMES) -> list[tuple[int, int]]:
    """Spans that start with a family name, with up to GIVEN characters of a given name; the search goes on after the family name."""
    family = "|".join(map(re.escape, sorted(surnames, key=len, reverse=True)))
    pattern = re.compile(f"({family})(?:[ 　]?(?:{_RUNE}){{1,{GIVEN}}})?")
    out, at = [], 0
    while m := pattern.search(text, at):
        out.append(m.span())
        at = m.end(1)
    return out


def untouched(spans: list[tuple[int, int]], base: list[dict]) -> list[tuple[int, int]]:
    """The spans that touch none of the base findings, which may come in any order."""
    taken = sorted((b["start"], b["end"]) for b in base)
    starts, furthest = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    return [s for s in spans if not (before := bisect_left(starts, s[1])) or furthest[before - 1] <= s[0]]


def with_names(base: list[dict], text: str, recognise: Recogniser, surnames: tuple[str, ...] = SURNAMES) -> list[dict]:
    """The base findings and the confirmed names that touch none of them.

    Every candidate is asked about, ``CANDIDATES_AT_ONCE`` in a question. A question that
    fails gives no names; after a late one this text isn't asked about again.
    """
    free, names = untouched(candidates(text, surnames), base), []
    for lo in range(0, len(free), CANDIDATES_AT_ONCE):
        asked = free[lo : lo + CANDIDATES_AT_ONCE]
        try:
            chosen = recognise(text, [text[a:b] for a, b in asked])
        except TimeoutError:
            break
        except Exception:  # noqa: BLE001  a model's failure must not lose the base findings
            continue
        names += [{"start": asked[i][0], "end": asked[i][1], "text": text[asked[i][0] : asked[i][1]], "rule": NAME_RULE, "category": "pii"} for i in dict.fromkeys(chosen) if 0 <= i < len(asked)]
    out: list[dict] = []
    for f in sorted([*base, *names], key=lambda f: (f["start"], -f["end"])):
        if not out or f["start"] >= out[-1]["end"]:
            out.append(f)
    return out


def findings_with_names(text: Column, recognise: Recogniser = everyone, rules: list[Rule] | None = None, surnames: tuple[str, ...] = SURNAMES, deadline: float | None = None) -> Column:
    """Findings with confirmed names; a question to the recogniser that fails or takes more than ``deadline`` seconds gives none, and the base findings stay."""
    active = build() if rules is None else rules

    @F.pandas_udf(f"array<{FINDING}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detector = Detector(active)
        asked = recognise if deadline is None else Timed(recognise, deadline)
        for texts in in_parts(batches):
            yield texts.map(lambda t: [] if not t else with_names(detector.detect(t), t, asked, surnames))

    return run(text)


def findings(df: DataFrame, id_cols: tuple[str, ...], text_col: str = "text", recognise: Recogniser = everyone) -> DataFrame:
    found = df.select(*id_cols, findings_with_names(F.col(text_col), recognise).alias("f"))
    return found.select(*id_cols, F.explode("f").alias("f")).select(*id_cols, "f.*")
