import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillguard.functions.rules import CATEGORIES, SENSITIVITY, build
from quillguard.operators import compress, harness, mask
from quillguard.operators.detect import Detector
from quillguard.plans import fixtures

ODD = [
    (None, 0, "no session 10.0.0.5 and a@b.io"), (None, 1, "again 10.0.0.5"),
    (8, 0, "user wrote <V1> and mail a@b.co and <V3>"), (8, 1, "then c@d.co, a@b.co, <V2> <V12345>"), (8, 2, None),
]


def frame(spark, rows):
    return spark.createDataFrame(list(rows), "conv_id long, turn long, text string")


def test_masking_loses_and_leaks_nothing(spark):
    talk = frame(spark, ODD)
    words = mask.dictionary(talk)
    masked = {(r.conv_id, r.turn): r.masked for r in mask.mask(talk).collect()}
    assert masked[None, 0] == "no session <V1> and <V2>" and masked[None, 1] == "again <V1>"
    assert masked[8, 0] == "user wrote <V1> and mail <V4> and <V3>"  # 1 to 3 stand in the texts themselves
    assert masked[8, 1] == "then <V5>, <V4>, <V2> <V12345>" and masked[8, 2] is None
    back = {(r.conv_id, r.turn): r.hydrated for r in mask.hydrate(mask.mask(talk), words).collect()}
    assert back == {(s, t): text for s, t, text in ODD}
    few = mask.mask(talk, words=words.filter("number = 4"))
    assert {(r.conv_id, r.turn): r.masked for r in few.collect()}[8, 0] == "user wrote <V1> and mail <V4> and <V3>"
    assert {(r.conv_id, r.turn): r.masked for r in few.collect()}[None, 0] == "no session <V0> and <V0>"
    assert all(r.roundtrip for r in harness.explain_payload(talk).collect())


def test_the_detector_runs_once(spark):
    plan = mask.mask(frame(spark, ODD))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan  # findings are read from their table


def running(rows):
    """What a session holds after each payload, by going through them in order."""
    detector, out, held = Detector(build()), {}, {}
    for s, t, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        values, counts, fired, level = held.setdefault(s, (set(), Counter(), set(), [0]))
        for f in detector.detect(text):
            values.add(f["text"])
            counts[f["category"]] += 1
            fired.add(f["rule"])
            level[0] = max(level[0], SENSITIVITY[f["category"]])
        out[s, t] = (len(values), *[counts[c] for c in CATEGORIES], sorted(fired), level[0])
    return out


def test_running_statistics(spark):
    rows = [*fixtures.TALK, *ODD]
    got = {(r.conv_id, r.turn): (r["values"], *[r[f"n_{c}"] for c in CATEGORIES], r.rules, r.level) for r in mask.running_statistics(frame(spark, rows)).collect()}
    assert got == running(rows)


CODE = [
    (1, 0, "org.example.service.Main failed at 10.0.0.5; see org.example.service.Main and a.b.c"),
    (1, 1, 'def f(x):\n  return g("10.0.0.5", 7, "plain", 7.5, "plain")\n# org.example.service.Main org.example.service.Main'),
    (1, 2, "mail a@b.io, again org.example.other.Thing org.example.other.Thing 10.0.0.5"),
    (1, 3, 'package main\nfunc h() string { return "a@b.io" + "new" }'),
    (1, 4, "new@host.io and x.example.deep.Name x.example.deep.Name"),
    (2, 0, "literal <V1> #REF1 then org.example.service.Main org.example.service.Main 10.9.9.9"),
    (2, 1, 'import x\nprint("see <V1>", 10, "v 10.9.9.9")'),
    (None, 0, "a@b.io 10.9.9.9"), (None, 1, "nothing"), (3, 0, ""), (3, 1, None),
]


def sequential(rows):
    """numbered text of each payload and token of each value, by one dictionary and all stages in turn."""
    detector, texts, tokens = Detector(build()), {}, {}
    for s in {r[0] for r in rows}:
        mine = sorted((t, text) for x, t, text in rows if x == s and text is not None)
        taken = {k: {int(n) for _, text in mine for n in re.findall(p, text)} for k, p in (("var", r"<V(\d+)>"), ("ref", r"#REF(\d+)"))}
        known, last = {}, {"var": 0, "ref": 0}

        def token(value, kind):
            if value not in known:
                last[kind] += 1
                while last[kind] in taken[kind]:
                    last[kind] += 1
                known[value] = f"<V{last[kind]}>" if kind == "var" else f"#REF{last[kind]}"
            return known[value]

        for t, text in mine:
            out, end = [], 0
            for f in detector.detect(text):
                out += [text[end : f["start"]], token(f["text"], "var")]
                end = f["end"]
            text = "".join(out) + text[end:]
            uses = Counter(m for m in re.findall(mask.DOTTED, text, re.A) if len(m) >= mask.MIN_LENGTH)
            text = re.sub(mask.DOTTED, lambda m: token(m[0], "ref") if uses[m[0]] >= mask.MIN_USES else m[0], text, flags=re.A)
            language = "go" if re.search(compress.GO_MARK, text) else "python" if re.search(compress.PYTHON_MARK, text) else None
            for value in compress.values_of(text, language) if language else []:
                token(value, "var")
            texts[s, t] = text
        tokens |= {(s, v): k for v, k in known.items()}
    return texts, tokens


@pytest.mark.parametrize("rows", [CODE, [*fixtures.TALK, *ODD]])
def test_one_dictionary_over_all_stages(spark, rows):
    payloads, words = mask.session_dictionary(frame(spark, rows))
    texts, tokens = sequential(rows)
    assert {(r.conv_id, r.turn): r.numbered for r in payloads.collect() if r.numbered is not None} == texts
    assert {(r.conv_id, r.original): r.token for r in words.collect()} == tokens
    assert payloads.filter(F.col("text").isNull() & F.col("numbered").isNotNull()).count() == 0
