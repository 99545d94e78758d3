import re

import pytest
from pyspark.sql import functions as F
from quillguard.operators import harness, names


def test_names():
    text = "担当は佐藤 太郎です。田中さん、林檎 mail a@b.io"
    spans = [text[a:b] for a, b in names.candidates(text)]
    assert spans[0].startswith("佐藤 太郎") and spans[1].startswith("田中")
    base = [{"start": 0, "end": 5, "text": text[:5], "rule": "r", "category": "pii"}]
    kept = names.with_names(base, text, names.everyone)
    assert kept[0] == base[0] and all(a["end"] <= b["start"] for a, b in zip(kept, kept[1:]))
    assert names.with_names(base, text, names.nobody) == base
    assert names.with_names(base, text, lambda t, c: [99]) == base
    assert names.with_names(base, text, lambda t, c: 1 / 0) == base


def test_every_candidate_is_asked_about(spark):
    asked = []

    def recorded(text, found):
        asked.append(len(found))
        return [*range(len(found)), len(found)]

    text = "、".join(f"佐藤太郎 10.0.0.{i % 250}" for i in range(200))
    base = [{"start": m.start(), "end": m.end(), "text": m[0], "rule": "ipv4", "category": "network"} for m in re.finditer("[0-9.]+", text)]
    kept = names.with_names(base, text, recorded)
    assert [(f["rule"], f["text"]) for f in kept] == [x for i in range(200) for x in (("jp_name", "佐藤太郎"), ("ipv4", f"10.0.0.{i % 250}"))]
    assert asked == [64, 64, 64, 8] and [text[f["start"] : f["end"]] for f in kept] == [f["text"] for f in kept]
    # candidates that base findings take up leave room for later ones, in whatever order those come
    first = {"start": 0, "end": text.index("、", 1200), "text": "", "rule": "r", "category": "pii"}
    later = names.with_names([*base[::-1], first], text, names.everyone)
    assert sum(f["rule"] == "jp_name" for f in later) == text[first["end"] :].count("佐藤")
    df = spark.createDataFrame([(1, text), (2, None), (3, "田中がいない")], "id long, text string")
    assert {r.id: (r.n, r["last"]) for r in names.findings(df, ("id",)).filter("rule = 'jp_name'").groupBy("id").agg(F.count("*").alias("n"), F.max("start").alias("last")).collect()} == {1: (200, text.rindex("佐藤")), 3: (1, 0)}


def test_a_question_that_fails_costs_its_own_names_only():
    calls = []

    def failing(error):
        def recognise(text, found):
            calls.append(found)
            if len(calls) == 2:
                raise error
            return list(range(len(found)))

        return recognise

    text = "、".join(["佐藤太郎"] * 200)
    assert len(names.with_names([], text, failing(ValueError()))) == 200 - 64 and len(calls) == 4
    calls.clear()
    # one late text must not use up all that a worker waits for
    assert len(names.with_names([], text, failing(TimeoutError()))) == 64 and len(calls) == 2


def test_judge_replies(spark):
    df = spark.createDataFrame([('Sure: {"score": 8, "reason": "ok"} done',), ("none",)], "t string")
    got = [r[0] for r in df.select(harness.judged(df.t)).collect()]
    assert got[0].score == 8 and (got[1] is None or got[1].score is None)


def test_a_late_recogniser_leaves_the_base_findings(spark):
    import time

    from pyspark.sql import functions as F

    def slow(text, found):
        if "slow" in text:
            time.sleep(5)
        return list(range(len(found)))

    rows = spark.createDataFrame([("担当は佐藤太郎です 10.0.0.5",), ("slow 佐藤太郎 10.0.0.6",)], "t string").coalesce(1)
    began = time.time()
    got = [[f.rule for f in r[0]] for r in rows.select(names.findings_with_names(F.col("t"), slow, deadline=0.5)).collect()]
    assert got == [["jp_name", "ipv4"], ["ipv4"]] and time.time() - began < 30
    late = names.Timed(lambda text, found: time.sleep(1), 0.05, most_late=2)
    for _ in range(3):
        with pytest.raises(TimeoutError):
            late("x", ["y"])
    assert late.late == 2


def test_compression_view_and_seams(spark):
    from pyspark.sql import functions as F

    from quillguard.operators import governance

    df = spark.createDataFrame([(1, 0, "mail a@b.io twice a@b.io"), (1, 1, 'import x\nprint("a@b.io", 7)  # note'), (2, 0, None), (2, 1, "")], "conv_id long, turn long, text string")
    view, words = harness.compression_view(df)
    got = {(r.conv_id, r.turn): r for r in view.collect()}
    assert got[1, 0].compressed == "mail <V1> twice <V1>" and got[1, 0].n_findings == 2 and got[1, 0].rules == ["email"] and got[1, 0].action == "local_only"
    assert got[1, 1].compressed == "import <id> <id> (<str>, <int>)" and got[1, 1].tokens_after < got[1, 1].tokens and got[1, 1].saved > 0
    assert got[2, 0].compressed is None and got[2, 1].saved == 0.0
    assert {(r.original, r.token) for r in words.collect()} == {("a@b.io", "<V1>"), ('"<V1>"', "<V2>"), ("7", "<V3>")}
    told = governance.decide(df, ("conv_id", "turn"), router=lambda t: F.struct(F.lit("cloud").alias("target"), F.lit("mine").alias("reason")), counter=lambda t: F.length(t).cast("long")).collect()
    assert {(r.target, r.reason) for r in told if r.n_findings} == {("local", "mine; policy: local only")} and {r.baseline_tokens for r in told if r.conv_id == 1} == {24, 35}
