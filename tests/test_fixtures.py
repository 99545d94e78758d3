from pyspark.sql import functions as F

from quillguard.functions import shell
from quillguard.functions.rules import ENTROPY_RULE, build
from quillguard.operators import detect, governance, guard, mask
from quillguard.operators.governance import INJECTION
from quillguard.plans import fixtures


def test_every_detection_rule_finds_something(spark):
    found = {r.rule for r in detect.findings(fixtures.talk(spark), ("conv_id", "turn")).collect()}
    # a clock reads as a short IPv6 run, which outranks this rule
    assert found == {r.name for r in build()} - {"timestamp_syslog"} | {ENTROPY_RULE}


def test_every_screen_rule_finds_something(spark):
    rows = fixtures.talk(spark, fixtures.STEERED)
    found = rows.select("turn", F.explode(governance.screen(F.col("text"))).alias("rule")).collect()
    assert {r.rule for r in found} == {n for n, _ in INJECTION} and not {r.turn for r in found} & {7, 8}


def test_every_guard_rule_is_expected_and_found(spark):
    found = guard.inspect(fixtures.numbered(spark, [text for text, _ in fixtures.GUARDED])).select("case_no", F.explode("guard_findings").alias("f")).collect()
    got = [(r.case_no, r.f.rule, r.f.severity) for r in found]
    assert {f[1] for f in got} == {r.name for r in shell.RULES}
    assert sorted(got) == sorted((i, *f) for i, (_, wanted) in enumerate(fixtures.GUARDED) for f in wanted)


def test_values_are_masked(spark):
    masked = {(r.conv_id, r.turn): r.masked for r in mask.mask(fixtures.talk(spark)).collect()}
    assert masked[1, 0] == "disk full on <V1>, mail <V2>" and masked[1, 2].startswith("mail <V2> of pid ") and masked[1, 4] == ""
    assert masked[5, 0] == "ディスク <V1> が満杯、é <V1> と<V2>"


def test_snippets_are_planted_by_id(spark):
    rows = spark.createDataFrame([(c, t, "x") for c in range(3) for t in range(8)], "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): r.text for r in fixtures.planted(rows, ("a", "b", "c")).collect()}
    assert got == {(c, t): "x\n" + "abc"[(8 * c + t) % 3] for c in range(3) for t in range(8)}
