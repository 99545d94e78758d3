import random
import re

import pytest
from pyspark.sql import functions as F

from quillguard.functions import checks, rules
from quillguard.operators import detect

GOOD_CARDS = ["4111111111111111", "4111-1111-1111-1111", "5500 0000 0000 0004", "3782 822463 10005", "3530111333300000"]
BAD_CARDS = ["4111111111111112", "1234567890123456", "1111111111111111"]


@pytest.mark.parametrize(
    "check,value,good",
    [("luhn", v, True) for v in GOOD_CARDS]
    + [("luhn", v, False) for v in BAD_CARDS]
    + [("jp_mynumber", "123456789018", True), ("jp_mynumber", "111122223333", True), ("jp_mynumber", "123456789012", False), ("jp_mynumber", "000000000000", False), ("jp_mynumber", "12345678901", False)]
    + [("jp_corporate_no", "9234567890123", True), ("jp_corporate_no", "1234567890123", False)]
    + [("plausible_secret", "hunter2", True), ("plausible_secret", "<token>", False), ("plausible_secret", "${TOKEN}", False), ("plausible_secret", "xxxx", False), ("plausible_secret", "abc", False)],
)
def test_checks(check, value, good):
    assert checks.CHECKS[check](value) is good


def test_checks_as_expressions(spark):
    rows = spark.createDataFrame([(v,) for v in GOOD_CARDS + BAD_CARDS + ["123456789018", "123456789012", "9234567890123", "1234567890123"]], "v string")
    for row in rows.select("v", checks.luhn_column(F.col("v")).alias("a"), checks.jp_mynumber_column(F.col("v")).alias("b"), checks.jp_corporate_no_column(F.col("v")).alias("c")).collect():
        assert (bool(row.a), bool(row.b), bool(row.c)) == (checks.luhn(row.v), checks.jp_mynumber(row.v), checks.jp_corporate_no(row.v)), row


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2026-06-29 15:04:05", [("large_integer", "2026"), ("ipv6", "15:04:05")]),
        ("2026-06-29T15:04:05Z", [("timestamp_iso8601", "2026-06-29T15:04:05Z")]),
        ("Jun 29 15:04:05", [("ipv6", "15:04:05")]),
        ("従業員1234", [("large_integer", "1234")]),
        ("blk_6952295868487656571", []),
        ("mail a.b@example.com from 10.0.0.5:8080", [("email", "a.b@example.com"), ("ipv4", "10.0.0.5:8080")]),
        ("db-1.tokyo.internal down", [("internal_hostname", "db-1.tokyo.internal")]),
        ("postgres://app:s3cr" + "etpw@db/x", [("dsn_password", "s3cr" + "etpw")]),
        ('token = "04dbebab91ab85687d33"', [("key_value", "04dbebab91ab85687d33")]),
        ("AWS_REGION=ap-northeast-1", []),
        ("key AKIA" + "ABCDEFGHIJKLMNOP", [("aws_access_key", "AKIA" + "ABCDEFGHIJKLMNOP")]),
        ("", []),
    ],
)
def test_detect(text, expected):
    found = detect.Detector(rules.build()).detect(text)
    assert [(f["rule"], f["text"]) for f in found] == expected
    assert all(text[f["start"] : f["end"]] == f["text"] for f in found)


def test_resolve_against_brute_force():
    import random

    random.seed(3)
    for _ in range(200):
        spans = []
        for order in range(random.randint(0, 12)):
            a = random.randint(0, 30)
            b = a + random.randint(1, 8)
            spans.append((a, b, "x" * (b - a), "r", "pii", random.choice([10, 20, 60]), order))
        kept = []
        for c in sorted(spans, key=lambda c: (-c[5], -(c[1] - c[0]), c[0], c[6])):
            if not any(c[0] < k[1] and k[0] < c[1] for k in kept):
                kept.append(c)
        assert detect.resolve(spans) == sorted(kept)


def test_native_matches_agree_with_the_detector(spark):
    texts = ["a 10.0.0.1 b 10.0.0.2:80", "従業員12345 x9999", None, "", "no digits", "1234" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("ipv4", "large_integer", "hex_blob"):
        rule = next(r for r in rules.build() if r.name == name)
        want = {(i, m.start(), m[0]) for i, t in enumerate(texts) if t for m in re.finditer(rule.pattern, t, re.ASCII)}
        assert {(r.doc_id, r.start, r.value) for r in detect.rule_matches(df, rule).collect()} == want


def test_entropy():
    key = "aB3dE5fG7hJ9kL1mN2pQ4rS6"
    assert checks.is_secret(key) and not checks.is_secret("a" * 30) and not checks.is_secret("ap-northeast-1")
    assert checks.value_part("AccountKey=Zm9v==") == "Zm9v==" and checks.value_part("A=b") == "b" and checks.value_part("==") == "=="


def test_rule_loading(tmp_path):
    with pytest.raises(ValueError, match="unknown rule pack"):
        rules.load_packs(("nope",))
    with pytest.raises(ValueError, match="duplicate"):
        rules.build(extra=(rules.Rule("email", "pii", 1, "x"),))
    with pytest.raises(ValueError, match="unknown category"):
        rules.build(extra=(rules.Rule("y", "odd", 1, "x"),))
    (tmp_path / "b.json").write_text('{"rules":[{"name":"t1","category":"pii","priority":5,"pattern":"x"}]}')
    (tmp_path / "a.json").write_text('{"name":"z","rules":[{"name":"t2","category":"pii","priority":5,"pattern":"y"}]}')
    assert [r.name for r in rules.load_pack_dir(str(tmp_path))] == ["t1", "t2"]
    assert "email" not in {r.name for r in rules.build(disable=("email",))}


def test_redact_and_sensitivity(spark):
    df = detect.with_findings(spark.createDataFrame([("a@b.io at 10.0.0.1 é",), ("plain",), (None,)], "text string"))
    out = df.select(detect.redact(F.col("text"), F.col("findings"), lambda f: F.concat(F.lit("<"), f["rule"], F.lit(">"))).alias("t"), detect.max_sensitivity(F.col("findings")).alias("s")).collect()
    assert [(r.t, r.s) for r in out] == [("<email> at <ipv4> é", 2), ("plain", 0), (None, 0)]


def test_no_text_with_findings_lacks_a_hint(spark):
    rng = random.Random(5)
    parts = [
        "a.b@c.de", "aa:bb:cc:dd:ee:ff", "fe:dc:ba::", "http://x", "abcdefab-abcd-abcd-abcd-abcdefabcdef", "/var/log", "deadbeefdeadbeef", "東京都港区", "-----BEGIN PRIVATE KEY-----x-----END PRIVATE KEY-----", "AIza" + "x" * 35,
        "ghp_" + "x" * 36, "xoxb-" + "a" * 10, "sk_live_" + "a" * 16, "npm_" + "a" * 36, "sk-" + "a" * 20, "eyJa.b.c", "Bearer abcdefghijkl", "amqp://u:pass@h", "password = hunter", "db.corp", "QwErTyUiOpAsDfGhJkLzXcVbNm", "Jan  1 10:00:00", "plain", "words", " ", "\n", ".", "=",
    ]
    detector, found = detect.Detector(rules.build()), set()
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(3000)]
    passed = {r.text for r in spark.createDataFrame([(t,) for t in texts], "text string").filter(detect.may_hold(F.col("text"), rules.build())).collect()}
    for text in texts:
        hits = detector.detect(text)
        found |= {h["rule"] for h in hits}
        assert not hits or text in passed, text
    assert len(found) >= 18 and len(passed) < len(set(texts))


def test_findings_are_made_in_small_batches():
    import pandas as pd

    from quillguard.operators import detect

    texts = pd.Series([f"t{i}" for i in range(1000)])
    parts = list(detect.in_parts(iter([texts, pd.Series([], dtype=object)])))
    assert max(map(len, parts)) <= detect.ROWS_AT_ONCE and pd.concat(parts).tolist() == texts.tolist()
