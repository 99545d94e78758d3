import re
import zlib
from collections import Counter

import pytest

from quillguard.llm import mixing, native, sharding

ROWS = [(i, f"text {i} " + "w " * (i * 7 % 50), f"s{i % 3}" if i % 11 else None, 1) for i in range(300)]
ROWS += [(7, "same", "s0", 1)] * 5 + [(None, None, "s1", 1), (900, "", None, 1), (901, "x" * 5000, "s2", 1)]
SCHEMA = "doc_id long, text string, source string, size int"


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(native, "BUCKET_ROWS", 20)
    monkeypatch.setattr(sharding, "bits_for", lambda n: native.bits_for(n, 20))
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = sharding.interleave(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and sorted(by) == list(range(16))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    for source in ("s0", "s1", "s2", None):
        n = [sum(r.source == source for r in rows) for rows in by.values()]
        assert max(n) - min(n) <= 2
    again = sharding.interleave(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def level(sizes, cap=3):
    """Resharing the excess by weight until no source is above its cap, step by step."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("rows", [ROWS, ROWS[:4], [(1, "one two", "a", 1), (2, None, "b", 1)], [(1, "w " * 3, "z", 0), (2, "w " * 500, "a", 0), (3, "w " * 400, "b", 0)]])
def test_mixture(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    source = {(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))): s for i, t, s, _ in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        s = source[(r.doc_id, r.size)]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert len(got) == len(rows)
    for s, want in level(sizes).items():
        assert target[s] == pytest.approx(want, abs=1e-6)
        shortest = min((r.size for r in got if r.size and source[(r.doc_id, r.size)] == s), default=0)
        assert abs(taken[s] - want) <= max(shortest, 1)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()))


def test_repeats_whole_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    copies = Counter()
    for r in mixing.mix(df, keep=("doc_id", "text")).collect():
        copies[(r.doc_id, r.text)] += r.copies
    out = Counter((r.doc_id, r.text) for r in mixing.repeat_documents(df).collect())
    assert sum(out.values()) == pytest.approx(sum(copies.values()), rel=0.1) and set(out) <= {(i, t) for i, t, _, _ in ROWS}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sharding.interleave(df).collect() == [] and mixing.mix(df).collect() == [] and mixing.repeat_documents(df).collect() == []


def test_repeats_rows_with_odd_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5, {"k": 1}, 1), (2, "c", "y", 6, None, 2)], "doc_id int, text string, source string, k1 int, `m.x` map<string,int>, copies int")
    out = mixing.repeat_documents(df)
    assert out.columns == df.columns and {r.k1 for r in out.collect()} <= {5, 6}


def test_many_lengths_miss_by_less_than_the_shortest(spark):
    rows = [(i, "w " * (i + 3), f"s{i % 2}", 0) for i in range(900)] + [(5000, "w " * 40_000, "s0", 0)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    for parity in (0, 1):
        mine = [r for r in got if (r.doc_id if r.doc_id < 5000 else 0) % 2 == parity]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 4 and all(0 <= r.copies <= 3 for r in mine)
