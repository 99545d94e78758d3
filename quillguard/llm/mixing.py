"""Mixing sources to target weights by entropy balancing.

Every document gets the rate that is closest to 1 in relative entropy while its
source's words meet the target: exp(lambda x size), held at the copy limit.
Rates depend on source and size only, so the dual is solved over the table of
(source, size) counts: Newton steps, each one distributed aggregation, kept
inside a bracket.  Rates then become whole copies: along a source's classes, from
the longest documents to the shortest, the running sum of copies is rounded, so a
class has the difference of two rounded sums.  What the words of a source then
miss is made up for by a ladder of at most 64 of its classes, one for each power
of two of the length.  Within a class a seeded hash decides who has one copy more.

Sums are taken over decimals, so their order, and with it the cluster's timing,
cannot change a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillguard.llm.native import BUCKET_ROWS, WHITE_RUN, leading, null_last, rank_in, spread
from quillguard.llm.session import cut, fresh, quoted

SEED, MOST_COPIES = 20240302, 3
STEPS, CLOSE = 200, 1e-7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WHITE_RUN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = MOST_COPIES) -> DataFrame:
    """Adds target to a table of __s and source_size (one row a source).

    Weights 1, 2, 3 repeat over the sources by code point.  Resharing the excess
    by weight until no source is above its cap is filling all sources to one
    level of target / weight, so the level is found from running sums over the
    sources in the order in which they reach their cap.
    """
    one = Window.partitionBy(F.lit(0))
    ordered = sizes.withColumn("__w", ((F.row_number().over(one.orderBy("__s")) - 1) % 3 + 1).cast("double")).withColumn("__cap", F.col("source_size").cast("double") * cap)
    by_cap = one.orderBy(F.col("__cap") / F.col("__w"), "__s")
    filled = ordered.withColumn("__used", F.coalesce(F.sum("__cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("__left", F.sum("__w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))).withColumn("__all", F.sum(F.col("source_size").cast("double")).over(one))
    level = (F.col("__all") - F.col("__used")) / F.col("__left")
    found = filled.withColumn("__level", F.min(F.when(level <= F.col("__cap") / F.col("__w"), F.struct((F.col("__cap") / F.col("__w")).alias("at"), level.alias("level")))).over(one)["level"])
    return found.withColumn("target", F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap")))).drop("__used", "__left", "__all", "__level", "__cap")


def solve(classes: DataFrame, goals: DataFrame, cap: int = MOST_COPIES) -> DataFrame:
    """__s, lam, longest: the dual's solution for each source; classes has __s, size, n."""
    state = cut(goals.select("__s", "target", (F.col("source_size").cast("double") * cap).alias("__cap"), F.greatest(F.col("longest"), F.lit(1)).cast("double").alias("longest"), F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")))
    exact = lambda x: F.sum(x.cast("decimal(30,6)")).cast("double")
    for step in range(STEPS):
        z = F.col("size") / F.col("longest")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * z, F.lit(700.0))))
        words = F.col("n") * F.col("size") * rate
        got = classes.join(state.select("__s", "lam", "longest"), "__s").groupBy("__s").agg(exact(words).alias("f"), exact(F.when(rate < cap, words * z).otherwise(0.0)).alias("slope"))
        gap = F.col("target") - F.col("f")
        lo, hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap <= 0, F.col("lam")).otherwise(F.col("hi"))
        moved = state.join(got, "__s").withColumn("lo", lo).withColumn("hi", hi)
        newton = F.col("lam") + gap / F.col("slope")
        between = F.when(F.col("lo").isNull(), F.col("hi") * 2 - F.lit(1.0)).when(F.col("hi").isNull(), F.col("lo") * 2 + 1.0).otherwise((F.col("lo") + F.col("hi")) / 2)
        between = F.when(F.col("lo").isNull() & (F.col("hi") > 0), F.lit(-1.0)).when(F.col("hi").isNull() & (F.col("lo") < 0), F.lit(1.0)).otherwise(between)
        inside = (F.col("slope") > 0) & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        done = (F.abs(gap) <= F.col("target") * CLOSE) | (F.col("target") >= F.col("__cap")) | (F.col("target") <= 0)
        state = cut(moved.select("__s", "target", "__cap", "longest", F.when(done, F.col("lam")).when(inside, newton).otherwise(between).alias("lam"), "lo", "hi", done.alias("done")))
        if state.filter(~F.col("done")).isEmpty():
            break
    else:
        raise RuntimeError(f"the rates still miss their targets after {STEPS} steps")
    return state.select("__s", "target", "__cap", "longest", "lam")


def _copies(classes: DataFrame, solved: DataFrame, cap: int) -> DataFrame:
    """__s, size, n, rate, k: whole copies that each class takes together.

    A source's classes are as many as it has different document lengths; their
    running sums are taken in one ordered pass.  Only its ladder, at most one class
    for each power of two, is gathered in a row.
    """
    rate = F.when(F.col("target") >= F.col("__cap"), F.lit(float(cap))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("longest"), F.lit(700.0)))))
    rated = classes.filter("size > 0").join(solved, "__s").withColumn("rate", rate).withColumn("want", F.col("n") * F.col("rate"))
    longest_first = Window.partitionBy("__s").orderBy(F.desc("size"))
    upto = F.floor(F.sum("want").over(longest_first.rowsBetween(Window.unboundedPreceding, 0)) + 0.5)
    summed = rated.withColumn("upto", upto).withColumn("k", F.col("upto") - F.coalesce(F.lag("upto").over(longest_first), F.lit(0)))
    whole = cut(summed.select("__s", "size", "n", "rate", "target", F.greatest(F.lit(0), F.least(F.lit(cap) * F.col("n"), F.col("k"))).cast("long").alias("k")))
    missed = whole.groupBy("__s").agg((F.first("target") - F.sum(F.col("size") * F.col("k"))).alias("missed"))
    step = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    rungs = whole.groupBy("__s", step.alias("step")).agg(F.min(F.struct("size", "n", "k")).alias("c"))
    ladders = rungs.groupBy("__s").agg(F.sort_array(F.collect_list("c"), asc=False).alias("all")).join(missed, "__s")
    move = f"greatest(-x.k, least({cap} * x.n - x.k, cast(a.rest / x.size + sign(a.rest) * 1e-9 as bigint)))"
    folded = F.expr(f"""aggregate(all, named_struct('rest', missed, 'out', cast(array() as array<struct<size:bigint,more:bigint>>)),
        (a, x) -> named_struct('rest', a.rest - x.size * {move}, 'out', array_append(a.out, named_struct('size', x.size, 'more', {move})))).out""")
    more = ladders.select("__s", F.explode(folded).alias("c")).select("__s", "c.size", "c.more")
    return whole.join(more, ["__s", "size"], "left").select("__s", "size", "n", "rate", (F.col("k") + F.coalesce("more", F.lit(0))).alias("k"))


def mix(df: DataFrame, seed: int = SEED, cap: int = MOST_COPIES, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: kept columns, size, source_size, target, taken, rate, copies.

    Null text has size 0 and takes nothing; null sources form a source of their
    own, last; an empty table gives an empty result; among rows with equal kept
    columns any may have the copy more, which is the same result.  The taken words of a
    source differ from its target by less than its shortest document, as long as
    the copy limit leaves room.  Raises if the rates do not meet their targets.
    Other columns of the input are ignored; the kept ones must not have the names
    of the columns that are added.
    """
    base = cut(df.select(*[F.col(quoted(c)) for c in keep], null_last(source_col).alias("__s"), word_count(F.col(quoted(text_col))).alias("size")).withColumn("__h", spread(*[F.col(quoted(c)) for c in keep], seed=seed)))
    classes = cut(base.groupBy("__s", "size").agg(F.count("*").alias("n")))
    sizes = classes.groupBy("__s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.max("size").alias("longest"))
    goals = cut(targets(sizes, cap))
    chosen = _copies(classes, solve(classes, goals, cap), cap)
    bits = F.when(F.col("n") > BUCKET_ROWS, F.ceil(F.log2(F.col("n") / BUCKET_ROWS))).otherwise(0)
    rows = base.join(chosen, ["__s", "size"], "left").withColumn("__b", leading(F.col("__h"), F.coalesce(bits, F.lit(0))))
    ranked = rank_in(rows, ["__s", "size"], "__b", [F.col("__h"), *[F.col(quoted(c)) for c in keep]], "__r")
    extra = F.when(F.col("__r") <= F.col("k") % F.col("n"), 1).otherwise(0)
    copies = F.coalesce(F.expr("k div n") + extra, F.lit(0)).cast("int")
    out = ranked.withColumn("copies", copies).join(goals.select("__s", "source_size", "target"), "__s")
    return out.select(*[F.col(quoted(c)) for c in keep], "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.coalesce("rate", F.lit(1.0)).alias("rate"), "copies")


def repeat_documents(df: DataFrame, seed: int = SEED, cap: int = MOST_COPIES, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: every row as often as its copies, with its columns as they were, whatever their names."""
    k1, k2, copies, place = fresh(df, "k1", "k2", "copies", "place")
    # maps can't be hashed; as JSON they can
    every = [F.to_json(F.struct(F.col(quoted(f.name)).alias("x"))) if "map<" in f.dataType.simpleString() else F.col(quoted(f.name)) for f in df.schema.fields]
    keyed = df.withColumn(k1, F.xxhash64(F.lit(1), *every)).withColumn(k2, F.xxhash64(F.lit(2), *every))
    plain = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(quoted(text_col)).alias("text"), F.col(quoted(source_col)).alias("source"))
    times = mix(plain, seed, cap, ("k1", "k2")).groupBy("k1", "k2").agg(F.sum("copies").alias("n")).filter("n > 0").select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("n").alias(copies))
    rows = keyed.groupBy(k1, k2).agg(*[F.first(F.col(quoted(c))).alias(c) for c in df.columns])
    return rows.join(times, [k1, k2]).withColumn(place, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(quoted(c)) for c in df.columns])
