"""The batch harness: compared arms, verdicts, and what a run would cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.functions.text import token_estimate
from quillguard.operators import mask
from quillguard.operators.compress import pruned
from quillguard.operators.detect import max_sensitivity
from quillguard.operators.governance import override, policy, route
from quillguard.operators.json_text import first_object
from quillguard.operators.stored import stored

# What a dry run assumes of one case and run.
CALLS, ANSWER_TOKENS, VERDICT_TOKENS = 4, 400, 60


def judged(reply: Column) -> Column:
    """score and reason of a judge's reply, whatever stands around its JSON."""
    return first_object(reply, "score double, reason string")


def compared(raw: DataFrame, gated: DataFrame) -> DataFrame:
    """Both arms of a case and run, or neither."""
    return raw.select("case", "run", F.col("score").alias("raw"), F.col("tokens").alias("raw_tokens")).join(gated.select("case", "run", F.col("score").alias("gated"), F.col("tokens").alias("gated_tokens")), ["case", "run"])


def summary(pairs: DataFrame) -> DataFrame:
    """Per case: mean and population deviation of both arms, their difference, tokens saved."""
    r = lambda c: F.round(c, 6)
    saved = 100.0 * (F.sum("raw_tokens") - F.sum("gated_tokens")) / F.sum("raw_tokens")
    return pairs.groupBy("case").agg(F.count("*").alias("runs"), r(F.avg("raw")).alias("raw"), r(F.stddev_pop("raw")).alias("raw_sd"), r(F.avg("gated")).alias("gated"), r(F.stddev_pop("gated")).alias("gated_sd"), r(F.avg("gated") - F.avg("raw")).alias("delta"), r(saved).alias("saved"))


def dry_run(cases: DataFrame, repeat: int, answer_price: tuple[float, float], judge_price: tuple[float, float]) -> DataFrame:
    """Calls, tokens, cost and locally routed cases of an evaluation that isn't run."""
    sized = cases.select(token_estimate(F.col("prompt")).alias("p"), token_estimate(F.col("rubric")).alias("r"), (route(F.col("prompt"))["target"] == "local").alias("local"))
    sums = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"), F.count_if("local").alias("local_cases"))
    n = F.col("n") * repeat * 2
    answer_in, judge_in = repeat * 2 * F.col("p"), repeat * 2 * (F.col("p") + F.col("r")) + n * ANSWER_TOKENS
    price = lambda i, o, rate: i / 1e6 * rate[0] + o / 1e6 * rate[1]
    cost = price(answer_in, n * ANSWER_TOKENS, answer_price) + price(judge_in, n * VERDICT_TOKENS, judge_price)
    return sums.select((F.col("n") * repeat * CALLS).alias("calls"), (answer_in + judge_in).alias("tokens_in"), (n * (ANSWER_TOKENS + VERDICT_TOKENS)).alias("tokens_out"), F.round(cost, 6).alias("cost"), "local_cases")


def explain_payload(df: DataFrame, session: str = "conv_id", order: tuple[str, ...] = ("turn",), text_col: str = "text") -> DataFrame:
    """Original, masked, compressed and hydrated text of each payload, with findings, route and a round-trip flag.

    Holds what masking hides: for debugging only, never for a sink.
    """
    found = mask.detected(df, text_col)
    words = stored(mask.dictionary(found, session, order, text_col), "words")
    masked = mask.mask(found, session, order, text_col, words=words, keep_findings=True)
    back = mask.hydrate(masked, words, session)
    return back.select(session, *order, F.col(text_col).alias("original"), "masked", "hydrated", "findings", route(F.col("masked")).alias("route"), F.col("hydrated").eqNullSafe(F.col(text_col)).alias("roundtrip"))


def compression_view(df: DataFrame, session: str = "conv_id", order: tuple[str, ...] = ("turn",), text_col: str = "text", cloud_max: int = 1, deny_above: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What all stages make of each payload, and the dictionary that goes with it.

    Payloads have the text after the stages, tokens before and after, the share
    saved, findings by category and rule, their level, and what policy and router
    make of it.  The dictionary is masked data: for its owner only.
    """
    found = mask.detected(df, text_col)
    payloads, words = mask.session_dictionary(found, session, order, text_col)
    before, after = token_estimate(F.col(text_col)), token_estimate(F.col("compressed"))
    level = max_sensitivity(F.col("findings"))
    view = payloads.withColumn("compressed", pruned(F.col("numbered"))).withColumn("level", level).withColumn("policy", policy(F.col("level"), cloud_max, deny_above)).withColumn("routed", override(route(F.col("numbered")), F.col("policy.action")))
    saved = F.when(F.col("tokens") > 0, F.round(100.0 * (F.col("tokens") - F.col("tokens_after")) / F.col("tokens"), 6)).otherwise(0.0)
    shown = view.select(session, *order, "compressed", before.alias("tokens"), after.alias("tokens_after"), F.size("findings").alias("n_findings"), F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["rule"]))).alias("rules"), "level", F.col("policy.action").alias("action"), F.col("routed.target").alias("target"), F.col("routed.reason").alias("reason"))
    return shown.withColumn("saved", saved), words
