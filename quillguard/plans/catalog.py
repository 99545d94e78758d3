"""The registered queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard import sources, streaming
from quillguard.functions import rules as R
from quillguard.functions import text as X
from quillguard.operators import audit, cache, compress, detect, governance, guard, harness, json_text, ledger, mask, names, tenancy
from quillguard.operators.stored import stored
from quillguard.plans import fixtures as FX
from quillguard.plans import sql as S
from quillguard.sources import spread

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "payload_decision"
RULES = {r.name: r for r in R.build()}
MODELS = ("gpt-4o-mini-2024", "gpt-4o-latest", "Claude-Sonnet-4-x", "o3-mini", "unlisted-model")
BASELINE = "gpt-4o"

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        _queries[key] = f
        if oracle:
            _oracles[key] = oracle
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet"))


def _talk(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/conversations.parquet"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """The event stream as accounting records."""
    e = _events(spark, sf)
    k = F.get_json_object("props", "$.k").cast("long")
    prompt = F.floor(F.col("value") * 10).cast("long")
    return e.select(
        "event_id", "ts", F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("tenant"), F.when(F.col("event_type") == "click", "local").when(F.col("event_type") == "view", "cache").otherwise("cloud").alias("route"),
        F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("event_id") % len(MODELS) + 1).cast("int")).alias("model"), (prompt * 3).alias("baseline_tokens"), prompt.alias("prompt_tokens"), k.alias("completion_tokens"), (F.col("event_id") % 3 != 0).alias("reported"),
    )


RECORDS = (
    "SELECT event_id, ts, 't' || (user_id % 10) AS tenant, CASE event_type WHEN 'click' THEN 'local' WHEN 'view' THEN 'cache' ELSE 'cloud' END AS route, "
    f"[{', '.join(S.quote(m) for m in MODELS)}][(event_id % {len(MODELS)} + 1)::INT] AS model, 3 * floor(value * 10)::BIGINT AS baseline_tokens, floor(value * 10)::BIGINT AS prompt_tokens, "
    "(props->>'$.k')::BIGINT AS completion_tokens, event_id % 3 <> 0 AS reported FROM events"
)
BOOK = "(VALUES " + ", ".join(f"({i}, '{m}', {a}, {b})" for i, (m, a, b) in enumerate(ledger.PRICES)) + ") AS b(no, prefix, ri, ro)"
MATCHED = f"(SELECT model, arg_max(ri, (length(prefix), -no)) AS ri, arg_max(ro, (length(prefix), -no)) AS ro FROM (SELECT DISTINCT model FROM ({RECORDS})) JOIN {BOOK} ON starts_with(lower(trim(model)), prefix) GROUP BY model)"
ACCOUNTED = (
    f"SELECT *, CASE WHEN route <> 'cloud' THEN baseline_tokens ELSE greatest(0, baseline_tokens - prompt_tokens) END AS tokens_saved, greatest(0.0, bc - c) AS cost_saved FROM (SELECT r.*, baseline_tokens / 1e6 * 2.5 + completion_tokens / 1e6 * 10.0 AS bc, "
    f"CASE WHEN route <> 'cloud' THEN 0.0 ELSE coalesce(prompt_tokens / 1e6 * ri + completion_tokens / 1e6 * ro, 0.0) END AS c FROM ({RECORDS}) r LEFT JOIN {MATCHED} m USING (model))"
)
TOTALS = (
    "count(*) AS requests, count(*) FILTER (route = 'local') AS local_requests, count(*) FILTER (route = 'cloud') AS cloud_requests, count(*) FILTER (route = 'cache') AS cache_requests, count(*) FILTER (NOT reported) AS estimated, "
    "sum(baseline_tokens)::BIGINT AS baseline_tokens, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(tokens_saved)::BIGINT AS tokens_saved, "
    "round(sum(bc::DECIMAL(30,12)), 6)::DOUBLE AS baseline_cost, round(sum((CASE WHEN route = 'cloud' THEN c ELSE 0.0 END)::DECIMAL(30,12)), 6)::DOUBLE AS cloud_cost, round(sum(cost_saved::DECIMAL(30,12)), 6)::DOUBLE AS cost_saved"
)
DOC_FINDINGS = S.resolved("documents", "doc_id")
TALK_FINDINGS = S.resolved("conversations", "conv_id, turn")


def _rule_query(name: str) -> None:
    pattern = S.quote(RULES[name].pattern)

    @query(f"SELECT doc_id, len(regexp_extract_all(text, {pattern}))::BIGINT AS n FROM documents WHERE regexp_matches(text, {pattern})", f"detect_{name}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return detect.rule_matches(_docs(spark, sf), RULES[name]).groupBy("doc_id").agg(F.count("*").alias("n"))


for _name in ("email", "ipv4", "hex_blob", "large_integer", "url", "unix_path"):
    _rule_query(_name)


@query(f"SELECT doc_id, pos AS start, pos + length(val) AS \"end\", val AS value FROM ({S._pieces('documents', 'doc_id', RULES['credit_card'].pattern, 0)}) WHERE {S._luhn('val')}")
def detect_credit_card(spark: SparkSession, sf: str) -> DataFrame:
    from quillguard.functions.checks import luhn_column

    return detect.rule_matches(_docs(spark, sf), RULES["credit_card"]).filter(luhn_column(F.col("value")))


@query(f"SELECT doc_id, s AS start, e AS \"end\", val AS text, rule, category FROM ({DOC_FINDINGS})")
def findings_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return detect.findings(_docs(spark, sf)).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text", "rule", "category")


@query(f"SELECT category, count(*) AS n FROM ({DOC_FINDINGS}) GROUP BY category")
def leak_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return detect.leak_sweep(_docs(spark, sf), "category")


@query(f"SELECT rule, count(*) AS n FROM ({DOC_FINDINGS}) GROUP BY rule")
def leak_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    return detect.leak_sweep(_docs(spark, sf), "rule")


@query(f"SELECT doc_id, t AS value, bits FROM ({S.entropy('documents', 'doc_id')})")
def entropy_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return detect.entropy_tokens(_docs(spark, sf))


@query(f"SELECT doc_id, {S.tokens('text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT conv_id, (sum({S.tokens('text')} + 4) + 3)::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def token_estimate_messages(spark: SparkSession, sf: str) -> DataFrame:
    return _talk(spark, sf).groupBy("conv_id").agg((F.sum(X.token_estimate(F.col("text")) + 4) + 3).alias("tokens"))


_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_LINES = rf"len(list_filter(string_split({_TRIM}, chr(10)), lambda x: regexp_matches(x, '\S')))"
_CODE = f"regexp_matches({_TRIM}, {S.quote(governance.CODE_MARKERS)})"
_KNOWN = f"(regexp_matches({_TRIM}, {S.quote(governance.SIMPLE_SIGNALS)}) OR regexp_matches({_TRIM}, {S.quote(governance.SIMPLE_SIGNALS_JA)}))"
ROUTE = (
    f"CASE WHEN {_CODE} THEN 'code or configuration' WHEN {_LINES} > 3 THEN 'many templates (' || {_LINES} || ' lines)' WHEN {S.tokens(_TRIM)} > 120 THEN 'large payload (~' || {S.tokens(_TRIM)} || ' tokens)' "
    f"WHEN {_KNOWN} THEN 'known simple error' ELSE 'small payload' END"
)
TARGET = f"CASE WHEN {_CODE} OR {_LINES} > 3 OR {S.tokens(_TRIM)} > 120 THEN 'cloud' ELSE 'local' END"


@query(f"SELECT doc_id, {TARGET} AS target, {ROUTE} AS reason FROM documents")
def route_decision(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", governance.route(F.col("text")).alias("r")).select("doc_id", "r.*")


@query(
    f"SELECT doc_id, coalesce(n, 0)::BIGINT AS n_findings, coalesce(level, 0)::INT AS max_sensitivity, CASE WHEN coalesce(level, 0) > 1 THEN 'local_only' ELSE 'allow' END AS action, CASE WHEN coalesce(level, 0) > 1 THEN 'local' ELSE {TARGET} END AS target, "
    f"{ROUTE} || CASE WHEN coalesce(level, 0) > 1 THEN '; policy: local only' ELSE '' END AS reason, {S.tokens('text')} AS baseline_tokens FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, max({S.LEVEL}) AS level FROM ({DOC_FINDINGS}) GROUP BY doc_id) USING (doc_id)"
)
def payload_decision(spark: SparkSession, sf: str) -> DataFrame:
    return governance.decide(_docs(spark, sf))


@query(f"SELECT action, count(*) AS n FROM (SELECT doc_id, CASE WHEN max(level) > 2 THEN 'deny' WHEN max(level) > 1 THEN 'local_only' ELSE 'allow' END AS action FROM (SELECT doc_id, 0 AS level FROM documents UNION ALL SELECT doc_id, {S.LEVEL} FROM ({DOC_FINDINGS})) GROUP BY doc_id) GROUP BY action")
def policy_counts(spark: SparkSession, sf: str) -> DataFrame:
    return governance.decide(_docs(spark, sf), deny_above=2).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {S.quote(p)}) THEN '{n}' END" for n, p in governance.INJECTION) + "], lambda x: x IS NOT NULL) AS rules FROM conversations")
def ingress_screen(spark: SparkSession, sf: str) -> DataFrame:
    return _talk(spark, sf).select("conv_id", "turn", governance.screen(F.col("text")).alias("rules"))


@query(f"WITH p AS (SELECT conv_id, turn, max(level)::INT AS payload_max FROM (SELECT conv_id, turn, 0 AS level FROM conversations UNION ALL SELECT conv_id, turn, {S.LEVEL} FROM ({TALK_FINDINGS})) GROUP BY conv_id, turn) SELECT conv_id, turn, payload_max, max(payload_max) OVER (PARTITION BY conv_id ORDER BY turn) AS session_max FROM p")
def session_running_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return mask.running_sensitivity(_talk(spark, sf))


@query(f"SELECT conv_id, '<V' || row_number() OVER (PARTITION BY conv_id ORDER BY ft, fs) || '>' AS token, original, uses FROM (SELECT conv_id, val AS original, min((turn, s)) AS f, min((turn, s))[1] AS ft, min((turn, s))[2] AS fs, count(*) AS uses FROM ({TALK_FINDINGS}) GROUP BY conv_id, val)")
def dictionary_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return mask.dictionary(_talk(spark, sf)).select("conv_id", "token", "original", "uses")


@query(FX.masked("conversations"))
def masked_text(spark: SparkSession, sf: str) -> DataFrame:
    return mask.mask(_talk(spark, sf)).select("conv_id", "turn", "masked")


@query("SELECT conv_id, turn, text AS hydrated FROM conversations")
def hydrate_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    found = mask.detected(_talk(spark, sf))
    words = mask.dictionary(found)
    return mask.hydrate(mask.mask(found, words=words), words).select("conv_id", "turn", "hydrated")


# a session is masked by first use, which is the order of its shape too
@query(f"SELECT conv_id, sha256('model-a' || chr(0) || string_agg(masked || chr(0), '' ORDER BY turn) || 't=0.2000m=256') AS cache_key FROM ({FX.masked('conversations')}) GROUP BY conv_id")
def shape_keys(spark: SparkSession, sf: str) -> DataFrame:
    talk = mask.mask(_talk(spark, sf)).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "masked"))), lambda x: x["masked"]).alias("texts"))
    return talk.select("conv_id", X.cache_key(F.lit("model-a"), X.shape(F.col("texts")), F.lit(0.2), F.lit(256)).alias("cache_key"))


@query("SELECT conv_id, sha256('model-a' || chr(0) || string_agg(text || chr(0), '' ORDER BY turn) || 't=0.2000m=256') AS cache_key FROM conversations GROUP BY conv_id")
def text_keys(spark: SparkSession, sf: str) -> DataFrame:
    talk = _talk(spark, sf).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    return talk.select("conv_id", X.cache_key(F.lit("model-a"), F.col("texts"), F.lit(0.2), F.lit(256)).alias("cache_key"))


_LINE = "SELECT source AS file, line FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''"


@query(
    f"WITH l AS ({_LINE}), c AS (SELECT file, line, count(*) AS n FROM l GROUP BY ALL), f AS (SELECT file, sum(n)::BIGINT AS lines, count(*) AS texts, count(*) AS shapes, count(*) FILTER (n = 1) AS singletons FROM c GROUP BY file), "
    "a AS (SELECT * FROM f UNION ALL SELECT 'ALL', sum(lines)::BIGINT, sum(texts)::BIGINT, sum(shapes)::BIGINT, sum(singletons)::BIGINT FROM f) "
    "SELECT *, round((lines - texts) / lines, 6) AS text_hit_rate, round((lines - shapes) / lines, 6) AS shape_hit_rate, round(singletons / lines, 6) AS headroom FROM a"
)
def cache_hit_rates(spark: SparkSession, sf: str) -> DataFrame:
    return cache.hit_rates(cache.shaped_lines(_docs(spark, sf), "source", "text"), "source")


@query()
def cache_hit_rates_masked(spark: SparkSession, sf: str) -> DataFrame:
    docs = mask.mask(_docs(spark, sf).withColumn("turn", F.lit(0)), "source", ("doc_id",))
    return cache.hit_rates(cache.shaped_lines(docs, "source", "masked"), "source")


_OPS = "SELECT event_id, 'k' || (user_id % 40) AS k, ts, event_type IN ('signup', 'purchase') AS put FROM events"


@query(f"WITH o AS ({_OPS}) SELECT g.event_id, p.ts AS put_at, coalesce(g.ts - p.ts <= INTERVAL 15 MINUTE, false) AS hit FROM (SELECT * FROM o WHERE NOT put) g ASOF LEFT JOIN (SELECT * FROM o WHERE put) p ON g.k = p.k AND g.ts >= p.ts")
def cache_lookups(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("event_id", F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("k"), "ts", F.col("event_type").isin("signup", "purchase").alias("put"))
    return cache.lookups(e, "k", "ts", "put", 900, "event_id").select("event_id", "put_at", "hit")


@query(f"WITH o AS ({_OPS}), h AS (SELECT coalesce(g.ts - p.ts <= INTERVAL 15 MINUTE, false) AS hit FROM (SELECT * FROM o WHERE NOT put) g ASOF LEFT JOIN (SELECT * FROM o WHERE put) p ON g.k = p.k AND g.ts >= p.ts) SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM h")
def cache_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return cache.statistics(cache_lookups(spark, sf))


@query()
def drain_templates(spark: SparkSession, sf: str) -> DataFrame:
    return compress.templates(_docs(spark, sf))


@query()
def bench_stage_tokens(spark: SparkSession, sf: str) -> DataFrame:
    # each stage reads the one before it several times, so it is written once
    docs = stored(mask.mask(_docs(spark, sf).select("doc_id", "text").withColumn("turn", F.lit(0)), "doc_id"), "masked")
    folded = mask.fold_references(stored(compress.templated(docs, text_col="masked"), "templated"), text_col="templated")
    return compress.stage_report(folded.withColumn("pruned", compress.pruned(F.col("folded"))), ["text", "masked", "templated", "folded", "pruned"])


_DOT = S.quote(mask.DOTTED)


@query(f"SELECT doc_id, identifier, count(*) AS uses FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_DOT})) AS identifier FROM documents) WHERE length(identifier) >= 16 GROUP BY ALL HAVING count(*) >= 2")
def refdict_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return mask.reference_candidates(_docs(spark, sf)).drop("token")


@query()
def guard_findings(spark: SparkSession, sf: str) -> DataFrame:
    return guard.inspect(_talk(spark, sf)).select("conv_id", "turn", F.explode("guard_findings").alias("f")).select("conv_id", "turn", "f.*")


@query()
def guard_withheld(spark: SparkSession, sf: str) -> DataFrame:
    return guard.withheld(_talk(spark, sf)).select("conv_id", "turn", F.col("withheld").alias("text"))


def _accounted(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.accounted(_records(spark, sf), ledger.price_book(spark), BASELINE)


@query(f"SELECT {TOTALS}, 0::BIGINT AS unpriced FROM ({ACCOUNTED})")
def ledger_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.totals(_accounted(spark, sf))


@query(f"SELECT tenant, {TOTALS} FROM ({ACCOUNTED}) GROUP BY tenant")
def ledger_by_tenant(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.by_tenant(_accounted(spark, sf))


@query(f"SELECT route, count(*) AS requests, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM ({RECORDS}) GROUP BY route")
def route_shares(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.route_shares(_records(spark, sf))


@query(f"SELECT tenant, date_trunc('minute', ts) AS minute, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens FROM ({RECORDS}) GROUP BY ALL")
def spend_per_minute(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.per_minute(_records(spark, sf))


@query(f"SELECT tenant, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens FROM ({RECORDS}) WHERE date_trunc('minute', ts) >= TIMESTAMP '2024-01-15 06:30:00' GROUP BY tenant")
def consumed_since(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.consumed(ledger.per_minute(_records(spark, sf)), F.lit("2024-01-15 06:30:20").cast("timestamp"))


@query(f"SELECT m.model, ri AS rate_in, ro AS rate_out FROM (SELECT DISTINCT model FROM ({RECORDS})) m LEFT JOIN {MATCHED} x ON x.model = m.model")
def price_longest_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.priced(_records(spark, sf).select("model").distinct(), ledger.price_book(spark), "model")


_PERIOD = "date_trunc('month', ts + INTERVAL 9 HOUR) - INTERVAL 9 HOUR"


@query(f"SELECT tenant, {_PERIOD} AS period, count(*) AS requests, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(baseline_tokens)::BIGINT AS baseline_tokens FROM ({RECORDS}) GROUP BY ALL")
def budget_periods(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.per_period(_records(spark, sf))


# The first request that finds the budget spent is refused, and so are all after it, so spending before tells admission.
@query(f"WITH r AS (SELECT *, {_PERIOD} AS period FROM ({RECORDS})) SELECT event_id, coalesce(sum(prompt_tokens) OVER (PARTITION BY tenant, period ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 20000 AS admitted FROM r")
def budget_admissions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf).select("event_id", "ts", "tenant", "prompt_tokens", ledger.period_start(F.col("ts")).alias("period"))
    return ledger.budget(rows, "tenant", "period", "ts", "event_id", "prompt_tokens", 20_000).select("event_id", "admitted")


@query(
    f"WITH RECURSIVE r AS MATERIALIZED (SELECT event_id, ts, tenant, row_number() OVER (PARTITION BY tenant ORDER BY ts, event_id) AS i FROM ({RECORDS})), s AS (SELECT tenant, i, event_id, ts, 2.0::DOUBLE AS level, true AS allowed FROM r WHERE i = 1 UNION ALL "
    "SELECT tenant, i, event_id, ts, CASE WHEN l >= 1 THEN l - 1 ELSE l END, l >= 1 FROM (SELECT r.tenant, r.i, r.event_id, r.ts, least(3.0::DOUBLE, s.level + (epoch(r.ts) - epoch(s.ts)) / 60.0 * 0.02::DOUBLE) AS l FROM s JOIN r ON r.tenant = s.tenant AND r.i = s.i + 1)) SELECT event_id, allowed FROM s"
)
def rate_limits(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.rate_limit(_records(spark, sf).select("event_id", "ts", "tenant"), "tenant", "ts", "event_id", 0.02, 3).select("event_id", "allowed")


@query(
    "WITH RECURSIVE r AS MATERIALIZED (SELECT user_id % 4 AS backend, epoch(ts) AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS i FROM events), "
    "s AS (SELECT backend, i, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS failures, NULL::DOUBLE AS opened FROM r WHERE i = 1 UNION ALL "
    "SELECT backend, i, state, CASE WHEN state = 'open' THEN failures WHEN ok THEN 0 ELSE met + 1 END, CASE WHEN state = 'open' THEN opened WHEN NOT ok AND met + 1 >= 2 THEN t END FROM ("
    "SELECT r.backend, r.i, r.t, r.ok, s.failures, s.opened, CASE WHEN s.opened IS NULL THEN 'closed' WHEN r.t - s.opened < 7200 THEN 'open' ELSE 'half_open' END AS state, CASE WHEN s.opened IS NULL THEN s.failures ELSE 1 END AS met FROM s JOIN r ON r.backend = s.backend AND r.i = s.i + 1)) "
    "SELECT backend, state, count(*) AS n FROM s GROUP BY backend, state"
)
def breaker_states(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("event_id", "ts", (F.col("user_id") % 4).alias("backend"), (F.col("event_type") != "error").alias("ok"))
    return ledger.breaker(e, "backend", "ts", "event_id", "ok", 2, 7200.0).groupBy("backend", "state").agg(F.count("*").alias("n"))


@query(f"SELECT route, model, count(*) AS n, round(avg(prompt_tokens), 6) AS mean, round(stddev_pop(prompt_tokens), 6) AS sd, max(prompt_tokens) AS most FROM ({RECORDS}) GROUP BY route, model")
def eval_mean_sd(spark: SparkSession, sf: str) -> DataFrame:
    r = _records(spark, sf).withColumn("k", F.struct("route", "model"))
    return ledger.mean_and_spread(r, "k", "prompt_tokens").select("k.route", "k.model", "n", "mean", "sd", "most")


_EVENT = "'{\"tenant\":\"' || tenant || '\",\"route\":\"' || route || '\",\"prompt_tokens\":' || prompt_tokens || '}'"


@query(f"SELECT tenant, row_number() OVER (PARTITION BY tenant ORDER BY ts, event_id) AS seq, {_EVENT} AS event, sha256({_EVENT}) AS event_hash FROM ({RECORDS})")
def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.numbered(_records(spark, sf).withColumn("event", audit.event_json(["tenant", "route", "prompt_tokens"])), ["ts", "event_id"], "tenant")
    return rows.select("tenant", "seq", "event", F.sha2("event", 256).alias("event_hash"))


@query(f"SELECT tenant, count(*) AS records, 0::BIGINT AS dropped, NULL::BIGINT AS first_break, 1::BIGINT AS first_seq, count(*) AS last_seq FROM ({RECORDS}) GROUP BY tenant")
def hash_chain_verify(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.numbered(_records(spark, sf), ["ts", "event_id"], "tenant").select("tenant", "seq", F.col("ts").cast("string").alias("ts"), F.lit("request").alias("kind"), audit.event_json(["route", "prompt_tokens"]).alias("event"), F.lit(0).cast("long").alias("dropped"))
    return audit.report(audit.verify(audit.chain(rows, "tenant"), "tenant"), "tenant").drop("head")


@query(f"SELECT event_id FROM (SELECT event_id, max(ts) OVER (PARTITION BY event_id // 100) AS newest, event_id // 100 AS segment FROM ({RECORDS})) WHERE newest > TIMESTAMP '2024-01-20 00:00:00' OR segment = 0")
def retention_prune(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf).withColumn("segment", F.floor(F.col("event_id") / 100))
    return audit.prune(rows, "segment", "ts", F.lit("2024-01-20").cast("timestamp"), F.lit(0)).select("event_id")


@query(f"SELECT 'requests_total{{tenant=\"' || tenant || '\",route=\"' || route || '\"}} ' || count(*) AS line FROM ({RECORDS}) GROUP BY tenant, route")
def metrics_counters(spark: SparkSession, sf: str) -> DataFrame:
    return audit.metrics(_records(spark, sf), "requests_total", ["tenant", "route"])


@query(
    "SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)"
)
def session_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return tenancy.sessions(_events(spark, sf), "user_id", "ts", "event_id").select("event_id", "user_id", "session_no")


@query("SELECT user_id AS stream_id, (event_id % 3)::INT AS index, string_agg(event_type, '' ORDER BY event_id) AS arguments FROM events GROUP BY ALL")
def tool_call_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).cast("int").alias("index"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.col("event_type").alias("args"))
    return sources.tool_calls(e).select("stream_id", "index", "arguments")


@query("SELECT c_custkey, coalesce(CASE n_name WHEN 'JAPAN' THEN 0 WHEN 'FRANCE' THEN 0 END, 1) AS cloud_max FROM customer JOIN nation ON n_nationkey = c_nationkey")
def tenant_overrides(spark: SparkSession, sf: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf}/customer.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("n_name").alias("tenant"))
    tenants = spark.createDataFrame([("JAPAN", 0), ("FRANCE", 0)], "tenant string, cloud_max int")
    return tenancy.with_overrides(customers, tenants, {"cloud_max": 1}).select("c_custkey", "cloud_max")


@query("SELECT s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name NOT IN ('ASIA', 'EUROPE')")
def unmapped_tenants(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("n_nationkey") == F.col("s_nationkey")).join(spark.read.parquet(f"{sf}/region.parquet"), F.col("r_regionkey") == F.col("n_regionkey"))
    mapping = spark.createDataFrame([("ASIA", "a"), ("EUROPE", "e")], "claim string, tenant string")
    return tenancy.mapped_tenant(s.select("s_suppkey", F.array("n_name", "r_name").alias("claims")), mapping)[1].select("s_suppkey")


@query("SELECT doc_id, line_no::INT AS line_no FROM (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(line) <> ''")
def line_scan(spark: SparkSession, sf: str) -> DataFrame:
    return sources.lines(_docs(spark, sf), ("doc_id",)).select("doc_id", "line_no")


@query("SELECT tenant, seq, floor(coalesce(sum(octet_length(encode(event)) + 200) OVER (PARTITION BY tenant ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20000.0)::BIGINT AS segment, seq % 100 = 0 AS checkpoint FROM (SELECT tenant, row_number() OVER (PARTITION BY tenant ORDER BY ts, event_id) AS seq, " + _EVENT + " AS event FROM (" + RECORDS + "))")
def audit_segments(spark: SparkSession, sf: str) -> DataFrame:
    return audit.segments(audit_events(spark, sf), "tenant", 20_000, 100).select("tenant", "seq", "segment", "checkpoint")


@query()
def name_findings(spark: SparkSession, sf: str) -> DataFrame:
    return names.findings(_docs(spark, sf), ("doc_id",))


@query("WITH a AS (SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id)), p AS (SELECT 'q' || quality AS c, quality::DOUBLE AS raw, (n_chars % 7)::DOUBLE AS gated, n_chars AS rt, n_chars // 2 AS gt FROM a) SELECT c AS \"case\", count(*) AS runs, round(avg(raw), 6) AS raw, round(stddev_pop(raw), 6) AS raw_sd, round(avg(gated), 6) AS gated, round(stddev_pop(gated), 6) AS gated_sd, round(avg(gated) - avg(raw), 6) AS delta, round(100.0 * (sum(rt) - sum(gt)) / sum(rt), 6) AS saved FROM p GROUP BY c")
def eval_arms(spark: SparkSession, sf: str) -> DataFrame:
    a = spark.read.parquet(f"{sf}/labels.parquet").join(_docs(spark, sf), "doc_id")
    arm = lambda score, tokens: a.select(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("case"), F.col("doc_id").alias("run"), score.cast("double").alias("score"), tokens.alias("tokens"))
    return harness.summary(harness.compared(arm(F.col("quality"), F.col("n_chars")), arm(F.col("n_chars") % 7, F.floor(F.col("n_chars") / 2).cast("long"))))


@query(f"SELECT count(*) * 12 AS calls, (6 * sum({S.tokens('text')}) + 6 * sum({S.tokens('text')} + 1) + count(*) * 2400)::BIGINT AS tokens_in, count(*) * 2760 AS tokens_out, round((6 * sum({S.tokens('text')})) / 1e6 * 2.5 + count(*) * 2400 / 1e6 * 10.0 + (6 * sum({S.tokens('text')} + 1) + count(*) * 2400) / 1e6 * 1.25 + count(*) * 360 / 1e6 * 10.0, 6) AS cost, count(*) FILTER ({TARGET} = 'local') AS local_cases FROM benchmark")
def eval_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    return harness.dry_run(spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("text").alias("prompt"), F.lit("good").alias("rubric")), 3, (2.5, 10.0), (1.25, 10.0))


@query("SELECT conv_id, turn, true AS roundtrip FROM conversations")
def payload_explained(spark: SparkSession, sf: str) -> DataFrame:
    return harness.explain_payload(_talk(spark, sf)).select("conv_id", "turn", "roundtrip")


# Queries over whole tables with a snippet planted in every row, so that each rule finds something.


def _planted(spark: SparkSession, sf: str) -> DataFrame:
    return FX.planted(_talk(spark, sf), FX.TALK_TEXTS)


@query(FX.TALK_SQL + f"SELECT conv_id, turn, s AS start, e AS \"end\", val AS text, rule, category FROM ({S.resolved('fixture', 'conv_id, turn')})")
def fixture_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = detect.findings(_planted(spark, sf), ("conv_id", "turn"))
    return found.select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text", "rule", "category")


@query(FX.TALK_SQL + f"SELECT conv_id, turn, t AS value, bits FROM ({S.entropy('fixture', 'conv_id, turn')})")
def fixture_entropy(spark: SparkSession, sf: str) -> DataFrame:
    rows = _planted(spark, sf).withColumn("id", F.struct("conv_id", "turn"))
    return detect.entropy_tokens(rows, "id").select("id.*", "value", "bits")


@query(FX.TALK_SQL + f"SELECT conv_id, token, original, uses FROM ({FX.dictionary(S.resolved('fixture', 'conv_id, turn'))})")
def fixture_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return mask.dictionary(_planted(spark, sf)).select("conv_id", "token", "original", "uses")


@query(FX.TALK_SQL + FX.masked("fixture"))
def fixture_masked(spark: SparkSession, sf: str) -> DataFrame:
    return mask.mask(_planted(spark, sf)).select("conv_id", "turn", "masked")


_STRONGEST = f"(SELECT conv_id, val, max({S.LEVEL}) AS level FROM f GROUP BY conv_id, val)"


@query(
    FX.TALK_SQL.rstrip() + f", f AS ({S.resolved('fixture', 'conv_id, turn')}), r AS (SELECT conv_id, turn, count(DISTINCT val) AS n_distinct, count(*) AS n_total, max(level) AS level FROM f JOIN {_STRONGEST} USING (conv_id, val) GROUP BY conv_id, turn) "
    "SELECT conv_id, turn, text AS hydrated, coalesce(n_distinct, 0)::INT AS n_distinct, coalesce(n_total, 0)::INT AS n_total, coalesce(level, 0)::INT AS level FROM fixture LEFT JOIN r USING (conv_id, turn)"
)
def fixture_hydrated(spark: SparkSession, sf: str) -> DataFrame:
    found = mask.detected(_planted(spark, sf))
    words = mask.dictionary(found)
    return mask.hydrate(mask.mask(found, words=words), words).select("conv_id", "turn", "hydrated", "n_distinct", "n_total", "level")


@query(
    FX.TALK_SQL.rstrip() + f", p AS (SELECT conv_id, turn, max(level)::INT AS payload_max FROM (SELECT conv_id, turn, 0 AS level FROM fixture UNION ALL SELECT conv_id, turn, {S.LEVEL} FROM ({S.resolved('fixture', 'conv_id, turn')})) GROUP BY conv_id, turn) "
    "SELECT conv_id, turn, payload_max, max(payload_max) OVER (PARTITION BY conv_id ORDER BY turn) AS session_max FROM p"
)
def fixture_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return mask.running_sensitivity(_planted(spark, sf))


_COUNTED = ", ".join(f"coalesce(sum(n_{c}) OVER w, 0)::BIGINT AS n_{c}" for c in R.CATEGORIES)


@query(
    FX.TALK_SQL.rstrip() + f", f AS MATERIALIZED ({S.resolved('fixture', 'conv_id, turn')}), v AS (SELECT *, row_number() OVER (PARTITION BY conv_id, val ORDER BY turn, s) = 1 AS new_value, row_number() OVER (PARTITION BY conv_id, rule ORDER BY turn, s) = 1 AS new_rule FROM f), "
    f"r AS (SELECT conv_id, turn, count(*) FILTER (new_value) AS vs, {', '.join(f'count(*) FILTER (category = {S.quote(c)}) AS n_{c}' for c in R.CATEGORIES)}, list(rule) FILTER (new_rule) AS rs, max({S.LEVEL}) AS l FROM v GROUP BY conv_id, turn) "
    f"SELECT conv_id, turn, coalesce(sum(vs) OVER w, 0)::BIGINT AS values, {_COUNTED}, array_to_string(list_sort(flatten(list(coalesce(rs, [])) OVER w)), ',') AS rules, coalesce(max(l) OVER w, 0)::INT AS level FROM fixture LEFT JOIN r USING (conv_id, turn) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
)
def session_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return mask.running_statistics(_planted(spark, sf)).withColumn("rules", F.array_join("rules", ","))


@query()
def session_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return mask.session_dictionary(_planted(spark, sf))[0].select("conv_id", "turn", "numbered")


@query(
    FX.TALK_SQL.rstrip() + f", f AS (SELECT conv_id, turn, count(*) AS n, list_sort(list(DISTINCT rule)) AS rs, max({S.LEVEL}) AS l FROM ({S.resolved('fixture', 'conv_id, turn')}) GROUP BY conv_id, turn) "
    f"SELECT conv_id, turn, {S.tokens('text')} AS tokens, coalesce(n, 0)::INT AS n_findings, coalesce(array_to_string(rs, ','), '') AS rules, coalesce(l, 0)::INT AS level, CASE WHEN coalesce(l, 0) > 2 THEN 'deny' WHEN coalesce(l, 0) > 1 THEN 'local_only' ELSE 'allow' END AS action FROM fixture LEFT JOIN f USING (conv_id, turn)"
)
def compression_view(spark: SparkSession, sf: str) -> DataFrame:
    view, _ = harness.compression_view(_planted(spark, sf), deny_above=2)
    return view.select("conv_id", "turn", "tokens", "n_findings", F.array_join("rules", ",").alias("rules"), "level", "action")


_STEERED = tuple(t for _, _, t in FX.STEERED)


@query(FX.planted_sql(_STEERED) + "SELECT * FROM (SELECT conv_id, turn, unnest([" + ", ".join(f"CASE WHEN regexp_matches(text, {S.quote(p)}) THEN '{n}' END" for n, p in governance.INJECTION) + "]) AS rule FROM fixture) WHERE rule IS NOT NULL")
def fixture_screen(spark: SparkSession, sf: str) -> DataFrame:
    return FX.planted(_talk(spark, sf), _STEERED).select("conv_id", "turn", F.explode(governance.screen(F.col("text"))).alias("rule"))


# what the guard must find for each snippet is written by hand; the conversations themselves hold no command
_GUARDED = tuple(text for text, _ in FX.GUARDED)
_WANTED = "wanted(case_no, rule, severity) AS (VALUES " + ", ".join(f"({i}, '{rule}', '{severity}')" for i, (_, found) in enumerate(FX.GUARDED) for rule, severity in found) + ")"


@query(FX.planted_sql(_GUARDED).rstrip() + f", {_WANTED} SELECT conv_id, turn, rule, severity FROM fixture JOIN wanted USING (case_no)")
def fixture_guard(spark: SparkSession, sf: str) -> DataFrame:
    found = guard.inspect(FX.planted(_talk(spark, sf), _GUARDED))
    return found.select("conv_id", "turn", F.explode("guard_findings").alias("f")).select("conv_id", "turn", "f.rule", "f.severity")


@query(FX.planted_sql(_GUARDED).rstrip() + f", {_WANTED} SELECT rule AS name, CASE rule WHEN 'rm_recursive_force' THEN 'block' ELSE severity END AS severity, count(*) AS n FROM fixture JOIN wanted USING (case_no) GROUP BY ALL")
def guard_rules(spark: SparkSession, sf: str) -> DataFrame:
    changed = {"rm_recursive_force": "block"}
    found = guard.inspect(FX.planted(_talk(spark, sf), _GUARDED), overrides=changed).select(F.explode("guard_findings").alias("f")).groupBy(F.col("f.rule").alias("name")).agg(F.count("*").alias("n"))
    return guard.rule_table(spark, changed).join(found, "name")


_KEPT = ", ".join(S.quote(kept) for _, kept in FX.WITHHELD)


@query(FX.planted_sql(tuple(text for text, _ in FX.WITHHELD)) + f"SELECT conv_id, turn, c.text || chr(10) || [{_KEPT}][case_no + 1] AS text FROM conversations c JOIN (SELECT conv_id, turn, case_no FROM fixture) USING (conv_id, turn)")
def fixture_withheld(spark: SparkSession, sf: str) -> DataFrame:
    return guard.withheld(FX.planted(_talk(spark, sf), tuple(text for text, _ in FX.WITHHELD))).select("conv_id", "turn", F.col("withheld").alias("text"))


_BLOCKED = ", ".join("true" if any(severity == "block" for _, severity in found) else "false" for _, found in FX.GUARDED)


@query(FX.planted_sql(_GUARDED) + f"SELECT f.conv_id * 100 + f.turn AS stream_id, CASE WHEN [{_BLOCKED}][case_no + 1] THEN c.text || chr(10) ELSE f.text END AS released, [{_BLOCKED}][case_no + 1] AS blocked FROM fixture f JOIN conversations c USING (conv_id, turn)")
def guard_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Every answer as a stream of pieces of 40 characters."""
    rows = FX.planted(_talk(spark, sf), _GUARDED).withColumn("stream_id", F.col("conv_id") * 100 + F.col("turn"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.char_length("text") / 40).cast("int")), lambda i: F.substring("text", i * 40 + 1, F.lit(40)))
    deltas = rows.select("stream_id", F.posexplode(pieces).alias("seq", "delta"), F.floor(F.char_length("text") / 40).cast("int").alias("last")).select("stream_id", F.col("seq").cast("long").alias("seq"), "delta", (F.col("seq") == F.col("last")).alias("done"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("seq")).alias("ts"))
    out = streaming.run_to_end(streaming.guard_stream(streaming.pieces(deltas, "deltas", 2, "seq", "stream_id"), late="1 day"), "guarded").withColumn("at", F.monotonically_increasing_id())
    return out.groupBy("stream_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ended", "released"))), lambda x: x["released"]), "").alias("released"), (F.max("sealed") != "").alias("blocked"))


@query(FX.planted_sql(tuple("\n".join(texts) for texts, _ in FX.SHAPED)) + f"SELECT conv_id, turn, c.text || chr(10) || [{', '.join(S.quote(chr(10).join(shapes)) for _, shapes in FX.SHAPED)}][case_no + 1] AS text FROM conversations c JOIN (SELECT conv_id, turn, case_no FROM fixture) USING (conv_id, turn)")
def fixture_shapes(spark: SparkSession, sf: str) -> DataFrame:
    rows = FX.planted(_talk(spark, sf), tuple("\n".join(texts) for texts, _ in FX.SHAPED))
    return rows.select("conv_id", "turn", F.array_join(X.shape(F.split("text", "\n")), "\n").alias("text"))


_NAMED = "wanted(case_no, s, e, name) AS (VALUES " + ", ".join(f"({i}, {a}, {b}, {S.quote(name)})" for i, (_, found) in enumerate(FX.NAMED) for a, b, name in found) + ")"


@query(FX.planted_sql(tuple(text for text, _ in FX.NAMED)).rstrip() + f", {_NAMED} SELECT conv_id, turn, (length(c.text) + 1 + s)::BIGINT AS start, (length(c.text) + 1 + e)::BIGINT AS \"end\", name AS text FROM fixture JOIN wanted USING (case_no) JOIN (SELECT conv_id, turn, text FROM conversations) c USING (conv_id, turn)")
def fixture_names(spark: SparkSession, sf: str) -> DataFrame:
    found = names.findings(FX.planted(_talk(spark, sf), tuple(text for text, _ in FX.NAMED)), ("conv_id", "turn"))
    return found.select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text")


_RULE_ROWS = ", ".join(f"({S.quote(r.name)}, {S.quote(r.category)}, {r.priority})" for r in RULES.values())


@query(FX.TALK_SQL.rstrip() + f", rules(name, category, priority) AS (VALUES {_RULE_ROWS}), f AS (SELECT rule, count(*) AS n FROM ({S.resolved('fixture', 'conv_id, turn')}) GROUP BY rule) SELECT name, category, priority, coalesce(n, 0)::BIGINT AS n FROM rules LEFT JOIN f ON rule = name")
def rule_list(spark: SparkSession, sf: str) -> DataFrame:
    found = detect.leak_sweep(_planted(spark, sf), "rule")
    return R.rules_table(spark, list(RULES.values())).select("name", "category", "priority").join(found, F.col("name") == F.col("rule"), "left").select("name", "category", "priority", F.coalesce("n", F.lit(0)).alias("n"))


_ROLE = "CASE user_id % 3 WHEN 0 THEN 'caller' WHEN 1 THEN 'operator' ELSE 'admin' END"
_NEEDED = "CASE event_type WHEN 'view' THEN 'caller' WHEN 'click' THEN 'caller' WHEN 'error' THEN 'operator' ELSE 'admin' END"


@query(f"SELECT event_id, {_ROLE} AS role, {_NEEDED} AS needed, list_position(['caller', 'operator', 'admin'], {_ROLE}) >= list_position(['caller', 'operator', 'admin'], {_NEEDED}) AS ok FROM events")
def role_access(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("event_id", F.expr(_ROLE).alias("role"), F.expr(_NEEDED).alias("needed"))
    return e.withColumn("ok", tenancy.allowed(F.col("role"), F.col("needed")))


_REASONS = "MAP {" + ", ".join(f"'{k}': {S.quote(v)}" for k, v in guard.REASONS.items()) + "}"


@query(
    FX.planted_sql(_GUARDED).rstrip() + f", {_WANTED}, v AS (SELECT conv_id, turn, arg_min(rule, n) FILTER (severity = 'block') AS b, arg_min(rule, n) FILTER (severity = 'warn') AS w FROM fixture JOIN (SELECT *, row_number() OVER () AS n FROM wanted) USING (case_no) GROUP BY conv_id, turn) "
    f"SELECT conv_id, turn, CASE WHEN b IS NOT NULL THEN printf({S.quote(guard.NOTICES['cut'])}, b, {_REASONS}[b]) ELSE printf({S.quote(guard.NOTICES['warned'])}, w, {_REASONS}[w]) END AS notice FROM v"
)
def guard_notices(spark: SparkSession, sf: str) -> DataFrame:
    found = guard.inspect(FX.planted(_talk(spark, sf), _GUARDED))
    return found.select("conv_id", "turn", guard.answer_notice(F.col("verdict")).alias("notice")).filter("notice is not null")


@query(FX.planted_sql(_STEERED) + "SELECT conv_id, turn, coalesce(" + ", ".join(f"nullif(regexp_extract(text, {S.quote(p)}), '')" for _, p in governance.INJECTION) + ") AS excerpt FROM fixture")
def screen_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return FX.planted(_talk(spark, sf), _STEERED).select("conv_id", "turn", governance.screened(F.col("text"))["excerpt"].alias("excerpt"))


def _tools(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(F.col("text").alias("description"), F.array("role", "text").alias("enum"), F.struct(F.array(F.lit("one"), F.lit("a@b.io")).alias("description"), F.col("turn").alias("n")).alias("k@mail.org"))
    return _planted(spark, sf).select("conv_id", "turn", F.to_json(F.struct(F.col("role").alias("name"), F.array(item, item).alias("items"))).alias("tools"))


_TOOLS = "{'name': role, 'items': [{'description': text, 'enum': [role, text], 'k@mail.org': {'description': ['one', 'a@b.io'], 'n': turn}}, {'description': text, 'enum': [role, text], 'k@mail.org': {'description': ['one', 'a@b.io'], 'n': turn}}]}"


@query(
    FX.TALK_SQL.rstrip() + f", j AS (SELECT conv_id, turn, to_json({_TOOLS}) AS t FROM fixture), n AS (SELECT conv_id, turn, e.key AS k, e.type AS type, e.atom->>'$' AS v, regexp_extract(e.path, '[.](\"[^\"]*\"|[^.\"\\[]+)(\\[[0-9]+\\])*$', 1) AS last FROM j, json_tree(t) e), "
    "s AS (SELECT conv_id, turn, CASE WHEN try_cast(k AS INTEGER) IS NULL THEN k ELSE trim(last, '\"') END AS under, false AS is_key, v AS text FROM n WHERE type = 'VARCHAR' UNION ALL SELECT conv_id, turn, '', true, k FROM n WHERE try_cast(k AS INTEGER) IS NULL AND k IS NOT NULL) "
    "SELECT is_key, under, count(*) AS n, count(DISTINCT text) AS texts FROM (SELECT is_key, CASE WHEN is_key THEN '' ELSE under END AS under, text FROM s) GROUP BY ALL"
)
def tool_strings(spark: SparkSession, sf: str) -> DataFrame:
    rows = json_text.strings_of(_tools(spark, sf), ("conv_id", "turn"), "tools")
    return rows.groupBy("is_key", F.when(F.col("is_key"), "").otherwise(F.col("under")).alias("under")).agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


@query(
    FX.TALK_SQL.rstrip() + f", f AS (SELECT conv_id, turn, count(*) AS n, list(DISTINCT rule) AS rs FROM ({S.resolved('fixture', 'conv_id, turn')}) GROUP BY conv_id, turn) "
    "SELECT conv_id, turn, (2 * coalesce(n, 0) + 2)::BIGINT AS n, len(list_distinct(list_concat(coalesce(rs, []), ['email'])))::INT AS n_rules FROM fixture LEFT JOIN f USING (conv_id, turn)"
)
def tool_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = json_text.classified(_tools(spark, sf), ("conv_id", "turn"), "tools")
    return found.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.countDistinct("rule").cast("int").alias("n_rules"))


@query(f"SELECT row_number() OVER (ORDER BY line) + 1 AS no, line FROM (SELECT 'requests_total{{tenant=\"' || tenant || '\",route=\"' || route || '\"}} ' || count(*) AS line FROM ({RECORDS}) GROUP BY tenant, route) UNION ALL VALUES (0, '# HELP requests_total Requests by tenant and route.'), (1, '# TYPE requests_total counter')")
def metrics_exposition(spark: SparkSession, sf: str) -> DataFrame:
    return audit.exposition(_records(spark, sf), "requests_total", ["tenant", "route"], "Requests by tenant and route.")


# Streams over whole tables: what a batch gives, dealt out in several batches with state between them.


def _stream(df: DataFrame) -> DataFrame:
    return streaming.pieces(df, "events", 3, "ts", "event_id")


@query(_oracles["rate_limits"])
def rate_limit_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(_records(spark, sf).select("event_id", "ts", "tenant"))
    return streaming.run_to_end(streaming.rate_limit_stream(rows, "tenant", "ts", "event_id", 0.02, 3), "limits").select("event_id", "allowed")


@query(_oracles["budget_admissions"])
def budget_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(_records(spark, sf).select("event_id", "ts", "tenant", "prompt_tokens")).withColumn("period", ledger.period_start(F.col("ts")))
    return streaming.run_to_end(streaming.budget_stream(rows, "tenant", "period", "ts", "event_id", "prompt_tokens", 20_000), "budgets").select("event_id", "admitted")


@query(_oracles["breaker_states"])
def breaker_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = _stream(_events(spark, sf).select("event_id", "ts", (F.col("user_id") % 4).alias("backend"), (F.col("event_type") != "error").alias("ok")))
    return streaming.run_to_end(streaming.breaker_stream(e, "backend", "ts", "event_id", "ok", 2, 7200.0), "breakers").groupBy("backend", "state").agg(F.count("*").alias("n"))


@query(_oracles["budget_periods"])
def durable_periods(spark: SparkSession, sf: str) -> DataFrame:
    folder = streaming.shared_folder(spark, "ledger")
    streaming.feed(_stream(_records(spark, sf)), streaming.spend.writer(folder, snapshot_every=2), f"{folder}/state")
    return streaming.spend.periods(spark, folder)


@query(f"SELECT tenant, count(*) AS events, count(*) // 100 AS checkpoints, (count(*) + count(*) // 100)::BIGINT AS last_seq, 0::BIGINT AS problems FROM ({RECORDS}) GROUP BY tenant")
def chain_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = streaming.shared_folder(spark, "chain")
    rows = _stream(_records(spark, sf).withColumn("event", audit.event_json(["tenant", "route", "prompt_tokens"])).select("event_id", "ts", "tenant", "event"))
    streaming.feed(rows, streaming.chain.writer(folder, "tenant", ("ts", "event_id"), every=100, segment_bytes=50_000), f"{folder}/state")
    kept = audit.verify(streaming.chain.records(spark, folder), "by")
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return kept.groupBy(F.col("by").alias("tenant")).agg(of("event").alias("events"), of("checkpoint").alias("checkpoints"), F.max("seq").alias("last_seq"), F.count("problem").alias("problems"))


@query(FX.TALK_SQL + f"SELECT conv_id, count(DISTINCT val) FILTER (turn < 5) AS n_distinct, count(DISTINCT val) AS size, count(DISTINCT val) >= 12 AND count(DISTINCT val) FILTER (turn < 5) / count(DISTINCT val) > 0.8 AS stop FROM ({S.resolved('fixture', 'conv_id, turn')}) GROUP BY conv_id")
def enumeration_stream(spark: SparkSession, sf: str) -> DataFrame:
    """An answer that repeats what was masked in the first turns of its session, sent turn by turn."""
    found = mask.detected(_planted(spark, sf))
    words = mask.dictionary(found)
    lines = mask.mask(found, words=words).filter("turn < 5").select(F.col("conv_id").alias("stream_id"), "conv_id", F.col("turn").alias("seq"), F.col("masked").alias("released"), F.lit(False).alias("done"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn")).alias("ts"))
    told = streaming.run_to_end(streaming.enumeration_stream(streaming.pieces(lines, "lines", 2, "seq", "stream_id"), stored(words, "words"), late="1 day"), "recited")
    return told.groupBy(F.col("stream_id").alias("conv_id")).agg(F.max("n_distinct").alias("n_distinct"), F.max("size").alias("size"), F.max("stop").alias("stop")).filter("size > 0")


def _cache_ops(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    op = F.when(F.col("event_type").isin("signup", "purchase"), "put").otherwise("get")
    return e.select("event_id", "ts", op.alias("op"), F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("k"), F.concat(F.lit("answer "), F.col("event_id").cast("string")).alias("answer"), F.floor(F.col("value")).cast("long").alias("tokens"))


# with room for all, the last put in time answers; the bounded cases are tested against a list kept by hand
@query(f"WITH o AS ({_OPS}) SELECT g.event_id, coalesce(g.ts - p.ts <= INTERVAL 15 MINUTE, false) AS hit FROM (SELECT * FROM o WHERE NOT put) g ASOF LEFT JOIN (SELECT * FROM o WHERE put) p ON g.k = p.k AND g.ts >= p.ts")
def cache_shards(spark: SparkSession, sf: str) -> DataFrame:
    return cache.bounded(_cache_ops(spark, sf), "k", "ts", "event_id", "op", "answer", "tokens", 1000, 900, 8).filter("op = 'get'").select("event_id", "hit")


@query()
def cache_bounded(spark: SparkSession, sf: str) -> DataFrame:
    out = cache.bounded(_cache_ops(spark, sf), "k", "ts", "event_id", "op", "answer", "tokens", 2, 86_400, 8)
    return cache.bounded_statistics(out, "op")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
