"""Session dictionaries: masking, numbering, reference folding, hydration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillguard.functions.rules import CATEGORIES, Rule, to_java
from quillguard.functions.text import PLACEHOLDER, placeholders
from quillguard.operators.compress import code_language, code_values
from quillguard.operators.detect import findings_column, max_sensitivity, redact_at, sensitivity
from quillguard.operators.stored import stored

# What counts as a repeated dotted identifier.
DOTTED = r"\b(?:[A-Za-z_][A-Za-z0-9_]*\.){2,}[A-Za-z_][A-Za-z0-9_]*\b"
MIN_LENGTH, MIN_USES = 16, 2
#: What stands in every text with such an identifier, and is found faster.
_DOTS = r"\.[A-Za-z_][A-Za-z0-9_]*+\.[A-Za-z_]"
#: Number of a row among those whose findings are stored.
ROW = "__row"


def detected(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows with their findings and a number of their own, as a table: the detector runs once for all that reads it."""
    return stored(df.withColumn("findings", findings_column(F.col(text_col), rules)).withColumn(ROW, F.monotonically_increasing_id()), "detected")


def _with_findings(df: DataFrame, text_col: str, rules: list[Rule] | None) -> DataFrame:
    return df if {"findings", ROW} <= set(df.columns) else detected(df, text_col, rules)


def _literals(df: DataFrame, session: str, text_col: str) -> DataFrame:
    """session, taken, taken_refs: numbers of the placeholders that a session's texts hold themselves, ascending."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1)).alias("found")) for kind, pattern in (("var", r"<V(\d{1,9})>"), ("ref", r"#REF(\d{1,9})"))])
    held = df.filter(F.contains(text_col, F.lit("<V")) | F.contains(text_col, F.lit("#REF"))).select(F.col(session).alias("__s"), F.explode(kinds).alias("k")).select("__s", "k.kind", F.explode("k.found").alias("n"))
    distinct = held.select("__s", "kind", F.col("n").cast("long").alias("n")).distinct()
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("n"))))
    return distinct.groupBy("__s").agg(of("var").alias("taken"), of("ref").alias("taken_refs"))


def _free(rank: Column, taken: Column) -> Column:
    """The number of that rank among those that aren't taken."""
    return F.aggregate(F.coalesce(taken, F.array().cast("array<bigint>")), rank.cast("long"), lambda n, x: F.when(x <= n, n + 1).otherwise(n)).cast("int")


def dictionary(df: DataFrame, session: str = "conv_id", order: tuple[str, ...] = ("turn",), text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """session, number, token, original, category, uses: values numbered by first use over the whole session.

    One value keeps one token whatever rules claim it, and its strongest category.
    Rows without a session are one session.  A placeholder that stands in a text
    itself keeps its number: no value gets it, so hydration leaves it alone.
    """
    rows = _with_findings(df, text_col, rules)
    found = rows.select(session, *order, F.explode("findings").alias("f"))
    place = F.struct(*[F.col(c) for c in order], F.col("f.start").alias("start"))
    values = found.groupBy(session, F.col("f.text").alias("original")).agg(F.min(place).alias("first"), F.max(F.struct(sensitivity(F.col("f.category")).alias("level"), F.col("f.category").alias("category")))["category"].alias("category"), F.count("*").alias("uses"))
    ranked = values.withColumn("number", F.row_number().over(Window.partitionBy(session).orderBy("first", "original")))
    literal = _literals(rows, session, text_col)
    numbered = ranked.join(literal, F.col(session).eqNullSafe(F.col("__s")), "left").withColumn("number", _free(F.col("number"), F.col("taken")))
    return numbered.select(session, "number", F.concat(F.lit("<V"), F.col("number").cast("string"), F.lit(">")).alias("token"), "original", "category", "uses")


def substituted(rows: DataFrame, key: str, session: str, values: Column, words: DataFrame, original: str, *wanted: str) -> DataFrame:
    """key, subs: for each of the row's values in order, the columns ``wanted`` of its word (null where there is none).

    Words are joined by (session, value), so that no row carries a session's
    dictionary and no session's words are ever one value.
    """
    asked = rows.select(key, F.col(session).alias("__s"), F.posexplode(values).alias("i", "__v"))
    told = words.select(F.col(session).alias("__ws"), F.col(original).alias("__wv"), F.struct(*wanted).alias("__w"))
    met = asked.join(told, F.col("__s").eqNullSafe(F.col("__ws")) & (F.col("__v") == F.col("__wv")), "left")
    return met.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "__w"))), lambda x: x["__w"]).alias("subs"))


def mask(df: DataFrame, session: str = "conv_id", order: tuple[str, ...] = ("turn",), text_col: str = "text", rules: list[Rule] | None = None, words: DataFrame | None = None, keep_findings: bool = False) -> DataFrame:
    """The rows with a column masked: every finding replaced by its session token.

    A finding without a word (of a dictionary that was given) becomes ``<V0>``,
    never nothing and never itself.
    """
    rows = _with_findings(df, text_col, rules)
    words = dictionary(rows, session, order, text_col) if words is None else words
    subs = substituted(rows.filter(F.size("findings") > 0), ROW, session, F.transform("findings", lambda f: f["text"]), words, "original", "token")
    joined = rows.join(subs, ROW, "left")
    token = lambda f, i: F.coalesce(F.get("subs", i)["token"], F.lit("<V0>"))
    return joined.withColumn("masked", redact_at(F.col(text_col), F.col("findings"), token)).drop("subs", ROW, *([] if keep_findings else ["findings"]))


def hydrate(df: DataFrame, words: DataFrame, session: str = "conv_id", text_col: str = "masked") -> DataFrame:
    """The rows with hydrated text and a report: distinct and total substitutions, strongest sensitivity."""
    rows = stored(df.withColumn(ROW, F.monotonically_increasing_id()), "answers")
    subs = substituted(rows, ROW, session, placeholders(F.col(text_col)), words, "token", "token", "original", "category")
    joined = rows.join(subs, ROW, "left").withColumn("used", F.filter(F.coalesce("subs", F.array().cast(subs.schema["subs"].dataType)), lambda s: s.isNotNull()))
    pieces = F.split(F.col(text_col), PLACEHOLDER, -1)
    told = F.transform(placeholders(F.col(text_col)), lambda p, i: F.coalesce(F.get("subs", i)["original"], p))
    text = F.array_join(F.zip_with(pieces, F.concat(told, F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    level = F.coalesce(F.array_max(F.transform("used", lambda s: sensitivity(s["category"]))), F.lit(0))
    return (
        joined.withColumn("hydrated", F.when(F.size("used") == 0, F.col(text_col)).otherwise(text))
        .withColumn("n_distinct", F.size(F.array_distinct(F.transform("used", lambda s: s["token"]))))
        .withColumn("n_total", F.size("used"))
        .withColumn("level", level)
        .drop("subs", "used", ROW)
    )


def reference_candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Long dotted identifiers that a payload uses at least twice, with their token number."""
    java = to_java(DOTTED)
    found = df.filter(F.col(text_col).rlike(_DOTS)).select(id_col, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(f"({java})"), F.lit(1))).alias("i", "identifier")).filter(F.length("identifier") >= MIN_LENGTH)
    counted = found.groupBy(id_col, "identifier").agg(F.count("*").alias("uses"), F.min("i").alias("first")).filter(F.col("uses") >= MIN_USES)
    return counted.withColumn("number", F.row_number().over(Window.partitionBy(id_col).orderBy("first"))).select(id_col, "identifier", "uses", F.concat(F.lit("#REF"), F.col("number").cast("string")).alias("token"))


def fold_references(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with those identifiers replaced by their tokens, in one pass."""
    return _folded(df, reference_candidates(df, id_col, text_col), id_col, text_col)


def _folded(df: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    java = to_java(DOTTED)
    lookup = named.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("identifier", "token"))).alias("refs"))
    pieces = F.split(F.col(text_col), java, -1)
    hits = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(f"({java})"), F.lit(1)), lambda h: F.coalesce(F.try_element_at(F.col("refs"), h), h))
    folded = F.array_join(F.zip_with(pieces, F.concat(hits, F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return df.join(lookup, id_col, "left").withColumn("folded", F.when(F.col("refs").isNull(), F.col(text_col)).otherwise(folded)).drop("refs")


def running_sensitivity(df: DataFrame, session: str = "conv_id", order: str = "turn", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Sensitivity of each payload and of its session so far."""
    upto = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = df.select(session, order, max_sensitivity(findings_column(F.col(text_col), rules)).alias("payload_max"))
    return found.withColumn("session_max", F.max("payload_max").over(upto))


def enumeration(distinct: Column, size: Column, least: int = 12, share: float = 0.8) -> Column:
    """True where an answer recites most of a dictionary that isn't small."""
    return (size >= least) & (distinct > 0) & (distinct / size > share)



def running_statistics(df: DataFrame, session: str = "conv_id", order: tuple[str, ...] = ("turn",), text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """What each payload's session holds so far: session, order, distinct values, findings by category, rules that fired, level.

    A value counts where its session uses it first, so running counts are sums
    of flags; the rules that have fired are gathered from first occurrences too.
    """
    rows = _with_findings(df, text_col, rules)
    keys = [session, *order]
    found = rows.select(*keys, ROW, F.posexplode("findings").alias("i", "f"))
    first = lambda *by: F.row_number().over(Window.partitionBy(session, *by).orderBy(*order, ROW, "i")) == 1
    flagged = found.withColumn("new_value", first("f.text")).withColumn("new_rule", first("f.rule"))
    count = lambda c: F.count_if(F.col("f.category") == c).alias(f"n_{c}")
    level = F.max(sensitivity(F.col("f.category"))).alias("level")
    by_row = flagged.groupBy(ROW).agg(F.count_if("new_value").alias("values"), *[count(c) for c in CATEGORIES], F.sort_array(F.collect_list(F.when(F.col("new_rule"), F.col("f.rule")))).alias("rules"), level)
    joined = rows.select(*keys, ROW).join(by_row, ROW, "left")
    upto = Window.partitionBy(session).orderBy(*order, ROW).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(upto).alias(c)
    fired = F.array_sort(F.flatten(F.collect_list(F.coalesce("rules", F.array().cast("array<string>"))).over(upto))).alias("rules")
    return joined.select(*keys, total("values"), *[total(f"n_{c}") for c in CATEGORIES], fired, F.max(F.coalesce("level", F.lit(0))).over(upto).alias("level"))


def _renamed(rows: DataFrame, key: str, session: str, text: str, mapping: DataFrame, out: str) -> DataFrame:
    """The rows with ``out``: the text with its placeholders under their final tokens; others stay."""
    subs = substituted(rows, key, session, placeholders(F.col(text)), mapping, "token", "final")
    names = F.transform(placeholders(F.col(text)), lambda p, i: F.coalesce(F.get("subs", i)["final"], p))
    whole = F.array_join(F.zip_with(F.split(F.col(text), PLACEHOLDER, -1), F.concat(names, F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return rows.join(subs, key, "left").withColumn(out, F.when(F.col("subs").isNull(), F.col(text)).otherwise(whole)).drop("subs")


def session_dictionary(df: DataFrame, session: str = "conv_id", order: tuple[str, ...] = ("turn",), text_col: str = "text", rules: list[Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """The payloads with ``numbered`` text, and the one dictionary that all stages of a session share.

    The stages are masking, reference folding and the values of code, one after
    another on each payload, payloads in their order.  A value takes its number
    where it is first substituted, as ``<Vn>`` (findings and code values) or
    ``#REFn`` (references), and keeps that token in all stages after.  Values of
    code stay in ``numbered`` (a skeleton shows their kind), but are numbered all
    the same.  The result is that of going through the stages payload by payload:
    which comes first is decided by one ranking over the substitutions of all
    stages.  A row's place among equal ``order`` is open.
    """
    rows = _with_findings(df, text_col, rules)
    # provisional tokens, one for each value and identifier of a session, tell values apart until all are ranked
    words = dictionary(rows, session, order, text_col)
    masked = stored(mask(rows, session, order, text_col, words=words, keep_findings=True).withColumn(ROW, F.monotonically_increasing_id()), "masked")
    keys = [session, *order, ROW]
    literal = stored(_literals(rows, session, text_col), "literals")
    candidates = stored(reference_candidates(masked, ROW, "masked").withColumn("at", F.regexp_extract("token", r"\d+", 0).cast("int")).drop("token").join(masked.select(*keys), ROW), "references")
    top = F.coalesce(F.array_max("taken_refs"), F.lit(0))
    number = F.row_number().over(Window.partitionBy("__ps").orderBy("identifier"))
    provisional = candidates.select(F.col(session).alias("__ps"), "identifier").distinct().withColumn("n", number).join(literal, F.col("__ps").eqNullSafe(F.col("__s")), "left").select("__ps", F.col("identifier").alias("__id"), F.concat(F.lit("#REF"), (F.col("n") + top).cast("string")).alias("token"))
    named = candidates.join(provisional, F.col(session).eqNullSafe(F.col("__ps")) & (F.col("identifier") == F.col("__id"))).select(ROW, "identifier", "token")
    folded = stored(_folded(masked, named, ROW, "masked").withColumn("code", code_language(F.col("folded"))), "folded")

    place = lambda stage: F.struct(*[F.col(c) for c in order], F.col(ROW).alias("row"), F.lit(stage).alias("stage"), F.col("at").cast("int").alias("at"))
    used = lambda rows, stage, kind, category: rows.select(session, "original", category.alias("category"), F.lit(kind).alias("class"), place(stage).alias("first"))
    shown = masked.select(*keys, F.posexplode(placeholders(F.col("masked"))).alias("at", "token"))
    known = words.select(F.col(session).alias("__ws"), F.col("token").alias("__wt"), "original", "category")
    values = shown.join(known, F.col(session).eqNullSafe(F.col("__ws")) & (F.col("token") == F.col("__wt")))
    code = folded.filter(F.col("code").isNotNull()).select(*keys, F.posexplode(code_values(F.col("folded"), F.col("code"))).alias("at", "original"))
    none = F.lit(None).cast("string")
    every = used(values, 1, "var", F.col("category")).unionByName(used(candidates.withColumnRenamed("identifier", "original"), 2, "ref", none)).unionByName(used(code, 3, "var", none))
    strongest = F.max(F.struct(sensitivity(F.col("category")).alias("level"), F.col("category").alias("category")))["category"]
    each = every.groupBy(session, "original").agg(F.min(F.struct("first", "class")).alias("f"), strongest.alias("category"), F.count("*").alias("uses")).select(session, "original", "category", "uses", "f.first", "f.class")
    rank = F.row_number().over(Window.partitionBy(session, "class").orderBy("first", "original"))
    taken = F.when(F.col("class") == "ref", F.col("taken_refs")).otherwise(F.col("taken"))
    ranked = each.withColumn("number", rank).join(literal, F.col(session).eqNullSafe(F.col("__s")), "left").withColumn("number", _free(F.col("number"), taken))
    token = F.when(F.col("class") == "ref", F.concat(F.lit("#REF"), F.col("number").cast("string"))).otherwise(F.concat(F.lit("<V"), F.col("number").cast("string"), F.lit(">")))
    final = stored(ranked.select(F.monotonically_increasing_id().alias(ROW), session, "original", token.alias("token"), "category", "uses"), "words")

    meant = final.select(F.col(session).alias("__fs"), F.col("original").alias("__fo"), F.col("token").alias("final"))
    both = known.select(F.col("__ws").alias(session), F.col("__wt").alias("token"), "original").unionByName(provisional.select(F.col("__ps").alias(session), "token", F.col("__id").alias("original")))
    mapping = stored(both.join(meant, F.col(session).eqNullSafe(F.col("__fs")) & (F.col("original") == F.col("__fo"))).select(session, "token", "final"), "tokens")
    payloads = _renamed(folded, ROW, session, "folded", mapping, "numbered").drop("masked", "folded", "code", ROW)
    told = _renamed(final, ROW, session, "original", mapping, "__o").withColumn("original", F.col("__o")).drop("__o", ROW)
    return payloads, told
