"""Personal data by fixed patterns and bootstrapped contextual extraction.

Base: e-mail addresses, IPv4 addresses, payment cards and phone numbers by
pattern and check.  Bootstrapping: seed entities are the base finds and tokens
that look like credentials (16 or more letters, digits and signs, at least three
letters and three digits).  What stands around an entity is a lexical pattern:
the two words before it, the word before it, the word after it, or a label that
is glued to it (``password=``, ``id:``).  Every other token with a digit is an
instance that patterns may claim.

Patterns and instances form a graph that is scored in rounds.  A pattern's
confidence is the share of its *whole* filling, ordinary words included, that
is sensitive, each find weighed by its score; it is accepted with enough
confidence and enough different finds.  A seed's score is 1; another value's is
the best confidence of an accepted pattern that holds it.  So values that
accepted patterns bring in induce further patterns in the next round, until
patterns and confidences repeat.
Instances in the place that an accepted pattern points at are reported: as kind
``secret`` if they are seeds, as kind ``id`` if the patterns have discovered them.
All counts are over distinct texts, so copies weigh nothing.

DataFrame functions only.  Matches are counted and placed in rows, not in one
growing array, so a text of very many matches costs linear time.  The patterns
below accept what the fixed ones accept, written so that Java's matcher neither
recurses nor tries a run of characters again from each of its places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillguard.llm.session import cut, fresh, quoted, written

KINDS = ("email", "ip", "card", "phone")
SEEDED, FOUND = "secret", "id"

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WHITE = r"\x20\x09-\x0D"
TOKEN = rf"(?<![^{WHITE}])[^0-9{WHITE}]*+[0-9][^{WHITE}]*+"
WORD_RUN = rf"[{WHITE}]+"
CREDENTIAL = r"^(?=(?:[^0-9]*[0-9]){3})(?=(?:[^A-Za-z]*[A-Za-z]){3})[A-Za-z0-9_+/=-]{16,}$"
#: A label: a letter, up to 39 more letters, digits or _ . -, and = or : at the end.
_LABEL = r"\p{L}[\p{L}\p{N}_.-]{0,39}[=:]"
LABEL_HEAD = rf"^([^\p{{L}}\p{{N}}{WHITE}]*{_LABEL})(?=[^{WHITE}])"
LABELS = rf"(?<![^{WHITE}])[^\p{{L}}\p{{N}}{WHITE}]*+({_LABEL})(?=[^{WHITE}])"
LABEL_TAIL = rf"(?<![^{WHITE}])[^\p{{L}}\p{{N}}{WHITE}]*({_LABEL})[\"']?\z"
#: Stands before a text whose begin is cut off, so that its first word is known to be no whole word.
CUT = "\uffff"
#: One or two whole words at the end of a text, and signs that open the find.
_TAIL = rf"[{WHITE}]++[^\p{{L}}\p{{N}}{WHITE}{CUT}]*+\z"
WORDS_BEFORE = rf"((?:(?<![^{WHITE}])[^{WHITE}{CUT}]++[{WHITE}]++)?(?<![^{WHITE}])[^{WHITE}{CUT}]++){_TAIL}"
TWO_BEFORE = rf"((?<![^{WHITE}])[^{WHITE}{CUT}]++[{WHITE}]++[^{WHITE}{CUT}]++){_TAIL}"
WORD_AFTER = rf"^[^{WHITE}]*+[{WHITE}]++([^{WHITE}]++)"

#: Confidence that a pattern needs, by its sort: two words before, one before, one after, a label.
CONFIDENCE = {"2": 0.8, "1": 0.9, "r": 0.9, "=": 0.8}
#: Different finds that a pattern needs, each weighed by its score.
MIN_FINDS = 3
#: Digits of a confidence, and rounds after which patterns and confidences must repeat; rounds only ever raise them.
DIGITS, ROUNDS = 6, 100


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2")]


def _may_match(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit("@")) if kind == "email" else F.contains(text, F.lit("+")) if kind == "phone" else F.lit(True)


def _part(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def _entry(kind: str, x: Column, i: Column) -> Column:
    """A match with its place among those of its kind, and what stands around it.

    The text before it is taken back to the match before the last one, which for
    tokens always holds two whole words; only if that is not the text's begin and
    the words reach further back (matches of a base kind glued together) do they
    stay unknown.
    """
    reach = F.concat(F.coalesce(x["hit2"], F.lit("")), F.coalesce(x["before1"], F.lit("")), F.coalesce(x["hit1"], F.lit("")), x["before"])
    left = reach if kind == "token" else F.when(i >= 2, F.concat(F.lit(CUT), reach)).otherwise(reach)
    words = F.coalesce(_part(F.concat(F.lit(CUT), F.right(reach, F.lit(200))), TWO_BEFORE), _part(left, WORDS_BEFORE))
    label = F.lit(None).cast("string") if kind == "token" else _part(F.concat(F.lit(CUT), F.right(reach, F.lit(64))), LABEL_TAIL)
    label = label if kind == "token" else F.coalesce(label, F.when(i == 0, _part(reach, LABEL_TAIL)))
    after = _part(F.concat(x["after"], F.coalesce(x["hit_after"], F.lit(""))), WORD_AFTER)
    return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["before"]).alias("gap"), x["hit"].alias("hit"), words.alias("left"), after.alias("right"), label.alias("label"))


def _holds() -> Column:
    digits = F.regexp_replace("hit", "[^0-9]", "")
    n = F.length(digits)
    small = lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False))
    return (
        F.when(F.col("kind") == "ip", F.forall(F.split("hit", r"\."), small))
        .when(F.col("kind") == "card", n.between(12, 19) & F.call_function("luhn_check", F.when(n.between(12, 19), digits).otherwise(F.lit("0"))))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def _finds(texts: DataFrame) -> DataFrame:
    """t1, t2, kind, start, end, hit, left, right, label of base finds and of tokens with a digit; texts are distinct."""
    text = F.col("text")
    patterns = [*PATTERNS.items(), ("token", TOKEN)]
    some = texts.filter(text.rlike("[0-9@]"))
    for kind, pattern in patterns:
        may = _may_match(text, kind)
        some = some.withColumn(f"b_{kind}", F.when(may, F.split(text, pattern, -1))).withColumn(f"h_{kind}", F.when(may, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))))

    def entries(kind: str) -> Column:
        b, h = F.col(f"b_{kind}"), F.col(f"h_{kind}")
        late = lambda x, k: F.concat(F.array_repeat(F.lit(None).cast("string"), k), x)
        next_of = lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))
        zipped = F.arrays_zip(b.alias("before"), h.alias("hit"), late(h, 1).alias("hit1"), late(b, 1).alias("before1"), late(h, 2).alias("hit2"), next_of(b).alias("after"), F.when(F.size(h) > 0, next_of(h)).otherwise(h).alias("hit_after"))
        return F.coalesce(F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), lambda x, i: _entry(kind, x, i)), F.expr("array()").cast("array<struct<kind:string,i:int,gap:int,hit:string,left:string,right:string,label:string>>"))

    rows = some.select("t1", "t2", F.explode(F.flatten(F.array(*[entries(k) for k, _ in patterns]))).alias("m")).select("t1", "t2", "m.*")
    upto = Window.partitionBy("t1", "t2", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    length = F.char_length("hit")
    placed = rows.withColumn("end", F.sum(F.col("gap").cast("long") + length).over(upto)).withColumn("start", F.col("end") - length)
    return placed.filter((F.col("kind") == "token") | _holds()).select("t1", "t2", "kind", "start", "end", "hit", "left", "right", "label")


def _free(finds: DataFrame) -> DataFrame:
    """The tokens that no base find overlaps."""
    base = finds.filter("kind <> 'token'").select("t1", "t2", "start", "end", F.lit(None).cast("string").alias("hit"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"), F.col("end").alias("reach"))
    tokens = finds.filter("kind = 'token'").select("t1", "t2", "start", "end", "hit", "left", "right", F.lit(None).cast("long").alias("reach"))
    by_text = Window.partitionBy("t1", "t2").orderBy("start", F.col("reach").isNull())
    earlier = F.max("reach").over(by_text.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first(F.when(F.col("reach").isNotNull(), F.col("start")), ignorenulls=True).over(by_text.rowsBetween(0, Window.unboundedFollowing))
    ordered = tokens.unionByName(base).withColumn("earlier", earlier).withColumn("later", later)
    return ordered.filter(F.col("reach").isNull() & (F.coalesce("earlier", F.lit(0)) <= F.col("start")) & (F.col("later").isNull() | (F.col("later") >= F.col("end")))).drop("earlier", "later", "reach")


def _value(of: Column) -> Column:
    return F.regexp_replace(of, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _contexts() -> Column:
    """The patterns around a find, from its columns left (one or two words), right and label."""
    before = F.split(F.lower(F.col("left")), WORD_RUN)
    two = F.when(F.size(before) == 2, F.concat(F.lit("2 "), before[0], F.lit(" "), before[1]))
    one = F.concat(F.lit("1 "), F.element_at(before, -1))
    return F.filter(F.array(two, one, F.concat(F.lit("r "), F.lower("right")), F.concat(F.lit("= "), F.lower("label"))), lambda x: x.isNotNull())


def entities(finds: DataFrame) -> DataFrame:
    """t1, t2, start, end, value, seed, base, contexts: base finds, and tokens that may be claimed.

    A token's label is no part of the entity.
    """
    head = F.regexp_extract("hit", LABEL_HEAD, 1)
    rest = F.expr("substring(hit, char_length(head) + 1)")
    tokens = _free(finds).withColumn("head", head).withColumn("label", F.when(F.col("head") != "", F.regexp_replace("head", r"^[^\p{L}\p{N}]+", ""))).withColumn("value", _value(rest))
    tokens = tokens.select("t1", "t2", (F.col("start") + F.char_length("head")).alias("start"), "end", "value", F.col("value").rlike(CREDENTIAL).alias("seed"), F.lit(False).alias("base"), _contexts().alias("contexts"))
    base = finds.filter("kind <> 'token'").select("t1", "t2", "start", "end", _value(F.col("hit")).alias("value"), F.lit(True).alias("seed"), F.lit(True).alias("base"), _contexts().alias("contexts"))
    return base.unionByName(tokens).filter("value <> ''")


def _fillings(texts: DataFrame) -> DataFrame:
    """context: one row for every word of every text and every pattern that it fills."""
    low = F.lower("text")
    words = texts.select(F.split(F.trim(F.regexp_replace(low, WORD_RUN, " ")), " ").alias("w"), F.when(F.contains(low, F.lit("=")) | F.contains(low, F.lit(":")), F.regexp_extract_all(low, F.lit(LABELS), F.lit(1))).alias("labels"))
    n = F.size("w")
    head = lambda k: F.slice("w", F.lit(1), F.greatest(n - k, F.lit(0)))
    two = F.transform(head(2), lambda x, i: F.concat(F.lit("2 "), x, F.lit(" "), F.get("w", i + 1)))
    one = F.transform(head(1), lambda x: F.concat(F.lit("1 "), x))
    after = F.transform(F.slice("w", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x: F.concat(F.lit("r "), x))
    labels = F.coalesce(F.transform("labels", lambda x: F.concat(F.lit("= "), x)), F.expr("array()").cast("array<string>"))
    return words.select(F.explode(F.concat(two, one, after, labels)).alias("context"))


def accepted(found: DataFrame, texts: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """context, trust of the accepted patterns; None if there can be none.  found: ``entities`` of the distinct texts."""
    edges = found.select("value", "seed", F.explode("contexts").alias("context")).groupBy("context", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    # no pattern with fewer values can be accepted; a small table of the others goes to all tasks before words are counted
    able = written(edges.groupBy("context").agg(F.count("*").alias("values"), F.sum("n").alias("most")).filter(F.col("values") >= MIN_FINDS), "patterns")
    if able.isEmpty():
        return None
    total = _fillings(texts).groupBy("context").agg(F.count("*").alias("total")).join(able.select("context"), "context", "left_semi")
    need = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.substring("context", 1, 1))
    open_ = written(able.join(total, "context").withColumn("need", need).filter(F.col("most") >= F.col("need") * F.col("total")).select("context", "total", "need"), "patterns")
    edges = written(edges.join(open_.select("context"), "context", "left_semi"), "edges")
    seeds = edges.filter("seed").select("value", F.lit(1.0).alias("score"))
    score, sure, before = seeds.distinct(), None, None
    for _ in range(rounds):
        got = edges.join(score, "value").groupBy("context").agg(F.sum(F.col("n") * F.col("score")).alias("good"), F.sum("score").alias("finds"))
        trust = F.round(F.least(F.lit(1.0), F.col("good") / F.col("total")), DIGITS)
        sure = cut(got.join(open_, "context").filter((F.col("finds") >= MIN_FINDS - 1e-9) & (trust >= F.col("need") - 1e-9)).select("context", trust.alias("trust")))
        now = tuple(sure.agg(F.count("*"), F.sum(F.xxhash64("context", "trust").cast("decimal(38,0)"))).first())
        if now == before:
            return sure
        before = now
        claimed = edges.join(sure, "context").select("value", F.col("trust").alias("score"))
        score = claimed.unionByName(seeds).groupBy("value").agg(F.max("score").alias("score"))
    raise RuntimeError(f"patterns still changed after {rounds} rounds")


def spans_by_text(texts: DataFrame) -> DataFrame:
    """t1, t2, kind, start, end of all finds; texts has text, t1, t2, no null text, and may repeat."""
    distinct = written(texts.dropDuplicates(["t1", "t2"]), "texts")
    finds = written(_finds(distinct), "finds")
    found = written(entities(finds), "entities")
    sure = accepted(found, distinct)
    base = finds.filter("kind <> 'token'").select("t1", "t2", "kind", "start", "end")
    if sure is None:
        return base
    kind = F.when(F.col("seed"), SEEDED).otherwise(FOUND).alias("kind")
    claimed = found.filter("not base").select("t1", "t2", kind, "start", "end", F.explode("contexts").alias("context")).join(sure, "context", "left_semi")
    return base.unionByName(claimed.select("t1", "t2", "kind", "start", "end").distinct())


def _ordinal() -> Column:
    out = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        out = F.when(F.col("kind") == k, F.lit(i)).otherwise(out)
    return out


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts of base finds, base_sha256, spans, n_secret, n_id.

    The last two count the added spans: claimed seeds and discovered values.
    Null text is empty and holds nothing; repeated rows hold the same; places are
    code points, ends exclusive; very long texts are read whole, their matches one
    row each.  An empty table gives an empty result.  Other columns of the input
    are ignored.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text.alias("text"), *_keys(text))
    spans = spans_by_text(rows.select("text", "t1", "t2"))
    entry = F.struct("start", _ordinal().alias("o"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    counted = spans.groupBy("t1", "t2").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in (*KINDS, SEEDED, FOUND)], F.sort_array(F.collect_list(entry)).alias("all"))
    told = lambda c: F.array_join(F.transform(c, lambda x: x["s"]), ",")
    texts = counted.select("t1", "t2", *[f"n_{k}" for k in (*KINDS, SEEDED, FOUND)], told(F.filter("all", lambda x: x["o"] < len(KINDS))).alias("base"), told(F.col("all")).alias("spans"))
    out = rows.select("doc_id", "t1", "t2").join(texts, ["t1", "t2"], "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in (SEEDED, FOUND)])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every find replaced by its kind in brackets; overlapping finds become one, named by the first.

    All columns stay, whatever their names; null texts stay null; an empty table
    gives an empty result.
    """
    k1, k2, found = fresh(df, "t1", "t2", "spans")
    text = F.col(quoted(text_col))
    first, second = _keys(text)
    keyed = df.withColumn(k1, first).withColumn(k2, second)
    spans = spans_by_text(df.filter(text.isNotNull()).select(text.alias("text"), *_keys(text)))
    before = Window.partitionBy("t1", "t2").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    reach = spans.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0).cast("long"))).filter(F.col("end") > F.col("from"))
    lists = reach.groupBy(F.col("t1").alias(k1), F.col("t2").alias(k2)).agg(F.sort_array(F.collect_list(F.struct("start", "from", "end", "kind"))).alias(found))
    piece = lambda x: F.concat(F.substring(text, x["from"].cast("int") + 1, F.greatest(F.lit(0), x["start"] - x["from"]).cast("int")), F.when(x["start"] >= x["from"], F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit("")))
    last = F.element_at(found, -1)["end"].cast("int")
    clean = F.concat(F.array_join(F.transform(found, piece), ""), F.substring(text, last + 1, F.char_length(text)))
    out = {c: F.col(quoted(c)) for c in df.columns} | {text_col: F.when(F.col(found).isNull(), text).otherwise(clean)}
    return keyed.join(lists, [k1, k2], "left").select(*[v.alias(c) for c, v in out.items()])
