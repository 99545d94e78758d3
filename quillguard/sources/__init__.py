"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions of a corpus folder.
EXTENSIONS = ("log", "txt", "json", "go", "py", "yaml", "yml", "sql")

TOOL_CALL = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("index", T.IntegerType()), T.StructField("function", T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]))])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("name", T.StringType()), T.StructField("tool_calls", T.ArrayType(TOOL_CALL))])
REQUEST = T.StructType([T.StructField("model", T.StringType()), T.StructField("messages", T.ArrayType(MESSAGE)), T.StructField("temperature", T.DoubleType()), T.StructField("stream", T.BooleanType()), T.StructField("max_tokens", T.IntegerType())])
PARTS = "array<struct<type:string,text:string>>"
DELTA = "struct<choices:array<struct<index:int,finish_reason:string,delta:struct<content:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>>>>"


def spread(df: DataFrame) -> DataFrame:
    """The rows, dealt anew if they come in fewer pieces than there are cores.

    A small table often lies in one file, which one task would read; a large one
    has more pieces than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """path, text: one row per file of a known extension, folders included."""
    pattern = "*.{" + ",".join(x for e in EXTENSIONS for x in (e, e.upper())) + "}"
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(df: DataFrame, id_cols: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """One row per line that isn't blank, with its number."""
    return df.select(*id_cols, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line")).filter(F.trim(F.col("line")) != "")


def message_text(content: Column) -> Column:
    """Content that is a JSON array of parts becomes their texts joined by line feeds; other content stays."""
    parts = F.from_json(content, PARTS)
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")
    return F.when(F.trim(content).startswith("[") & parts.isNotNull(), joined).otherwise(content)


def requests(df: DataFrame, json_col: str = "value") -> DataFrame:
    """Requests with typed fields; ``raw`` keeps everything else as it came."""
    parsed = df.withColumn("__r", F.from_json(F.col(json_col), REQUEST))
    messages = F.transform("__r.messages", lambda m: F.struct(m["role"].alias("role"), message_text(m["content"]).alias("content"), m["name"].alias("name"), m["tool_calls"].alias("tool_calls")))
    return parsed.select("*", "__r.model", messages.alias("messages"), "__r.temperature", "__r.stream", "__r.max_tokens", F.col(json_col).alias("raw")).drop("__r")


def message_texts(message: Column) -> Column:
    """The content of a message and the arguments of its tool calls."""
    calls = F.coalesce(F.transform(message["tool_calls"], lambda t: t["function"]["arguments"]), F.array().cast("array<string>"))
    return F.filter(F.concat(F.array(message["content"]), calls), lambda t: t.isNotNull())


def embedding_inputs(value: Column) -> Column:
    """Texts of an embeddings input: a string or strings; token ids and anything else hold no text."""
    parsed = F.try_parse_json(value)
    kind = F.schema_of_variant(parsed)
    one = F.array(F.try_variant_get(parsed, "$", "string"))
    many = F.try_variant_get(parsed, "$", "array<string>")
    return F.when(kind == "STRING", one).when(kind == "ARRAY<STRING>", many).when(parsed.isNull() & value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))


def deltas(df: DataFrame, line_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Content and tool fragments of every choice of an event stream's ``data:`` lines; bad and empty ones are skipped."""
    data = F.trim(F.substring(F.col(line_col), 6, 1 << 30))
    rows = df.filter(F.startswith(F.col(line_col), F.lit("data:")) & (data != "[DONE]")).select(*keep, F.from_json(data, DELTA).alias("d")).filter("d.choices is not null")
    choice = F.col("choice")
    each = rows.select(*keep, F.posexplode("d.choices").alias("place", "choice"))
    told = each.select(*keep, choice["delta"]["content"].alias("content"), choice["delta"]["tool_calls"].alias("tool_calls"), choice["finish_reason"].alias("finish_reason"), F.coalesce(choice["index"], F.col("place")).alias("index"))
    return told.filter("coalesce(content, '') <> '' or tool_calls is not null or finish_reason is not null")


def until_error(rows: DataFrame, stream: str, seq: str, error: str = "error") -> DataFrame:
    """The rows of each stream up to and with its first error; what a stream sends after it is no part of the answer."""
    before = Window.partitionBy(stream).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__failed", F.count(error).over(before)).filter("__failed = 0").drop("__failed")


BLOCK_EVENT = "struct<type:string,index:int,delta:struct<type:string,text:string,partial_json:string,stop_reason:string>,content_block:struct<type:string,id:string,name:string>,error:struct<type:string,message:string>>"


def block_deltas(df: DataFrame, line_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The same of a stream that sends typed blocks: text, tool fragments by block index, stop reason, error."""
    event = F.from_json(F.trim(F.substring(F.col(line_col), 6, 1 << 30)), BLOCK_EVENT)
    rows = df.filter(F.startswith(F.col(line_col), F.lit("data:"))).select(*keep, event.alias("e"))
    text = F.when(F.col("e.delta.type") == "text_delta", F.col("e.delta.text"))
    tool = F.when((F.col("e.content_block.type") == "tool_use") | (F.col("e.delta.type") == "input_json_delta"), F.struct(F.col("e.index").alias("index"), F.col("e.content_block.id").alias("id"), F.col("e.content_block.name").alias("name"), F.col("e.delta.partial_json").alias("args")))
    out = rows.select(*keep, text.alias("content"), tool.alias("tool"), finish_reason(F.col("e.delta.stop_reason")).alias("finish_reason"), F.col("e.error.message").alias("error"))
    return out.filter("coalesce(content, '') <> '' or tool is not null or finish_reason is not null or error is not null")


def assembled(messages: Column, preamble: str) -> Column:
    """The messages with the preamble in front as a system message."""
    first = F.struct(F.lit("system").alias("role"), F.lit(preamble).alias("content"))
    return F.concat(F.array(first), F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))


def finish_reason(reason: Column) -> Column:
    """One vocabulary for why an answer ended."""
    return F.when(reason.isin("end_turn", "stop_sequence", "stop"), "stop").when(reason.isin("max_tokens", "length"), "length").when(reason.isin("tool_use", "tool_calls"), "tool_calls").otherwise(reason)


def price_file(spark: SparkSession, path: str) -> DataFrame:
    """no, prefix, rate_in, rate_out of a price file; one without prices is an error."""
    book = spark.read.schema("currency string, prices array<struct<model:string,input_per_million:double,output_per_million:double>>").json(path, multiLine=True)
    rows = book.select(F.posexplode("prices").alias("no", "p")).select("no", F.lower(F.trim("p.model")).alias("prefix"), F.col("p.input_per_million").alias("rate_in"), F.col("p.output_per_million").alias("rate_out"))
    if rows.isEmpty():
        raise ValueError(f"no prices in {path}")
    return rows


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cases array<struct<name:string,category:string,prompt:string,rubric:string>>").json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")


def write_audit(df: DataFrame, path: str) -> None:
    """Events as JSON lines; null fields are left out."""
    df.write.mode("append").json(path)


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def tool_calls(fragments: DataFrame, stream: str = "stream_id", seq: str = "seq", index: str = "index") -> DataFrame:
    """Tool calls put together from their fragments: first id, last name, arguments in order."""
    ordered = F.sort_array(F.collect_list(F.struct(seq, "id", "name", "args")))
    calls = fragments.groupBy(stream, index).agg(ordered.alias("f"))
    present = lambda c: F.filter(F.transform("f", lambda x: x[c]), lambda v: v.isNotNull() & (v != ""))
    return calls.select(stream, index, F.get(present("id"), 0).alias("id"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), present("name")), -1).alias("name"), F.array_join(present("args"), "").alias("arguments"))
