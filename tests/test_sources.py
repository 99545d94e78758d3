from pyspark.sql import functions as F

from quillguard import sources, streaming


def test_corpus(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.LOG").write_text("x\n\ny")
    (tmp_path / "d" / "b.py").write_text("z")
    (tmp_path / "c.bin").write_text("no")
    got = sources.corpus(spark, str(tmp_path))
    assert sorted(r.text for r in got.collect()) == ["x\n\ny", "z"]
    assert got.transform(lambda d: sources.lines(d, ("path",))).count() == 3


def test_requests(spark):
    raw = '{"model":"m","messages":[{"role":"user","content":"hi"},{"role":"user","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]},{"role":"assistant","content":null,"tool_calls":[{"id":"1","function":{"name":"f","arguments":"{}"}}]}],"temperature":0.5,"extra":1}'
    r = sources.requests(spark.createDataFrame([(raw,)], "value string")).first()
    assert [m.content for m in r.messages] == ["hi", "a\nb", None] and r.temperature == 0.5 and r.max_tokens is None and '"extra":1' in r.raw


def test_event_stream(spark):
    lines = ['data: {"choices":[{"index":0,"delta":{"content":"he"}}]}', "data: {bad", ": ping", 'data: {"choices":[{"index":0,"delta":{"content":""}}]}', "data: [DONE]"]
    got = sources.deltas(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.content for r in got.collect()] == ["he"]


def test_embedding_inputs(spark):
    df = spark.createDataFrame([('"one"',), ('["a","b"]',), ("[1,2]",)], "v string")
    assert [r[0] for r in df.select(sources.embedding_inputs(F.col("v"))).collect()] == [["one"], ["a", "b"], []]


def test_guard_stream(spark, tmp_path):
    rows = [("s", 1, "ok line\nrm -", False), ("s", 2, "rf /\nmore\n", True), ("t", 1, "fine", True)]
    spark.createDataFrame(rows, "stream_id string, seq long, delta string, done boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id string, seq long, delta string, done boolean").parquet(str(tmp_path / "in"))
    q = streaming.guard_stream(stream).writeStream.format("memory").queryName("released").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.stream_id: (r.released, r.sealed) for r in spark.table("released").collect()}
    assert got == {"s": ("ok line\n", "rm_recursive_force_root"), "t": ("fine", "")}


def test_block_stream(spark):
    lines = ['data: {"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"hi"}}', 'data: {"type":"content_block_start","index":1,"content_block":{"type":"tool_use","id":"t","name":"f"}}', 'data: {"type":"message_delta","delta":{"stop_reason":"end_turn"}}', "event: ping", 'data: {"type":"ping"}']
    got = sources.block_deltas(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.content, r.tool.name if r.tool else None, r.finish_reason) for r in got] == [("hi", None, None), (None, "f", None), (None, None, "stop")]
