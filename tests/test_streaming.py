from gritstone.streaming import ingest


def test_latest_row_of_each_document(spark, tmp_path):
    source, table, mark = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "mark")
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        ingest.keep_latest(spark.readStream.schema("doc_id long, text string").parquet(source), table, mark).awaitTermination()
    assert sorted((r.doc_id, r.text) for r in ingest.current(spark, table).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_event_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("event_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.start, r.event_type, r.n) for r in spark.table("event_counts").collect())
    assert got == sorted((r.start, r.event_type, r.n) for r in ingest.event_counts(events).collect())
