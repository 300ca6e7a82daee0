from pyspark.sql import functions as F

from tagloom.catalog import QUERIES
from tagloom.functions.text import default_stop_words, preprocess_text
from tagloom.plans import mllib, segments
from tagloom.shared import new_path
from tagloom.streaming import report, scoring


def test_stream_equals_batch_and_repeats_safely(spark, training, sf_dir):
    path = new_path(spark, "in")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("appId"), F.col("text").alias("description")
    )
    docs.repartition(3).write.parquet(path)
    model = segments.train(training)
    out, checkpoint = new_path(spark, "out"), new_path(spark, "checkpoint")
    for _ in range(2):
        stream = scoring.read_record_stream(spark, path, docs.schema, files_per_trigger=1)
        scoring.score_stream(
            stream, lambda batch: segments.batch_segments(batch, model), out, checkpoint
        ).awaitTermination()
    streamed = spark.read.parquet(out)
    assert streamed.select("batch").distinct().count() == 3
    batch = segments.batch_segments(docs, model)
    assert streamed.count() == batch.count()
    assert streamed.select(batch.columns).exceptAll(batch).count() == 0


def test_row_wise_pipeline_on_a_stream(spark, training):
    path = new_path(spark, "in")
    spark.createDataFrame([("1", "bank budget")], "appId string, description string").write.parquet(path)
    fitted = mllib.fit_hashed_bayes(training)

    def score(batch):
        words = preprocess_text(F.col("description"), default_stop_words())
        prepared = batch.withColumn("clean_description", words)
        return mllib.predict(fitted, prepared).select("appId", "predictedLabel")

    stream = scoring.read_record_stream(spark, path, spark.read.parquet(path).schema)
    out = new_path(spark, "out")
    scoring.score_stream(stream, score, out, new_path(spark, "checkpoint")).awaitTermination()
    assert spark.read.parquet(out).first().predictedLabel == "Finance"


def test_report_stream_equals_batch(spark, sf_dir):
    # A watermark takes a zoned timestamp; the session runs in UTC.
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type"
    )
    path = new_path(spark, "events")
    events.repartitionByRange(3, "ts").write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (
        report.sliding_report(stream, "ts", ["event_type"], watermark="365 days")
        .writeStream.outputMode("complete").format("memory").queryName("sliding")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    batch = report.sliding_report(events, "ts", ["event_type"])
    streamed = spark.table("sliding")
    assert streamed.exceptAll(batch).count() == 0
    assert batch.exceptAll(streamed).count() == 0


def test_late_rows_are_dropped(spark):
    path = new_path(spark, "late")
    schema = "ts timestamp, event_type string"

    def add(*stamps):
        rows = [(stamp, "x") for stamp in stamps]
        df = spark.createDataFrame(rows, "ts string, event_type string")
        df.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(path)

    out, checkpoint = new_path(spark, "late-out"), new_path(spark, "late-checkpoint")

    def run():
        stream = spark.readStream.schema(schema).parquet(path)
        counted = report.sliding_report(
            stream, "ts", ["event_type"], window="10 minutes", slide="10 minutes", watermark="5 minutes"
        )
        counted.writeStream.outputMode("append").format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start().awaitTermination()

    add("2024-01-01 00:01:00", "2024-01-01 01:00:00")
    run()
    add("2024-01-01 00:02:00", "2024-01-01 03:00:00")
    run()
    found = {row.window_start.hour * 60 + row.window_start.minute: row.n for row in spark.read.parquet(out).collect()}
    assert found == {0: 1, 60: 1}


def test_panes_equal_sliding_windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    panes = report.sliding_report_panes(events, "ts", ["event_type"]).select(
        "window_start", "window_end", F.col("value").alias("event_type"), "n"
    )
    plain = report.sliding_report(events, "ts", ["event_type"])
    assert panes.exceptAll(plain).count() == 0 and plain.exceptAll(panes).count() == 0


def test_panes_count_an_event_once_per_attribute(spark):
    events = spark.createDataFrame([(None, "x", 1), ("2024-01-01 00:05:00", None, 1)], "ts string, a string, n int").select(
        F.col("ts").cast("timestamp").alias("ts"), "a", "n"
    )
    df = report.sliding_report_panes(events, "ts", ["a", "n"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    rows = df.collect()
    assert len(rows) == 12 and {(r.attribute, r.value, r.n) for r in rows} == {("a", None, 1), ("n", "1", 1)}
    # The rows that are counted into panes are shuffled once, by pane; windows are made of panes.
    assert plan.count("Exchange hashpartitioning") == 2
    assert report.sliding_report_panes(events.where("false"), "ts", ["a"]).collect() == []


def test_late_rows_of_panes_are_dropped(spark):
    path = new_path(spark, "late-panes")

    def add(*stamps):
        rows = [(stamp, "x") for stamp in stamps]
        df = spark.createDataFrame(rows, "ts string, event_type string")
        df.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(path)

    out, checkpoint = new_path(spark, "late-panes-out"), new_path(spark, "late-panes-checkpoint")

    def run():
        stream = spark.readStream.schema("ts timestamp, event_type string").parquet(path)
        counted = report.sliding_report_panes(
            stream, "ts", ["event_type"], window="20 minutes", slide="10 minutes", watermark="5 minutes"
        )
        report.write_report(counted, out, checkpoint).awaitTermination()

    add("2024-01-01 00:01:00", "2024-01-01 00:12:00", "2024-01-01 01:00:00")
    run()
    add("2024-01-01 00:02:00", "2024-01-01 03:00:00")
    run()
    add("2024-01-01 06:00:00")
    run()
    found = {r.window_start.hour * 60 + r.window_start.minute: r.n for r in spark.read.parquet(out).where("day(window_start) = 1").collect()}
    # 00:02 came after 01:00 and counts in no window.
    assert found == {0: 2, 10: 1, 50: 1, 60: 1, 170: 1, 180: 1}


def test_streams_read_tables_that_are_folders(spark, sf_dir, tmp_path):
    for name in ("documents", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for streamed, batch in (("stream_score", "batch_segments"), ("sliding_report_stream", "sliding_report_panes")):
        found, expected = QUERIES[streamed](spark, str(tmp_path)), QUERIES[batch](spark, sf_dir)
        assert found.count() == expected.count() > 0
        assert found.select(expected.columns).exceptAll(expected).count() == 0
