"""Streams over a file source, run to the end, against their batch form."""

from pyspark.sql import functions as F

from partwatch.streaming import streams

EVENTS = "/root/testdata/sf0.01/events.parquet"


def land(spark, tmp_path, closing=False):
    """Events as a folder of files in time order; with ``closing`` a last event lets the watermark pass all others."""
    folder = str(tmp_path / "in")
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    if closing:
        last = events.orderBy(F.desc("ts")).limit(1)
        events = events.unionByName(last.withColumns({"ts": F.col("ts") + F.expr("INTERVAL 9 DAYS"), "event_type": F.lit("closing")}))
    events.orderBy("ts").coalesce(1).write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder), spark.read.parquet(folder)


def run(df, tmp_path, name, mode="append"):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_quota(spark, tmp_path):
    stream, batch = land(spark, tmp_path)
    got = run(streams.quota_breaches(stream, 1, ("event_type",)), tmp_path, "quota")
    # Windows that end after the watermark stay open.
    end = batch.agg(F.max("ts") - F.expr("INTERVAL 2 MINUTES")).first()[0]
    want = streams.quota_breaches(batch, 1, ("event_type",)).where(F.col("minute") + F.expr("INTERVAL 1 MINUTE") <= F.lit(end))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 0


def test_repeated_lookups(spark, tmp_path):
    stream, batch = land(spark, tmp_path, closing=True)
    batch = batch.where("event_type <> 'closing'")
    got = run(streams.fresh_lookup_stream(stream, ("event_type",), 3_000), tmp_path, "lookups")
    want = streams.fresh_lookups(batch, ("event_type",), 3_000)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert 0 < got.count() < batch.count()


def test_lookups_are_remembered_for_their_time(spark):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:19:59"), ("a", "2024-01-02")]
    df = spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("ts"))
    got = [str(r.ts) for r in streams.fresh_lookups(df, ("k",)).orderBy("ts").collect()]
    assert got == ["2024-01-01 00:00:00", "2024-01-01 00:10:00", "2024-01-02 00:00:00"]


def test_upsert_is_idempotent(spark, tmp_path):
    columns = "slug string, cycle string, latest string, status string, updated_at string"
    source, table = str(tmp_path / "items"), str(tmp_path / "inventory")
    rows = [("a", "1", "2", "ok", "2024-01-01"), ("a", "1", "3", "bajo", "2024-02-01"), ("b", "1", "1", "ok", "2024-01-01")]
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(source)
    items = spark.readStream.schema(columns).parquet(source)
    for _ in range(2):
        streams.upsert_stream(items, "platform", table, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([("b", "1", "9", "alto", "2024-03-01")], columns).coalesce(1).write.mode("append").parquet(source)
    streams.upsert_stream(items, "platform", table, str(tmp_path / "c")).awaitTermination()
    got = {(r["slug"], r["latest"], r["status"]) for r in streams.read_inventory(spark, table).collect()}
    assert got == {("a", "3", "bajo"), ("b", "9", "alto")}
