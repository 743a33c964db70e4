"""Tables kept up to date by streams: buckets, upserts, history and latest verdicts, repeated lookups out of order."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from partwatch.operators import history
from partwatch.sinks.tables import upsert_cycles
from partwatch.streaming import buckets, streams

ITEMS = "slug string, cycle string, latest string, status string, updated_at string"
SF = "/root/testdata/sf0.001"


def combine(old, new):
    return new if old is None else upsert_cycles(old, new, "platform")


def files_of(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/rows/**/*.parquet", recursive=True)}


def content(spark, path):
    return sorted(tuple(r) for r in buckets.read_table(spark, path).select("slug", "latest").collect())


def items(spark, rows):
    return spark.createDataFrame([(s, "1", latest, "ok", "t") for s, latest in rows], ITEMS)


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "table")
    assert buckets.read_table(spark, path) is None
    touched = buckets.apply_batch(items(spark, [(f"s{i}", "1") for i in range(300)]), 0, path, ["slug"], combine, 16)
    assert len(touched) == 16
    before = files_of(path)
    one = buckets.apply_batch(items(spark, [("s7", "2")]), 1, path, ["slug"], combine, 16)
    after = files_of(path)
    assert len(one) == 1
    assert {os.path.dirname(f) for f in set(before.items()) ^ set(after.items()) for f in [f[0]]} == {f"{path}/rows/buckets=16/bucket={one[0]}"}
    assert content(spark, path) == sorted((f"s{i}", "2" if i == 7 else "1") for i in range(300))
    assert {r.batch for r in buckets.batches_of(spark, path).collect()} == {0, 1}


def test_repeated_and_older_batches_change_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    for n in range(3):
        buckets.apply_batch(items(spark, [("a", str(n)), ("b", str(n))]), n, path, ["slug"], combine, 4)
    before = files_of(path)
    for n in range(3):
        assert buckets.apply_batch(items(spark, [("a", str(n)), ("b", str(n))]), n, path, ["slug"], combine, 4) == []
    assert files_of(path) == before and content(spark, path) == [("a", "2"), ("b", "2")]
    assert buckets.apply_batch(items(spark, []), 3, path, ["slug"], combine, 4) == []
    with pytest.raises(ValueError):
        buckets.apply_batch(items(spark, [("a", "9")]), 4, path, ["slug"], combine, 5)


def test_a_stopped_exchange_is_finished(spark, tmp_path, monkeypatch):
    """A batch that stops after it was written aside, with a bucket gone, is completed when it is repeated."""
    path = str(tmp_path / "table")
    buckets.apply_batch(items(spark, [(f"s{i}", "1") for i in range(30)]), 0, path, ["slug"], combine, 4)
    new = items(spark, [(f"s{i}", "2") for i in range(0, 30, 2)])
    buckets.apply_batch(new, 1, path, ["slug"], combine, 4)
    whole = content(spark, path)
    gone = glob.glob(f"{path}/rows/buckets=4/bucket=2/*.parquet")
    assert gone
    for f in gone:
        os.truncate(f, 0)
        os.remove(f)
    assert content(spark, path) != whole
    assert buckets.apply_batch(new, 1, path, ["slug"], combine, 4) == [2]
    assert content(spark, path) == whole


def test_null_keys(spark, tmp_path):
    path = str(tmp_path / "table")
    for n in range(2):
        buckets.apply_batch(spark.createDataFrame([(None, n)], "app string, v int"), n, path, ["app"], lambda old, new: new, 4)
    assert [tuple(r) for r in buckets.read_table(spark, path).collect()] == [(None, 1)]


def test_latest_verdicts_after_each_batch(spark, tmp_path):
    schema = "id long, app_name string, verdict string, created_at timestamp"
    batches = [
        [(1, "a", "ok", "2024-01-01"), (2, "b", "alto", "2024-01-01"), (3, None, "bajo", "2024-01-02")],
        [(4, "a", "medio", "2023-01-01"), (5, "b", "ok", "2024-01-01"), (6, "c", "ok", None)],
        [(7, "a", "crítico", "2024-05-01"), (8, None, "ok", "2024-01-03")],
    ]
    for rows in batches:
        df = spark.createDataFrame([(i, a, v, d) for i, a, v, d in rows], "id long, app_name string, verdict string, d string")
        df.select("id", "app_name", "verdict", F.col("d").cast("timestamp").alias("created_at")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.history_stream(stream, str(tmp_path / "history"), str(tmp_path / "hs")).awaitTermination()
        streams.latest_verdict_stream(stream, str(tmp_path / "latest"), str(tmp_path / "ls"), 8).awaitTermination()
        want = history.latest_verdicts(spark.read.parquet(str(tmp_path / "history")))
        got = streams.read_verdicts(spark, str(tmp_path / "latest"))
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def plain_lookups(rows, ttl):
    """The lookups that are made, key by key in order of time."""
    out, last = set(), {}
    for k, t in sorted(set(rows), key=lambda r: (str(r[0]), r[1])):
        if k not in last or t - last[k] >= ttl:
            out.add((k, t))
            last[k] = t
    return out


def made_lookups(n=3_000):
    """One key with most of the rows, dense and sparse keys, a null key, repeated times."""
    rows = [("hot", i * 7 % 5_000 + i % 3 * 40_000) for i in range(n)] + [("dense", i) for i in range(300)] + [(None, i * 90) for i in range(80)]
    rows += [(f"k{i % 50}", i * i % 90_001) for i in range(800)] + [("edge", t) for t in (0, 599, 600, 1_199, 1_200, 9_000)]
    return [(k, t + 1_000_000) for k, t in rows]


def times(spark, rows):
    return spark.createDataFrame(rows, "k string, t long").repartition(6).select("k", F.timestamp_seconds("t").alias("ts"))


def test_lookups_against_plain_form(spark):
    rows = made_lookups()
    for ttl in (600, 60, 1):
        got = streams.fresh_lookups(times(spark, rows), ("k",), ttl)
        assert {(r.k, int(r.t)) for r in got.select("k", F.unix_seconds("ts").alias("t")).collect()} == plain_lookups(rows, ttl)
        assert got.count() == len(plain_lookups(rows, ttl))


def test_lookups_of_odd_tables(spark):
    empty = spark.createDataFrame([], "k string, ts timestamp, outcome string")
    assert streams.fresh_lookups(empty, ("k",)).count() == 0
    rows = times(spark, [("a", 0), ("a", 10)]).withColumn("outcome", F.when(F.unix_seconds("ts") == 0, "neterror"))
    rows = rows.unionByName(spark.createDataFrame([("a", None, None)], empty.schema))
    assert [str(r.ts) for r in streams.fresh_lookups(rows, ("k",)).collect()] == ["1970-01-01 00:00:10"]


def test_lookup_stream_out_of_order(spark, tmp_path):
    """Files whose times overlap: every row the watermark has passed is judged as in a batch; rows later than that are dropped."""
    rows = sorted(made_lookups(600), key=lambda r: r[1] + hash(r[1]) % 1_700)  # out of order by less than the delay
    size = len(rows) // 4 + 1

    def land(part):
        """A file more, and all that the stream has given by then."""
        times(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
        writer = streams.fresh_lookup_stream(stream, ("k",), 600, delay="3000 seconds").writeStream.format("parquet")
        writer.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(((r.k, r.t) for r in spark.read.parquet(str(tmp_path / "out")).select("k", F.unix_seconds("ts").alias("t")).collect()), key=str)

    for n in range(0, len(rows), size):
        got = land(rows[n : n + size] + ([("end", 1_400_000)] if n + size >= len(rows) else []))
    want = sorted(plain_lookups(rows, 600), key=str)
    assert got == want
    # Rows older than the watermark are dropped.
    assert land([("hot", 1_000_005), ("late", 1_000_007), ("end", 1_500_000)]) == sorted([*want, ("end", 1_400_000)], key=str)
