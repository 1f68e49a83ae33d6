"""Streaming on file sources, run to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.streaming import ingest


def test_ingest_goes_on_and_keeps_each_key_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.range(0, 10).write.parquet(src)
    run = lambda: ingest.ingest(ingest.read_stream(spark, src, "id long"), out, cp, "id").awaitTermination(60)
    run()
    spark.range(5, 15).write.mode("append").parquet(src)
    run()
    run()
    got = spark.read.parquet(out)
    assert got.count() == got.select("id").distinct().count() == 15


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = ingest.upsert_to(str(tmp_path / "out"), "id")
    write(spark.range(5), 0)
    write(spark.range(3, 8), 1)
    write(spark.range(3, 8), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_windows_in_a_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(0, 100).select(F.timestamp_seconds(1_000_000_200 + F.col("id") * 30).alias("ts"), (F.col("id") % 2).alias("k"), F.lit(1.0).alias("x")).write.parquet(src)
    s = ingest.first_of_each(ingest.read_stream(spark, src, "ts timestamp, k long, x double"), ["ts"], "ts")
    t = ingest.tumbling(ingest.read_stream(spark, src, "ts timestamp, k long, x double"), "ts", "10 minutes", ["k"], "x")
    for name, d, mode in (("firsts", s, "append"), ("tumbled", t, "complete")):
        q = d.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("firsts").count() == 100
    assert {r["n"] for r in spark.table("tumbled").collect()} == {10}
