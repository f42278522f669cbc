import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.summaries import peak_per_unit
from tidemark.streaming.loggers import daily_peaks, write_peaks


def test_stream_equals_batch_for_closed_days(spark, tmp_path):
    start = dt.datetime(2006, 6, 20, 1)
    rows = [("BP", i % 3, start + dt.timedelta(hours=5 * i), float((i * 37) % 50)) for i in range(120)]
    schema = "site string, number int, ts timestamp, temp double"
    source = str(tmp_path / "in")
    df = spark.createDataFrame(rows, schema)
    df.where("number < 2").coalesce(1).write.parquet(source)
    df.where("number = 2").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    write_peaks(daily_peaks(stream, ["site", "number"], "ts", "temp"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r["number"], r["day"]): r["dm"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = peak_per_unit(df.withColumn("day", F.col("ts").cast("date")), ["site", "number", "day"], "temp")
    expected = {(r["number"], r["day"]): r["dm"] for r in batch.collect()}
    assert got and set(got) <= set(expected)
    assert all(expected[k] == v for k, v in got.items())
    last = max(r[2] for r in rows).date()
    assert {k for k in expected if k[1] < last - dt.timedelta(days=1)} <= set(got)
