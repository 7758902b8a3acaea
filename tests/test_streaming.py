"""Activity counts of a stream that is stopped, restarted and fed in between."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postloom.operators.report import activity
from postloom.streaming.activity import read_activity, run_activity, stream_activity

START = datetime(2022, 12, 11, 18)


def rows_of(spark, minutes):
    rows = [(START + timedelta(minutes=m), "abc"[m % 3] if m % 7 else None) for m in minutes]
    return spark.createDataFrame(rows, "created_at timestamp, label_sentiment string")


def counts(df):
    return {(r.created_at, r.label_sentiment): r["count"] for r in df.collect()}


def test_restart_between_batches(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = rows_of(spark, [1]).schema
    whole = None
    for portion in (range(0, 95), range(80, 200), range(195, 400)):
        part = rows_of(spark, portion)
        part.write.mode("append").parquet(source)
        whole = part if whole is None else whole.unionByName(part)
        stream = spark.readStream.schema(schema).parquet(source)
        run_activity(stream_activity(stream), out, state)
        assert counts(read_activity(spark, out)) == counts(activity(whole))
    # A run that finds nothing new changes nothing; rows far behind the watermark are left out.
    before = counts(read_activity(spark, out))
    run_activity(stream_activity(spark.readStream.schema(schema).parquet(source)), out, state)
    assert counts(read_activity(spark, out)) == before
    rows_of(spark, [1]).write.mode("append").parquet(source)
    run_activity(stream_activity(spark.readStream.schema(schema).parquet(source)), out, state)
    assert counts(read_activity(spark, out)) == before


def test_repeated_batch_replaces_its_rows(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(START, "a", 3)], "created_at timestamp, label_sentiment string, count bigint")
    for number, n in ((0, 3), (1, 5), (1, 6)):
        rows.withColumn("count", F.lit(n).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
    assert counts(read_activity(spark, folder)) == {(START, "a"): 6}
