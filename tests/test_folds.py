from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodeworks.sources.shared import fresh
from lodeworks.streaming import folds

T0 = datetime(2024, 1, 1)


def landed(spark):
    path = fresh(spark, "stream")
    for d in (0, 1, 60):
        rows = [("A", T0 + timedelta(days=d, hours=h), 1.5, h) for h in range(3)] + [(None, T0, 1.0, 9)]
        spark.createDataFrame(rows, "acct string, at timestamp_ntz, x double, age int").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", fresh(df.sparkSession, "offsets")).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_hazard_so_far(spark):
    df = folds.hazard_so_far(landed(spark), F.floor(F.col("age") / 2).cast("int"), F.lit(1), (F.col("age") == 1).cast("int"))
    assert sorted(tuple(r) for r in run(df, "complete", "hazard_so_far")) == [(0, 6, 3), (1, 3, 0), (4, 3, 0)]


def test_days_come_out_when_the_watermark_has_passed(spark):
    rows = run(folds.daily_episodes(landed(spark), "acct", "at", "x", "10 days"), "append", "daily")
    assert sorted((r.account, r.day.isoformat(), r.rows, r.total) for r in rows) == [("A", "2024-01-01", 3, 4.5), ("A", "2024-01-02", 3, 4.5)]
