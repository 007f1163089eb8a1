"""Streams read to their end give what the batch operators give."""

from pyspark.sql import functions as F

from closetlake.operators import platform
from closetlake.streaming import live
from tests.conftest import SF_DIR
from verification.registry import Tables


def drained(stream, mode, tmp_path, name):
    query = (
        stream.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    query.stop()
    return stream.sparkSession.table(name)


def source(spark, tmp_path):
    logs = Tables(spark, SF_DIR).v_api_logs
    path = str(tmp_path / "logs")
    logs.repartitionByRange(3, "ts").write.parquet(path)
    return logs, spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_calls_per_day(spark, tmp_path):
    logs, stream = source(spark, tmp_path)
    got = drained(live.calls_per_day(stream, "40 days"), "complete", tmp_path, "per_day")
    want = logs.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_health_by_window(spark, tmp_path):
    logs, stream = source(spark, tmp_path)
    got = {r["start"].date(): r for r in drained(live.health_by_window(stream, "1 day", "40 days"), "complete", tmp_path, "health").collect()}
    day = sorted(got)[1]
    one_day = logs.filter(F.to_date("ts") == F.lit(day))
    want = platform.api_health(one_day, day).first()
    assert (got[day]["success_percent"], got[day]["failures"], got[day]["average_ms"]) == (
        want["success_percent"], want["failures"], want["average_ms"])


def test_first_success(spark, tmp_path):
    logs, stream = source(spark, tmp_path)
    got = drained(live.first_success(stream), "complete", tmp_path, "firsts")
    want = platform.first_recommendations(logs).filter("first").select("user_id", "ts", "log_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
