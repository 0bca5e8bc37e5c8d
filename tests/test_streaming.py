import pytest
from pyspark.sql import functions as F

from tarn.operators.state import rate_limit
from tarn.streaming import ingest, limiter

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def source(spark, tmp_path):
    spark.read.parquet(EVENTS).repartition(2).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(EVENTS).schema).parquet(str(tmp_path / "in"))


def test_limiter_equals_the_batch(spark, source, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", limiter.STORE)
    q = limiter.limited(source, 2, 86_400).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["event_id"]: r["accepted"] for r in spark.table("limited").collect()}
    want = {r["event_id"]: r["accepted"] for r in rate_limit(spark.read.parquet(EVENTS), 2, 86_400).collect()}
    assert got == want


def test_upsert(spark, source, tmp_path):
    out = str(tmp_path / "t")
    slim = source.select("user_id", "event_type", "event_id")
    ingest.stream_upsert(slim, out, ["user_id", "event_type"], "event_id", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = {tuple(r) for r in ingest.current(spark, out).select("user_id", "event_type", "event_id").collect()}
    want = {tuple(r) for r in spark.read.parquet(EVENTS).groupBy("user_id", "event_type").agg(F.max("event_id")).collect()}
    assert got == want


def test_sessions(spark, source, tmp_path):
    q = ingest.sessions(source).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("sessions").count() > 0
