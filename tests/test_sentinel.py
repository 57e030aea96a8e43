"""Reading until a sentinel: batch, stream, replay and restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone import sources
from lodestone.plans import catalogue
from lodestone.streaming import sentinel

DDL = "k string, t timestamp, n long, v string"


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def write(spark, path, rows):
    spark.createDataFrame([(k, at(m), n, v) for k, m, n, v in rows], DDL).coalesce(1).write.mode("append").parquet(path)


def run(spark, place, delay="10 minutes"):
    """Goes on from the checkpoint over what has come since; the query."""
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    rows = sentinel.until_sentinel(stream, "k", "t", "n", "v", "q", delay)
    with sentinel.keyed_state(spark):
        query = rows.writeStream.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start(f"{place}/out", format="parquet")
        query.awaitTermination()
    return query


def out(spark, place):
    return sorted((r["k"] or "", r["n"]) for r in spark.read.schema(DDL).parquet(f"{place}/out").collect())


def test_order_restart_and_late_rows(spark, tmp_path):
    place = str(tmp_path)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    # rows out of order: the sentinel of a comes first, rows before it later but in time; null is a key
    write(spark, f"{place}/in", [("a", 8, 3, "q"), ("b", 3, 10, "x"), (None, 1, 20, "y")])
    write(spark, f"{place}/in", [("a", 5, 2, "x"), ("a", 2, 1, "x"), ("a", 9, 4, "x"), ("b", 3, 9, "x")])
    run(spark, place)
    assert out(spark, place) == []  # the watermark has passed none
    write(spark, f"{place}/in", [("b", 19, 11, "x")])
    run(spark, place)
    assert out(spark, place) == [("", 20), ("a", 1), ("a", 2), ("b", 9), ("b", 10)]
    # after a restart: a is closed, what comes late is counted, b goes on to its own sentinel (ties by n)
    write(spark, f"{place}/in", [("a", 25, 5, "x"), ("b", 4, 12, "x"), ("b", 25, 13, "x"), ("b", 25, 15, "x"), ("b", 25, 14, "q")])
    write(spark, f"{place}/in", [("c", 90, 30, "x")])
    query = run(spark, place)
    assert sentinel.late_rows(query) == 1
    assert out(spark, place) == [("", 20), ("a", 1), ("a", 2), ("b", 9), ("b", 10), ("b", 11), ("b", 13)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_stream_equals_batch_on_a_replay(spark, tmp_path):
    """Shuffled rows of many keys, microseconds apart and with ties, read file by file."""
    rnd, place = random.Random(4), str(tmp_path)
    rows = [(rnd.choice("abcdefgh"), datetime(2024, 1, 1) + timedelta(microseconds=rnd.randrange(4000)), n, rnd.choice(["q", *"vwxyz" * 3])) for n in range(300)]
    events = spark.createDataFrame(rows, DDL)
    events.repartition(3).write.parquet(f"{place}/in")
    tick = spark.createDataFrame([(None, datetime(2024, 1, 2), None, None)], DDL)
    got = sentinel.replay_until_sentinel(spark.readStream.schema(DDL).parquet(f"{place}/in"), tick, "k", "t", "n", "v", "q", "1 hour")
    want = sources.until_sentinel(events, F.struct("t", "n"), "v", "q", "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20


@pytest.mark.parametrize("name", ["until_sentinel", "stream_until_sentinel"])
def test_query_reads_a_table_of_many_files(spark, tmp_path, name):
    events = sources.load(spark, "/root/testdata/sf0.001", "events")
    events.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES[name](spark, str(tmp_path)).count()
    assert got == catalogue.QUERIES["until_sentinel"](spark, "/root/testdata/sf0.001").count() > 0


def test_batch_with_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "q"), ("a", 3, "x"), (None, 2, "x"), (None, 3, "q"), ("b", 9, "x"), ("c", 1, "q")], "k string, n int, v string")
    assert sorted((r["k"] or "", r["n"]) for r in sources.until_sentinel(df, F.col("n"), "v", "q", "k").collect()) == [("", 2), ("a", 1), ("b", 9)]
    assert sources.until_sentinel(df.limit(0), F.col("n"), "v", "q", "k").count() == 0
