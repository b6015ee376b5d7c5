"""Streams whose events come in any order over micro-batches give what the batch forms give; state goes, repeated batches change nothing."""

import random
from datetime import datetime, timedelta

import pytest

from lectern.streaming import playback as P

START = datetime(2024, 1, 1)
EVENT = "user_id bigint, position_id bigint, ts timestamp, book_id int, chapter_no int, t double"


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def files(spark, rows, schema, path, n):
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.mode("append").parquet(str(path))


def source(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_changes_over_shuffled_batches_are_those_of_the_batch(rocks, tmp_path):
    para = rocks.createDataFrame([(1, c, i, 20.0 * i, 20.0 * i + 15) for c in (1, 2) for i in range(8)], "book_id int, chapter_no int, frag_idx int, begin double, end double")
    rng = random.Random(1)
    rows = [(u, 100 * u + k, START + timedelta(seconds=k), 1, rng.choice([1, 2]), rng.uniform(-5, 170)) for u in (7, 8, 9) for k in range(40)]
    shuffled = rng.sample(rows, len(rows))
    files(rocks, shuffled, EVENT, tmp_path / "e", 4)
    files(rocks, [(1, 1, START + timedelta(days=2), 1, 1, 0.0)], EVENT, tmp_path / "e", 1)  # the watermark goes on
    stream = P.paragraph_changes_stream(source(rocks, EVENT, tmp_path / "e"), para, late="5 minutes", idle="1 hour")
    q = stream.writeStream.format("memory").queryName("moved").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    want = sorted((r.user_id, r.position_id, r.frag_idx) for r in P.paragraph_changes(rocks.createDataFrame(rows, EVENT), para).collect())
    got = [(r.user_id, r.position_id, r.frag_idx) for r in rocks.table("moved").collect() if r.user_id != 1]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 60


def test_latest_progress_loses_to_no_older_event_and_expires(rocks, tmp_path):
    schema = "user_id bigint, book_id int, ts timestamp, place string"
    rng = random.Random(2)
    rows = [(u, b, START + timedelta(minutes=k), f"{u}-{b}-{k}") for u in (1, 2) for b in (1, 2) for k in range(30)]
    late = [(5, 1, START + timedelta(days=40), "far"), (5, 1, START + timedelta(days=40, minutes=1), "farther")]
    files(rocks, rng.sample(rows, len(rows)), schema, tmp_path / "e", 3)
    files(rocks, late[:1], schema, tmp_path / "e", 1)
    files(rocks, late[1:], schema, tmp_path / "e", 1)
    stream = P.latest_progress_stream(source(rocks, schema, tmp_path / "e"), late="1 day", idle="10 days")
    q = P.write_latest(stream, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    want = sorted(map(tuple, P.latest_progress(rocks.createDataFrame(rows + late, schema)).collect()))
    assert sorted(map(tuple, P.read_latest(rocks, str(tmp_path / "out")).select("user_id", "book_id", "ts", "place").collect())) == want
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # the four old keys are gone
    written = rocks.read.parquet(str(tmp_path / "out"))
    again = written.where("batch = 0").drop("batch")
    again.cache().count()
    again.write.mode("overwrite").parquet(str(tmp_path / "out" / "batch=0"))  # as a batch that runs a second time does
    assert sorted(map(tuple, P.read_latest(rocks, str(tmp_path / "out")).select("user_id", "book_id", "ts", "place").collect())) == want
