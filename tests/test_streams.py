"""Velocity row by row on a stream, with rows that come out of order, against the batch operator."""

import random
from datetime import datetime, timedelta

import pytest

from cardsieve.operators import velocity
from cardsieve.streaming import windows


def test_the_same_as_batch(spark, tmp_path):
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 40 == 1 else f"k{rng.randrange(9)}", start + timedelta(seconds=i * 7 + rng.randrange(200), milliseconds=rng.choice([0, 400])), float(rng.randrange(20))) for i in range(600)]
    schema, spans = "id long, key string, ts timestamp, amount double", {"5s": 5, "2m": 120, "1h": 3600}
    for k in range(4):  # rows come up to 200 s late, also across files
        own = rows[k * 150 : k * 150 + 150]
        rng.shuffle(own)
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(-1, "end", start + timedelta(days=9), 0.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = windows.exact_velocity_stream(stream, "key", "ts", "id", "amount", spans, late="5 minutes")
    found.writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    names = [f"{m}_{w}" for w in spans for m in ("n", "sum")]
    got = {r.id: tuple(r[n] for n in names) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = velocity.velocity(spark.createDataFrame(rows, schema), ["key"], "ts", "id", "amount", spans)
    want = {r.id: tuple(r[n] for n in names) for r in batch.collect() if r.key is not None}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i])
