import math

import pytest
from pyspark.sql import functions as F

from tideline.operators import hawkes
from tideline.streaming import excitation


def test_advance_equals_the_fold(spark):
    import numpy as np

    legs = hawkes.simulate_hawkes(hawkes.Params((0.05, 0.05), ((0.1, 0.1), (0.1, 0.1)), 0.5), 200.0, 1)
    events = sorted([(float(t), 0) for t in legs[0]] + [(float(t), 1) for t in legs[1]])
    half = len(events) // 2
    a, s = excitation.advance(None, events[:half], 0.5)
    b, _ = excitation.advance(s, events[half:], 0.5)
    want = hawkes.fold_states(legs, 0.5)
    for k in (0, 1):
        got = np.array([(r0, r1) for leg, _, r0, r1 in a + b if leg == k])
        assert got == pytest.approx(want[k])


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("p", 0, float(t)) for t in (1, 2, 3)] + [("q", 1, float(t)) for t in (1, 1, 2)]
    df = spark.createDataFrame(rows, "key string, leg int, t double")
    df.filter("t < 3").coalesce(1).write.parquet(str(src))
    df.filter("t >= 3").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = excitation.excitation_stream(stream, 0.5).writeStream.format("memory").queryName("exc").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["key"], r["t"]): (r["r_0"], r["r_1"]) for r in spark.table("exc").collect()}
    assert got["q", 2.0] == pytest.approx((0.0, 2 * math.exp(-0.5))) and got["p", 2.0] == pytest.approx((math.exp(-0.5), 0.0))

    timed = stream.withColumn("ts", F.timestamp_seconds("t"))
    q = excitation.windowed_counts(timed, "ts", "60 seconds").writeStream.format("memory").queryName("wc").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["n"] for r in spark.table("wc").collect()) == 6
