"""Ordered work in ranges against the plain windows and sums."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.operators import asof, hawkes, ranges, sweeps


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    data = [(int(rng.integers(0, 3)), float(x), i) for i, x in enumerate(np.round(rng.exponential(size=900), 2))] + [(1, 5.0, 900 + i) for i in range(500)] + [(0, None, 2000)]
    return spark.createDataFrame(data, "k int, x double, i long").repartition(4)


def test_cuts_are_few_and_in_order(rows):
    points = ranges.cuts(rows, "x", "i", 100)
    assert 8 <= len(points) <= 40 and points == sorted(points, key=lambda p: (p[0], -math.inf if p[1] is None else p[1]))
    sizes = [r["count"] for r in rows.withColumn("b", ranges.place(points, "x", "i")).groupBy("b").count().collect()]
    assert max(sizes) <= 300  # although one value stands 500 times
    assert ranges.cuts(rows, "x") == [] and ranges.cuts(rows.filter("false"), "x", None, 1) == []


def test_ranks_equal_one_window(rows):
    w = Window.partitionBy("k").orderBy("x", "i")
    want = {r["i"]: (r["n"], r["m"]) for r in rows.withColumns({"n": F.row_number().over(w), "m": F.count("*").over(Window.partitionBy("k"))}).collect()}
    for size in (70, None):
        got = {r["i"]: (r["n"], r["m"]) for r in ranges.ranked(rows, ["k"], "x", "i", "n", {"m": F.count("*")}, size).collect()}
        assert got == want


def test_lags_equal_one_window(rows):
    d = rows.filter("x IS NOT NULL")
    w = Window.partitionBy("k").orderBy("x", "i")
    want = sorted((r["k"], r["x"], r["b"] if r["b"] is not None else -1.0) for r in d.withColumn("b", F.lag("x").over(w)).collect())
    for size in (70, None):
        assert sorted((r["k"], r["x"], r["b"] if r["b"] is not None else -1.0) for r in ranges.lagged(d, ["k"], "x", "x", "b", size).collect()) == want


def test_asof_by_key_is_the_same_in_ranges(spark, monkeypatch):
    left = spark.range(400).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1000).alias("t"), "id")
    right = spark.range(90).select((F.col("id") % 4).alias("k"), (F.col("id") * 13 % 1000).alias("rt"), F.col("id").alias("v"))
    run = lambda: sorted(map(tuple, asof.asof_backward(left, right, "t", "rt", ["v"], ["k"]).collect()), key=repr)
    whole = run()
    monkeypatch.setattr(ranges, "RANGE_ROWS", 37)
    assert run() == whole and any(r[-1] is None for r in whole) and any(r[-1] is not None for r in whole)


@pytest.mark.parametrize("beta", [1e-3, 0.5, 40.0])
def test_excitation_in_ranges_is_the_plain_sum(spark, beta):
    rng = np.random.default_rng(1)
    t = np.round(rng.uniform(0, 300, 400), 1)
    leg = rng.integers(0, 2, 400)
    legs = spark.createDataFrame([(int(a), float(b), i) for i, (a, b) in enumerate(zip(leg, t, strict=True))], "leg int, t double, i int")
    got = {r["i"]: r for r in hawkes.excitation(legs, beta, 100.0, 40).collect()}
    for i in range(400):
        for k in (0, 1):
            before = t[(leg == k) & (t < t[i])]
            assert got[i][f"r_{k}"] == pytest.approx(np.exp(-beta * (t[i] - before)).sum(), abs=1e-9)
            assert got[i][f"c_{k}"] == (before >= 100).sum()


def test_sweeps_in_many_leaves_are_those_in_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    t = np.round(np.concatenate([rng.uniform(0, 300, 300), rng.uniform(900, 1000, 300), [5.0] * 20]), 1)
    legs = spark.createDataFrame([(int(i % 3 > 0), float(x)) for i, x in enumerate(t)], "leg int, t double").repartition(3)
    p = hawkes.Params((0.2, 0.3), ((0.2, 0.1), (0.05, 0.25)), 0.7)

    def all_of():
        res = hawkes.residuals(legs, p, 20.0)
        return [sorted(tuple(None if x is None else round(x, 6) for x in r) for r in d.collect()) for d in (res.select("leg", "event_time", "rescaled_dt").na.fill(-1), hawkes.compensator(legs, p, 20.0), hawkes.log_likelihood(legs, p, 1000.0, 20.0), hawkes.ks_exponential(res))]

    one = all_of()
    monkeypatch.setattr(ranges, "RANGE_ROWS", 30)
    assert sweeps.leaves_of(legs, 0.7).root > 3 and all_of() == one
    monkeypatch.setattr(sweeps, "EXPONENT", 40.0)
    few = sweeps.leaves_of(legs, 0.7)
    assert few.group < few.root and all_of() == one


def test_kolmogorov_distance_is_the_plain_one(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.exponential(size=400), [0.25] * 30, [-1.0, 0.0]])
    got = sweeps.ks_exponential(spark.createDataFrame([(0, float(v)) for v in x] + [(1, 2.0), (1, None)], "k int, x double"), "k", "x").collect()
    v = np.sort(x[x > 0])
    f, i = 1 - np.exp(-v), np.arange(1, len(v) + 1)
    assert [(r["k"], r["n"]) for r in got] == [(0, 430)] and got[0]["d"] == pytest.approx(max((i / 430 - f).max(), (f - (i - 1) / 430).max()))


def test_plans_stay_in_the_jvm_and_start_few_jobs(spark):
    p = hawkes.Params((0.02, 0.03), ((0.2, 0.1), (0.05, 0.25)), 0.5)
    legs = spark.createDataFrame([(i % 2, float(i)) for i in range(50)], "leg int, t double")
    spark.sparkContext.setJobGroup("built", "")
    try:
        d = hawkes.ks_exponential(hawkes.residuals(legs, p))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("built")) <= 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not {"FlatMapGroupsInPandas", "MapInPandas"} & set(d._jdf.queryExecution().toString().split())


def test_plans_have_no_nested_loop_over_history(spark, capsys):
    p = hawkes.Params((0.02, 0.03), ((0.2, 0.1), (0.05, 0.25)), 0.5)
    legs = spark.createDataFrame([(i % 2, float(i)) for i in range(50)], "leg int, t double")
    hawkes.residuals(legs, p).explain()
    assert "CartesianProduct" not in capsys.readouterr().out
