import pytest
from pyspark.sql import functions as F

from tideline.operators import asof, ledger, panel, series


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_asof_edges(spark):
    left = _df(spark, [(1, "a"), (5, "b"), (5, "b2"), (9, "c"), (None, "d")], "k long, name string")
    right = _df(spark, [(5, 50.0), (7, 70.0)], "rk long, v double")
    out = {r["name"]: (r["v"], r["method"]) for r in asof.label(asof.asof_backward(left, right, "k", "rk", ["v"]), "k", "rk").collect()}
    assert out == {"a": (None, "unavailable"), "b": (50.0, "exact"), "b2": (50.0, "exact"), "c": (70.0, "forward_fill"), "d": (None, "unavailable")}
    none = asof.asof_backward(left, right.filter("false"), "k", "rk", ["v"])
    assert none.count() == 5 and none.filter("v IS NOT NULL").count() == 0


def test_asof_without_key_is_many_tasks(spark):
    left = spark.range(2000).select((F.col("id") * 3).alias("k"))
    right = spark.range(500).select((F.col("id") * 11).alias("rk"), F.col("id").alias("v"))
    out = asof.asof_backward(left, right, "k", "rk", ["v"])
    assert all(r["rk"] == min(r["k"] // 11 * 11, 499 * 11) for r in out.collect())


def test_range_flag_is_three_valued(spark):
    left = _df(spark, [(1, 10), (1, 20), (1, 21), (1, None), (2, 5)], "b long, tick int")
    state = _df(spark, [(1, 10, 20)], "b long, lo int, hi int")
    out = panel.in_range(left, state, "b", "tick", "lo", "hi").orderBy("b", F.col("tick").asc_nulls_last()).collect()
    assert [r["in_range"] for r in out] == [True, True, False, None, False]


def test_exclusion_nulls(spark):
    df = _df(spark, [("Transfer", panel.ADAPTERS[0].upper().replace("0X", "0x"), "0x1"), ("Transfer", "0x1", "0x2"), ("Transfer", None, "0x2"), ("Swap", panel.ADAPTERS[0], None), (None, panel.ADAPTERS[0], None)], "event_name string, from string, to string")
    kept = [tuple(r) for r in panel.exclude(df, "event_name", "Transfer", ["from", "to"]).collect()]
    assert len(kept) == 3 and ("Transfer", None, "0x2") not in kept


def test_split_example(spark):
    legs = _df(spark, [(0, 0.0), (0, 100.0), (0, 700.0), (0, 850.0), (1, 200.0), (1, 900.0), (1, 1000.0)], "leg int, t double")
    out = series.split(legs)
    assert out.first()["t_split"] == pytest.approx(800) and out.filter("is_train").count() == 4
    with pytest.raises(ValueError):
        series.split(legs, 0)


def test_last_bin_is_closed(spark):
    legs = _df(spark, [(0, 0.0), (0, 60.0), (0, 120.0), (1, 61.0)], "leg int, t double")
    got = {(r["leg"], r["bin"]): r["n"] for r in series.bin_counts(legs, 60).collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (1, 0): 0, (1, 1): 1}


def test_pit_identity_branch_and_ties(spark):
    v = _df(spark, [("a", 0.0, 0), ("a", 0.5, 1), ("a", 1.0, 2), ("b", 5.0, 0), ("b", 5.0, 1)], "k string, x double, i int")
    got = {(r["k"], r["i"]): r["u"] for r in series.pit(v, "k", "x", "i").collect()}
    assert got["a", 0] == 1e-10 and got["a", 1] == 0.5 and got["a", 2] == 1 - 1e-10
    assert got["b", 0] == pytest.approx(1 / 3) and got["b", 1] == pytest.approx(2 / 3)


def test_nan_moments_do_not_fire(spark):
    m = _df(spark, [(0, 100, float("nan"), 3.0), (1, 100, 1.0, 1.0), (2, 5, 1.0, 1.0)], "leg int, n long, skew double, kurt double")
    assert [r["fires"] for r in series.tail_gate(m).orderBy("leg").collect()] == [False, True, False]


def test_permutation_power(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    mk = lambda y: _df(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True), 1)], "i long, a double, b double")
    p = lambda y: series.permutation_p(series.permutation_null(mk(y), 99, 3)).first()["p_value"]
    assert p(x + 0.3 * rng.normal(size=200)) <= 0.05
    assert p(rng.normal(size=200)) >= 0.05


def test_manifest_keeps_the_old(spark):
    old = _df(spark, [("a", 1)], "k string, v int")
    new = _df(spark, [("a", 2), ("b", 3), ("b", 3)], "k string, v int")
    assert sorted(map(tuple, ledger.insert_new(old, new, "k").collect())) == [("a", 1), ("b", 3)]


def test_content_hash_ignores_order(spark):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    h = lambda d: ledger.content_hash(d).first()["hash"]
    assert h(a) == h(a.repartition(7).orderBy(F.desc("id"))) != h(a.filter("id > 0"))


def test_copula_fits_spread_their_pairs_and_sum_the_densities(spark, monkeypatch):
    """Pairs go to every core however few files they come in, and a pass's sums are those of the Column densities."""
    import numpy as np
    import pandas as pd

    from tideline.operators import dependence

    rng = np.random.default_rng(6)
    d = spark.createDataFrame(pd.DataFrame({"u": rng.uniform(1e-9, 1, 3000), "v": rng.uniform(1e-9, 1, 3000)})).coalesce(1)
    tried = {("clayton", 0.0): [1e-4, 0.7, 30.0], ("frank", 0.0): [1e-4, 3.0, 30.0], ("gumbel", 0.0): [1 + 1e-6, 2.0, 30.0]}
    got = dependence._scores(d, list(tried), tried)
    for (family, _), thetas in tried.items():
        for r in dependence.log_likelihood(d, family, thetas).collect():
            assert got[family, 0.0][r["theta"]] == pytest.approx(r["ll"], rel=1e-6, abs=1e-6)
    asked, kind = [], type(d)
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *n: (asked.append(n), plain(self, *n))[1])
    dependence.fit_menu(d, ("gaussian",))
    assert asked == [(3 * spark.sparkContext.defaultParallelism,)]
