"""Operators that go over the rows of a table: sweeps, designs, transforms of all rows, configurations as columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import bigints
from tideline.operators import dependence, ledger
from tideline.sources import config


def test_sweeps_of_rows(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.5), ("c", None)], "k string, x double")
    cells = ledger.sweep_rows(d, {"p": [0.1, 1.0], "q": [1.0, 2.0, 3.0]}, F.col("x") * F.col("p") * F.col("q") > 0.25)
    got = {r["k"]: (r["cells"], r["outcomes"], r["invariant"]) for r in ledger.invariance(cells, ["k"]).collect()}
    assert got == {"a": (12, 2, False), "b": (6, 2, False), "c": (6, 0, False)}
    assert ledger.invariance(ledger.sweep_rows(d, {"p": [0.1]}, F.col("x") > 9), ["k"]).filter("k = 'a'").first()["invariant"]
    with pytest.raises(ValueError):
        ledger.sweep_rows(d, {"p": [0.0] * 101, "q": [0.0] * 100}, F.lit(True))


def test_designs_hold_each_stratum_once(spark):
    d = spark.createDataFrame([(1, 2.0, -4.0), (2, None, 1.0)], "k long, a double, b double")
    got = dependence.designs(d, "k", ["a", "b"], 8)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    one = got.filter("k = 1").toPandas()
    for c, lo, hi in (("x0", 1.0, 3.0), ("x1", -6.0, -2.0)):
        assert sorted(np.floor((one[c] - lo) / (hi - lo) * 8)) == list(range(8))
    assert got.filter("k = 2 AND x0 IS NULL AND x1 BETWEEN 0.5 AND 1.5").count() == 8
    flips = {r["k"]: r for r in dependence.sensitivity(got, F.col("x1") < 1.0, F.col("b") < 1.0, ["k"]).collect()}
    assert flips[1]["flips"] == 0 and flips[2]["flips"] == 4 and len(flips[2]["examples"]) == 4 and flips[2]["fragile"]


def test_transform_of_all_rows_equals_the_characteristic_function(spark):
    rng = np.random.default_rng(3)
    x = [*rng.normal(0, 30, 500), 1e4, math.nan, math.inf, None]
    d = spark.createDataFrame([(float(v) if v is not None else None,) for v in x], "x double")
    phi = dependence.transform(d, "x", 64, 200.0)
    u = (np.arange(64) - 32) * 6.25
    good = d.filter("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')")
    want = {r["u"]: complex(r["re"], r["im"]) for r in dependence.characteristic(good, "x", list(u)).collect()}
    assert max(abs(p - want[float(v)]) for p, v in zip(phi, u, strict=True)) < 1e-9
    none = dependence.densities(d.filter("x > 1e9 AND x < 1e10"), "x", 64)
    assert none.agg(F.max(F.abs("q"))).first()[0] == 0


def test_finer_attempts_come_from_one_transform(spark):
    d = spark.createDataFrame([(0.1 * i,) for i in range(-20, 21)], "x double")
    both, one = dependence.densities(d, "x", 256, attempts=2), dependence.densities(d, "x", 256)
    first = both.filter("attempt = 0").orderBy("k").toPandas()
    assert np.allclose(first["q"], one.orderBy("k").toPandas()["q"], atol=1e-12) and both.filter("attempt = 1").count() == 512


def test_front_matter_as_a_column(spark):
    texts = ["---\nverdict: fail\nb: \"x: y\"\n---\nverdict: pass", "---\na: 1\na : 2\n---", "verdict: no", "", "---\nb: 1"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    for key in ("verdict", "a", "b"):
        got = [r["v"] for r in d.orderBy("i").select(config.front_matter_value(F.col("t"), key).alias("v")).collect()]
        assert got == [config.front_matter(t).get(key) for t in texts] + [None]


def test_specifications_in_bulk(spark):
    a = "0x" + "A" * 40
    good = f'[protocol]\nname = "x"\n[protocol.anchor_pool]\naddress = "{a}"\nfee_tier_bps = 7\n'
    rows = [(1, good + "[protocol.vaults.v1]\nactive = true\n[protocol.vaults.v2]\n"), (2, good), (3, good.replace("0xA", "0xZ")), (4, None), (5, "[protocol"), (6, "protocol = 3")]
    got = config.protocols(spark.createDataFrame(rows, "k long, t string"), "t", "k").collect()
    assert [(r["vault"], r["active"], r["pool"], r["finality"]) for r in got if r["k"] == 1] == [("v1", True, a.lower(), 120), ("v2", False, a.lower(), 120)]
    assert [(r["vault"], r["fee_tier"]) for r in got if r["k"] == 2] == [(None, 7)]
    assert sorted(r["k"] for r in got if r["error"]) == [3, 4, 5, 6] and len(got) == 7
    heads = spark.createDataFrame([("5", 6), ("", 6), (None, None)], "e string, s long")
    assert [r["h"] for r in heads.select(config.head_of(F.col("e"), F.col("s"), F.lit(7)).alias("h")).collect()] == [5, 6, 7]


def test_topics_of_a_column(spark):
    d = spark.createDataFrame([("Transfer(address,address,uint256)",), (None,)], "s string")
    assert [r["t"] for r in d.select(bigints.topic_udf("s").alias("t")).collect()] == ["0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef", None]


def test_normal_quantiles(spark):
    from statistics import NormalDist

    ps = [1e-300, 1e-10, 0.001, 0.07, 0.0750001, 0.3, 0.5, 0.7, 0.95, 1 - 1e-9]
    d = spark.createDataFrame([(p,) for p in ps], "p double")
    got = {r["p"]: r["q"] for r in d.select("p", F.expr(dependence.normal_quantile("p")).alias("q")).collect()}
    assert got == pytest.approx({p: NormalDist().inv_cdf(p) for p in ps}, rel=1e-12, abs=1e-14)


def test_menu_of_copulas_reaches_each_top(spark):
    u = np.clip(dependence.sample_copula("t", 0.6, 4.0, 3000, 5), 1e-9, 1 - 1e-9)
    rows = [(float(a), float(b)) for a, b in u] + [(None, 0.5), (0.5, math.nan), (0.0, 0.5), (1.0, 0.2)]
    s = spark.createDataFrame(rows, "u double, v double")
    menu = {r["family"]: r for r in dependence.fit_menu(s).collect()}
    assert set(menu) == set(dependence.FAMILIES) and dependence.best_family(dependence.fit_menu(s)).first()["family"] == "t"
    assert menu["t"]["theta"] == pytest.approx(0.6, abs=0.05) and menu["t"]["nu"] in (3.0, 4.0, 6.0)
    good = s.filter("u > 0 AND u < 1 AND v > 0 AND v < 1")
    for f in ("clayton", "frank", "gumbel"):
        th = menu[f]["theta"]
        near = {r["theta"]: r["ll"] for r in dependence.log_likelihood(good, f, [th * 0.999, th, th * 1.001]).collect()}
        assert max(near, key=near.get) == th and near[th] == pytest.approx(menu[f]["ll"], rel=1e-12)
    turned = s.selectExpr("u", "1 - v AS v")  # these families know no negative dependence: they end at independence
    ends = {r["family"]: r["theta"] for r in dependence.fit_menu(turned, ("clayton", "frank", "gumbel")).collect()}
    assert ends == {f: dependence.BOUNDS[f][0] for f in ends}
