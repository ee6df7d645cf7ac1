import datetime as dt

import numpy as np
import pytest

from tests.conftest import SF
from tideline.operators import dependence, series
from tideline.plans import catalog


def _events(spark, folder, values):
    """A folder with a table of events: a purchase and a click a second, of the values given for each."""
    at = lambda i, k: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i, milliseconds=500 * k)
    rows = [(2 * i + k, i % 7, ("purchase", "click")[k], at(i, k), float(v)) for k in (0, 1) for i, v in enumerate(values[k])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_permutation_test_sees_pairs_beyond_the_first(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=900), rng.normal(size=900)
    b[300 + 40 :] = a[300:-40]  # late pairs depend, at a lag of 40
    got = catalog.queries()["permutation_test"](spark, _events(spark, tmp_path, (a, b))).first()
    assert got["p_value"] == pytest.approx(1 / 1001)


def test_permutation_null_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=130), rng.normal(size=130)
    null = {r["rep"]: r["stat"] for r in series.permutation_null(spark.createDataFrame([(i + 1, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a double, b double"), 3).collect()}
    a, b = a - a.mean(), b - b.mean()
    from hashlib import md5

    for rep in range(4):
        c = b if rep == 0 else b[sorted(range(130), key=lambda i: md5(f"perm:{rep}:{i + 1}".encode()).hexdigest())]
        want = max(abs(sum(a[i] * c[i + k] for i in range(130) if 0 <= i + k < 130)) for k in range(-50, 51)) / np.sqrt((a @ a) * (b @ b))
        assert null[rep] == pytest.approx(want, abs=1e-12)


def test_permutations_in_waves_and_buckets_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pairs = spark.createDataFrame([(i + 1, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.normal(size=700), rng.normal(size=700), strict=True))], "i int, a double, b double").cache()
    stats = lambda **k: {r["rep"]: r["stat"] for r in series.permutation_null(pairs, 7, **k).collect()}
    whole = stats()
    seen = []
    map_in_pandas = type(pairs).mapInPandas
    monkeypatch.setattr(type(pairs), "mapInPandas", lambda *a, **k: seen.append(spark.conf.get(series.CLEANUP, None)) or map_in_pandas(*a, **k))
    parts = stats(bucket_rows=100, wave_rows=1500)
    assert seen == ["true"] * 4 and spark.conf.get(series.CLEANUP, "false") == "false"  # two replicates a wave
    assert sorted(parts) == list(range(8)) and all(parts[k] == pytest.approx(whole[k], abs=1e-12) for k in whole)


def test_bootstrap_has_as_many_draws_as_its_level_needs(spark):
    got = catalog.queries()["bootstrap_lr"](spark, SF).first()
    assert got["n_ok"] + got["n_failed"] == 1000


def test_quantiles_see_every_row(spark):
    values = np.random.default_rng(3).exponential(size=1000)
    df = spark.createDataFrame([(float(v),) for v in [*values, float("nan")]], "x double")
    for points in (11, 300, 999):
        want = np.quantile(values, np.linspace(0, 1, points))
        assert dependence.quantiles(df, "x", points) == pytest.approx(want)
    assert dependence.quantiles(df, "x").tolist() == sorted(values)


def test_stress_sees_rows_after_the_first_twenty_thousand(spark, tmp_path):
    values = np.r_[np.ones(20_000), np.full(5000, 1001.0)]
    got = catalog.queries()["stress"](spark, _events(spark, tmp_path, (values, values))).first()
    assert got["independence"] == pytest.approx(402, rel=0.1)  # 2 if only the first rows count
