import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tideline.operators import dependence, hawkes
from tideline.plans import catalog, catalog_process

P = hawkes.Params((0.02, 0.03), ((0.2, 0.1), (0.05, 0.25)), 0.5)


def _legs(spark, arrays):
    return spark.createDataFrame([(k, float(t)) for k, a in enumerate(arrays) for t in a], "leg int, t double")


def test_compensator_by_hand(spark):
    p = hawkes.Params((0.1, 0.1), ((0.5, 0.0), (0.0, 0.5)), 1.0)
    legs = _legs(spark, [[0.5, 2.0], [3.0]])
    got = {(r["leg"], r["t"]): r["big"] for r in hawkes.compensator(legs, p, 1.0).collect()}
    assert got[0, 2.0] == pytest.approx(0.1 + 0.5 * (math.exp(-0.5) - math.exp(-1.5)), abs=1e-9)


def test_ties_do_not_excite_each_other(spark):
    legs = _legs(spark, [[1.0, 1.0, 2.0], [1.0]])
    rows = {(r["leg"], r["t"]): (r["r_0"], r["r_1"]) for r in hawkes.excitation(legs, 0.5).collect()}
    assert rows[0, 1.0] == (0.0, 0.0) and rows[0, 2.0] == pytest.approx((2 * math.exp(-0.5), math.exp(-0.5)))
    states = hawkes.fold_states([np.array([1.0, 1.0, 2.0]), np.array([1.0])], 0.5)
    assert states[0][2] == pytest.approx(rows[0, 2.0]) and (states[0][:2] == 0).all()


def test_ll_forms_agree(spark):
    a = hawkes.simulate_hawkes(P, 400.0, 1)
    legs = _legs(spark, a)
    whole = hawkes.log_likelihood(legs, P, 400.0).first()["ll"]
    assert whole == pytest.approx(hawkes.ll_of(np.array(P.mu), np.array(P.alpha), P.beta, a, 400.0), abs=1e-6)
    zero = hawkes.Params(P.mu, ((0.0, 0.0), (0.0, 0.0)), 0.5)
    assert hawkes.log_likelihood(legs, zero, 400.0).first()["ll"] == pytest.approx(hawkes.poisson_log_likelihood(legs, P.mu, 400.0).first()["ll"], abs=1e-6)
    cut = 300.0
    parts = hawkes.log_likelihood(legs, P, cut).first()["ll"] + hawkes.log_likelihood(legs, P, 400.0, cut).first()["ll"]
    assert parts == pytest.approx(whole, abs=1e-6)
    assert hawkes.log_likelihood(legs.filter("leg = 0"), P, 400.0).first()["ll"] == -math.inf


def test_recovery_of_eta():
    eta = [hawkes.fit_beta(hawkes.simulate_hawkes(P, 6000.0, s), 0.5, 6000.0)["eta"] for s in range(3)]
    assert abs(np.mean(eta) - P.eta()) < 0.12


def test_fit_beats_a_grid():
    a = hawkes.simulate_hawkes(P, 1500.0, 5)
    best = hawkes.fit_beta(a, 0.5, 1500.0)["ll"]
    for m in (0.7, 1.0, 1.4):
        for s in (0.5, 1.0, 1.3):
            assert hawkes.ll_of(np.array(P.mu) * m, np.array(P.alpha) * s, 0.5, a, 1500.0) <= best + 1e-6


def test_profile_is_below_the_maximum_and_covers(spark):
    a = hawkes.simulate_hawkes(P, 2500.0, 2)
    rows = hawkes.profile(_legs(spark, a), 0.5, 2500.0, np.linspace(0.05, 0.95, 10).tolist())
    top = rows.filter("eta IS NULL").first()
    assert rows.filter(f"ll > {top['ll'] + 1e-3}").count() == 0
    ci = hawkes.profile_interval(rows).first()
    assert 0 < ci["lower"] <= top["eta_hat"] <= ci["upper"] < 1


def test_bootstrap_size_and_power(spark):
    flat = _legs(spark, hawkes.simulate_poisson((0.05, 0.05), 1000.0, 3))
    t = hawkes.bootstrap_test(hawkes.bootstrap(flat, 0.5, 1000.0, 20, 1)).first()
    assert t["p_value"] >= 0.05 and t["n_ok"] + t["n_failed"] == 20
    excited = _legs(spark, hawkes.simulate_hawkes(P, 1500.0, 4))
    assert hawkes.bootstrap_test(hawkes.bootstrap(excited, 0.5, 1500.0, 20, 1)).first()["p_value"] <= 0.05


def test_bootstrap_statistics_are_not_negative(spark):
    flat = _legs(spark, hawkes.simulate_poisson((0.05, 0.05), 600.0, 3))
    assert hawkes.bootstrap(flat, 0.5, 600.0, 10, 1).filter("stat < 0").count() == 0


def test_ks_p_values():
    # published critical values of the one-sample statistic at level 0.05
    for n, d in ((5, 0.5633), (10, 0.4093), (20, 0.2941), (50, 0.1884)):
        assert hawkes.ks_p_value(d, n) == pytest.approx(0.05, abs=2e-3)
    assert hawkes.ks_p_value(0.0, 5) == 1.0


def test_residuals_keep_their_events(spark):
    legs = _legs(spark, [[1.0, 1.0, 2.0], [1.5]])
    out = hawkes.residuals(legs, P).filter("leg = 0").orderBy("event_time", "rescaled_dt").collect()
    assert len(out) == 3 and sum(r["rescaled_dt"] is None for r in out) == 1 and out[-1]["event_time"] == 2.0 and out[-1]["rescaled_dt"] > 0


def test_inar_mean_rate():
    rates = [hawkes.mean_rate(hawkes.inar(hawkes.simulate_poisson((0.02, 0.03), 60000.0, s), 60000.0, 60, order=1)) for s in range(6)]
    assert np.mean(rates, axis=0) == pytest.approx([0.02, 0.03], rel=0.15)
    assert hawkes.inar([np.array([]), np.array([1.0])], 100.0, 10)["p"] == 0


def test_copula_families_are_told_apart(spark):
    for family, th in (("clayton", 2.0), ("gaussian", 0.7), ("gumbel", 2.0), ("frank", 6.0)):
        u = dependence.sample_copula(family, th, 0.0, 1500, 1)
        s = spark.createDataFrame([tuple(map(float, r)) for r in np.clip(u, 1e-9, 1 - 1e-9)], "u double, v double")
        best = dependence.best_family(dependence.fit_menu(s)).first()
        assert best["family"] == family and best["theta"] == pytest.approx(th, rel=0.25)
    few = spark.createDataFrame([(0.1 + i / 300, 0.2 + i / 300) for i in range(50)], "u double, v double")
    assert dependence.best_family(dependence.fit_menu(few)).first()["family"] == "degenerate"


def test_strip_and_stress(spark):
    normal = lambda u: np.exp(-0.5 * np.asarray(u) ** 2)
    k, q = dependence.invert(normal)
    assert np.abs(q - np.exp(-0.5 * k * k) / math.sqrt(2 * math.pi)).max() < 1e-9
    some = spark.createDataFrame([(1.0,), (-1.0,)], "x double")  # its characteristic function is the cosine
    slopes = dependence.characteristic(some, "x", [1.0, 10.0, 100.0])
    good = dependence.densities_of(spark, normal, attempts=2)
    assert not dependence.strip_state(good, slopes).first()["degenerate"]
    sold = dependence.strip(good, lambda k: k * k)
    assert sold.agg({"price": "sum"}).first()[0] == pytest.approx(1.0) and sold.count() == 2048
    spiky = dependence.densities(some, "x", spread=0.0, attempts=2)
    flat = dependence.strip_state(spiky, slopes).first()
    assert flat["degenerate"] and flat["n"] == 4096 and flat["reason"] == "positivity_fail_after_2_12" and flat["method"] in ("none", "PROJ", "COS")
    assert dependence.strip(spiky, lambda k: k).count() == 0
    rng = np.random.default_rng(0)
    x, y = rng.exponential(size=400), rng.exponential(size=400)
    frame = lambda v: spark.createDataFrame([(float(a),) for a in [*v, math.nan]] + [(None,)], "v double")
    points = dependence.scenarios(spark, rng.uniform(size=(4000, 2)), 4000)
    got = dependence.stress(points, frame(x), frame(y), "v", lambda a, b: a * b).first()
    assert got["comonotone"] >= got["independence"] and got["diverges"] and got["fitted"] == pytest.approx(got["independence"], rel=0.2)
    u = spark.createDataFrame([(0.0,), (0.3,), (0.5,), (1.0,)], "u double")
    at = {r["u"]: r["q"] for r in dependence.at_quantile(u, "u", frame(x), "v", "q").collect()}
    assert at == pytest.approx({k: np.quantile(x, k) for k in at})
    assert [r["q"] for r in dependence.at_quantile(u, "u", frame([]), "v", "q").orderBy("u").collect()] == [0.0, 0.3, 0.5, 1.0]


def test_compensator_equals_brute_force_before_and_after_the_start(spark):
    rng = np.random.default_rng(3)
    a = [np.round(rng.uniform(0, 300, 60)), rng.uniform(0, 300, 50)]
    got = sorted((r["leg"], r["t"], r["big"]) for r in hawkes.compensator(_legs(spark, a), P, 100.0).collect())
    part = lambda t, x: sum(math.exp(-P.beta * (max(100.0, u) - u)) - math.exp(-P.beta * (t - u)) for u in x if u < t)
    want = sorted((i, t, P.mu[i] * (t - 100) + sum(P.alpha[i][j] * part(t, a[j]) for j in (0, 1)) / P.beta) for i in (0, 1) for t in a[i] if t >= 100)
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-9)


def test_ordered_passes_do_not_grow_with_the_square(spark):
    n = 200_000  # a range join would meet 2e10 pairs
    legs = spark.range(n).select((F.col("id") % 2).cast("int").alias("leg"), F.col("id").cast("double").alias("t"))
    top = hawkes.compensator(legs, P).agg(F.count("*").alias("n"), F.max("big").alias("big")).first()
    assert top["n"] == n and top["big"] == pytest.approx(P.mu[1] * (n - 1) + sum(P.alpha[1]) / P.beta * n / 2, rel=1e-3)
    assert math.isfinite(hawkes.log_likelihood(legs, P, float(n)).first()["ll"])


def test_ks_p_values_of_large_samples_join_the_exact_ones():
    d = math.sqrt(3.76 / 1500)
    assert hawkes.ks_p_value(d * 1.0001, 1500) == pytest.approx(hawkes.ks_p_value(d, 1500), rel=0.02)
    assert hawkes.ks_p_value(0.0027, 100_001) == pytest.approx(hawkes.ks_p_value(0.0027, 100_000), rel=0.01)
    assert hawkes.ks_p_value(0.3, 20_000) < 1e-300 and hawkes.ks_p_value(1e-5, 200_000) == 1.0


def test_estimators_see_every_event(spark):
    l, end = catalog_process.process(spark, SF)
    assert l.count() == catalog_process.legs(spark, SF).count()
    seen = hawkes.fit_grid(l, end, (1e-3,)).first()
    assert catalog.queries()["hawkes_fit_grid"](spark, SF).filter("beta = 1e-3").first()["ll"] == pytest.approx(seen["ll"])


def test_fits_of_many_events_reach_the_top():
    a = hawkes.simulate_poisson((0.05, 0.05), 200_000.0, 4)
    flat = sum(len(x) * math.log(len(x) / 200_000.0) - len(x) for x in a)
    for beta in (1e-4, 1e-3, 1.0):
        best = hawkes.fit_beta(a, beta, 200_000.0)
        assert best["ll"] >= flat - 1e-6
        mu, alpha = np.array([best["mu0"], best["mu1"]]), np.array([[best["a00"], best["a01"]], [best["a10"], best["a11"]]])
        for m, s in ((1.0, 0.9), (1.0, 1.1), (0.999, 1.0), (1.001, 1.0), (1.002, 0.8)):
            assert hawkes.ll_of(mu * m, alpha * s, beta, a, 200_000.0) <= best["ll"] + 1e-6


def test_fits_by_aggregates_reach_the_same_top(spark):
    a = hawkes.simulate_hawkes(P, 900.0, 6)
    legs = _legs(spark, a)
    got = {r["beta"]: r for r in hawkes.fit_grid(legs, 900.0, (0.05, 0.5, 5.0), most_events=0).collect()}
    for beta, r in got.items():
        want = hawkes.fit_beta(a, beta, 900.0)
        assert r["ll"] == pytest.approx(want["ll"], abs=1e-6) and r["eta"] == pytest.approx(want["eta"], abs=1e-4) and r["boundary"] == want["boundary"]
    assert len(got) == 3 and hawkes.fit_table(legs.filter("leg = 0"), 0.5, 900.0) is None


def test_no_task_holds_a_process_that_leaves_the_bounds(spark, monkeypatch):
    a = hawkes.simulate_hawkes(P, 900.0, 6)
    want = hawkes.fit_beta(a, 0.5, 900.0, rounds=6, most=0.3)
    got = hawkes._fit_swept(_legs(spark, a), 0.5, 900.0, most=0.3, rounds=6)
    assert got["eta"] == pytest.approx(0.3) == want["eta"] and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in ("ll", "mu0", "mu1", "a00", "a01", "a10", "a11"))
    monkeypatch.setattr(hawkes, "MOST_EVENTS", 0)
    seen = hawkes.bootstrap(_legs(spark, a), 0.5, 900.0, 1, 3).filter("rep = 0").first()["stat"]
    assert seen == pytest.approx(hawkes.lr_statistic(a, 0.5, 900.0), abs=1e-5)


def test_excitation_that_never_shows_is_left_at_zero(spark):
    a = [np.arange(20) * 1000.0, np.arange(20) * 1000.0 + 500]
    best = hawkes.fit_beta(a, 1.0, 20_000.0)
    flat = sum(20 * math.log(20 / 20_000.0) - 20 for _ in a)
    assert best["ll"] == pytest.approx(flat, abs=1e-6) and max(best[k] for k in ("a00", "a01", "a10", "a11")) < 1e-9
    assert hawkes.fit_grid(_legs(spark, a), 20_000.0, (1.0,), most_events=0).first()["ll"] == pytest.approx(flat, abs=1e-6)


def test_profile_is_the_top_of_its_ratio(spark):
    p = hawkes.Params((0.05, 0.08), ((0.15, 0.1), (0.05, 0.2)), 0.5)
    a = hawkes.simulate_hawkes(p, 3000.0, 3)
    rows = hawkes.profile(_legs(spark, a), 0.5, 3000.0, [0.0, 0.25, 0.6])
    got = {r["eta"]: r["ll"] for r in rows.collect()}
    n = np.array([len(x) for x in a])
    assert got[0.0] == pytest.approx(float((n * np.log(n / 3000.0) - n).sum()))
    assert got[None] == pytest.approx(hawkes.fit_beta(a, 0.5, 3000.0)["ll"], abs=1e-4)
    rng = np.random.default_rng(5)
    for eta in (0.25, 0.6):
        best, at, wide = -np.inf, (n / 3000.0 * (1 - eta), np.ones((2, 2))), 1.0
        states = hawkes.fold_states(a, 0.5)
        for _ in range(3000):  # a blind climb over matrices scaled onto the ratio
            mu, m = at[0] * np.exp(wide * 0.3 * rng.normal(size=2)), at[1] * np.exp(wide * rng.normal(size=(2, 2)))
            m *= eta * 0.5 / hawkes.spectral(m)
            if (ll := hawkes.ll_of(mu, m, 0.5, a, 3000.0, states)) > best:
                best, at, wide = ll, (mu, m), min(1.0, wide * 1.5)
            else:
                wide = max(1e-3, wide * 0.97)
        assert got[eta] - 0.6 < best < got[eta] + 1e-6 and got[eta] >= hawkes.fit_beta(a, 0.5, 3000.0, eta=eta)["ll"] - 1e-6


def test_an_interval_holds_its_estimate(spark):
    """Also where the estimate lies below the first positive ratio of the grid."""
    legs = _legs(spark, hawkes.simulate_poisson([0.05, 0.06], 4000.0, 11))
    ci = hawkes.profile_interval(hawkes.profile(legs, 0.5, 4000.0)).first()
    assert 0.0 <= ci["lower"] <= ci["eta_hat"] <= ci["upper"] < 0.3 and ci["lower"] == 0.0
    none = hawkes.profile(legs.filter("leg = 0"), 0.5, 4000.0, [0.0, 0.5]).collect()
    assert all(r["ll"] == -math.inf for r in none)


def test_passes_over_parts_are_the_sums_over_all(spark):
    rng = np.random.default_rng(9)
    rows = [(float(i), int(rng.integers(0, 3)), int(rng.integers(0, 2)), float(rng.exponential()), float(rng.exponential())) for i in range(300)]
    d = spark.createDataFrame(rows, "t double, n_0 int, n_1 int, r_0 double, r_1 double").repartition(5)
    tries = rng.uniform(0.1, 1, (3, 2, 3))
    value, grad, outer = hawkes.leg_sums(d, tries)
    z, n = np.array([[1, r[3], r[4]] for r in rows]), np.array([[r[1], r[2]] for r in rows])
    for m in range(3):
        for k in (0, 1):
            lam = z @ tries[m, k]
            assert value[m, k] == pytest.approx((n[:, k] * np.log(lam)).sum())
            assert grad[m, k] == pytest.approx((n[:, k] / lam) @ z)
            assert outer[m, k] == pytest.approx((z * (n[:, k] / lam**2)[:, None]).T @ z)


@pytest.mark.parametrize("order", [None, 1, 3])
def test_autoregression_by_lagged_sums_is_the_regression_over_bins(spark, order):
    rng = np.random.default_rng(4)
    y = np.zeros((400, 2))
    for t in range(2, 400):
        y[t] = rng.poisson(0.3 + 0.4 * y[t - 1] + np.array([0.0, 0.3]) * y[t - 2, ::-1])
    legs = [np.repeat(np.arange(400), y[:, k].astype(int)) * 10.0 + 3.0 for k in (0, 1)]
    d = _legs(spark, legs)
    for widths in ((10.0, 37.0), (1000.0, 4000.0)):  # of 400, 109, 4 and 1 bins
        got = {r["width"]: r for r in hawkes.inar_grid(d, 4000.0, widths, order).collect()}
        for w in widths:
            want, r = hawkes.inar(legs, 4000.0, w, order=min(order or 99, max(1, math.ceil(4000 / w) // 3)) if order else None), got[w]
            assert (r["p"], r["bins"], r["negative"]) == (want["p"], want["bins"], want["negative"])
            if want["aic"] < -50:  # as many bins as coefficients: nothing is left to explain
                assert r["aic"] < -50
            else:
                assert r["aic"] == pytest.approx(want["aic"], rel=1e-8)
                assert np.array(r["coefs"]).reshape(-1) == pytest.approx(np.array(want["coefs"]).reshape(-1), abs=1e-8)
                assert r["intercept"] == pytest.approx(want["intercept"], abs=1e-8)


def test_a_fast_decay_over_a_long_span_asks_for_no_file_a_leaf(spark, monkeypatch):
    """Leaves are as short as the decay; twenty events over a year must not become half a million tasks."""
    asked = []
    kind = type(spark.range(1))
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *by: (asked.append(n), plain(self, min(n, 64), *by))[1])
    legs = _legs(spark, [np.linspace(0.0, 3e7, 11), np.linspace(5.0, 2.9e7, 9)])
    rows = hawkes.swept_table(legs, 10.0)
    assert asked == [spark.sparkContext.defaultParallelism]
    assert rows.agg(F.sum("n_0") + F.sum("n_1")).first()[0] == 20


def test_a_null_draw_holds_little_more_than_its_times_and_states():
    """A process of many events is fitted in chunks: about 90 bytes an event at the peak, and the same top."""
    import tracemalloc

    end = 2e5
    tracemalloc.start()
    legs = hawkes.simulate_poisson([1.0, 1.0], end, 3)
    seen = hawkes.lr_statistic(legs, 0.05, end)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * sum(map(len, legs))
    f = hawkes.fit_beta(legs, 0.05, end)
    states = hawkes.fold_states(legs, 0.05)
    whole = 0.0
    for i, (mu, alpha) in enumerate(((f["mu0"], (f["a00"], f["a01"])), (f["mu1"], (f["a10"], f["a11"])))):
        mass = np.array([(1 - np.exp(-0.05 * (end - x))).sum() for x in legs]) / 0.05
        whole += np.log(mu + states[i] @ alpha).sum() - mu * end - np.dot(alpha, mass)
    flat = sum(len(x) * math.log(len(x) / end) - len(x) for x in legs)
    assert seen == pytest.approx(max(0.0, 2 * (whole - flat)), abs=1e-6)


def test_a_process_of_few_events_goes_by_no_array(monkeypatch):
    """The same likelihood as by arrays, ties and times beyond the end included, without their cost a call."""
    rng = np.random.default_rng(8)
    mu, alpha = np.array([0.05, 0.04]), np.array([[0.3, 0.1], [0.2, 0.25]])
    each = [[np.sort(rng.integers(1, 51, n).astype(float)) for n in rng.integers(1, 6, 2)] for _ in range(50)]
    want = [hawkes.ll_of(mu, alpha, 1.0, x, 60.0, hawkes.fold_states(x, 1.0)) for x in each]
    far = hawkes.ll_of(mu, alpha, 1.0, [np.array([2000.0]), np.array([1.0])], 60.0)
    monkeypatch.setattr(hawkes, "fold_states", None)
    assert [hawkes.ll_of(mu, alpha, 1.0, x, 60.0) for x in each] == pytest.approx(want, rel=1e-12)
    assert far == math.inf


DRAWS = [((0.6, 0.5), 0.05, 1.2e5, 3), ((0.6, 0.5), 0.05, 1.2e5, 4), ((0.9, 0.3), 0.05, 6e4, 5), ((0.3, 0.25), 0.01, 6e4, 6), ((0.3, 0.25), 0.2, 6e4, 7)]


@pytest.mark.parametrize("mu, beta, end, seed", DRAWS)
def test_a_null_draw_that_is_not_held_has_the_same_statistic(monkeypatch, mu, beta, end, seed):
    want = hawkes.lr_statistic(hawkes.simulate_poisson(mu, end, seed), beta, end)
    monkeypatch.setattr(hawkes, "simulate_poisson", None)
    assert hawkes.null_statistic(mu, beta, end, seed) == pytest.approx(want, abs=1e-6)


def test_a_null_draw_holds_no_more_where_it_has_more_events():
    import tracemalloc

    peaks = []
    for end in (1e5, 1e6):
        tracemalloc.start()
        hawkes.null_statistic((1.0, 1.0), 0.05, end, 3)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] and peaks[1] < 8e6  # 144 MB as times and excitation


def test_null_draws_that_no_series_is_sure_of_are_fitted_whole(monkeypatch):
    few, slow, fast = ((0.05, 0.05), 0.01, 2e4, 3), ((1.0, 1.0), 1e-3, 2e4, 3), ((0.3, 0.25), 0.5, 6e4, 3)
    whole = lambda mu, beta, end, seed: hawkes.lr_statistic(hawkes.simulate_poisson(mu, end, seed), beta, end)
    for x in (few, slow, fast):
        assert hawkes.null_statistic(*x) == whole(*x)
    monkeypatch.setattr(hawkes, "_LEFT_OUT", 0.0)
    assert hawkes.null_statistic(*DRAWS[0]) == whole(*DRAWS[0])


def test_arrivals_in_windows_are_the_simulated_ones():
    end, rates = 30_000.0, (0.7, 0.9)
    want = hawkes.simulate_poisson(rates, end, 5)
    got = hawkes._Arrivals(np.random.default_rng(5), rates[0], end)
    parts = [got.until(t) for t in (10.0, 10.0, 9_000.0, 9_000.5, end)]
    assert np.concatenate(parts).tobytes() == want[0].tobytes() and all((x < t).all() for x, t in zip(parts, (10, 10, 9000, 9000.5, end), strict=True))


def test_earlier_events_are_strictly_earlier():
    for legs in ([[1.0, 2, 5], [1.5, 3]], [[1.0, 2, 2, 5], [2.0, 5, 5, 6]], [[], [1.0, 1]], [[], []]):
        legs = [np.array(x) for x in legs]
        got = hawkes._earlier(legs)
        for i, j in ((i, j) for i in (0, 1) for j in (0, 1)):
            assert got[i][j].tolist() == [int((legs[j] < t).sum()) for t in legs[i]]


def test_bootstrap_draws_many_events_as_the_whole_fit_sees_them(spark):
    legs = spark.range(24_000).select((F.col("id") % 2).cast("int").alias("leg"), (F.col("id") * 2.5).alias("t"))
    got = {r["rep"]: r["stat"] for r in hawkes.bootstrap(legs, 0.01, 60_000.0, 3, 11).collect()}
    want = {k: hawkes.lr_statistic(hawkes.simulate_poisson([0.2, 0.2], 60_000.0, 11 + k), 0.01, 60_000.0) for k in (1, 2, 3)}
    assert sorted(got) == [0, 1, 2, 3] and {k: got[k] for k in want} == pytest.approx(want, abs=1e-6)


def test_passes_over_packed_times_are_passes_over_times(spark):
    rng = np.random.default_rng(3)
    legs = _legs(spark, [np.sort(rng.uniform(0, 500, n)).round(1) for n in (900, 700)])
    rows = hawkes.swept_table(legs, 0.05)
    few = hawkes.packed(rows)
    assert few.count() <= rows.rdd.getNumPartitions() < 50 < rows.count()
    tries = np.array([[[0.5, 0.1, 0.2], [0.4, 0.2, 0.1]], [[1.5, 0.0, 0.1], [-1.0, 0.2, 0.0]]])
    for got, want in zip(hawkes.leg_sums(few, tries), hawkes.leg_sums(rows, tries), strict=True):
        assert np.allclose(got, want, rtol=1e-12, equal_nan=True)
