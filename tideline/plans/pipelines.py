"""The three entry points as plans: panel, fit, verdict. Stages pass state on, not files."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import dependence, hawkes, ledger, panel, series

materialize = panel.materialize

FIT_KEYS = (
    "run_id", "window", "split", "inar", "hawkes", "lr_test", "held_out", "stationarity", "ks", "profile_ci", "ties", "simultaneous", "log_likelihoods", "gate", "eta", "beta", "data_hash", "seed",
)
KS_LEVEL, LR_LEVEL = 0.05, 0.01


def data_hash(legs: DataFrame) -> str:
    return ledger.content_hash(legs.select("leg", "t")).first()["hash"] or hashlib.sha256(b"").hexdigest()


def fit(legs: DataFrame, reps: int = 200, decays=hawkes.DECAYS, etas=hawkes.ETA_GRID, held_out: float = 0.2, version: str = "v1") -> dict:
    """The whole fit of one process (leg, t) as a record; all times are shifted to the first event.

    The gate needs: the likelihood-ratio test rejects, both residual tests pass, the held-out likelihood
    beats constant rates, the interval of the branching ratio stays above zero, and rates are stationary.
    """
    first = legs.agg(F.min("t")).first()[0]
    if first is None:
        raise ValueError("no events")
    legs = hawkes.stored(legs.select("leg", (F.col("t") - F.lit(float(first))).alias("t")))
    w = series.window_of(legs).first()
    end = max(float(w["w_end"]), 1e-9)
    cut = (1 - held_out) * end
    h = data_hash(legs)
    seed = int(hashlib.sha256((h + "bootstrap").encode()).hexdigest()[:8], 16)
    train = legs.filter(F.col("t") < cut)
    best = hawkes.best(hawkes.fit_grid(train, cut, decays)).first()
    p = hawkes.Params((best["mu0"], best["mu1"]), ((best["a00"], best["a01"]), (best["a10"], best["a11"])), best["beta"])
    grid = [r.asDict() for r in hawkes.inar_grid(train, cut).orderBy("aic").collect()]
    lr = hawkes.bootstrap_test(hawkes.bootstrap(legs, p.beta, end, reps, seed), LR_LEVEL).first().asDict()
    n = {r["leg"]: r["n"] for r in train.groupBy("leg").agg(F.count("*").alias("n")).collect()}
    mu = [max(n.get(k, 0), 1) / cut for k in (0, 1)]
    out_hawkes = hawkes.log_likelihood(legs, p, end, cut).first()["ll"]
    out_poisson = hawkes.poisson_log_likelihood(legs, mu, end, cut).first()["ll"]
    still = series.stationarity(series.split(legs, held_out)).first()["piecewise_required"]
    ks = {r["leg"]: {"n": r["n"], "d": r["d"], "p": hawkes.ks_p_value(r["d"], r["n"])} for r in hawkes.ks_exponential(hawkes.residuals(legs, p, cut)).collect()}
    ci = hawkes.profile_interval(hawkes.profile(legs, p.beta, end, etas)).first().asDict()
    worst = min((x["p"] for x in ks.values()), default=math.nan)
    gate = {
        "lr_rejects": bool(lr["rejects"]), "ks_passes": bool(len(ks) == 2 and worst >= KS_LEVEL), "held_out_better": bool(out_hawkes > out_poisson),
        "interval_above_zero": bool(ci["lower"] > 0 and ci["lower"] > min(etas)), "stationary": not still,
    }
    return {
        "run_id": hashlib.sha256((h + version).encode()).hexdigest()[:12], "window": [0.0, end], "split": cut, "inar": grid, "hawkes": best.asDict(), "lr_test": lr,
        "held_out": {"hawkes": out_hawkes, "poisson": out_poisson}, "stationarity": {"piecewise_required": still}, "ks": ks, "profile_ci": ci,
        "ties": {r["leg"]: r["ties"] for r in series.ties(legs).collect()}, "simultaneous": series.simultaneous(legs).first()["simultaneous"],
        "log_likelihoods": {"train_hawkes": best["ll"]}, "gate": {**gate, "passes": all(gate.values())}, "eta": best["eta"], "beta": p.beta, "data_hash": h, "seed": seed,
    }


def hedge(report: dict, residuals: DataFrame, cost: str | None = None, reps: int = 200, max_lag: int = 50, samples: int = 10_000) -> dict:
    """Dependence, gates, strip, stress and verdict from a fit's record and its residuals (leg, event_time, rescaled_dt)."""
    good = hawkes.stored(residuals.filter(F.col("rescaled_dt").isNotNull() & ~F.isnan("rescaled_dt")))
    pairs = hawkes.stored(series.paired(good.select("leg", F.col("rescaled_dt").alias("x"), F.col("event_time").alias("t")), "x", "t"))
    n = pairs.count()
    out: dict = {"pairs": n}
    if n <= 2 * max_lag + 1:
        out["joint"] = {"family": "degenerate", "reason": f"{n} pairs do not exceed {2 * max_lag + 1}"}
        family = None
    else:
        out["correlogram"] = [r.asDict() for r in series.correlogram(pairs, max_lag).orderBy("lag").collect()]
        out["permutation"] = series.permutation_p(series.permutation_null(pairs, reps, max_lag)).first().asDict()
        u = series.pit(good.select("leg", F.col("rescaled_dt").alias("x"), F.col("event_time").alias("t")), "leg", "x", "t")
        menu = dependence.fit_menu(series.paired(u, "u", "t").select(F.col("a").alias("u"), F.col("b").alias("v")))
        family = dependence.best_family(menu).first().asDict()
        out["joint"] = family
    vol = series.variance_of_variance(good, "leg", "event_time", "rescaled_dt").agg(F.bool_or("fires").alias("f")).first()["f"]
    tails = series.tail_gate(series.moments(good, "leg", "rescaled_dt")).agg(F.bool_or("fires").alias("f")).first()["f"]
    eta = report["eta"]
    out["gate"] = {"vol_of_vol": bool(vol), "fat_tails": bool(tails), "self_excitation": bool(eta == eta and eta >= 0.2 and report["gate"]["interval_above_zero"])}
    out["gate"]["any"] = any(out["gate"].values())
    x, y = (dependence.quantiles(good.filter(F.col("leg") == k), "rescaled_dt") for k in (0, 1))
    fam = family or {"family": "independence", "theta": 0.0, "nu": 0.0}
    fitted = dependence.sample_copula(fam["family"], fam["theta"], fam["nu"], samples, report["seed"] % 2**32)
    sums = np.interp(fitted[:, 0], np.linspace(0, 1, max(len(x), 2)), np.sort(x) if len(x) > 1 else [0, 1]) + np.interp(fitted[:, 1], np.linspace(0, 1, max(len(y), 2)), np.sort(y) if len(y) > 1 else [0, 1])
    drawn = good.sparkSession.createDataFrame(pd.DataFrame({"x": sums}), "x double")
    strip = dependence.strip_state(dependence.densities(drawn, "x", spread=0.0, attempts=2), dependence.characteristic(drawn, "x", [1.0, 10.0, 100.0])).first().asDict()
    out["strip"] = strip
    points = dependence.scenarios(good.sparkSession, fitted, samples, str(report["seed"]))
    out["stress"] = dependence.stress(points, good.filter("leg = 0"), good.filter("leg = 1"), "rescaled_dt", lambda a, b: a + b).first().asDict()
    p = report["lr_test"]["p_value"]
    out["verdict"] = (
        "null_cost" if (cost or "").upper() == "FAIL" else "null_lr" if p is not None and p >= 0.05 else "null_convex" if not out["gate"]["any"] else "null_strip_unavailable" if strip["degenerate"] else None
    )
    return out
