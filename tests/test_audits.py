"""Macro groups, validation and the walk-forward study on small panels."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import kernels
from tidepanel.operators import backtest, checks, macro, pipelines, portfolio, xsection
from tidepanel.operators import ic as ics

DAY = datetime.date(2020, 1, 1)


def days(n):
    return [DAY + datetime.timedelta(days=i) for i in range(n)]


@pytest.fixture(scope="module")
def small(spark):
    """120 days of 14 entities; x leads y, z is noise; one entity comes late and one has holes."""
    rng = np.random.default_rng(4)
    rows = []
    for i, d in enumerate(days(120)):
        for k in range(14):
            if k == 13 and i < 60:
                continue
            x, z = rng.normal(size=2)
            rows.append((d, f"E{k:02d}", float(x), float(z), float(0.02 * x + 0.01 * rng.normal()), None if k == 12 and i % 3 else 10.0 + k, 100.0))
    return spark.createDataFrame(rows, "dt date, ticker string, x double, z double, y double, close double, volume double").cache()


def test_macro_groups_need_their_series_and_follow_their_formulas(spark):
    rng = np.random.default_rng(2)
    names = ["tsy_2y", "tsy_10y", "hy_spread", "vix", "cpi_index", "initial_claims"]
    frame = pd.DataFrame({"dt": days(90), **{n: 5 + rng.normal(size=90).cumsum() / 3 for n in names}})
    r = macro.Rows(4, 8, 20)
    got = macro.macro_groups(spark.createDataFrame(frame), r).toPandas().sort_values("dt").reset_index(drop=True)
    slope = frame.tsy_10y - frame.tsy_2y
    z = lambda s: (s - s.rolling(20, min_periods=10).mean()) / (s.rolling(20, min_periods=10).std() + 1e-8)
    yoy = (frame.cpi_index / frame.cpi_index.shift(20) - 1) * 100
    claims = frame.initial_claims.rolling(4, min_periods=2).mean()
    place = frame.hy_spread.rolling(20, min_periods=10).rank(pct=True)
    step = lambda s, good, bad: np.where(good(s), 1, np.where(bad(s), -1, 0))
    score = step(slope, lambda s: s > 0.5, lambda s: s < 0) + step(place, lambda s: s < 0.3, lambda s: s > 0.7) + step(z(frame.vix), lambda s: s < -0.5, lambda s: s > 1)
    want = {
        "yc_slope_10_2": slope, "yc_slope_momentum_21": slope.diff(4), "yc_inverted": (slope < 0).astype(float), "yc_slope_zscore": z(slope), "cpi_yoy": yoy, "inflation_high": (yoy > yoy.rolling(40).quantile(0.8)).astype(float),
        "claims_4wk_ma": claims, "claims_momentum_4w": claims.pct_change(4, fill_method=None), "credit_stress": (frame.hy_spread > frame.hy_spread.rolling(20).quantile(0.8)).astype(float),
        "macro_regime_score": pd.Series(score, dtype=float), "risk_on": pd.Series(score >= 2).astype(float), "risk_off": pd.Series(score <= -2).astype(float),
    }
    for name, values in want.items():
        assert np.allclose(got[name].astype(float), values, equal_nan=True, atol=1e-9), name
    assert not {"yc_curvature", "real_rate_10y", "quality_spread", "fci", "epu", "indpro_yoy", "_place"} & set(got.columns)


def test_filters_drop_late_and_sparse_entities_and_bad_columns(small):
    late = checks.listed_in_time(small, DAY + datetime.timedelta(days=60), 40)
    assert {r.ticker for r in late.select("ticker").distinct().collect()} == {f"E{k:02d}" for k in range(13)}
    dense = checks.dense_entities(small)
    assert "E12" not in {r.ticker for r in dense.select("ticker").distinct().collect()} and dense.select("ticker").distinct().count() == 13
    flat = small.withColumns({"one": F.lit(1.0), "void": F.lit(None).cast("double")})
    assert "one" not in checks.drop_columns(flat, ["x", "one", "void"], 0.2, 10, 1e-10).columns
    assert set(flat.columns) - set(checks.drop_columns(flat, ["x", "close", "one", "void"], 0.0).columns) == {"close", "void"}


def test_gates_raise(spark, small):
    assert checks.gate(small, ["x", "y"]) is small
    with pytest.raises(checks.DataError, match="close"):
        checks.gate(small, ["x", "close"])
    with pytest.raises(checks.DataError, match="x 1"):
        checks.gate(small.withColumn("x", F.when((F.col("dt") == F.lit(DAY)) & (F.col("ticker") == "E00"), F.lit(float("inf"))).otherwise(F.col("x"))), ["x"])
    series = spark.createDataFrame([("a", DAY, 1.0), ("b", DAY + datetime.timedelta(days=50), 1.0)], "name string, dt date, value double")
    start = DAY + datetime.timedelta(days=40)
    assert {r.name: r.late for r in checks.available(series, start, 20, fatal=False).collect()} == {"a": False, "b": True}
    with pytest.raises(checks.DataError, match="b"):
        checks.available(series, start, 20, fatal=True)
    assert checks.require_target(small, "y") == "y"
    for bad in ("FwdRet_21", "ticker", "void"):
        with pytest.raises(checks.DataError, match=bad):
            checks.require_target(small.withColumn("void", F.lit(None).cast("double")), bad)


@pytest.mark.parametrize(
    ("config", "wrong"),
    [
        ({"long_only": True, "short_only": True}, "exclude"),
        ({"start": DAY, "end": DAY}, "before"),
        ({"start": DAY, "end": DAY + datetime.timedelta(days=300), "formation_years": 1}, "365"),
        ({"long_quantile": 1.5}, "long_quantile"),
        ({"cap": 0}, "cap"),
        ({"horizon": 0}, "horizon"),
        ({"mode": "both"}, "both"),
    ],
)
def test_configurations_that_cannot_work_are_refused(config, wrong):
    with pytest.raises(checks.DataError, match=wrong):
        checks.validate(config)
    fine = {"start": DAY, "end": DAY + datetime.timedelta(days=900), "formation_years": 1, "long_quantile": 0.67, "mode": "ls", "long_only": False}
    assert checks.validate(fine) is fine


def test_requirements_and_defaults(spark, small):
    need = checks.requirements(datetime.date(2022, 1, 1), datetime.date(2023, 1, 1), 1, 0.5, 252, 21, today=datetime.date(2023, 1, 10))
    assert need.lookback == 630 and need.earliest == datetime.date(2022, 1, 1) - datetime.timedelta(days=945) and need.latest == datetime.date(2023, 1, 10)
    own = checks.against_requirements(small, checks.Requirements(DAY, DAY + datetime.timedelta(days=119), 0)).collect()
    assert {r.ticker for r in own if not r.fine} == {"E13"}
    meta = spark.createDataFrame([("a", None), ("b", 0.2)], "ticker string, cap double")
    assert {(r.ticker, r.cap, r.family) for r in checks.with_defaults(meta, {"cap": 0.1, "family": "other"}).collect()} == {("a", 0.1, "other"), ("b", 0.2, "other")}


def test_residuals_to_any_number_of_controls(small):
    df = small.withColumn("c3", F.col("x") * F.col("z"))
    for controls in (("x",), ("x", "z"), ("x", "z", "c3")):
        got = xsection.residual(df, "y", controls, least=10).toPandas()
        for _, part in got.groupby("dt"):
            a = np.column_stack([np.ones(len(part)), *(part[k] for k in controls)])
            beta = np.linalg.solve(a.T @ a + 1e-6 * np.eye(len(controls) + 1), a.T @ part["y"])
            assert np.allclose(part["y_resid"], part["y"] - a @ beta, atol=1e-9)
    twins = xsection.residual(df.withColumn("x2", F.col("x") * 2), "y", ("x", "x2"), least=10)  # only the ridge tells them apart
    assert twins.where("y_resid is null or isnan(y_resid)").count() == 0
    holes = xsection.residual(df, "y", ("x", "close"), least=14)
    assert holes.where("abs(y_resid - y) > 1e-12").select("dt").distinct().count() < 120
    assert holes.where("close is null and y_resid is not null").where(F.abs(F.col("y_resid") - F.col("y")) > 1e-12).count() == 0


def test_of_features_alike_the_one_that_says_more_stays():
    pairs = [("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", -0.8), ("a", "d", 0.2), ("b", "d", None), ("c", "d", 0.76)]
    assert pipelines.most_informative(["a", "b", "c", "d"], {"a": 0.2, "b": 0.5, "c": 0.1, "d": 0.0}, pairs) == ["b"]
    assert pipelines.most_informative(["a", "b"], {"a": 0.3, "b": 0.3}, pairs) == ["a"]


def test_expanding_folds_look_only_back():
    """The last part follows another law: folds that look ahead would know it, expanding ones are judged by it alone."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = x[:, 0] + 0.1 * rng.normal(size=300)
    y[250:] = 0.0
    ahead, back = kernels.lasso_cv(x, y, folds=5), kernels.lasso_cv(x, y, folds=5, expanding=True)
    assert ahead[2] != back[2] or not np.allclose(ahead[0], back[0])
    coef = kernels.lasso_cv(x[:250], y[:250], expanding=True)[0]
    assert coef[0] > 0.9 and np.abs(coef[1:]).max() < 0.05


def test_walk_forward_learns_only_from_the_past(spark, small):
    grid = spark.createDataFrame([(i + 1, DAY + datetime.timedelta(days=d), d + 1) for i, d in enumerate((5, 60, 90, 110))], "window_id int, at date, at_row int")
    modes = spark.createDataFrame([(1, "ls"), (2, "ls"), (3, "long_only"), (4, "short_only")], "window_id int, mode string")
    ic = ics.daily_ic(small, ["x", "z"], "y")
    weights = backtest.learned_weights(ic, grid)
    found = {(r.window_id, r.feature): r.weight for r in weights.collect()}
    assert {k for k in found if k[1] == "x"} == {(2, "x"), (3, "x"), (4, "x")} and all(v > 0.5 for k, v in found.items() if k[1] == "x")
    # what comes after the embargo changes nothing
    spoiled = ics.daily_ic(small.withColumn("y", F.when(F.col("dt") > DAY + datetime.timedelta(days=60 - 21), F.lit(0.5) - F.col("y")).otherwise(F.col("y"))), ["x", "z"], "y")
    assert {(r.window_id, r.feature): r.weight for r in backtest.learned_weights(spoiled, grid).collect()}[2, "x"] == pytest.approx(found[2, "x"])
    rules = portfolio.Rules(cap=0.2)
    bars = small.withColumn("close", F.lit(10.0)).withColumn("dt", F.col("dt"))
    out = {r.window_id: r for r in backtest.walk_forward(small, ic, grid, modes, ["x", "z"], "y", "x", rules, bars=bars, least=12).collect()}
    assert sorted(out) == [1, 2, 3, 4] and all(r.n_long == r.n_short == 0 and r.turnover == 0 and r.net_ret == pytest.approx(0.034 * 21 / 365) for r in out.values())  # listed for too short a time
    old = bars.withColumn("dt", F.date_sub("dt", 400)).unionByName(bars)
    out = {r.window_id: r for r in backtest.walk_forward(small, ic, grid, modes, ["x", "z"], "y", "x", rules, bars=old).collect()}
    assert out[1].n_features == 0 and out[1].n_long and out[2].n_long and out[2].n_short  # the first falls back
    assert out[3].n_long and not out[3].n_short and out[4].n_short and not out[4].n_long
    capital = 1.0
    for i in (1, 2, 3, 4):
        capital *= 1 + out[i].net_ret
        assert out[i].capital == pytest.approx(capital)
    assert out[2].long_ret > 0 > -out[2].short_ret
