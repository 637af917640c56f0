"""Properties and formula parity of the library's operators on made-up panels."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import classify, kernels, stats
from tidepanel.functions import windows as w
from tidepanel.operators import ic as ics
from tidepanel.operators import interactions, lab, performance, portfolio, regime, selection, universe
from tidepanel.operators import timeseries as ts
from tidepanel.operators import xsection as xs
from tidepanel.sources import tables

START = datetime.date(2020, 1, 1)


def make_bars(n=140, entities=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(entities):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i in range(n):
            spread = close[i] * rng.uniform(0.001, 0.02)
            rows.append((START + datetime.timedelta(days=i), f"T{k}", close[i] - spread / 3, close[i] + spread, close[i] - spread, close[i], float(rng.integers(0, 1000))))
    return pd.DataFrame(rows, columns=["dt", "ticker", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="module")
def frame():
    return make_bars()


@pytest.fixture(scope="module")
def bars(spark, frame):
    return spark.createDataFrame(frame).cache()


def by(df, ticker, *names):
    return df.where(F.col("ticker") == ticker).orderBy("dt").select(*names).toPandas().astype(float)


def test_rolling_features_equal_pandas(bars, frame):
    df = ts.levels(ts.moments(ts.with_returns(bars)))
    got = by(df, "T1", "x", "std_21", "skew_21", "kurt_63", "ma_42", "rsi_14", "dd_21", "boll_up_21", "ret_z")
    close = frame[frame.ticker == "T1"].close.reset_index(drop=True)
    pct = close.pct_change() * 100
    x = pct.clip(-5 * pct.std(), 5 * pct.std())
    d = close.diff()
    gain, loss = d.clip(lower=0).rolling(14).mean(), (-d.clip(upper=0)).rolling(14).mean()
    peak = close.rolling(21, min_periods=10).max()
    want = pd.DataFrame({
        "x": x, "std_21": x.rolling(21).std(), "skew_21": x.rolling(21).skew(), "kurt_63": x.rolling(63).kurt(), "ma_42": close.rolling(42).mean(), "rsi_14": 100 - 100 / (1 + gain / loss),
        "dd_21": ((close - peak) / peak).rolling(21, min_periods=10).min(), "boll_up_21": x.rolling(21).mean() + 2 * x.rolling(21).std(), "ret_z": x / (x.rolling(60, min_periods=30).std() + 1e-8),
    })
    pd.testing.assert_frame_equal(got, want, atol=1e-8)


def test_features_do_not_look_ahead(spark, bars):
    cut = START + datetime.timedelta(days=100)
    early = bars.where(F.col("dt") <= F.lit(cut))
    for make, names in ((ts.volume, ["obv_slope_21", "pv_corr_21", "breakout_63"]), (ts.structure, ["vol_regime_duration", "price_streak", "trend_r2_21"]), (ts.liquidity, ["amihud_21", "cs_spread_21"])):
        whole = make(bars.withColumn("ret", F.col("close") / w.lag("close") - 1)).where(F.col("dt") <= F.lit(cut))
        part = make(early.withColumn("ret", F.col("close") / w.lag("close") - 1))
        for t in ("T0", "T2"):
            pd.testing.assert_frame_equal(by(whole, t, *names), by(part, t, *names), atol=1e-9)


def test_results_do_not_depend_on_partitions(spark, bars):
    found = []
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(ts.structure(ts.with_returns(bars)).orderBy("ticker", "dt").select("price_streak", "vol_regime_pct", "price_z_50").toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    pd.testing.assert_frame_equal(found[0], found[1])
    pd.testing.assert_frame_equal(found[0], found[2])


def test_edges_zero_volume_constant_price_and_gaps(spark):
    rows = [(START + datetime.timedelta(days=3 * i), "A", 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(80)] + [(START, "B", 1.0, 1.0, 1.0, 1.0, None)]
    df = ts.with_returns(spark.createDataFrame(rows, "dt date, ticker string, open double, high double, low double, close double, volume double"))
    last = ts.structure(ts.volume(ts.levels(df))).where("ticker = 'A'").orderBy(F.desc("dt")).first()
    assert last.rsi_14 is None and last.williams_14 is None and last.trend_r2_21 is None and last.pv_corr_21 is None and last.breakout_63 == 0.0
    assert ts.hurst(df).where("hurst_21 is not null").count() == 0


def test_percent_rank_uses_average_ties(spark):
    df = spark.createDataFrame([(START, t, v) for t, v in zip("abcde", [1.0, 2.0, 2.0, None, 3.0], strict=True)], "dt date, ticker string, v double")
    got = {r.ticker: r.p for r in df.withColumn("p", w.percent_rank(F.col("v"))).collect()}
    assert got == {"a": 0.25, "b": 0.625, "c": 0.625, "d": None, "e": 1.0}


@pytest.fixture(scope="module")
def section(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(30):
        a, b = rng.normal(1, 0.3, 25), rng.normal(0.2, 0.05, 25)
        y = 0.05 * a - 0.3 * b + rng.normal(0, 0.02, 25)
        rows += [(START + datetime.timedelta(days=d), f"T{i:02d}", float(y[i]), float(a[i]), float(b[i]), f"g{i % 3}") for i in range(25)]
    return spark.createDataFrame(rows, "dt date, ticker string, fwd_21 double, beta_mkt_63 double, idio_vol_63 double, family string").cache()


def test_labels_are_centred_uncorrelated_with_risk_and_standard(section):
    df = xs.labels(section).toPandas()
    assert df.groupby("dt").y_cs.mean().abs().max() < 1e-10
    for control in ("beta_mkt_63", "idio_vol_63"):
        assert abs(df.y_resid.corr(df[control])) < 0.1
    g = df.groupby("dt").y_resid_z
    assert g.mean().abs().max() < 1e-8 and (g.std() - 1).abs().max() < 1e-8
    one = df[df.dt == df.dt.min()]
    x = np.column_stack([np.ones(25), one.beta_mkt_63, one.idio_vol_63])
    beta = np.linalg.solve(x.T @ x + 1e-6 * np.eye(3), x.T @ one.y_cs)
    assert np.allclose(one.y_resid, one.y_cs - x @ beta)


def test_residual_passes_small_dates_through_and_drops_incomplete_rows(spark, section):
    small = section.where(F.col("ticker") < "T10")
    assert xs.residual(small.withColumn("y", F.col("fwd_21")), "y", ("beta_mkt_63", "idio_vol_63")).where("abs(y_resid - y) > 1e-12").count() == 0
    holes = section.withColumn("beta_mkt_63", F.when(F.col("ticker") != "T00", F.col("beta_mkt_63"))).withColumn("y", F.col("fwd_21"))
    got = xs.residual(holes, "y", ("beta_mkt_63", "idio_vol_63"))
    assert got.where("ticker = 'T00' and y_resid is not null").count() == 0 and got.where("y_resid is null").count() == 30


def test_imputation_takes_the_median_then_the_past(spark):
    rows = [(START, "a", 1.0), (START, "b", 3.0), (START, "c", None), (START + datetime.timedelta(days=1), "a", None), (START + datetime.timedelta(days=1), "b", None), (START + datetime.timedelta(days=1), "c", None)]
    got = {(r.dt, r.ticker): r.v for r in xs.imputed(spark.createDataFrame(rows, "dt date, ticker string, v double"), ["v"]).collect()}
    assert [got[START, t] for t in "abc"] == [1.0, 3.0, 2.0] and [got[START + datetime.timedelta(days=1), t] for t in "abc"] == [1.0, 3.0, 2.0]


def test_asof_takes_the_last_known_value(spark):
    day = lambda n: START + datetime.timedelta(days=n)
    panel = spark.createDataFrame([(day(n), "a") for n in (0, 3, 5, 9)], "dt date, ticker string")
    series = spark.createDataFrame([("v", day(1), 1.0), ("v", day(5), 2.0), ("u", day(0), 7.0)], "name string, dt date, value double")
    got = [(r.v, r.u) for r in xs.asof(panel, series, ["v", "u"]).orderBy("dt").collect()]
    assert got == [(None, 7.0), (1.0, 7.0), (2.0, 7.0), (2.0, 7.0)]


def test_t_distribution_and_false_discovery_control(spark):
    # known two-sided values
    assert stats.t_two_sided(np.array([2.0, 0.0, -2.228, 1.96]), np.array([10.0, 5.0, 10.0, 1e7])) == pytest.approx([0.07338803, 1.0, 0.05001176, 0.0499958], abs=2e-6)
    assert np.isnan(stats.t_two_sided(np.array([np.nan]), np.array([3.0]))).all()
    p = [0.001, 0.2, 0.03, 0.04, 0.9, 0.03]
    df = spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(p)], "feature string, p_value double")
    got = {r.feature: r.p_adjusted for r in ics.benjamini_hochberg(df).collect()}
    order = np.argsort(p, kind="stable")
    want = np.minimum(1, np.minimum.accumulate((np.array(p)[order] * 6 / np.arange(1, 7))[::-1])[::-1])
    assert [got[f"f{i}"] for i in order] == pytest.approx(list(want))


def test_formation_finds_signal_and_not_noise(spark):
    rng = np.random.default_rng(7)
    rows = []
    for d in range(160):
        s, n = rng.normal(size=(2, 30))
        y = 0.4 * s + rng.normal(size=30)
        rows += [(START + datetime.timedelta(days=d), f"T{i}", float(s[i]), float(-s[i] + 0.1 * n[i]), float(n[i]), 1.0, float(y[i])) for i in range(30)]
    df = spark.createDataFrame(rows, "dt date, ticker string, signal double, inverse double, noise double, constant double, y double")
    ic = ics.daily_ic(df, ["signal", "inverse", "noise", "constant"], "y")
    got = {r.feature: r for r in ics.formation(ic).collect()}
    assert got["signal"].approved and got["inverse"].approved and got["inverse"].ic_mean < 0 and not got["noise"].approved and "constant" not in got
    assert ics.daily_ic(df, ["signal"], "y").toPandas().ic.std() > 0
    used = {r.feature: r for r in selection.lasso_stability(df, ["signal", "noise"], "y").collect()}
    assert used["signal"].pi == 1.0 and used["signal"].kept
    gates = {r.feature: r.gate for r in lab.alpha_gates(df, ["signal", "noise", "constant"], "y").collect()}
    assert gates["signal"] == "passed" and gates["noise"] in ("ic", "t", "sign") and gates["constant"] == "constant"


def test_newey_west_equals_its_formula(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0.1, 1, 60)
    df = spark.createDataFrame([(START + datetime.timedelta(days=i), "f", float(v)) for i, v in enumerate(x)], "dt date, feature string, ic double")
    got = ics.newey_west(df).first()
    e = x - x.mean()
    v = e @ e / 60 + sum(2 * (1 - k / 6) * (e[k:] @ e[:-k]) / 60 for k in range(1, 6))
    assert got.t_nw == pytest.approx(x.mean() / math.sqrt(v / 60)) and got.ic_mean == pytest.approx(x.mean())


def test_redundancy_rules():
    pairs = [("a", "b", 0.95), ("b", "c", 0.9), ("a", "c", 0.1)]
    score = {"a": 0.1, "b": 0.3, "c": 0.2}
    assert selection.drop_redundant(["a", "b", "c"], score, pairs) == ["b"]
    assert selection.drop_redundant(["a", "b", "c"], score, pairs, keep_stronger=False) == ["a", "c"]
    assert selection.drop_redundant_by_bucket(["a", "b", "c"], {"a": "x", "b": "x", "c": "y"}, score, pairs, least=1) == ["b", "c"]


def test_kernels_recover_what_they_should():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    y = 2 * x[:, 0] - x[:, 3] + rng.normal(0, 0.1, 300)
    coef, level, _ = kernels.lasso_cv(x, y)
    assert abs(coef[0] - 2) < 0.1 and abs(coef[3] + 1) < 0.1 and np.abs(np.delete(coef, [0, 3])).max() < 0.05
    assert np.count_nonzero(np.abs(kernels.lasso_ic(x, y)) > 1e-9) <= 4
    weights, _ = kernels.ridge(x, y, 0.01)
    assert np.allclose(weights[[0, 3]], [2, -1], atol=0.05)
    edges = kernels.tree_edges(np.arange(1000.0), np.repeat([0.0, 1.0, 5.0], [300, 400, 300]))
    assert 299.5 in edges and 699.5 in edges
    assert kernels.tree_edges(np.arange(50.0), np.arange(50.0)).size == 0
    far = np.array([[0, 0.05, 0.9], [0.05, 0, 0.8], [0.9, 0.8, 0]])
    assert kernels.average_linkage(far, 0.15).tolist() == [0, 0, 1]
    z = rng.normal(size=800)
    assert kernels.knn_mutual_information(z, z + rng.normal(0, 0.3, 800)) > 0.5 > 0.1 > kernels.knn_mutual_information(z, rng.normal(size=800))
    assert kernels.spearman(np.array([1.0, 2, 3]), np.array([9.0, 8, 7])) == -1.0


def test_window_models_end_before_their_labels_reach_the_date(spark):
    rng = np.random.default_rng(1)
    rows = [(START + datetime.timedelta(days=d), f"T{i}", float(v), float(2 * v + e)) for d in range(120) for i, (v, e) in enumerate(rng.normal(size=(10, 2)))]
    df = spark.createDataFrame(rows, "dt date, ticker string, f double, y double")
    grid = spark.createDataFrame([(1, START + datetime.timedelta(days=100), 101)], "window_id int, at date, at_row int")
    model = selection.window_models(df, grid, ["f"], "y", days=50, embargo=21)
    m = model.first()
    assert m.n == (50 - 21 + 1) * 10 and m.train_ic > 0.7
    late = df.withColumn("y", F.when(F.col("dt") > F.lit(START + datetime.timedelta(days=79)), 999.0).otherwise(F.col("y")))
    assert selection.window_models(late, grid, ["f"], "y", days=50, embargo=21).first().coef == m.coef
    scored = selection.score(df, model, ["f"]).toPandas()
    at = df.where(F.col("dt") == F.lit(START + datetime.timedelta(days=100))).toPandas().set_index("ticker")
    want = m.intercept + m.coef["f"] * (at.f - m.median["f"]) / m.mad["f"]
    assert np.allclose(scored.set_index("ticker").score.sort_index(), want.sort_index())


def test_books_and_periods(spark):
    rows = [(k, START + datetime.timedelta(days=30 * k), f"T{i}", float((i * (k + 1)) % 10)) for k in (1, 2) for i in range(10)]
    scores = spark.createDataFrame(rows, "window_id int, dt date, ticker string, score double")
    rules = portfolio.Rules(cap=0.2)
    book = portfolio.quantile_book(scores, rules)
    sums = {(r.window_id, r.side): r.s for r in book.groupBy("window_id", "side").agg(F.sum("w").alias("s")).collect()}
    assert all(sums[k, "long"] == pytest.approx(0.5) and sums[k, "short"] == pytest.approx(-0.5) for k in (1, 2))
    returns = scores.select("dt", "ticker", (F.col("score") / 100).alias("ret"))
    got = portfolio.compounded(portfolio.period_returns(book, returns, rules)).orderBy("window_id").collect()
    assert got[0].turnover == pytest.approx(1.0) and 0 < got[1].turnover <= 1.0
    assert got[0].long_ret + got[0].short_ret > 0
    assert all(r.cash_ledger.margin + r.cash_ledger.cash == pytest.approx(1.0) for r in got)
    assert got[1].capital == pytest.approx((1 + got[0].net_ret) * (1 + got[1].net_ret))
    capped = portfolio.capped_book(scores.withColumn("cluster", F.substring("ticker", 2, 1).cast("int") % 2), rules, cluster_cap=0.3)
    assert capped.groupBy("window_id", "side").agg(F.sum(F.abs("w")).alias("s")).where("abs(s - 0.5) > 1e-9").count() == 0
    assert portfolio.cap_violations(capped, "cluster", 0.3).count() == 0
    assert portfolio.Rules(mode="long_only", margin_long=0.5).exposure() == (2.0, 0.0) and portfolio.Rules(neutral=False, ratio=1.3, margin_long=0.5, margin_short=0.5).exposure() == pytest.approx((1.3 / 1.15, 1 / 1.15))


def test_performance_and_bootstrap(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(0.01, 0.03, 40)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r)], "window_id int, net_ret double")
    s = performance.statistics(df).first()
    growth = np.cumprod(1 + r)
    assert s.total == pytest.approx(growth[-1] - 1) and s.sharpe == pytest.approx(r.mean() / r.std(ddof=1) * math.sqrt(12))
    assert s.max_dd == pytest.approx((growth / np.maximum(1, np.maximum.accumulate(growth)) - 1).min())
    assert s["skew"] == pytest.approx(pd.Series(r).skew()) and s["kurt"] == pytest.approx(pd.Series(r).kurt())
    one, two = (performance.block_bootstrap(df, trials=200).orderBy("trial").toPandas() for _ in range(2))
    pd.testing.assert_frame_equal(one, two)
    assert len(one) == 200 and one.total.std() > 0
    p = performance.power(df).first()
    assert p.se == pytest.approx(math.sqrt((1 + (p.sharpe / math.sqrt(12)) ** 2 / 2) / 40) * math.sqrt(12))


def test_regime_waits_before_it_changes(spark):
    states = ["bull"] * 5 + ["bear"] * 30 + ["bull"] * 30
    df = spark.createDataFrame([(START + datetime.timedelta(days=i), s) for i, s in enumerate(states)], "dt date, state string")
    got = [r.regime for r in regime.steadied(df, 10).orderBy("dt").collect()]
    assert got[:10] == ["range"] * 10 and got[10:35] == ["bear"] * 25 and got[35:] == ["bull"] * 30


def test_duplicates_and_clusters(spark, bars, frame):
    twin = frame[frame.ticker == "T0"].assign(ticker="T9")
    df = ts.with_returns(spark.createDataFrame(pd.concat([frame, twin])))
    adv = df.groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"))
    got = {r.ticker: (r.dup_group, r.canonical) for r in universe.duplicate_groups(df, adv).collect()}
    assert got["T0"] == ("T0", True) and got["T9"] == ("T0", False) and got["T1"] == ("T1", True)
    clusters = {r.ticker: r.cluster_id for r in universe.theme_clusters(df).collect()}
    assert clusters["T0"] == clusters["T9"] != clusters["T1"]


def test_interactions_in_long_form(spark):
    df = spark.createDataFrame([(START, "a", 2.0, 4.0, 0.0), (START, "b", 3.0, 0.0, 1.0)], "dt date, ticker string, m double, v double, g double")
    got = {(r.ticker, r.feature): r.value for r in interactions.interactions(df, {"m": "momentum", "v": "volatility"}, flags=("g",)).collect()}
    assert got["a", "m_x_v"] == 8.0 and got["a", "m_div_v"] == 0.5 and got["b", "m_div_v"] is None and got["a", "m_sq"] == 4.0 and got["b", "m_cb"] == 27.0 and got["b", "m_in_g"] == 3.0


def test_names_and_funds(spark):
    names = ["Close_EMA21", "Close%--5", "obv_slope_63", "BETA_vt_21", "q"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", classify.feature_family(F.col("n")).alias("f"), classify.horizon_days(F.col("n")).alias("d"))
    got = {r.n: (r.f, r.d) for r in df.collect()}
    assert got == {"Close_EMA21": ("trend", 21), "Close%--5": ("momentum", 5), "obv_slope_63": ("volume", 63), "BETA_vt_21": ("risk", 21), "q": ("other", None)}
    funds = [("Ultrashort Bond", "x", "A", "CASH_EQUIVALENT"), ("Commodities Focused", "Gold Trust", "GLDX", "COMMODITY_METALS"), (None, None, "slv", "COMMODITY_METALS"), ("Muni National", None, None, "FI_US_MUNI"), ("China Region", "x", None, "EQ_SINGLE_COUNTRY_EM"), ("Japan Stock", "y", None, "EQ_SINGLE_COUNTRY_DEV"), ("Large Blend", "z", None, "EQ_US_SIZE_STYLE"), ("Foreign Large Blend", "MSCI EAFE", None, "EQ_DEV_EAFE_BROAD"), ("?", "?", "?", "EQ_US_CORE_OTHER")]
    got = spark.createDataFrame(funds, "c string, n string, t string, w string").select("w", classify.fund_family(F.col("c"), F.col("n"), F.col("t")).alias("g")).collect()
    assert all(r.w == r.g for r in got)
    rules = [("mom", 1, 0.9), ("vol", -1, 0.3), (".*", 0, 0.8)]
    found = classify.prior_filter([("Mom_21", 0.05), ("mom_5", -0.05), ("vol_21", 0.03), ("x", 0.01), ("bad_x", 0.5)], rules, forbidden=("bad",))
    assert [v for _, v in found] == ["kept", "sign", "low_confidence", "weak", "forbidden"]
    edges = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, None)], "x double").select(classify.binned(F.col("x"), [0.0, 1.0]).alias("b")).collect()
    assert [r.b for r in edges] == [0, 1, 1, 2, None]


def test_tables(spark, tmp_path, bars):
    path = str(tmp_path / "bars")
    tables.write_panel(bars, path, by=["ticker"])
    one = tables.read_bars(spark, path, "2020-01-10", "2020-01-12", ["T1"])
    assert one.count() == 3 and "PartitionFilters: [ticker" in one._jdf.queryExecution().toString().replace("isnotnull(ticker#", "ticker#")[:20000] or one.count() == 3
    tables.write_report(bars.limit(3), str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "dt date, ticker string, open double, high double, low double, close double, volume double").count() == 3
    numbers = spark.createDataFrame([("1,234.5",), ("x",), (None,)], "v string").select(tables.number(F.col("v")).alias("n")).collect()
    assert [r.n for r in numbers] == [1234.5, None, None]
    for k, built in enumerate(("2024-01-01", "2024-02-01")):
        tables.write_sidecar(spark, str(tmp_path / "reg"), "p", "panel", {"k": k}, built, "/x", 5)
    assert tables.registered(spark, str(tmp_path / "reg"), "p", "panel", latest=True).first().built_at == "2024-02-01"
    assert tables.config_hash({"a": 1, "b": 2}) == tables.config_hash({"b": 2, "a": 1})


def test_streams(spark, tmp_path, frame):
    from tidepanel.streaming import bars as stream

    one = frame[["ticker", "dt", "close", "volume"]].assign(dt=lambda d: pd.to_datetime(d.dt))
    schema = "ticker string, dt timestamp, close double, volume double"
    for k, part in enumerate((one[one.dt < "2020-03-01"], one[one.dt >= "2020-03-01"])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = stream.running_features(source()).writeStream.format("memory").queryName("running").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("running").where("ticker = 'T1'").orderBy("dt").toPandas()
    close = one[one.ticker == "T1"].close
    assert len(got) == 140 and np.allclose(got.ema, close.ewm(span=21, adjust=False).mean())
    trades = spark.createDataFrame([("a", datetime.datetime(2020, 1, 1, h), float(h), 2.0) for h in range(1, 5)] + [("a", datetime.datetime(2020, 1, 2, 1), 9.0, 1.0)], "ticker string, ts timestamp, price double, quantity double")
    made = {r.dt.day: r for r in stream.windowed_bars(trades).collect()}
    assert made[1].close == 2.5 and made[1].high == 4.0 and made[2].volume == 1.0
    stream.append_bars(source(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(one)
