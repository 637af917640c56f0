"""Chains on small tables with known answers."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import kernels
from tidepanel.operators import checks as ck
from tidepanel.operators import ic as ics
from tidepanel.operators import study as st
from tidepanel.sources import events, tables

DAY = datetime.date(2020, 1, 1)


def day(i: int) -> datetime.date:
    return DAY + datetime.timedelta(days=i)


@pytest.fixture(scope="module")
def values():
    """a drives y, near is a with a little noise, b is noise, s is a weak short feature; (dt, ticker, _row, _y, feature, value)."""
    rng, rows = np.random.default_rng(5), []
    for i in range(60):
        for k in range(12):
            a, b, s = rng.normal(size=3)
            y = 0.5 * a + 0.02 * s + rng.normal() * 0.05
            rows += [(day(i), f"T{k:02d}", i + 1, float(y), f, float(v)) for f, v in (("a", a), ("near", a + rng.normal() * 0.01), ("b", b), ("s", s))]
    return pd.DataFrame(rows, columns=["dt", "ticker", "_row", "_y", "feature", "value"])


def test_models_choose_what_drives_the_target_and_score_by_it(spark, values):
    long = spark.createDataFrame(values)
    grid = spark.createDataFrame([(1, day(55), 56), (2, day(5), 6)], "window_id int, at date, at_row int")
    pool = spark.createDataFrame([(w, f, s, i + 1, f == "s") for w in (1, 2) for i, (f, s) in enumerate((("a", 0.9), ("near", 0.8), ("s", 0.1), ("b", 0.05)))], "window_id int, feature string, score double, place int, short boolean")
    models = st.sparse_models(long, pool, grid, embargo=5, most=1)
    got = models.toPandas().set_index("feature")
    assert set(got.index) == {"a", "s"} and (got["window_id"] == 1).all()  # near is a copy, b no choice; window 2 has one row of its past only
    past = values[values["_row"] <= 51].pivot_table(index=["dt", "ticker", "_y"], columns="feature", values="value")[["a", "s"]]
    x, mid, mad = kernels.robust_scale(past.to_numpy())
    y = past.index.get_level_values("_y").to_numpy()
    coef, level = kernels.ridge(x, y, 0.01)
    np.testing.assert_allclose(got.loc[["a", "s"], "coef"], coef, rtol=1e-9)
    assert (got["n"] == len(past)).all()
    # scores of all entities at the window's date, but of the one that lacks a feature; window 2 ranks by the fallback
    broken = values[~((values["dt"] == day(55)) & (values["ticker"] == "T03") & (values["feature"] == "s"))]
    scored = st.model_scores(spark.createDataFrame(broken), spark.createDataFrame(broken[["dt", "ticker"]].drop_duplicates()), models, grid, "b").toPandas()
    now = broken[broken["dt"] == day(55)].pivot(index="ticker", columns="feature", values="value")[["a", "s"]].dropna()
    want = pd.Series(((now.to_numpy() - mid) / mad) @ coef + level, index=now.index)
    one = scored[scored["window_id"] == 1].set_index("ticker")["score"]
    assert len(one) == 11 and np.allclose(one.sort_index(), want.sort_index(), atol=1e-9)
    two = scored[scored["window_id"] == 2].set_index("ticker")["score"]
    plain = broken[(broken["dt"] == day(5)) & (broken["feature"] == "b")].set_index("ticker")["value"].rank(pct=True) - 0.5
    assert np.allclose(two.sort_index(), plain.sort_index(), atol=1e-9)


def test_formation_of_a_window_is_that_of_its_slice(spark, values):
    ic = ics.section_ic(spark.createDataFrame(values)).join(spark.createDataFrame(values[["dt", "_row"]].drop_duplicates()), "dt").persist()
    grid = spark.createDataFrame([(1, day(40), 41), (2, day(59), 60)], "window_id int, at date, at_row int")
    got = st.formation(ic, grid, days=30, embargo=5, block=10).toPandas()
    for window, at, row in ((1, 40, 41), (2, 59, 60)):
        alone = ics.formation(ic.where((F.col("_row") <= row - 5) & (F.col("dt") >= F.lit(day(at - 30)))).select("dt", "feature", "ic"), block=10).toPandas()
        mine = got[got["window_id"] == window].drop(columns="window_id")
        pd.testing.assert_frame_equal(mine.sort_values("feature").reset_index(drop=True)[alone.columns], alone.sort_values("feature").reset_index(drop=True), check_dtype=False)
        assert set(mine.loc[mine["approved"], "feature"]) >= {"a", "near"}


def test_pools_want_a_parent_that_is_not_weak(spark):
    row = "window_id int, feature string, ic_mean double, p_value double, consistency double, approved boolean"
    tested = spark.createDataFrame([(1, "a", 0.1, 0.01, 1.0, True), (1, "b", 0.001, 0.9, 0.5, False), (1, "s", 0.05, 0.02, 0.5, True)], row)
    crossed = spark.createDataFrame([(1, "a_x_b", 0.08, 0.01, 1.0, True), (1, "b_sq", 0.2, 0.01, 1.0, True)], row)
    got = st.pools(tested, crossed, {"a_x_b": ("a", "b"), "b_sq": ("b",)}, {"a": 63, "s": 2}).orderBy("place").collect()
    assert [(r.feature, r.short) for r in got] == [("a", False), ("a_x_b", False), ("s", True)]
    assert [r.feature for r in st.pools(tested, crossed, {"a_x_b": ("a", "b")}, top=1).collect()] == ["a"]


def test_integrity_tells_of_names_targets_and_gaps(spark):
    rows = [(day(i), "A", 100.0 + i, None if i >= 8 else (100.0 + i + 2) / (100.0 + i) - 1 + (0.01 if i == 3 else 0.0)) for i in range(10)]
    df = spark.createDataFrame(rows, "dt date, ticker string, close double, y double")
    grid = spark.createDataFrame([(day(0),), (day(21),), (day(42),)], "at date")
    got = {r.name: (r.value, r.fine) for r in st.integrity(df, ["mom_21", "close_next", "y_raw_fwd"], "y", 2, grid, settings=8).collect()}
    assert got["names_ahead"] == (1.0, False) and got["targets_off"] == (1.0, False) and got["targets_missing"] == (0.0, True) and got["mean_gap_days"] == (21.0, True)
    assert got["level"][0] == pytest.approx(0.05 / 80)
    none = {r.name: (r.value, r.fine) for r in st.integrity(df.limit(0), [], "y", 2, grid.limit(0), settings=0).collect()}
    assert none["targets_off"] == (0.0, True) and none["mean_gap_days"] == (None, True)


def test_feature_panel_cuts_late_fills_little_and_raises(spark, tmp_path):
    series = spark.createDataFrame([("rate", day(0), 1.0), ("rate", day(50), 2.0)], "name string, dt date, value double")

    def bars(gap: int):
        rows = [(day(i), t, 1.0, 1.0, 1.0, None if t == "B" and 40 <= i < 40 + gap else 100.0 + i + k, 10.0) for k, t in enumerate("ABC") for i in range(100)]
        return spark.createDataFrame([*rows, (day(95), "late", 1.0, 1.0, 1.0, 1.0, 1.0)], "dt date, ticker string, open double, high double, low double, close double, volume double")

    made = lambda gap, path=None: st.feature_panel(bars(gap), series, ["rate"], day(35), (), "A", warmup=10, horizon=5, path=path)
    got = made(3).toPandas()
    assert got["dt"].min() == day(35) and set(got["ticker"]) == set("ABC") and got["close"].notna().all()
    assert set(got.loc[got["dt"] >= day(50), "rate"]) == {2.0} and set(got.loc[got["dt"] < day(50), "rate"]) == {1.0}
    b = got[got["ticker"] == "B"].set_index("dt")
    assert b.loc[day(42), "close"] == 140.0 and b.loc[day(60), "y_raw"] == pytest.approx(166 / 161 - 1)
    assert len(made(3, str(tmp_path / "panel")).toPandas()) == len(got)
    with pytest.raises(ck.DataError, match="close 1"):
        made(6)


def test_bundle_and_results_are_written(spark, tmp_path):
    some = spark.createDataFrame([(1, "x")], "n int, k string")
    paths = tables.write_bundle({"sides": some, "none": some.limit(0)}, {"risk": {"beta": 1.5, "none": None}}, str(tmp_path), "s1")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["attribution_sides_s1", "attribution_summary_s1"]
    assert spark.read.option("header", True).csv(paths[1]).orderBy("metric").first().value == "1.5"
    stamped, latest = tables.write_results(some, str(tmp_path), "run", "s1")
    assert spark.read.option("header", True).csv(stamped).collect() == spark.read.option("header", True).csv(latest).collect()


def test_event_calendar(spark):
    got = {r.event: r.n for r in events.event_calendar(spark).groupBy("event").agg(F.countDistinct("dt").alias("n")).collect()}
    assert got == {"fomc": 53, "cpi": 12, "nfp": 12}
