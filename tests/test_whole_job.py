"""Cases in which the panel's queries once did less than the whole job."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from tidepanel.functions import kernels
from tidepanel.operators import performance, pipelines
from tidepanel.queries import queries

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@needs_data
@pytest.mark.parametrize("name", ["v02_shuffled_null", "v03_random_books"])
def test_studies_have_a_thousand_trials(spark, name):
    assert queries()[name](spark, str(DATA)).select("trial").distinct().count() == 1000


def test_a_book_is_placed_among_random_ones(spark):
    books = spark.createDataFrame([(0, 0.1, 0.5), (1, 0.2, None), (2, 0.3, 2.0), (3, 0.05, -1.0)], "trial long, total double, sharpe double")
    periods = spark.createDataFrame([(1, 0.1), (2, 0.1)], "window_id int, net_ret double")  # no deviation: a Sharpe of 0
    got = performance.against_random(books, periods).collect()
    assert len(got) == 4
    assert {(round(r.actual_total, 9), r.actual_sharpe, r.p_value_return, r.p_value_sharpe, r.percentile) for r in got} == {(0.21, 0.0, 0.25, 0.75, 25.0)}


def brute_force_information(x, y, k=3):
    n = len(x)
    x, y = (x - x.mean()) / (x.std() or 1.0), (y - y.mean()) / (y.std() or 1.0)
    far = np.maximum(np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None]))
    radius = np.sort(far, axis=1)[:, k]
    digamma = np.concatenate([[np.nan], -0.5772156649015329 + np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])])
    counts = [np.maximum(((v[None] < (v + radius)[:, None]) & (v[None] > (v - radius)[:, None])).sum(axis=1), 1) for v in (x, y)]
    return max(0.0, digamma[n] + digamma[k] - (digamma[counts[0]] + digamma[counts[1]]).mean())


def test_nearest_neighbours_equal_brute_force():
    rng = np.random.default_rng(6)
    for n in (4, 5, 60, 700, 1500):
        for x, y in ((rng.normal(size=n), rng.normal(size=n)), (z := rng.standard_t(2, n), z + rng.normal(0, 0.2, n))):
            assert kernels.knn_mutual_information(x, y) == pytest.approx(brute_force_information(x, y), abs=1e-9)


def test_mutual_information_uses_every_row(spark):
    rng = np.random.default_rng(7)
    n, names = 360, 30  # 3,600 rows a fold
    x = rng.normal(size=n * names)
    df = pd.DataFrame({"dt": np.repeat(pd.date_range("2020-01-01", periods=n), names), "ticker": [f"t{i:02d}" for i in range(names)] * n, "f": x, "y": x + rng.normal(size=n * names)})
    got = {r.fold: r.mi for r in pipelines.mutual_information(spark.createDataFrame(df), ["f"], "y").collect()}
    third = n * names // 3
    want = [kernels.knn_mutual_information(df.f.to_numpy()[k : k + third], df.y.to_numpy()[k : k + third]) for k in range(0, 3 * third, third)]
    assert sorted(got.values()) == pytest.approx(sorted(want), abs=1e-9)


def test_features_that_flip_their_sign_are_out(spark):
    rng = np.random.default_rng(8)
    n, names = 80, 10
    y = rng.normal(size=n * names)
    late = np.repeat(np.arange(n) >= 60, names)
    df = pd.DataFrame({"dt": np.repeat(pd.date_range("2020-01-01", periods=n), names), "ticker": [f"t{i}" for i in range(names)] * n, "rv_5": y, "tail_event": (y > 1).astype(float)})
    df["steady"], df["flips"] = y + rng.normal(size=len(y)), np.where(late, -y, y) + rng.normal(size=len(y))
    df = spark.createDataFrame(df)
    assert [r.feature for r in pipelines.sign_flips(df, ["steady", "flips"], "rv_5").collect()] == ["flips"]
    got = pipelines.risk_scores(df, ["steady", "flips"], {"steady": "a", "flips": "b"}).collect()
    assert [r.feature for r in got] == ["steady"]


def test_names_of_queries_claim_only_what_is_built():
    numbers = {part for name in queries() for part in name.split("_")}
    assert not numbers & {"l04", "l18", "l21", "f02", "b05", "v01"}
