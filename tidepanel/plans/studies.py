"""Registered queries: further selectors, joins, availability reports, diagnostics and robustness studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import windows as w
from tidepanel.operators import ic as ics
from tidepanel.operators import lab
from tidepanel.operators import performance as perf
from tidepanel.operators import pipelines as pl
from tidepanel.operators import portfolio as pf
from tidepanel.operators import selection as sel
from tidepanel.plans.cross import _BASIC_FROM, BENCH, basic, rebalance_grid
from tidepanel.plans.panel import BARS, PANEL, SERIES, T, avg, co, dev, panel, rank_pct, series, shown
from tidepanel.plans.research import _LONG, _WIDE, FEATURES, _nw, daily, wide
from tidepanel.plans.trading import _BOOK, _PERIODS, _SCORES, RULES, periods, scores
from tidepanel.registry import query

c = F.col

# strength against reference entities, and correlation with one

_STRENGTH_FROM = f"""{PANEL}, g AS (SELECT *, max(CASE WHEN ticker = '{BENCH}' THEN ret END) OVER (PARTITION BY dt) AS b FROM panel
), h AS (SELECT *, {', '.join(f"(CASE WHEN count(ret) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n // 2} THEN sum(ret - b) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END) AS rs_{n}" for n in (21, 63))} FROM g)"""
_STRENGTH = {"rs_21": "rs_21", "rs_63": "rs_63", "rs_63_z": f"(rs_63 - {avg('rs_63', 252, 126)}) / ({dev('rs_63', 252, 126)} + 1e-8)", "corr21": f"coalesce({co('ret', 'b', 21, 10)}, CASE WHEN b IS NULL THEN 0.0 END)", "corr_63": co("ret", "b", 63, 31)}


@query("w51_w58_relative_strength", f"WITH {_STRENGTH_FROM} SELECT dt, ticker, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in _STRENGTH.items()) + " FROM h")
def relative_strength(spark, sf_dir):
    df = panel(spark, sf_dir)
    bench = df.where(c("ticker") == BENCH).select("dt", c("ret").alias("b"))
    df = df.join(F.broadcast(bench), "dt", "left")  # one row a date
    gap = c("ret") - c("b")
    df = df.withColumns({f"rs_{n}": F.when(F.count("ret").over(w.last(n)) >= n // 2, F.sum(gap).over(w.last(n))) for n in (21, 63)})
    df = df.withColumns({"rs_63_z": w.zscore(c("rs_63"), 252, 126), "corr21": F.coalesce(w.corr(c("ret"), c("b"), 21, 10), F.when(c("b").isNull(), 0.0)), "corr_63": w.corr(c("ret"), c("b"), 63, 31)})
    return shown(df, list(_STRENGTH))


_JOINS = f"""
WITH {_BOOK}, n AS (SELECT * FROM book WHERE window_id = 3), p AS (SELECT * FROM book WHERE window_id = 2)
SELECT coalesce(n.ticker, p.ticker) AS ticker, round(coalesce(n.w, 0), 8) + 0.0 AS w, round(coalesce(p.w, 0), 8) + 0.0 AS w0, (SELECT count(*) FROM n WHERE ticker IN (SELECT ticker FROM p)) AS stayed, (SELECT count(*) FROM n WHERE ticker NOT IN (SELECT ticker FROM p)) AS came
FROM n FULL OUTER JOIN p ON n.ticker = p.ticker
"""


@query("j08_j10_semi_anti_outer", _JOINS)
def joins(spark, sf_dir):
    book = pf.quantile_book(scores(spark, sf_dir)[0], RULES)
    now, before = book.where("window_id = 3").select("ticker", "w"), book.where("window_id = 2").select("ticker", c("w").alias("w0"))
    stayed, came = now.join(before, "ticker", "left_semi").agg(F.count("*").alias("stayed")), now.join(before, "ticker", "left_anti").agg(F.count("*").alias("came"))
    both = now.join(before, "ticker", "full_outer").select("ticker", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("w0", F.lit(0.0)).alias("w0"))
    return both.crossJoin(F.broadcast(stayed)).crossJoin(F.broadcast(came)).select("ticker", w.rounded("w", 8), w.rounded("w0", 8), "stayed", "came")


_AVAILABLE = f"""
WITH {BARS}, {SERIES}, s AS (SELECT ticker AS name, 'bars' AS kind, min(dt) AS first, max(dt) AS last, count(*) AS n FROM bars GROUP BY 1 UNION ALL SELECT name, 'series', min(dt), max(dt), count(*) FROM series GROUP BY 1)
SELECT name, kind, first, last, n, first <= DATE '1995-02-01' AS early_enough, last >= DATE '2001-10-01' AS late_enough FROM s
"""


@query("p14_p15_availability", _AVAILABLE)
def availability(spark, sf_dir):
    of = lambda df, name, kind: df.groupBy(c(name).alias("name")).agg(F.lit(kind).alias("kind"), F.min("dt").alias("first"), F.max("dt").alias("last"), F.count("*").alias("n"))
    both = of(panel(spark, sf_dir), "ticker", "bars").unionByName(of(series(spark, sf_dir), "name", "series"))
    day = lambda s: F.lit(s).cast("date")
    return both.withColumns({"early_enough": c("first") <= day("1995-02-01"), "late_enough": c("last") >= day("2001-10-01")})


_SAMPLE = f"""
WITH {BARS}, o AS (SELECT dt, ticker, row_number() OVER (PARTITION BY dt ORDER BY md5(dt || ticker || '11')) AS r FROM bars) SELECT dt, ticker FROM o WHERE r <= 5
"""


@query("k06_seeded_sample", _SAMPLE)
def seeded_sample(spark, sf_dir):
    order = F.md5(F.concat(c("dt").cast("string"), "ticker", F.lit("11")).cast("binary"))
    return panel(spark, sf_dir).withColumn("r", F.row_number().over(w.section().orderBy(order))).where("r <= 5").select("dt", "ticker")


# selection

_DAYS = {"ret_pct_1": 1, "ret_pct_5": 5, "ret_pct_21": 21, "ret_pct_63": 63, "std_21": 21, "std_63": 63, "rel_volume_21": 21, "pct_from_high": None}
_SHORT = f"WITH {_nw('1.0')} SELECT feature, round(ic_mean, 6) + 0.0 AS ic_mean, row_number() OVER (ORDER BY abs(ic_mean) DESC, feature) AS place FROM nw WHERE feature IN ('ret_pct_1') AND abs(ic_mean) >= 0.01 QUALIFY place <= 3"


@query("l03_short_lag", _SHORT)
def short_lag(spark, sf_dir):
    return pl.short_lag(ics.newey_west(daily(spark, sf_dir)), _DAYS).select("feature", w.rounded("ic_mean"), c("place").cast("long").alias("place"))


_FILTER = f"""
WITH {_nw('1.0')}, d AS (SELECT dt, floor((row_number() OVER (ORDER BY dt) - 1) * 4.0 / count(*) OVER ()) AS fold FROM (SELECT DISTINCT dt FROM ic)
), f AS (SELECT feature, fold, avg(ic) AS m FROM ic JOIN d USING (dt) GROUP BY 1, 2), o AS (SELECT feature, median(m) AS mid FROM f GROUP BY 1
), s AS (SELECT feature, count(*) FILTER (sign(m) = sign(mid)) AS same_sign, max(mid) AS median_ic FROM f JOIN o USING (feature) GROUP BY 1)
SELECT feature, round(ic_mean, 6) + 0.0 AS ic_mean, same_sign, round(median_ic, 6) + 0.0 AS median_ic, abs(ic_mean) > 0.02 AND abs(t_nw) > 1.96 AND same_sign >= 2 AND abs(median_ic) >= 0.02 AS kept FROM nw JOIN s USING (feature)
"""


@query("l15_window_filter", _FILTER)
def window_filter(spark, sf_dir):
    return pl.window_filter(daily(spark, sf_dir)).select("feature", w.rounded("ic_mean"), "same_sign", w.rounded("median_ic"), "kept")


def _stats(df):
    """Absolute mean IC by feature, and correlations by pair: small on the driver."""
    score = {r.feature: abs(r.ic_mean) for r in ics.summary(ics.daily_ic(df, FEATURES, "y")).collect()}
    return score, [(r.feature_a, r.feature_b, r["corr"]) for r in ics.pair_correlations(df, FEATURES).collect()]


_FAMILY = {f: "volatility" if f.startswith("std") else "volume" if f.startswith("rel") else "momentum" for f in FEATURES}


@query("l07_l09_l10_pools")
def pools(spark, sf_dir):
    """Which features three redundancy rules keep, and the health of what is left."""
    score, pairs = _stats(wide(spark, sf_dir))
    rules = {"bucket": sel.drop_redundant_by_bucket(FEATURES, _FAMILY, score, pairs, least=2), "hierarchical": pl.hierarchical(FEATURES, _FAMILY, score, pairs, protected=("ret_pct_63",)), "all": FEATURES}
    rows = [(k, len(v), *(pl.pool_health(pairs, v)[m] for m in ("max_corr", "mean_corr", "condition")), sorted(v)) for k, v in rules.items()]
    return spark.createDataFrame(rows, "rule string, n int, max_corr double, mean_corr double, condition double, features array<string>")


@query("a19_mutual_information")
def mutual_information(spark, sf_dir):
    return pl.mutual_information(wide(spark, sf_dir), FEATURES, "y")


@query("l16_supervised_binning")
def binning(spark, sf_dir):
    return pl.binning(wide(spark, sf_dir), FEATURES, "y")


@query("l14_elastic_net")
def elastic_net(spark, sf_dir):
    return pl.elastic_net(wide(spark, sf_dir), FEATURES, "y")


@query("l17_d02_d04_window_scores")
def window_scores(spark, sf_dir):
    """Scores of each window's own model at its date, with the rank correlation that they reach."""
    df = wide(spark, sf_dir)
    models = sel.window_models(df, rebalance_grid(df, 130), FEATURES, "y")
    scored = sel.score(df, models, FEATURES).join(df.select("dt", "ticker", "y"), ["dt", "ticker"])
    ranked = scored.where("score is not null and y is not null").withColumns({"rx": w.percent_rank(c("score"), keys=("window_id",)), "ry": w.percent_rank(c("y"), keys=("window_id",))})
    return ranked.groupBy("window_id", "dt").agg(ics.safe_corr(c("rx"), c("ry")).alias("ic"), F.count("*").alias("n"))


_COMBINED = f"""
WITH {_BASIC_FROM} SELECT dt, ticker, round(coalesce({rank_pct('mom')}, 0.5) * 0.7 - coalesce({rank_pct('vol')}, 0.5) * 0.3, 6) + 0.0 AS score FROM b0
"""


@query("d03_rank_combination", _COMBINED)
def rank_combination(spark, sf_dir):
    df = basic(spark, sf_dir)
    return shown(df.withColumn("score", pl.rank_combination(df, {"mom": 0.7, "vol": -0.3})), ["score"])


# feature lab

_STRESS = f"""
WITH {_LONG}, m AS (SELECT dt, avg(ret) AS mkt FROM panel GROUP BY dt)
SELECT feature, count(*) AS n, round(avg(ic), 6) + 0.0 AS stress_ic FROM ic JOIN m USING (dt) WHERE mkt < 0 AND ic IS NOT NULL GROUP BY 1 HAVING count(*) >= 20
"""


@query("b03_stress_ic", _STRESS)
def stress_ic(spark, sf_dir):
    market = panel(spark, sf_dir).groupBy("dt").agg(F.avg("ret").alias("mkt")).where("mkt < 0")
    out = daily(spark, sf_dir).join(F.broadcast(market), "dt").where("ic is not null").groupBy("feature").agg(F.count("*").alias("n"), F.avg("ic").alias("stress_ic"))
    return out.where("n >= 20").select("feature", "n", w.rounded("stress_ic"))


_COMPOSITE = f"""
WITH {_LONG}, m AS (SELECT feature, abs(avg(ic)) AS a, abs(avg(ic)) / stddev_samp(ic) AS b, stddev_samp(ic) AS s FROM ic GROUP BY 1
), r AS (SELECT *, row_number() OVER (ORDER BY a DESC, feature) - 1 AS ra, row_number() OVER (ORDER BY b DESC, feature) - 1 AS rb, row_number() OVER (ORDER BY s, feature) - 1 AS rs, count(*) OVER () AS n FROM m)
SELECT feature, round(0.5 * 100 * (1 - ra / (n - 1.0)) + 0.3 * 100 * (1 - rb / (n - 1.0)) + 0.2 * 100 * (1 - rs / (n - 1.0)), 5) + 0.0 AS composite FROM r
"""


@query("b04_composite", _COMPOSITE)
def composite(spark, sf_dir):
    m = ics.summary(daily(spark, sf_dir)).select("feature", F.abs("ic_mean").alias("a"), F.abs("ir").alias("b"), c("ic_std").alias("s"))
    return lab.composite(m, {"a": 0.5, "b": 0.3, "s": 0.2}, lower_better=("s",)).select("feature", w.rounded("composite", 5))


@query("b06_b08_risk_selector")
def risk_selector(spark, sf_dir):
    df = wide(spark, sf_dir).join(pl.risk_targets(panel(spark, sf_dir)).select("dt", "ticker", "rv_5", "tail_event"), ["dt", "ticker"])
    return pl.risk_scores(df, FEATURES, _FAMILY)


_QUALITY = f"""
WITH {_WIDE}, l AS (SELECT feature, value FROM wide UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(FEATURES)}))), s AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM l GROUP BY 1)
SELECT feature, round(count(value) * 1.0 / count(*), 6) + 0.0 AS coverage, round(avg((abs(value - m) > 10 * s)::INT) FILTER (value IS NOT NULL), 6) + 0.0 AS outliers,
  CASE WHEN count(value) * 1.0 / count(*) < 0.85 THEN 'coverage' WHEN avg((abs(value - m) > 10 * s)::INT) FILTER (value IS NOT NULL) > 0.01 THEN 'outliers' WHEN max(s) < 1e-8 THEN 'constant' END AS quality FROM l JOIN s USING (feature) GROUP BY 1
"""


@query("b01_a14_quality_gate", _QUALITY)
def quality_gate(spark, sf_dir):
    return lab.quality(wide(spark, sf_dir), FEATURES).select("feature", w.rounded("coverage"), w.rounded("outliers"), "quality")


# diagnostics and studies

_EXPOSURE = "SELECT * FROM (VALUES ('ls', 1.0, 1.0, 0.5, 0.5), ('ls', 0.5, 0.5, 1.0, 1.0), ('long_only', 0.5, 0.5, 2.0, 0.0), ('short_only', 0.25, 0.3, 0.0, 3.333333), ('cash', 1.0, 1.0, 0.0, 0.0)) t(mode, margin_long, margin_short, long_exposure, short_exposure)"


@query("t01_exposure", f"SELECT mode, CAST(margin_long AS DOUBLE) AS margin_long, CAST(margin_short AS DOUBLE) AS margin_short, CAST(long_exposure AS DOUBLE) AS long_exposure, CAST(short_exposure AS DOUBLE) AS short_exposure FROM ({_EXPOSURE})")
def exposure(spark, sf_dir):
    rows = []
    for mode, a, b in (("ls", 1.0, 1.0), ("ls", 0.5, 0.5), ("long_only", 0.5, 0.5), ("short_only", 0.25, 0.3), ("cash", 1.0, 1.0)):
        long, short = pf.Rules(mode=mode, margin_long=a, margin_short=b).exposure()
        rows.append((mode, a, b, round(long, 6), round(short, 6)))
    return spark.createDataFrame(rows, "mode string, margin_long double, margin_short double, long_exposure double, short_exposure double")


_RANKING = f"""
WITH {_SCORES}, o AS (SELECT window_id, score AS x, fwd_21 AS y, {rank_pct('score', 'window_id')} AS rx FROM sc WHERE score IS NOT NULL AND fwd_21 IS NOT NULL
), r AS (SELECT *, {rank_pct('y', 'window_id')} AS ry, row_number() OVER (PARTITION BY window_id ORDER BY y DESC) AS hi, row_number() OVER (PARTITION BY window_id ORDER BY y) AS lo FROM o)
SELECT window_id, round(stddev_samp(y), 6) + 0.0 AS dispersion, round(avg(y) FILTER (hi <= 5) - avg(y) FILTER (lo <= 5), 6) + 0.0 AS extreme_spread, round(covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0), 6) + 0.0 AS ic FROM r GROUP BY 1
"""


@query("v05_ranking_analysis", _RANKING)
def ranking_analysis(spark, sf_dir):
    sc, df = scores(spark, sf_dir)
    rows = sc.join(df.select("dt", "ticker", "fwd_21"), ["dt", "ticker"]).where("score is not null and fwd_21 is not null")
    of = Window.partitionBy("window_id")
    rows = rows.withColumns({"rx": w.percent_rank(c("score"), keys=("window_id",)), "ry": w.percent_rank(c("fwd_21"), keys=("window_id",)), "hi": F.row_number().over(of.orderBy(F.desc("fwd_21"))), "lo": F.row_number().over(of.orderBy("fwd_21"))})
    out = rows.groupBy("window_id").agg(F.stddev("fwd_21").alias("dispersion"), (F.avg(F.when(c("hi") <= 5, c("fwd_21"))) - F.avg(F.when(c("lo") <= 5, c("fwd_21")))).alias("extreme_spread"), ics.safe_corr(c("rx"), c("ry")).alias("ic"))
    return out.select("window_id", w.rounded("dispersion"), w.rounded("extreme_spread"), w.rounded("ic"))


_SHUFFLED = f"""
WITH {_PERIODS}, od AS (SELECT trial, net_ret AS r, row_number() OVER (PARTITION BY trial ORDER BY md5(trial || ':' || window_id || ':11')) AS k FROM nr, range(1000) t(trial)
), g AS (SELECT trial, r, k, product(1 + r) OVER (PARTITION BY trial ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM od
), d AS (SELECT trial, r, g / greatest(1, max(g) OVER (PARTITION BY trial ORDER BY k ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM g)
SELECT trial, round(avg(r) * sqrt(12) / nullif(stddev_samp(r), 0), 6) + 0.0 AS sharpe, round(least(0, min(dd)), 6) + 0.0 AS max_dd FROM d GROUP BY 1
"""


@query("v02_shuffled_null", _SHUFFLED)
def shuffled_null(spark, sf_dir):
    """Sharpe of shuffled histories, which all are equal, and their drawdowns, which are not."""
    out = perf.shuffled(periods(spark, sf_dir)[0])
    return out.select(c("trial").cast("long").alias("trial"), w.rounded("sharpe"), w.rounded("max_dd"))


_FUNNEL = f"""
WITH {_BASIC_FROM}, a AS (SELECT *, {rank_pct('volume')} AS vr FROM b0)
SELECT dt, count(*) AS listed, count(*) FILTER (mom IS NOT NULL) AS with_history, count(*) FILTER (mom IS NOT NULL AND vr >= 0.5) AS liquid, count(*) FILTER (mom IS NOT NULL AND vr >= 0.5 AND family <> 'F3') AS eligible FROM a GROUP BY dt
"""


@query("r11_filter_funnel", _FUNNEL)
def filter_funnel(spark, sf_dir):
    df = basic(spark, sf_dir).withColumn("vr", w.percent_rank(c("volume")))
    history, liquid = c("mom").isNotNull(), c("mom").isNotNull() & (c("vr") >= 0.5)
    return df.groupBy("dt").agg(F.count("*").alias("listed"), F.count(F.when(history, 1)).alias("with_history"), F.count(F.when(liquid, 1)).alias("liquid"), F.count(F.when(liquid & (c("family") != "F3"), 1)).alias("eligible"))


_SHIFT = f"""
WITH {_LONG}, s AS (SELECT feature, avg(ic) FILTER (dt < DATE '1999-01-01') AS formation, avg(ic) FILTER (dt >= DATE '1999-01-01') AS training FROM ic GROUP BY 1)
SELECT feature, round(formation, 6) + 0.0 AS formation, round(training, 6) + 0.0 AS training, round(training - formation, 6) + 0.0 AS shift, sign(training) = sign(formation) AS same_sign FROM s
"""


@query("r11_ic_shift", _SHIFT)
def ic_shift(spark, sf_dir):
    early = c("dt") < F.lit("1999-01-01").cast("date")
    out = daily(spark, sf_dir).groupBy("feature").agg(F.avg(F.when(early, c("ic"))).alias("formation"), F.avg(F.when(~early, c("ic"))).alias("training"))
    out = out.withColumns({"shift": c("training") - c("formation"), "same_sign": F.signum("training") == F.signum("formation")})
    return out.select("feature", w.rounded("formation"), w.rounded("training"), w.rounded("shift"), "same_sign")


_TARGETS = f"""
WITH {PANEL}, f AS (SELECT dt, ticker, (close / lag(close, 21) OVER {T} - 1) AS x, lead(close, 5) OVER {T} / close - 1 AS y5, lead(close, 21) OVER {T} / close - 1 AS y21 FROM panel
), l AS (SELECT dt, x, target, y FROM (UNPIVOT f ON y5, y21 INTO NAME target VALUE y) WHERE x IS NOT NULL
), r AS (SELECT dt, target, {rank_pct('x', 'dt, target')} AS rx, {rank_pct('y', 'dt, target')} AS ry FROM l
), i AS (SELECT dt, target, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS ic FROM r GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT target, count(ic) AS n, round(avg(ic), 6) + 0.0 AS ic_mean, round(stddev_samp(ic), 6) + 0.0 AS ic_std FROM i GROUP BY 1
"""


@query("r10_target_comparison", _TARGETS)
def target_comparison(spark, sf_dir):
    df = panel(spark, sf_dir).withColumns({"x": w.ratio(c("close"), w.lag("close", 21)) - 1} | {f"y{n}": w.ratio(F.lead("close", n).over(w.history()), c("close")) - 1 for n in (5, 21)})
    long = df.select("dt", "ticker", "x", "y5", "y21").unpivot(["dt", "ticker", "x"], ["y5", "y21"], "target", "y").where("x is not null and y is not null")
    long = long.withColumns({"rx": w.percent_rank(c("x"), keys=("dt", "target")), "ry": w.percent_rank(c("y"), keys=("dt", "target"))})
    ic = long.groupBy("dt", "target").agg(ics.safe_corr(c("rx"), c("ry")).alias("ic"), F.count("*").alias("k")).where("k >= 3")
    return ic.groupBy("target").agg(F.count("ic").alias("n"), F.avg("ic").alias("ic_mean"), F.stddev("ic").alias("ic_std")).select("target", "n", w.rounded("ic_mean"), w.rounded("ic_std"))


@query("r05_r09_feature_attribution")
def feature_attribution(spark, sf_dir):
    """How often models use each feature, and what that went with."""
    from tidepanel.operators import performance as perf
    df = wide(spark, sf_dir)
    grid = rebalance_grid(df)
    models = sel.window_models(df, grid, FEATURES, "y", most=4)
    return perf.feature_attribution(models, periods(spark, sf_dir)[0].select("window_id", "net_ret"), grid.count())
