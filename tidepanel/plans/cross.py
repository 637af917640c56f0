"""Registered queries: cross-sections, alignment, labels, set and rank operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import windows as w
from tidepanel.operators import timeseries as ts
from tidepanel.operators import xsection as xs
from tidepanel.plans.features import _RISK_FROM, with_market
from tidepanel.plans.panel import BARS, PANEL, SERIES, T, bars, dev, panel, rank_pct, read, select, series, shown
from tidepanel.registry import query

c = F.col
BENCH = "Brand#1"
FAMILY = "concat('F', cast(cast(substr(ticker, 7) as int) % 4 as varchar))"


def with_family(df):
    return df.withColumn("family", F.concat(F.lit("F"), (F.substring("ticker", 7, 9).cast("int") % 4).cast("string")))


_BASIC_FROM = f"""{PANEL}, b0 AS (SELECT *, (close / lag(close, 21) OVER {T} - 1) * 100.0 AS mom, {dev('ret', 21, 10)} AS vol, lead(close, 21) OVER {T} / close - 1 AS fwd_21, {FAMILY} AS family FROM panel)"""


def basic(spark, sf_dir):
    """The panel with 21-bar momentum, volatility, forward return and family."""
    df = panel(spark, sf_dir).withColumns({"mom": (w.ratio(c("close"), w.lag("close", 21)) - 1) * 100.0, "vol": w.std(c("ret"), 21, 10), "fwd_21": w.ratio(F.lead("close", 21).over(w.history()), c("close")) - 1})
    return with_family(df)


_RANKS = {"mom_rank": rank_pct("mom"), "volume_rank": rank_pct("volume"), "low_liquidity": f"CASE WHEN {rank_pct('volume')} < 0.2 THEN 1.0 ELSE 0.0 END"}


@query("x01_x15_percent_rank", select(_RANKS, 6, "b0", with_=_BASIC_FROM))
def ranks(spark, sf_dir):
    df = basic(spark, sf_dir).withColumns({"mom_rank": w.percent_rank(c("mom")), "volume_rank": w.percent_rank(c("volume"))})
    return shown(df.withColumn("low_liquidity", w.flag(c("volume_rank") < 0.2)), list(_RANKS))


_REL_FROM = f"""{PANEL}, e0 AS (SELECT dt, ticker, {', '.join(f'(close / lag(close, {n}) OVER {T} - 1) * 100.0 AS r{n}' for n in (5, 21, 63))} FROM panel
), e1 AS (SELECT *, {', '.join(f"max(CASE WHEN ticker = '{BENCH}' THEN r{n} END) OVER (PARTITION BY dt) AS m{n}" for n in (5, 21, 63))} FROM e0)"""
_REL = {}
for _n in (5, 21, 63):
    _REL |= {f"rel_{_n}_basket": f"r{_n} - avg(r{_n}) OVER (PARTITION BY dt)", f"rel_{_n}_bench": f"CASE WHEN m{_n} IS NULL THEN 0.0 ELSE r{_n} - m{_n} END"}


@query("x02_x03_relative_returns", select(_REL, 6, "e1", with_=_REL_FROM))
def relative(spark, sf_dir):
    return shown(xs.relative_returns(panel(spark, sf_dir), BENCH), list(_REL))


_WIN = {
    "ret_winsorised": "CASE WHEN ret IS NOT NULL THEN coalesce(least(greatest(ret, avg(ret) OVER d - 2.5 * stddev_samp(ret) OVER d), avg(ret) OVER d + 2.5 * stddev_samp(ret) OVER d), ret) END",
    "ret_demeaned": "ret - avg(ret) OVER d",
    "ret_demeaned_family": "ret - avg(ret) OVER (PARTITION BY dt, family)",
}


@query("x04_x06_winsorise_demean", select(_WIN, 6, "b0", with_=_BASIC_FROM) + " WINDOW d AS (PARTITION BY dt)")
def winsorise(spark, sf_dir):
    df = basic(spark, sf_dir).withColumns({"ret_winsorised": xs.winsorised("ret"), "ret_demeaned": xs.demeaned("ret"), "ret_demeaned_family": xs.demeaned("ret", ("family",))})
    return shown(df, list(_WIN))


_IMPUTE = f"""
WITH {_BASIC_FROM}, m AS (SELECT dt, ticker, coalesce(mom, median(mom) OVER d) AS mom, coalesce(vol, median(vol) OVER d) AS vol FROM b0 WINDOW d AS (PARTITION BY dt))
SELECT dt, ticker, round(last_value(mom IGNORE NULLS) OVER u, 6) + 0.0 AS mom, round(last_value(vol IGNORE NULLS) OVER u, 6) + 0.0 AS vol FROM m
WINDOW u AS (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING)
"""


@query("x05_impute", _IMPUTE)
def impute(spark, sf_dir):
    return shown(xs.imputed(basic(spark, sf_dir), ["mom", "vol"]), ["mom", "vol"])


def _det(t):
    return f"(({t[0][0]}) * (({t[1][1]}) * ({t[2][2]}) - ({t[1][2]}) * ({t[2][1]})) - ({t[0][1]}) * (({t[1][0]}) * ({t[2][2]}) - ({t[1][2]}) * ({t[2][0]})) + ({t[0][2]}) * (({t[1][0]}) * ({t[2][1]}) - ({t[1][1]}) * ({t[2][0]})))"


_M = [["n + 1e-6", "sa", "sb"], ["sa", "saa + 1e-6", "sab"], ["sb", "sab", "sbb + 1e-6"]]
_R = ["sy", "say", "sby"]
_BETAS = ", ".join(f"{_det([[_R[i] if j == k else _M[i][j] for j in range(3)] for i in range(3)])} / nullif({_det(_M)}, 0) AS b{k}" for k in range(3))
_LABELS = f"""
WITH {_RISK_FROM}, g0 AS (SELECT dt, ticker, beta_mkt_63 AS a, {dev('res', 63, 31)} AS b, lead(close, 21) OVER {T} / close - 1 AS y_raw FROM k1
), g1 AS (SELECT *, y_raw - avg(y_raw) OVER (PARTITION BY dt) AS y_cs FROM g0
), g2 AS (SELECT dt, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS saa, sum(a * b) AS sab, sum(b * b) AS sbb, sum(y_cs) AS sy, sum(a * y_cs) AS say, sum(b * y_cs) AS sby
  FROM g1 WHERE a IS NOT NULL AND b IS NOT NULL AND y_cs IS NOT NULL GROUP BY dt
), g3 AS (SELECT dt, n, {_BETAS} FROM g2
), g4 AS (SELECT g1.*, CASE WHEN coalesce(n, 0) < 20 THEN y_cs ELSE y_cs - (b0 + b1 * a + b2 * b) END AS y_resid FROM g1 LEFT JOIN g3 USING (dt))
SELECT dt, ticker, round(y_raw, 6) + 0.0 AS y_raw, round(y_cs, 6) + 0.0 AS y_cs, round(y_resid, 6) + 0.0 AS y_resid,
  round(CASE WHEN count(y_resid) OVER d >= 20 AND stddev_samp(y_resid) OVER d >= 1e-6 THEN (y_resid - avg(y_resid) OVER d) / stddev_samp(y_resid) OVER d END, 5) + 0.0 AS y_resid_z
FROM g4 WINDOW d AS (PARTITION BY dt)
"""


@query("x07_x09_labels", _LABELS)
def labels(spark, sf_dir):
    df = ts.market_risk(with_market(spark, sf_dir)).withColumn("fwd_21", w.ratio(F.lead("close", 21).over(w.history()), c("close")) - 1)
    df = xs.labels(df)
    return df.select("dt", "ticker", w.rounded("y_raw"), w.rounded("y_cs"), w.rounded("y_resid"), w.rounded("y_resid_z", 5))


_ZSCORE = f"""
WITH {_BASIC_FROM}, q AS (SELECT dt, quantile_cont(mom, 0.05) AS lo, quantile_cont(mom, 0.95) AS hi FROM b0 GROUP BY dt
), v AS (SELECT b0.dt, ticker, CASE WHEN mom IS NOT NULL THEN least(greatest(mom, lo), hi) END AS v FROM b0 JOIN q USING (dt))
SELECT dt, ticker, round(CASE WHEN count(v) OVER d >= 20 AND stddev_samp(v) OVER d >= 1e-6 THEN (v - avg(v) OVER d) / stddev_samp(v) OVER d END, 6) + 0.0 AS mom_z FROM v WINDOW d AS (PARTITION BY dt)
"""


@query("x08_zscore", _ZSCORE)
def zscore(spark, sf_dir):
    return shown(xs.standardised(basic(spark, sf_dir), "mom", "mom_z", limits=(0.05, 0.95)), ["mom_z"])


_SPREAD = f"""
WITH {_BASIC_FROM}, o AS (SELECT dt, fwd_21 AS y, row_number() OVER (PARTITION BY dt ORDER BY mom, ticker) AS r, count(*) OVER (PARTITION BY dt) AS n FROM b0 WHERE mom IS NOT NULL AND fwd_21 IS NOT NULL)
SELECT dt, round(avg(y) FILTER (r > floor(n * 0.8)) - avg(y) FILTER (r <= floor(n * 0.2)), 6) + 0.0 AS spread, round(avg(y) FILTER (r > floor(n * 0.8)) - avg(y), 6) + 0.0 AS top_excess
FROM o GROUP BY dt HAVING max(n) >= 20
"""


@query("x10_quintile_spread", _SPREAD)
def spread(spark, sf_dir):
    return shown(xs.quintile_spread(basic(spark, sf_dir), "mom", "fwd_21"), ["spread", "top_excess"], keys=("dt",))


_THRESHOLD = f"""
WITH {_BASIC_FROM}, o AS (SELECT dt, mom AS x, fwd_21 AS y FROM b0 WHERE mom IS NOT NULL AND fwd_21 IS NOT NULL), q AS (SELECT dt, quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.8) AS hi FROM o GROUP BY dt)
SELECT dt, round(avg(y) FILTER (x >= hi) - avg(y) FILTER (x <= lo), 6) + 0.0 AS spread, round(avg(y) FILTER (x >= hi) - avg(y), 6) + 0.0 AS top_excess
FROM o JOIN q USING (dt) GROUP BY dt HAVING count(*) >= 20
"""


@query("x11_threshold_spread", _THRESHOLD)
def threshold(spark, sf_dir):
    return shown(xs.threshold_spread(basic(spark, sf_dir), "mom", "fwd_21"), ["spread", "top_excess"], keys=("dt",))


_MONOTONE = f"""
WITH {_BASIC_FROM}, o AS (SELECT dt, fwd_21 AS y, {rank_pct('mom')} AS p FROM b0 WHERE mom IS NOT NULL AND fwd_21 IS NOT NULL
), f AS (SELECT dt, least(5, ceil(p * 5)) AS q, avg(y) AS m FROM o GROUP BY 1, 2
), s AS (SELECT dt, m, lag(m) OVER (PARTITION BY dt ORDER BY q) AS b FROM f)
SELECT dt, count(*) FILTER (m > b) / 4.0 AS monotonicity, round(max(m) - min(m), 6) + 0.0 AS reach FROM s GROUP BY dt
"""


@query("x12_monotonicity", _MONOTONE)
def monotonicity(spark, sf_dir):
    df = basic(spark, sf_dir).where("mom is not null and fwd_21 is not null").withColumn("p", w.percent_rank(c("mom")))
    fifths = df.groupBy("dt", F.least(F.lit(5), F.ceil(c("p") * 5)).alias("q")).agg(F.avg("fwd_21").alias("m"))
    fifths = fifths.withColumn("b", F.lag("m").over(w.section().orderBy("q")))
    return fifths.groupBy("dt").agg((F.count(F.when(c("m") > c("b"), 1)) / F.lit(4.0)).alias("monotonicity"), (F.max("m") - F.min("m")).alias("reach")).select("dt", "monotonicity", w.rounded("reach"))


_TURNOVER = f"""
WITH {_BASIC_FROM}, o AS (SELECT dt, ticker, row_number() OVER (PARTITION BY dt ORDER BY mom DESC, ticker) AS r, count(*) OVER (PARTITION BY dt) AS n FROM b0 WHERE mom IS NOT NULL
), t AS (SELECT dt, ticker FROM o WHERE r <= greatest(1, floor(n * 0.2))
), d AS (SELECT dt, lag(dt) OVER (ORDER BY dt) AS before FROM (SELECT DISTINCT dt FROM t))
SELECT t.dt, round(1 - count(p.ticker) * 1.0 / count(*), 6) + 0.0 AS turnover
FROM t JOIN d ON d.dt = t.dt LEFT JOIN t p ON p.dt = d.before AND p.ticker = t.ticker WHERE d.before IS NOT NULL GROUP BY t.dt
"""


@query("x13_x14_top_turnover", _TURNOVER)
def turnover(spark, sf_dir):
    return shown(xs.top_turnover(basic(spark, sf_dir), "mom", 0.2), ["turnover"], keys=("dt",))


_COVERAGE = f"""
WITH {_BASIC_FROM}, s AS (SELECT dt, ((mom IS NOT NULL)::INT + (vol IS NOT NULL)::INT + (fwd_21 IS NOT NULL)::INT) / 3.0 AS s FROM b0)
SELECT dt, count(*) AS n, round(avg(s), 6) + 0.0 AS share, count(*) FILTER (s >= 0.9) AS n_good, count(*) FILTER (s >= 0.5 AND s < 0.9) AS n_fair, count(*) FILTER (s < 0.5) AS n_poor FROM s GROUP BY dt
"""


@query("x16_p20_coverage", _COVERAGE)
def coverage(spark, sf_dir):
    return xs.coverage(basic(spark, sf_dir), ["mom", "vol", "fwd_21"]).select("dt", "n", w.rounded("share"), "n_good", "n_fair", "n_poor")


_ASOF = f"""
WITH {BARS}, {SERIES}
SELECT b.dt, b.ticker, round(p.value, 6) + 0.0 AS price, round(o.value, 6) + 0.0 AS orders
FROM bars b ASOF LEFT JOIN (SELECT * FROM series WHERE name = 'price') p ON b.dt >= p.dt ASOF LEFT JOIN (SELECT * FROM series WHERE name = 'orders') o ON b.dt >= o.dt
"""


@query("j04_asof_join", _ASOF)
def asof(spark, sf_dir):
    return shown(xs.asof(bars(spark, sf_dir), series(spark, sf_dir), ["price", "orders"]), ["price", "orders"])


_WINDOW_JOIN = f"""
WITH {PANEL}, d AS (SELECT dt, row_number() OVER (ORDER BY dt) AS i FROM (SELECT DISTINCT dt FROM bars)), g AS (SELECT CAST(row_number() OVER (ORDER BY dt) AS INT) AS window_id, dt AS at_, dt - INTERVAL 364 DAY AS lo FROM d WHERE i > 60 AND (i - 61) % 21 = 0)
SELECT window_id, CAST(at_ AS DATE) AS dt, count(*) AS n, count(DISTINCT ticker) AS entities, round(avg(ret), 6) + 0.0 AS mean_ret FROM g JOIN panel p ON p.dt >= g.lo AND p.dt < g.at_ GROUP BY 1, 2
"""


def rebalance_grid(df, first: int = 60, step: int = 21):
    """(window_id, at): every step-th date after the first ones."""
    dates = df.select("dt").distinct().withColumn("i", F.row_number().over(Window.orderBy("dt")))
    grid = dates.where((c("i") > first) & ((c("i") - first - 1) % step == 0))
    return grid.select(F.row_number().over(Window.orderBy("dt")).alias("window_id"), c("dt").alias("at"), c("i").alias("at_row"))


@query("j14_k04_window_slices", _WINDOW_JOIN)
def window_slices(spark, sf_dir):
    df = panel(spark, sf_dir)
    grid = F.broadcast(rebalance_grid(df))  # a row for each rebalance date
    joined = grid.join(df, (c("dt") >= F.date_sub("at", 364)) & (c("dt") < c("at")))
    return joined.groupBy("window_id", c("at").alias("dt")).agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("entities"), F.avg("ret").alias("mean_ret")).select("window_id", "dt", "n", "entities", w.rounded("mean_ret"))


_GROUPS = f"""
WITH {_BASIC_FROM}
SELECT coalesce(family, 'all') AS family, coalesce(CAST(year(dt) AS VARCHAR), 'all') AS year, count(*) AS n, count(mom) AS n_mom, round(avg(mom), 6) + 0.0 AS mean, round(stddev_samp(mom), 6) + 0.0 AS sd,
  round(median(mom), 6) + 0.0 AS mid, round(quantile_cont(mom, 0.05), 6) + 0.0 AS q05, round(quantile_cont(mom, 0.95), 6) + 0.0 AS q95, round(skewness(mom), 5) + 0.0 AS skew, round(kurtosis(mom), 5) + 0.0 AS kurt,
  round(avg(ret) FILTER (ret < 0), 6) + 0.0 AS mean_loss, count(DISTINCT ticker) AS entities, arg_max(ticker, volume * 1000000 + CAST(substr(ticker, 7) AS INT)) AS largest
FROM b0 GROUP BY CUBE (family, year(dt))
"""


@query("a04_a15_group_statistics", _GROUPS)
def group_statistics(spark, sf_dir):
    x, n = c("mom"), F.count("mom")
    df = basic(spark, sf_dir).withColumn("y", F.year("dt").cast("string")).cube("family", "y").agg(
        F.count("*").alias("n"), n.alias("n_mom"), F.avg(x).alias("mean"), F.stddev(x).alias("sd"), F.median(x).alias("mid"), F.percentile(x, F.lit(0.05)).alias("q05"), F.percentile(x, F.lit(0.95)).alias("q95"),
        (F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))).alias("skew"), (((n + 1) * F.kurtosis(x) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0))).alias("kurt"),
        F.avg(F.when(c("ret") < 0, c("ret"))).alias("mean_loss"), F.countDistinct("ticker").alias("entities"), F.max_by("ticker", c("volume") * 1000000 + F.substring("ticker", 7, 9).cast("int")).alias("largest"),
    )
    shown_ = [w.rounded(k) for k in ("mean", "sd", "mid", "q05", "q95")] + [w.rounded("skew", 5), w.rounded("kurt", 5), w.rounded("mean_loss")]
    return df.select(F.coalesce("family", F.lit("all")).alias("family"), F.coalesce("y", F.lit("all")).alias("year"), "n", "n_mom", *shown_, "entities", "largest")


_TOPK = f"""
WITH {_BASIC_FROM}, o AS (SELECT dt, family, ticker, mom, row_number() OVER (PARTITION BY dt, family ORDER BY mom DESC, ticker) AS r FROM b0 WHERE mom IS NOT NULL)
SELECT dt, family, ticker, CAST(r AS INT) AS r, round(mom, 6) + 0.0 AS mom FROM o WHERE r <= 2
"""


@query("k03_k05_top_by_family", _TOPK)
def top_by_family(spark, sf_dir):
    df = basic(spark, sf_dir).where("mom is not null").withColumn("r", F.row_number().over(Window.partitionBy("dt", "family").orderBy(F.desc("mom"), "ticker")))
    return df.where("r <= 2").select("dt", "family", "ticker", "r", w.rounded("mom"))


_SETS = f"""
WITH {_BASIC_FROM}, hi AS (SELECT dt, ticker FROM b0 WHERE mom > 0), lo AS (SELECT dt, ticker FROM b0 WHERE vol < 0.3)
SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM hi INTERSECT SELECT * FROM lo) UNION ALL SELECT 'only', count(*) FROM (SELECT * FROM hi EXCEPT SELECT * FROM lo)
UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM hi UNION SELECT * FROM lo) UNION ALL SELECT 'all', count(*) FROM (SELECT * FROM hi UNION ALL SELECT * FROM lo)
"""


@query("u01_u07_sets", _SETS)
def sets(spark, sf_dir):
    df = basic(spark, sf_dir)
    high, low = df.where("mom > 0").select("dt", "ticker"), df.where("vol < 0.3").select("dt", "ticker")
    kinds = {"both": high.intersect(low), "only": high.subtract(low), "either": high.union(low).distinct(), "all": high.unionByName(low)}
    counted = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in kinds.items()]
    out = counted[0]
    for d in counted[1:]:
        out = out.unionByName(d)
    return out


_PIVOT = f"""
WITH {_BASIC_FROM}
SELECT year(dt) AS year, {', '.join(f"round(avg(ret) FILTER (family = 'F{k}'), 6) + 0.0 AS f{k}" for k in range(4))} FROM b0 GROUP BY 1
"""


@query("u08_pivot", _PIVOT)
def pivot(spark, sf_dir):
    df = basic(spark, sf_dir).groupBy(F.year("dt").alias("year")).pivot("family", [f"F{k}" for k in range(4)]).agg(F.avg("ret"))
    return df.select(c("year").cast("long").alias("year"), *((F.round(f"F{k}", 6) + F.lit(0.0)).alias(f"f{k}") for k in range(4)))


_UNIVERSE = f"""
WITH {_BASIC_FROM}, a AS (SELECT *, avg(close * volume) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS adv, min(dt) OVER (PARTITION BY ticker) AS listed FROM b0
), r AS (SELECT *, {rank_pct('adv')} AS adv_rank, ((mom IS NOT NULL)::INT + (vol IS NOT NULL)::INT) / 2.0 AS quality FROM a)
SELECT dt, ticker, round(adv_rank, 6) + 0.0 AS adv_rank FROM r WHERE adv_rank >= 0.5 AND quality >= 0.9 AND datediff('day', listed, dt) >= 252 AND family <> 'F3'
"""


@query("p01_p06_p08_universe", _UNIVERSE)
def universe(spark, sf_dir):
    df = basic(spark, sf_dir).withColumns({"adv": F.avg(c("close") * c("volume")).over(w.last(63)), "listed": F.min("dt").over(w.whole())})
    df = df.withColumns({"adv_rank": w.percent_rank(c("adv")), "quality": (c("mom").isNotNull().cast("int") + c("vol").isNotNull().cast("int")) / 2.0})
    df = df.where((c("adv_rank") >= 0.5) & (c("quality") >= 0.9) & (F.datediff("dt", "listed") >= 252) & (c("family") != "F3"))
    return shown(df, ["adv_rank"])


_NULLS = f"""
WITH {_BASIC_FROM}, t AS (SELECT * FROM b0 WHERE dt >= DATE '1996-06-01')
SELECT 'mom' AS feature, round(avg((mom IS NULL)::INT), 6) + 0.0 AS null_share, round(median(abs(mom - m)), 6) + 0.0 AS mad FROM t, (SELECT median(mom) AS m FROM t) GROUP BY 1
UNION ALL SELECT 'vol', round(avg((vol IS NULL)::INT), 6) + 0.0, round(median(abs(vol - m)), 6) + 0.0 FROM t, (SELECT median(vol) AS m FROM t) GROUP BY 1
UNION ALL SELECT 'fwd_21', round(avg((fwd_21 IS NULL)::INT), 6) + 0.0, round(median(abs(fwd_21 - m)), 6) + 0.0 FROM t, (SELECT median(fwd_21) AS m FROM t) GROUP BY 1
"""


@query("p09_null_shares", _NULLS)
def null_shares(spark, sf_dir):
    names = ["mom", "vol", "fwd_21"]
    df = basic(spark, sf_dir).where(c("dt") >= F.lit("1996-06-01").cast("date")).select(*names)
    mids = df.agg(*(F.median(n).alias(f"m_{n}") for n in names))
    one = df.crossJoin(F.broadcast(mids)).agg(*(F.avg(c(n).isNull().cast("double")).alias(f"s_{n}") for n in names), *(F.median(F.abs(c(n) - c(f"m_{n}"))).alias(f"d_{n}") for n in names))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), (F.round(f"s_{n}", 6) + F.lit(0.0)).alias("null_share"), (F.round(f"d_{n}", 6) + F.lit(0.0)).alias("mad")) for n in names))))


_CACHE = """
SELECT p_brand AS ticker, min(CAST(l_shipdate AS DATE)) AS first, max(CAST(l_shipdate AS DATE)) AS last, count(*) AS n, CAST(datediff('day', min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE))) AS BIGINT) AS days
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
"""


@query("s13_cache_status", _CACHE)
def cache_status(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey")).groupBy(c("p_brand").alias("ticker"))
    return df.agg(F.min("l_shipdate").cast("date").alias("first"), F.max("l_shipdate").cast("date").alias("last"), F.count("*").alias("n")).withColumn("days", F.datediff("last", "first").cast("long"))


_MERGE = f"""
WITH {SERIES}, loads AS (SELECT name, dt, value, 1 AS load_id FROM series UNION ALL SELECT name, dt, value * 2, 2 FROM series WHERE month(dt) % 3 = 0)
SELECT name, dt, round(value, 4) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY name, dt ORDER BY load_id DESC) AS r FROM loads) WHERE r = 1
"""


@query("s10_s12_u06_merge_keep_last", _MERGE)
def merge_keep_last(spark, sf_dir):
    from tidepanel.sources.tables import merged

    old = series(spark, sf_dir).withColumn("load_id", F.lit(1))
    new = old.where(F.month("dt") % 3 == 0).withColumns({"value": c("value") * 2, "load_id": F.lit(2)})
    return merged(old, new, ["name", "dt"], "load_id").select("name", "dt", w.rounded("value", 4))

