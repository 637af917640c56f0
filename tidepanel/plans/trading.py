"""Registered queries: books, backtest, performance, regimes, universe construction, studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import classify
from tidepanel.functions import windows as w
from tidepanel.operators import performance as perf
from tidepanel.operators import portfolio as pf
from tidepanel.operators import regime as rg
from tidepanel.operators import universe as un
from tidepanel.operators import xsection as xs
from tidepanel.plans.cross import _BASIC_FROM, basic, rebalance_grid
from tidepanel.plans.panel import BARS, PANEL, SERIES, bars, panel, rank_pct, series
from tidepanel.registry import query

c = F.col
RULES = pf.Rules(cap=0.15, cost_bps=8.0)

# a momentum rank model, rebalanced every 21 bars


def scores(spark, sf_dir):
    df = basic(spark, sf_dir)
    ranked = df.withColumn("score", w.percent_rank(c("mom")))
    return pf.momentum_scores(ranked, rebalance_grid(df), "mom", c("score")), df


_SCORES = f"""{_BASIC_FROM}, dates AS (SELECT dt, row_number() OVER (ORDER BY dt) AS i FROM (SELECT DISTINCT dt FROM bars)
), grid AS (SELECT CAST(row_number() OVER (ORDER BY dt) AS INT) AS window_id, dt FROM dates WHERE i > 60 AND (i - 61) % 21 = 0
), ranked AS (SELECT dt, ticker, family, fwd_21, {rank_pct('mom')} AS score FROM b0
), sc AS (SELECT window_id, dt, ticker, family, fwd_21, score FROM ranked JOIN grid USING (dt))"""
_BOOK = f"""{_SCORES}, o AS (
  SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY window_id ORDER BY score DESC, ticker) AS up, row_number() OVER (PARTITION BY window_id ORDER BY score, ticker) AS down FROM sc WHERE score IS NOT NULL WINDOW g AS (PARTITION BY window_id)
), s AS (
  SELECT *, CASE WHEN up <= greatest(1, floor(n * (1 - 0.67))) THEN 'long' WHEN down <= greatest(1, floor(n * 0.33)) THEN 'short' END AS side FROM o
), k AS (
  SELECT *, least(0.5 / CASE WHEN side = 'long' THEN greatest(1, floor(n * (1 - 0.67))) ELSE greatest(1, floor(n * 0.33)) END, 0.15) AS w0 FROM s WHERE side IS NOT NULL
), book AS (SELECT window_id, dt, ticker, side, score, fwd_21, family, w0 * 0.5 / sum(w0) OVER (PARTITION BY window_id, side) * CASE WHEN side = 'long' THEN 1 ELSE -1 END AS w FROM k)"""
_PERIODS = f"""{_BOOK}, pr AS (
  SELECT window_id, dt, coalesce(sum(w * coalesce(fwd_21, 0)) FILTER (side = 'long'), 0) AS long_ret, coalesce(sum(w * coalesce(fwd_21, 0)) FILTER (side = 'short'), 0) AS short_ret,
    sum(w) FILTER (side = 'long') AS gl, -sum(w) FILTER (side = 'short') AS gs, count(*) FILTER (side = 'long') AS n_long, count(*) FILTER (side = 'short') AS n_short FROM book GROUP BY 1, 2
), ch AS (
  SELECT window_id, sum(abs(d)) AS change FROM (
    SELECT window_id, ticker, sum(w) AS d FROM (SELECT window_id, ticker, w FROM book UNION ALL SELECT window_id + 1, ticker, -w FROM book WHERE window_id < (SELECT max(window_id) FROM book)) GROUP BY 1, 2
  ) GROUP BY 1
), pd AS (
  SELECT pr.*, change * CASE WHEN window_id = 1 THEN 1.0 ELSE 0.5 END AS turnover, greatest(0, 1 - gl - gs) AS cash FROM pr JOIN ch USING (window_id)
), nr AS (
  SELECT *, cash * 0.034 * 21 / 365.0 AS cash_ret, turnover * 8 / 1e4 AS cost, gs * 0.01 * 21 / 365.0 AS borrow, long_ret + short_ret + cash * 0.034 * 21 / 365.0 - turnover * 8 / 1e4 - gs * 0.01 * 21 / 365.0 AS net_ret FROM pd
)"""


@query("d01_momentum_scores", f"WITH {_SCORES} SELECT window_id, dt, ticker, round(score, 6) + 0.0 AS score FROM sc")
def momentum_scores(spark, sf_dir):
    return scores(spark, sf_dir)[0].select("window_id", "dt", "ticker", w.rounded("score"))


@query("t02_k02_quantile_book", f"WITH {_BOOK} SELECT window_id, dt, ticker, side, round(w, 8) + 0.0 AS w FROM book")
def quantile_book(spark, sf_dir):
    return pf.quantile_book(scores(spark, sf_dir)[0], RULES).select("window_id", "dt", "ticker", "side", w.rounded("w", 8))


def periods(spark, sf_dir):
    sc, df = scores(spark, sf_dir)
    book = pf.quantile_book(sc, RULES)
    return pf.period_returns(book, df.select("dt", "ticker", c("fwd_21").alias("ret")), RULES), book, df


@query(
    "t05_t09_walk_forward",
    f"""WITH {_PERIODS} SELECT window_id, dt, n_long, n_short, round(long_ret, 8) + 0.0 AS long_ret, round(short_ret, 8) + 0.0 AS short_ret, round(cash_ret, 8) + 0.0 AS cash_ret, round(turnover, 8) + 0.0 AS turnover,
  round(cost, 8) + 0.0 AS cost, round(borrow, 8) + 0.0 AS borrow, round(net_ret, 8) + 0.0 AS net_ret, round(product(1 + net_ret) OVER (ORDER BY window_id ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS capital FROM nr""",
)
def walk_forward(spark, sf_dir):
    out = pf.compounded(periods(spark, sf_dir)[0])
    return out.select("window_id", "dt", "n_long", "n_short", *(w.rounded(k, 8) for k in ("long_ret", "short_ret", "cash_ret", "turnover", "cost", "borrow", "net_ret")), w.rounded("capital"))


_CAPPED = f"""
WITH {_SCORES}, o AS (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY window_id ORDER BY score DESC, ticker) AS place FROM sc WHERE score IS NOT NULL WINDOW g AS (PARTITION BY window_id)
), s AS (SELECT * FROM (SELECT *, CASE WHEN place <= greatest(1, floor(n * (1 - 0.67))) THEN 'long' WHEN place > n - greatest(1, floor(n * 0.33)) THEN 'short' END AS side FROM o) WHERE side IS NOT NULL
), r AS (SELECT window_id, side, sum(least(m * 0.15, 0.25)) AS room FROM (SELECT window_id, side, family, count(*) AS m FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2
), x AS (SELECT s.*, CASE WHEN room < 0.99 * 0.5 THEN 1.1 * 0.5 / room ELSE 1.0 END AS f FROM s JOIN r USING (window_id, side)
), t AS (SELECT *, greatest(0, least(0.15 * f, 0.25 * f - (row_number() OVER (PARTITION BY window_id, side, family ORDER BY score DESC, ticker) - 1) * 0.15 * f)) AS take FROM x
), u AS (SELECT *, greatest(0, least(take, 0.5 - coalesce(sum(take) OVER (PARTITION BY window_id, side ORDER BY score DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS w FROM t)
SELECT window_id, dt, ticker, side, round(w * CASE WHEN side = 'long' THEN 1 ELSE -1 END, 6) + 0.0 AS w FROM u WHERE round(w, 6) <> 0
"""


@query("t03_capped_book", _CAPPED)
def capped_book(spark, sf_dir):
    sc, df = scores(spark, sf_dir)
    sc = sc.join(df.select("dt", "ticker", c("family").alias("cluster")), ["dt", "ticker"])
    return pf.capped_book(sc, RULES).select("window_id", "dt", "ticker", "side", w.rounded("w")).where("w != 0")


@query(
    "t10_trading_ledger",
    f"""WITH {_PERIODS}, cp AS (SELECT window_id, product(1 + net_ret) OVER (ORDER BY window_id ROWS UNBOUNDED PRECEDING) AS capital FROM nr), st AS (SELECT window_id, coalesce(lag(capital) OVER (ORDER BY window_id), 1) AS start FROM cp)
SELECT window_id, dt, ticker, CASE WHEN side = 'long' THEN 'buy' ELSE 'sell' END AS action, round(w, 8) + 0.0 AS w, round(abs(w) * start, 6) + 0.0 AS amount FROM book JOIN st USING (window_id)""",
)
def trading_ledger(spark, sf_dir):
    out, book, _ = periods(spark, sf_dir)
    return pf.ledger_rows(book, pf.compounded(out)).select("window_id", "dt", "ticker", "action", w.rounded("w", 8), w.rounded("amount"))


_STATS = f"""
WITH {_PERIODS}, g AS (SELECT window_id, net_ret AS r, product(1 + net_ret) OVER o AS growth FROM nr WINDOW o AS (ORDER BY window_id ROWS UNBOUNDED PRECEDING)
), d AS (SELECT r, growth / greatest(1, max(growth) OVER (ORDER BY window_id ROWS UNBOUNDED PRECEDING)) - 1 AS dd, (SELECT quantile_cont(r, 0.05) FROM g) AS v FROM g)
SELECT count(*) AS n, round(product(1 + r) - 1, 6) + 0.0 AS total, round(avg(r) * 12, 6) + 0.0 AS annual, round(stddev_samp(r) * sqrt(12), 6) + 0.0 AS vol, round(avg(r) * sqrt(12) / nullif(stddev_samp(r), 0), 6) + 0.0 AS sharpe,
  round(avg(r) * sqrt(12) / nullif(sqrt(avg(pow(least(r, 0), 2))), 0), 6) + 0.0 AS sortino, round(min(dd), 6) + 0.0 AS max_dd, round(sum(greatest(r, 0)) / nullif(-sum(least(r, 0)), 0), 6) + 0.0 AS omega,
  round(max(v), 6) + 0.0 AS var_05, round(avg(r) FILTER (r <= v), 6) + 0.0 AS cvar_05, round(avg((r > 0)::INT), 6) + 0.0 AS win_rate, round(avg(r) FILTER (r > 0), 6) + 0.0 AS mean_win, round(avg(r) FILTER (r < 0), 6) + 0.0 AS mean_loss,
  round(max(r), 6) + 0.0 AS best, round(min(r), 6) + 0.0 AS worst, round(skewness(r), 5) + 0.0 AS skew, round(kurtosis(r), 5) + 0.0 AS kurt, round(avg(r) * 12 / nullif(-min(dd), 0), 6) + 0.0 AS calmar FROM d
"""


@query("r01_statistics", _STATS)
def statistics(spark, sf_dir):
    out = perf.statistics(periods(spark, sf_dir)[0])
    names = ["total", "annual", "vol", "sharpe", "sortino", "max_dd", "omega", "var_05", "cvar_05", "win_rate", "mean_win", "mean_loss", "best", "worst", "calmar"]
    return out.select("n", *(w.rounded(k) for k in names), w.rounded("skew", 5), w.rounded("kurt", 5))


_AGAINST = f"""
WITH {_PERIODS}, mk AS (SELECT dt, avg(fwd_21) AS b FROM b0 GROUP BY dt), p AS (SELECT net_ret AS r, b, net_ret - b AS d FROM nr JOIN mk USING (dt) WHERE b IS NOT NULL)
SELECT count(*) AS n, round(avg(d) * 12, 6) + 0.0 AS excess, round(stddev_samp(d) * sqrt(12), 6) + 0.0 AS tracking, round(avg(d) * sqrt(12) / nullif(stddev_samp(d), 0), 6) + 0.0 AS info_ratio,
  round(covar_samp(r, b) / nullif(var_samp(b), 0), 6) + 0.0 AS beta, round((avg(r) - covar_samp(r, b) / nullif(var_samp(b), 0) * avg(b)) * 12, 6) + 0.0 AS alpha, round(covar_samp(r, b) / nullif(stddev_samp(r) * stddev_samp(b), 0), 6) + 0.0 AS corr,
  round(avg(r) FILTER (b > 0) / nullif(avg(b) FILTER (b > 0), 0), 6) + 0.0 AS up_capture, round(avg(r) FILTER (b < 0) / nullif(avg(b) FILTER (b < 0), 0), 6) + 0.0 AS down_capture, round(product(1 + b) - 1, 6) + 0.0 AS bench_total FROM p
"""


@query("r03_t11_benchmark", _AGAINST)
def benchmark(spark, sf_dir):
    out, _, df = periods(spark, sf_dir)
    bench = df.groupBy("dt").agg(F.avg("fwd_21").alias("b"))
    names = ["excess", "tracking", "info_ratio", "beta", "alpha", "corr", "up_capture", "down_capture", "bench_total"]
    return perf.against(out.join(bench, "dt"), "net_ret", "b").select("n", *(w.rounded(k) for k in names))


_SIDES = f"""
WITH {_PERIODS} SELECT family, side, count(*) AS positions, round(sum(w * coalesce(fwd_21, 0)), 6) + 0.0 AS contribution, round(avg(w), 6) + 0.0 AS mean_w, round(avg((w * coalesce(fwd_21, 0) > 0)::INT), 6) + 0.0 AS hit_rate FROM book GROUP BY 1, 2
"""


@query("r04_r07_attribution", _SIDES)
def attribution(spark, sf_dir):
    _, book, df = periods(spark, sf_dir)
    held = book.join(df.select("dt", "ticker", "family", "fwd_21"), ["dt", "ticker"]).withColumn("k", c("w") * F.coalesce("fwd_21", F.lit(0.0)))
    out = held.groupBy("family", "side").agg(F.count("*").alias("positions"), F.sum("k").alias("contribution"), F.avg("w").alias("mean_w"), F.avg((c("k") > 0).cast("int")).alias("hit_rate"))
    return out.select("family", "side", "positions", w.rounded("contribution"), w.rounded("mean_w"), w.rounded("hit_rate"))


_YEARS = f"WITH {_PERIODS} SELECT year(dt) AS year, count(*) AS n, round(avg(net_ret), 6) + 0.0 AS mean, round(product(1 + net_ret) - 1, 6) + 0.0 AS total, round(avg((net_ret > 0)::INT), 6) + 0.0 AS win_rate FROM nr GROUP BY 1"


@query("r07_by_year", _YEARS)
def by_year(spark, sf_dir):
    out = perf.by_group(periods(spark, sf_dir)[0].withColumn("year", F.year("dt").cast("long")), "year")
    return out.select("year", "n", w.rounded("mean"), w.rounded("total"), w.rounded("win_rate"))


_TREND = f"""
WITH {_PERIODS}, i AS (SELECT net_ret AS y, row_number() OVER (ORDER BY window_id) - 1 AS x FROM nr)
SELECT count(*) AS n, round(regr_slope(y, x), 8) + 0.0 AS slope, round(regr_intercept(y, x), 8) + 0.0 AS level, round(regr_r2(y, x), 6) + 0.0 AS r2, round(sign(regr_slope(y, x)) * sqrt(regr_r2(y, x) * (count(*) - 2) / (1 - regr_r2(y, x))), 5) + 0.0 AS t FROM i
"""


@query("a22_r07_trend", _TREND)
def trend(spark, sf_dir):
    return perf.trend(periods(spark, sf_dir)[0], "net_ret").select("n", w.rounded("slope", 8), w.rounded("level", 8), w.rounded("r2"), w.rounded("t", 5))


_POWER = f"""
WITH {_PERIODS}, sh AS (SELECT count(*) AS n, avg(net_ret) / nullif(stddev_samp(net_ret), 0) AS s FROM nr)
SELECT n, round(s * sqrt(12), 6) + 0.0 AS sharpe, round(sqrt((1 + s * s / 2) / n) * sqrt(12), 6) + 0.0 AS se, round(2.8 * sqrt((1 + s * s / 2) / n) * sqrt(12), 6) + 0.0 AS mde FROM sh
"""


@query("v07_power", _POWER)
def power(spark, sf_dir):
    return perf.power(periods(spark, sf_dir)[0]).select("n", w.rounded("sharpe"), w.rounded("se"), w.rounded("mde"))


_DRAWN = f"""
WITH {_PERIODS}, h AS (SELECT net_ret AS r, row_number() OVER (ORDER BY window_id) AS i, count(*) OVER () AS n FROM nr), z AS (SELECT max(n) AS n FROM h
), p AS (SELECT t.trial, b.part, n, CAST('0x' || substr(md5(t.trial || ':' || b.part || ':42'), 1, 15) AS BIGINT) % greatest(1, n - 5) AS start FROM z, range(1000) t(trial), range(1000) b(part) WHERE b.part < ceil(n / 6.0)
), d AS (SELECT trial, r FROM p JOIN h ON h.i > start AND h.i <= start + least(6, p.n - part * 6))
SELECT trial, round(product(1 + r) - 1, 3) + 0.0 AS total, round(avg(r) * sqrt(12) / nullif(stddev_samp(r), 0), 6) + 0.0 AS sharpe FROM d GROUP BY 1
"""


@query("r02_block_bootstrap", _DRAWN)
def bootstrap(spark, sf_dir):
    return perf.block_bootstrap(periods(spark, sf_dir)[0]).select("trial", w.rounded("total", 3), w.rounded("sharpe"))


_RANDOM = f"""
WITH {_PERIODS}, e AS (SELECT dt, ticker, fwd_21 AS ret FROM sc JOIN (SELECT DISTINCT dt FROM grid) USING (dt) WHERE fwd_21 IS NOT NULL
), od AS (SELECT trial, dt, ret, row_number() OVER (PARTITION BY trial, dt ORDER BY md5(trial || ':' || dt || ':' || ticker || ':7')) AS k FROM e, range(1000) t(trial)
), y AS (SELECT trial, dt, avg(ret) AS r FROM od WHERE k <= 10 GROUP BY 1, 2), b AS (SELECT trial, product(1 + r) - 1 AS total, avg(r) * sqrt(12) / nullif(stddev_samp(r), 0) AS sharpe FROM y GROUP BY 1
), a AS (SELECT product(1 + net_ret) - 1 AS actual_total, coalesce(avg(net_ret) * sqrt(12) / nullif(stddev_samp(net_ret), 0), 0) AS actual_sharpe FROM nr
), q AS (SELECT avg((total >= actual_total)::INT) AS p_value_return, avg((coalesce(sharpe, 0) >= actual_sharpe)::INT) AS p_value_sharpe FROM b, a)
SELECT trial, round(total, 3) + 0.0 AS total, round(sharpe, 6) + 0.0 AS sharpe, round(actual_total, 3) + 0.0 AS actual_total, round(actual_sharpe, 6) + 0.0 AS actual_sharpe, round(p_value_return, 6) + 0.0 AS p_value_return, round(p_value_sharpe, 6) + 0.0 AS p_value_sharpe,
  round((1 - p_value_sharpe) * 100, 4) + 0.0 AS percentile FROM b, a, q
"""


@query("v03_random_books", _RANDOM)
def random_books(spark, sf_dir):
    """Books of ten random entities, and how the momentum book stands among them."""
    reached, _, df = periods(spark, sf_dir)
    grid = rebalance_grid(df)
    held = df.join(F.broadcast(grid), c("dt") == c("at")).select("dt", "ticker", c("fwd_21").alias("ret"))
    out = perf.against_random(perf.random_books(held), reached)
    return out.select(c("trial").cast("long").alias("trial"), w.rounded("total", 3), w.rounded("sharpe"), w.rounded("actual_total", 3), *(w.rounded(k) for k in ("actual_sharpe", "p_value_return", "p_value_sharpe")), w.rounded("percentile", 4))


_FORESIGHT = f"""
WITH {_SCORES}, o AS (
  SELECT window_id, fwd_21 AS y, row_number() OVER (PARTITION BY window_id ORDER BY fwd_21 DESC, ticker) AS best, row_number() OVER (PARTITION BY window_id ORDER BY score DESC, ticker) AS top, row_number() OVER (PARTITION BY window_id ORDER BY score, ticker) AS low
  FROM sc WHERE fwd_21 IS NOT NULL AND score IS NOT NULL
)
SELECT window_id, round(avg(y) FILTER (best <= 10), 6) + 0.0 AS perfect, round(avg(y) FILTER (top <= 10), 6) + 0.0 AS momentum, round(avg(y) FILTER (low <= 10), 6) + 0.0 AS inverse FROM o GROUP BY 1
"""


@query("v04_v06_baselines", _FORESIGHT)
def baselines(spark, sf_dir):
    sc, df = scores(spark, sf_dir)
    rows = sc.join(df.select("dt", "ticker", "fwd_21"), ["dt", "ticker"]).where("fwd_21 is not null and score is not null")
    of = Window.partitionBy("window_id")
    rows = rows.withColumns({"best": F.row_number().over(of.orderBy(F.desc("fwd_21"), "ticker")), "top": F.row_number().over(of.orderBy(F.desc("score"), "ticker")), "low": F.row_number().over(of.orderBy("score", "ticker"))})
    out = rows.groupBy("window_id").agg(*(F.avg(F.when(c(k) <= 10, c("fwd_21"))).alias(n) for k, n in (("best", "perfect"), ("top", "momentum"), ("low", "inverse"))))
    return out.select("window_id", w.rounded("perfect"), w.rounded("momentum"), w.rounded("inverse"))


_AUDIT = f"""
WITH {_BASIC_FROM}, g AS (SELECT dt, lag(dt) OVER (ORDER BY dt) AS b FROM (SELECT DISTINCT dt FROM bars))
SELECT 'rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM b0 UNION ALL SELECT 'repeated_keys', CAST(count(*) - count(DISTINCT (dt, ticker)) AS DOUBLE) FROM b0
UNION ALL SELECT 'high_below_low', CAST(count(*) FILTER (high < low OR close > high + 1e-9 OR close < low - 1e-9) AS DOUBLE) FROM b0 UNION ALL SELECT 'longest_gap', CAST(max(datediff('day', b, dt)) AS DOUBLE) FROM g
UNION ALL SELECT 'null_closes', CAST(count(*) FILTER (close IS NULL) AS DOUBLE) FROM b0
"""


@query("p22_audit", _AUDIT)
def audit(spark, sf_dir):
    return un.audit(basic(spark, sf_dir))


# regimes and series of the market


def market(spark, sf_dir):
    return bars(spark, sf_dir).groupBy("dt").agg(F.avg("close").alias("close"))


_D = "(ORDER BY dt ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_dated = lambda call, x, n, least=None: f"(CASE WHEN count({x}) OVER {_D.format(n=n - 1)} >= {n if least is None else least} THEN {call.format(x=x)} OVER {_D.format(n=n - 1)} END)"
_STATE = f"""
{BARS}, mk AS (SELECT dt, avg(close) AS close FROM bars GROUP BY dt), q AS (SELECT *, {_dated('avg({x})', 'close', 200)} AS ma, close / lag(close, 63) OVER (ORDER BY dt) - 1 AS ret_span, row_number() OVER (ORDER BY dt) AS i FROM mk
), st AS (SELECT *, CASE WHEN coalesce(close > ma, false) AND ret_span > 0.02 THEN 'bull' WHEN NOT coalesce(close > ma, false) AND ret_span < -0.02 THEN 'bear' ELSE 'range' END AS state FROM q)"""
_REGIME = f"""
WITH RECURSIVE {_STATE}, run AS (
  SELECT i, 'range' AS regime, 1 AS held FROM st WHERE i = 1
  UNION ALL SELECT s.i, CASE WHEN s.state <> r.regime AND r.held >= 21 THEN s.state ELSE r.regime END, CASE WHEN s.state <> r.regime AND r.held >= 21 THEN 1 ELSE r.held + 1 END FROM run r JOIN st s ON s.i = r.i + 1
)
SELECT dt, round(ma, 4) + 0.0 AS ma, round(ret_span, 6) + 0.0 AS ret_span, state, regime, coalesce(lag(regime) OVER (ORDER BY dt), 'range') AS known,
  CASE regime WHEN 'bull' THEN 'long_only' WHEN 'bear' THEN 'short_only' ELSE 'cash' END AS mode FROM st JOIN run USING (i)
"""


@query("w62_w64_market_regime", _REGIME)
def market_regime(spark, sf_dir):
    df = rg.steadied(rg.market_state(market(spark, sf_dir)))
    return df.withColumns({"known": rg.lagged(), "mode": rg.trading_mode(c("regime"))}).select("dt", w.rounded("ma", 4), w.rounded("ret_span"), "state", "regime", "known", "mode")


def _z(x: str) -> str:
    return f"({x} - {_dated('avg({x})', x, 252, 126)}) / ({_dated('stddev_samp({x})', x, 252, 126)} + 1e-8)"


_MACRO = f"""
WITH {BARS}, {SERIES}, d AS (SELECT DISTINCT dt FROM bars), al AS (
  SELECT d.dt, p.value AS price, o.value AS orders FROM d ASOF LEFT JOIN (SELECT * FROM series WHERE name = 'price') p ON d.dt >= p.dt ASOF LEFT JOIN (SELECT * FROM series WHERE name = 'orders') o ON d.dt >= o.dt
), a AS (SELECT *, price / lag(price) OVER (ORDER BY dt) - 1 AS ch FROM al
), b AS (SELECT *, {_dated('stddev_samp({x})', 'ch', 60, 30)} AS vol, {_z('price')} AS level_z, {_z('orders')} AS orders_z, price - {_dated('avg({x})', 'price', 63, 31)} AS slope FROM a
), e AS (SELECT *, sign(slope) + sign(coalesce(level_z, 0)) - sign(coalesce(orders_z, 0)) AS score FROM b)
SELECT dt, round(slope, 3) + 0.0 AS slope, round(level_z, 5) + 0.0 AS level_z, round(orders_z, 5) + 0.0 AS orders_z, CASE WHEN ch < -2.5 * vol THEN 1.0 ELSE 0.0 END AS crash_flag, CASE WHEN ch > 2.5 * vol THEN 1.0 ELSE 0.0 END AS meltup_flag,
  CASE WHEN level_z > 1 THEN 1.0 ELSE 0.0 END AS high_level, CASE WHEN level_z < -1 THEN 1.0 ELSE 0.0 END AS low_level, round((price / lag(price, 52) OVER (ORDER BY dt) - 1) * 100, 5) + 0.0 AS yoy,
  CASE WHEN price > {_dated('quantile_cont({x}, 0.8)', 'price', 252, 126)} THEN 1.0 ELSE 0.0 END AS stress, round({_dated('avg({x})', 'orders', 4, 2)}, 5) + 0.0 AS orders_mean_4,
  CASE WHEN score >= 2 THEN 1.0 ELSE 0.0 END AS risk_on, CASE WHEN score <= -2 THEN 1.0 ELSE 0.0 END AS risk_off FROM e
"""


@query("m01_macro_flags", _MACRO)
def macro(spark, sf_dir):
    days = bars(spark, sf_dir).select("dt").distinct()
    df = rg.macro(xs.asof(days, series(spark, sf_dir), ["price", "orders"]))
    return df.select("dt", w.rounded("slope", 3), w.rounded("level_z", 5), w.rounded("orders_z", 5), "crash_flag", "meltup_flag", "high_level", "low_level", w.rounded("yoy", 5), "stress", w.rounded("orders_mean_4", 5), "risk_on", "risk_off")


_REGIME_PERF = f"""
WITH {_PERIODS}, mk AS (SELECT dt, avg(close) AS close FROM bars GROUP BY dt), tr AS (SELECT dt, (close / lag(close, 63) OVER (ORDER BY dt) - 1) * 100 AS past FROM mk
), j AS (SELECT net_ret, CASE WHEN past > 10 THEN 'bull' WHEN past < -10 THEN 'bear' ELSE 'range' END AS regime FROM nr JOIN tr USING (dt))
SELECT regime, count(*) AS n, round(avg(net_ret), 6) + 0.0 AS mean, round(avg((net_ret > 0)::INT), 6) + 0.0 AS win_rate FROM j GROUP BY 1
"""


@query("r08_regime_performance", _REGIME_PERF)
def regime_performance(spark, sf_dir):
    out = periods(spark, sf_dir)[0]
    trailing = market(spark, sf_dir).withColumn("t", (c("close") / F.lag("close", 63).over(Window.orderBy("dt")) - 1) * 100).select("dt", F.when(c("t") > 10, "bull").when(c("t") < -10, "bear").otherwise("range").alias("regime"))
    return perf.by_group(out.join(F.broadcast(trailing), "dt"), "regime").select("regime", "n", w.rounded("mean"), w.rounded("win_rate"))


# universe construction

_DUPLICATES = f"""
WITH RECURSIVE {PANEL}, r AS (SELECT dt, ticker, ret FROM panel WHERE ret IS NOT NULL), p AS (
  SELECT a.ticker AS a, b.ticker AS b FROM r a JOIN r b ON a.dt = b.dt AND a.ticker < b.ticker GROUP BY 1, 2 HAVING covar_samp(a.ret, b.ret) / nullif(stddev_samp(a.ret) * stddev_samp(b.ret), 0) >= 0.05
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), t AS (SELECT DISTINCT ticker FROM r), x AS (
  SELECT ticker AS id, ticker AS seen FROM t UNION SELECT x.id, e.b FROM x JOIN e ON x.seen = e.a
), g AS (SELECT id AS ticker, min(seen) AS dup_group FROM x GROUP BY 1), v AS (SELECT ticker, avg(close * volume) AS adv FROM bars GROUP BY 1)
SELECT ticker, dup_group, round(adv, 2) + 0.0 AS adv, row_number() OVER (PARTITION BY dup_group ORDER BY adv DESC, ticker) = 1 AS canonical FROM g JOIN v USING (ticker)
"""


@query("g02_duplicate_groups", _DUPLICATES)
def duplicate_groups(spark, sf_dir):
    df = panel(spark, sf_dir)
    adv = df.groupBy("ticker").agg(F.avg(c("close") * c("volume")).alias("adv"))
    return un.duplicate_groups(df, adv, 0.05).select("ticker", "dup_group", w.rounded("adv", 2), "canonical")


@query("g03_theme_clusters")
def theme_clusters(spark, sf_dir):
    return un.theme_clusters(panel(spark, sf_dir), 0.85)


_CAPS = f"""
WITH {_BASIC_FROM}, f AS (SELECT ticker, max(family) AS family, avg(close * volume) AS adv FROM b0 GROUP BY 1), k AS (SELECT family, bool_or(family IN ('F3')) AS risky FROM f GROUP BY 1)
SELECT ticker, family, CASE WHEN risky THEN 0.10 ELSE 0.15 END + 0.0 AS cluster_cap, CASE WHEN family = 'F3' THEN 0.07 ELSE 0.10 END + 0.0 AS asset_cap FROM f JOIN k USING (family)
"""


@query("g04_caps", _CAPS)
def caps(spark, sf_dir):
    df = basic(spark, sf_dir).groupBy("ticker").agg(F.max("family").alias("family")).withColumn("cluster", c("family"))
    return un.caps(df, ("F3",), 0.15, 0.10, 0.10, 0.07).select("ticker", "family", "cluster_cap", "asset_cap")


_NAMES = ["Close%-21", "Close_MA63", "rel_volume_10", "amihud_21", "beta_VT_63", "Close_RSI14", "Close%-1_x_Close_std21", "vix_z_1y", "days_since_mom_flip", "Close_lag3", "x", "corr_VIX_126", "Close_BollUp21"]
_CLASSIFY = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{f}', {d}, '{b}')" for n, f, d, b in [
    ("Close%-21", "momentum", 21, "H6_21"), ("Close_MA63", "trend", 63, "H22p"), ("rel_volume_10", "momentum", 10, "H6_21"), ("amihud_21", "liquidity", 21, "H6_21"), ("beta_VT_63", "risk", 63, "H22p"), ("Close_RSI14", "momentum", 14, "H6_21"),
    ("Close%-1_x_Close_std21", "interaction", 1, "H1"), ("vix_z_1y", "macro", 1, "H1"), ("days_since_mom_flip", "momentum", "NULL", "H22p"), ("Close_lag3", "momentum", 3, "H2_5"), ("x", "other", "NULL", "H22p"), ("corr_VIX_126", "risk", 126, "H22p"),
    ("Close_BollUp21", "trend", 21, "H6_21"),
]) + ") t(feature, family, days, bucket)"


@query("g01_name_classes", _CLASSIFY)
def name_classes(spark, sf_dir):
    df = spark.createDataFrame([(n,) for n in _NAMES], "feature string")
    return df.select("feature", classify.feature_family(c("feature")).alias("family"), classify.horizon_days(c("feature")).alias("days"), classify.horizon_bucket(classify.horizon_days(c("feature"))).alias("bucket"))

