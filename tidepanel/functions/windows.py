"""Window specifications of a panel, and aggregates with a least number of observations."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ENTITY, TIME = "ticker", "dt"


def history() -> WindowSpec:
    """The rows of an entity in order."""
    return Window.partitionBy(ENTITY).orderBy(TIME)


def section() -> WindowSpec:
    """The cross-section of a date."""
    return Window.partitionBy(TIME)


def whole() -> WindowSpec:
    return Window.partitionBy(ENTITY)


def upto() -> WindowSpec:
    return history().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last(n: int) -> WindowSpec:
    """The last n rows of an entity, the current one included."""
    return history().rowsBetween(1 - n, 0)


def lag(c: Column | str, n: int = 1) -> Column:
    return F.lag(c, n).over(history())


def guarded(value: Column, observed: Column, n: int, least: int | None = None) -> Column:
    """``value`` over the last n rows where ``observed`` has at least ``least`` (n) values there."""
    return F.when(F.count(observed).over(last(n)) >= (n if least is None else least), value.over(last(n)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def mean(c: Column, n: int, least: int | None = None) -> Column:
    return guarded(F.avg(c), c, n, least)


def std(c: Column, n: int, least: int | None = None) -> Column:
    """Sample deviation; null below two observations."""
    return guarded(F.stddev(c), c, n, max(2, n if least is None else least))


def total(c: Column, n: int, least: int | None = None) -> Column:
    return guarded(F.sum(c), c, n, least)


def most(c: Column, n: int, least: int | None = None) -> Column:
    return guarded(F.max(c), c, n, least)


def fewest(c: Column, n: int, least: int | None = None) -> Column:
    return guarded(F.min(c), c, n, least)


def quantile(c: Column, p: float, n: int, least: int | None = None) -> Column:
    return guarded(F.percentile(c, F.lit(p)), c, n, least)


def pair(x: Column, y: Column) -> tuple[Column, Column]:
    """Both columns, null where either is."""
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def cov(x: Column, y: Column, n: int, least: int | None = None) -> Column:
    x, y = pair(x, y)
    return guarded(F.covar_samp(x, y), x, n, max(2, n if least is None else least))


def corr(x: Column, y: Column, n: int, least: int | None = None) -> Column:
    """Pearson correlation over complete pairs; null where either has no variance."""
    x, y = pair(x, y)
    w = last(n)
    value = F.try_divide(F.covar_samp(x, y).over(w), F.stddev(x).over(w) * F.stddev(y).over(w))
    return F.when(F.count(x).over(w) >= max(2, n if least is None else least), value)


def skew(c: Column, n: int) -> Column:
    """Bias-corrected skewness of n rows."""
    return guarded(F.skewness(c), c, n) * F.lit((n * (n - 1)) ** 0.5 / (n - 2))


def kurt(c: Column, n: int) -> Column:
    """Bias-corrected excess kurtosis of n rows."""
    return (guarded(F.kurtosis(c), c, n) * F.lit(n + 1.0) + F.lit(6.0)) * F.lit((n - 1) / ((n - 2) * (n - 3)))


def flag(condition: Column) -> Column:
    """1 or 0; 0 where the condition is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def zscore(c: Column, n: int, least: int | None = None, tiny: float = 1e-8) -> Column:
    return (c - mean(c, n, least)) / (std(c, n, least) + F.lit(tiny))


def percent_rank(c: Column, keys: tuple[str, ...] = (TIME,)) -> Column:
    """Average rank over the number of values of each cross-section; null for null."""
    base = Window.partitionBy(*keys)
    rank = F.rank().over(base.orderBy(c.asc_nulls_last())) + (F.count(c).over(Window.partitionBy(*keys, c)) - 1) / F.lit(2.0)
    return F.when(c.isNotNull(), rank / F.count(c).over(base))


def rounded(c: str, digits: int = 6) -> Column:
    """For comparison across engines: rounded, and no negative zero."""
    return (F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c)
