"""Column expressions: null-safe arithmetic, ranks, false-discovery rates, standard scores, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    """NaN and infinities become null; Spark's aggregates and comparisons would take them for values."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def effective(value: Column | str = "abundance", dropped: Column | str = "dropped_by_qc") -> Column:
    """The value where quality control kept the cell and the value is finite. Being below the detection limit is no reason to drop it."""
    dropped = F.col(dropped) if isinstance(dropped, str) else dropped
    return F.when(~F.coalesce(dropped, F.lit(False)), finite(value))


def average_rank(value: str, *by: str) -> Column:
    """Ranks from 1 within `by`, ties sharing their mean. The value must not be null or NaN."""
    within = W.partitionBy(*by)
    return F.rank().over(within.orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


def bh_fdr(p: str, by: list[str], key: list[str]) -> Column:
    """Benjamini-Hochberg q-values within families; a null p is no test and stays null."""
    family = W.partitionBy(*by)
    m = F.count(p).over(family)
    place = F.row_number().over(family.orderBy(F.col(p).asc_nulls_last(), *key))
    down = family.orderBy(F.col(p).desc_nulls_first(), *(F.col(k).desc() for k in key)).rowsBetween(W.unboundedPreceding, 0)
    return F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(F.col(p) * m / place).over(down)))


def zscore(value: Column | str, *by: str) -> Column:
    """(x - mean) / sd with n - 1; null where the values are constant or single."""
    value = F.col(value) if isinstance(value, str) else value
    w = W.partitionBy(*by)
    sd = F.stddev_samp(value).over(w)
    return (value - F.avg(value).over(w)) / F.when(sd > 0, sd)


def pearson_agg(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate: null if either is constant, held within -1 and 1."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sa > 1e-12) & (sb > 1e-12), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.covar_pop(a, b), sa * sb))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def nearest_quantile(values: Column, q: float) -> Column:
    """The element at index round((n - 1) q) of an array, half up, after sorting."""
    s = F.array_sort(values)
    return F.element_at(s, (F.floor((F.size(s) - 1) * F.lit(q) + 0.5) + 1).cast("int"))


def trimmed_mean(values: Column, share: float = 0.2) -> Column:
    """Mean without floor(n share) values off either end; null for an empty array."""
    n = F.size(values)
    cut = F.floor(n * F.lit(share)).cast("int")
    kept = F.slice(F.array_sort(values), cut + 1, F.greatest(n - 2 * cut, F.lit(0)))
    return F.when(n > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def sign(c: Column, zero: int = 0) -> Column:
    """The sign of a number; operators differ in how zero counts, so say it."""
    return F.when(c > 0, 1).when(c < 0, -1).when(c == 0, zero)


def top_abs(df: DataFrame, value: str, n: int, by: list[str], key: str) -> DataFrame:
    """The n rows of largest absolute value in each group, ties by key."""
    order = W.partitionBy(*by).orderBy(F.abs(F.col(value)).desc(), key)
    return df.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_place")
