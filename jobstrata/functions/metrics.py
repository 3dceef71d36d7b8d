"""Column-level building blocks of the report.

Rounding of the report is half-even, that of search shares half-up; aggregates are one-pass and mergeable so Spark can
combine them on the map side before any shuffle.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(col: Column, digits: int = 4) -> Column:
    return F.bround(col, digits)


def half_up(col: Column, digits: int) -> Column:
    """Half away from zero of the scaled double, as SQL rounds doubles; ``F.round`` rounds the shortest decimal that stands for one."""
    return F.round(col * F.lit(10.0**digits)) / F.lit(10.0**digits)


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def pct(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded ratio, 0.0 when the whole is zero or missing."""
    return F.coalesce(rounded(ratio(part, whole), digits), F.lit(0.0))


def cagr(first: Column, last: Column, periods: Column) -> Column:
    ok = (first > 0) & (last > 0) & (periods > 0)
    growth = F.pow(ratio(last, first), F.lit(1.0) / periods.cast("double")) - 1
    return F.when(ok, rounded(growth))


def hhi(count: Column) -> Column:
    """Aggregate: sum of squared shares of integer counts."""
    c = count.cast("double")
    return F.coalesce(rounded(F.try_divide(F.sum(c * c), F.pow(F.sum(c), F.lit(2.0)))), F.lit(0.0))


def effective_categories(rounded_hhi: Column) -> Column:
    return rounded(F.try_divide(F.lit(1.0), F.nullif(rounded_hhi, F.lit(0.0))), 2)


def entropy(count: Column, epsilon: float = 1e-12) -> Column:
    """Aggregate: Shannon entropy in bits of integer counts.

    -sum(p*log2(p+e)) expanded to first order in e, so no per-group total is needed first.
    """
    c = count.cast("double")
    positive = F.when(c > 0, c)
    total = F.sum(c)
    log_sum = F.sum(positive * F.log2(positive))
    correction = F.count(positive) * F.lit(epsilon) / F.log(F.lit(2.0))
    return F.coalesce(rounded(F.log2(total) - F.try_divide(log_sum, total) - correction), F.lit(0.0))


def period_name(year: Column, periods, attribute="name", default=None) -> Column:
    """Label of the first inclusive year range holding ``year``; a ``when`` chain, no join."""
    out = None
    for p in periods:
        hit, value = year.between(p.start, p.end), F.lit(getattr(p, attribute))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.lit(default))


def finite(col: Column) -> Column:
    """NaN and infinities to null, for JSON output."""
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)


def descending(count: str, *keys: str) -> list:
    """Order by count descending; ties by key ascending, nulls last."""
    return [F.col(count).desc(), *[F.col(k).asc_nulls_last() for k in keys]]
