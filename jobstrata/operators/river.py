"""Category-by-year shapes for charts, from counts by year and category.

All inputs are report tables of (year, job_category, count, share): their size is years
times categories, whatever the number of postings.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "job_category"


def category_order(by_year: DataFrame) -> DataFrame:
    """Categories with total and rank, largest first."""
    totals = by_year.groupBy(KEY).agg(F.sum("count").alias("total"))
    w = Window.orderBy(F.col("total").desc(), KEY)
    return totals.withColumn("rank", F.row_number().over(w))


def river_long(by_year: DataFrame, mode: str = "absolute") -> DataFrame:
    """Every category in every known year, zero-filled."""
    if mode not in ("absolute", "share"):
        raise ValueError(f"unknown mode: {mode}")
    value = F.col("count").cast("double") if mode == "absolute" else F.col("share")
    years = by_year.agg(F.array_sort(F.collect_set("year"))).scalar()
    grid = category_order(by_year).select(KEY, "rank", F.explode(years).alias("year"))
    held = by_year.select(KEY, "year", value.alias("_v"))
    return grid.join(held, [KEY, "year"], "left").select(
        "year", KEY, "rank", F.coalesce("_v", F.lit(0.0)).alias("value"))


def river_matrix(by_year: DataFrame, years, mode: str = "absolute") -> DataFrame:
    """One row per category in rank order, one column per listed year."""
    long = river_long(by_year, mode)
    return long.groupBy(KEY, "rank").pivot("year", list(years)).agg(F.sum("value")).fillna(0.0)


def river_stack(by_year: DataFrame, mode: str = "absolute") -> DataFrame:
    """Lower and upper edge of each category's band per year; other modes scale a year to 1."""
    long = river_long(by_year, "absolute" if mode == "absolute" else "share")
    below = Window.partitionBy("year").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("value").over(Window.partitionBy("year"))
    upper = F.sum("value").over(below)
    scale = F.lit(1.0) if mode == "absolute" else F.when(whole > 0, whole).otherwise(1.0)
    return long.withColumns({
        "upper": F.bround(upper / scale, 6), "lower": F.bround((upper - F.col("value")) / scale, 6),
    }).select("year", KEY, "lower", "upper")


def ranking(by_year: DataFrame, year: int, k: int = 10) -> DataFrame:
    return by_year.filter(F.col("year") == year).orderBy(F.col("count").desc(), KEY).limit(k).select(
        KEY, "count", "share")


def dominant(by_year: DataFrame, year: int) -> DataFrame:
    return ranking(by_year, year, 1).select(KEY)


def category_totals(by_year: DataFrame, k: int = 6) -> DataFrame:
    return by_year.groupBy(KEY).agg(F.sum("count").alias("total")).orderBy(F.col("total").desc(), KEY).limit(k)
