"""Time series and momentum.

Windows ordered by year run over one row per year (or per year of one category): tables
bounded by the calendar, never by the data.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from jobstrata.config import FLAGS
from jobstrata.functions.metrics import (
    cagr, descending, effective_categories, entropy, hhi, pct, period_name, ratio, rounded,
)
from jobstrata.operators.aggregates import value_counts, yearly_dimension
from jobstrata.plans.quality import adjusted_rate
from jobstrata.plans.registry import section


def centred_mean(column, window, width=3, digits=4):
    """Mean of the row and its neighbours over rows present; null unless all are there."""
    w = window.rowsBetween(-(width // 2), width // 2)
    return F.when(F.count(column).over(w) == width, rounded(F.avg(column).over(w), digits))


@section("ts.yearly_volume")
def yearly_volume(cubes):
    w = Window.orderBy("year")
    previous = F.lag("records").over(w)
    return cubes.cube("year").select("year", F.col("n_ids").alias("records")).select(
        "year", "records",
        rounded(ratio(F.col("records"), previous) - 1).alias("yoy_growth"),
        F.coalesce(F.col("records") - previous, F.lit(0)).alias("yoy_delta"),
        centred_mean("records", w, digits=1).alias("rolling_3y_avg"),
        F.sum("records").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"),
        period_name(F.col("year"), cubes.settings.periods, default="unknown").alias("period"),
    )


@section("ts.diversity_by_year")
def diversity_by_year(cubes):
    cube = cubes.cube("year", "job_category")
    known = F.when(F.col("job_category").isNotNull(), F.col("n_rows"))
    # categories of one year: bounded by the vocabulary
    w = Window.partitionBy("year").orderBy(F.col("known").desc_nulls_last(), F.col("job_category").asc_nulls_last())
    ranked = cube.select("year", "job_category", "n_rows", known.alias("known")).withColumn(
        "rank", F.row_number().over(w)
    )
    top3 = F.sum(F.when(F.col("rank") <= 3, F.col("known")))
    return ranked.groupBy("year").agg(
        F.sum("n_rows").alias("records"), hhi(F.col("known")).alias("category_hhi"),
        entropy(F.col("known")).alias("category_entropy"), pct(top3, F.sum("known")).alias("top3_share"),
    ).withColumn("effective_categories", effective_categories(F.col("category_hhi")))


@section("ts.category_by_year")
def category_by_year(cubes):
    return yearly_dimension(cubes.cube("year", "job_category"), "job_category")


@section("ts.seniority_by_year")
def seniority_by_year(cubes):
    return yearly_dimension(cubes.cube("year", "seniority"), "seniority")


@section("ts.top_locations_by_year")
def top_locations_by_year(cubes, k=20):
    located = cubes.cube("year", "location_extracted").filter("location_extracted IS NOT NULL")
    top = value_counts(located, "location_extracted").orderBy(*descending("count", "location_extracted")).limit(k)
    return yearly_dimension(located, "location_extracted").join(top, "location_extracted", "left_semi")


@section("ts.geographic_concentration")
def geographic_concentration(cubes):
    s = cubes.settings
    first, second = s.focus_places
    located = cubes.cube("year", "location_extracted").filter("location_extracted IS NOT NULL")

    def at(place):
        return F.sum(F.when(F.col("location_extracted") == place, F.col("n_rows")).otherwise(0))

    sums = located.groupBy("year").agg(F.sum("n_rows").alias("n_located"), at(first).alias("a"), at(second).alias("b"))
    n, a, b = F.col("n_located"), F.col("a"), F.col("b")
    return sums.filter(n >= s.min_located_per_year).select(
        "year", "n_located", pct(a, n).alias("first_place_share"), pct(b, n).alias("second_place_share"),
        pct(a + b, n).alias("combined_share"), rounded(ratio(a, b), 2).alias("place_ratio"),
    )


@section("ts.flags_by_year")
def flags_by_year(cubes):
    cube = cubes.cube("year")
    counted = cube.select("year", F.col("n_ids").alias("total"), *[F.col(f"n_{f}").alias(f) for f in FLAGS])
    return counted.select(
        "*", *[rounded(ratio(F.col(f), F.col("total"))).alias(f"rate_{f}_raw") for f in FLAGS],
        adjusted_rate(cubes).alias("rate_gender_marker_adjusted"), F.lit(True).alias("remote_hint_suppressed"),
    )


# --- momentum -----------------------------------------------------------------------

def long_run(cubes):
    by_year = category_by_year(cubes)
    bounds = cubes.cube("year", "job_category").agg(
        F.struct(F.min("year").alias("first"), F.max("year").alias("last"))).scalar()
    marked = by_year.withColumn("b", bounds).withColumns({"first_year": F.col("b.first"), "last_year": F.col("b.last")})

    def at(edge, value):
        return F.sum(F.when(F.col("year") == F.col(edge), F.col(value)).otherwise(0))

    per_category = marked.groupBy("job_category", "first_year", "last_year").agg(
        at("first_year", "count").alias("first_count"), at("last_year", "count").alias("last_count"),
        rounded(at("first_year", "share")).alias("first_share"), rounded(at("last_year", "share")).alias("last_share"),
        F.max_by("year", F.struct(F.col("count"), -F.col("year"))).alias("peak_year"),
        F.max("count").alias("peak_count"),
    )
    return per_category.select(
        "job_category", "first_year", "last_year", "first_count", "last_count",
        (F.col("last_count") - F.col("first_count")).alias("count_delta"), "first_share", "last_share",
        rounded(F.col("last_share") - F.col("first_share")).alias("share_delta"),
        cagr(F.col("first_count"), F.col("last_count"), F.col("last_year") - F.col("first_year")).alias("count_cagr"),
        "peak_year", "peak_count",
    )


@section("momentum.long_run")
def momentum_long_run(cubes):
    return long_run(cubes)


def _edge(cubes, frame, column, rising):
    order = F.col(column).desc() if rising else F.col(column).asc()
    return frame.orderBy(order, "job_category").limit(cubes.settings.movers)


@section("momentum.share_risers")
def share_risers(cubes):
    return _edge(cubes, long_run(cubes), "share_delta", True)


@section("momentum.share_fallers")
def share_fallers(cubes):
    rest = long_run(cubes).join(share_risers(cubes).select("job_category"), "job_category", "left_anti")
    return _edge(cubes, rest, "share_delta", False)


@section("momentum.cagr_risers")
def cagr_risers(cubes):
    return _edge(cubes, long_run(cubes).filter("count_cagr IS NOT NULL"), "count_cagr", True)


@section("momentum.cagr_fallers")
def cagr_fallers(cubes):
    growing = long_run(cubes).filter("count_cagr IS NOT NULL")
    rest = growing.join(cagr_risers(cubes).select("job_category"), "job_category", "left_anti")
    return _edge(cubes, rest, "count_cagr", False)


@section("momentum.rolling_share")
def rolling_share(cubes):
    w = Window.partitionBy("job_category").orderBy("year")
    return category_by_year(cubes).withColumn("rolling_3y_share", centred_mean("share", w))
