"""Market structure, places, companies and the per-period deep dive."""

from pyspark.sql import functions as F

from jobstrata.config import FLAGS
from jobstrata.functions.metrics import (
    descending, effective_categories, entropy, hhi, pct, period_name, ratio, rounded,
)
from jobstrata.operators.aggregates import (
    add_share, flag_profile, not_null, top_by_period, top_per_group, value_counts, value_counts_share,
    yearly_dimension,
)
from jobstrata.plans.quality import clean_companies, period_table
from jobstrata.plans.registry import section
from jobstrata.plans.trends import category_by_year

PLACE, COMPANY, CATEGORY = "location_extracted", "company_extracted", "job_category"


# --- market structure -----------------------------------------------------------------

@section("market.category_hhi_by_year")
def category_hhi_by_year(cubes):
    """From rounded shares with "Unknown" as a category, unlike diversity_by_year."""
    by_year = category_by_year(cubes)
    top3 = top_per_group(by_year, "year", descending("count", CATEGORY), 3).groupBy("year").agg(
        rounded(F.sum("share")).alias("top3_share")
    )
    h = F.sum(F.col("share") * F.col("share"))
    return by_year.groupBy("year").agg(
        rounded(h).alias("hhi"), rounded(F.try_divide(F.lit(1.0), h), 2).alias("effective_categories"),
        entropy(F.col("count")).alias("category_entropy"),
        F.sum(F.when(F.col("count") > 0, 1).otherwise(0)).alias("n_categories_active"),
    ).join(top3, "year")


@section("market.location_hhi_by_year")
def location_hhi_by_year(cubes):
    by_year = yearly_dimension(located(cubes, "year"), PLACE)
    return by_year.groupBy("year").agg(
        rounded(F.sum(F.col("share") * F.col("share"))).alias("location_hhi"),
        F.count(F.lit(1)).alias("unique_locations"),
    ).filter(F.col("unique_locations") >= cubes.settings.min_places_per_year)


@section("market.top_categories_by_period")
def top_categories_by_period(cubes, k=3):
    top = top_by_period(cubes.cube("year", CATEGORY), CATEGORY, cubes.settings.periods, k, "non_null")
    return top.select(CATEGORY, "share", "period", "period_label")


# --- places -------------------------------------------------------------------------------

def located(cubes, *keys):
    return cubes.cube(*keys, PLACE).filter(F.col(PLACE).isNotNull())


@section("loc.coverage")
def location_coverage(cubes):
    by_place = cubes.cube(PLACE)
    present = F.sum(F.when(F.col(PLACE).isNotNull(), F.col("n_rows")).otherwise(0))
    total = F.sum("n_rows")
    return by_place.agg(
        present.alias("records_with_location"), pct(present, total).alias("location_coverage_rate"),
        F.count(PLACE).alias("unique_locations"), pct(total - present, total).alias("share_missing"),
    )


@section("loc.top_locations")
def top_locations(cubes, k=30):
    return value_counts_share(located(cubes), PLACE, top_n=k)


@section("loc.by_period")
def locations_by_period(cubes, k=10):
    return top_by_period(located(cubes, "year"), PLACE, cubes.settings.periods, k)


@section("loc.category_mix")
def category_mix_by_location(cubes, k=5):
    pairs = located(cubes, CATEGORY).filter(not_null(CATEGORY)).groupBy(PLACE, CATEGORY).agg(
        F.sum("n_rows").alias("count")
    )
    return top_per_group(add_share(pairs, PLACE), PLACE, descending("count", CATEGORY), k)


@section("loc.flags_min20")
def flags_by_location(cubes):
    return flag_profile(located(cubes), PLACE).filter(F.col("total") >= cubes.settings.min_ads_per_place)


@section("loc.focus_yearly")
def focus_places_yearly(cubes):
    return located(cubes, "year").filter(F.col(PLACE).isin(list(cubes.settings.focus_places))).select(
        "year", PLACE, F.col("n_rows").alias("count")
    )


# --- companies ----------------------------------------------------------------------------

@section("company.coverage")
def company_coverage(cubes):
    named = cubes.companies()
    noisy = F.lower(COMPANY).isin(list(cubes.settings.place_noise))
    has = F.col(COMPANY).isNotNull()
    n = F.col("n_rows")
    raw, clean = F.sum(F.when(has, n).otherwise(0)), F.sum(F.when(has & ~noisy, n).otherwise(0))
    return named.agg(
        raw.alias("records_with_company_raw"), clean.alias("records_with_company_clean"),
        pct(clean, F.sum(n)).alias("company_coverage_rate_clean"),
        F.count_distinct(F.when(has & ~noisy, F.col(COMPANY))).alias("unique_companies_clean"),
        (raw - clean).alias("geo_noise_removed"),
    )


@section("company.top")
def top_companies(cubes, k=40):
    return value_counts_share(clean_companies(cubes), COMPANY, top_n=k)


@section("company.profiles")
def company_profiles(cubes, k=40):
    clean = clean_companies(cubes)
    top = value_counts(clean, COMPANY).orderBy(*descending("count", COMPANY)).limit(k)
    n = F.sum("n_rows")
    # the counted frame has one row per company and year, so counting rows counts years
    return clean.join(top, COMPANY, "left_semi").groupBy(COMPANY).agg(
        F.sum("n_ids").alias("total_ads"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count(F.lit(1)).alias("active_years"), rounded(ratio(F.sum("n_gender_marker"), n)).alias("gender_rate"),
        rounded(ratio(F.sum("n_is_internship"), n)).alias("internship_rate"),
        rounded(ratio(F.sum("n_part_time_hint"), n)).alias("part_time_rate"),
    )


@section("company.hhi_by_year")
def company_hhi_by_year(cubes):
    return clean_companies(cubes).groupBy("year").agg(
        hhi(F.col("n_rows")).alias("company_hhi"), F.count(F.lit(1)).alias("unique_companies_active"),
    ).filter(F.col("unique_companies_active") >= cubes.settings.min_companies_per_year)


# --- deep dive ------------------------------------------------------------------------------

def _in_period(cubes, frame):
    return frame.withColumn("period", period_name(F.col("year"), cubes.settings.periods)).filter("period IS NOT NULL")


@section("deep_dive.summary")
def deep_dive_summary(cubes):
    """Per configured period: volume, concentration, sparse years and flag rates."""
    s = cubes.settings
    cube = _in_period(cubes, cubes.cube("year", CATEGORY))
    years = cube.groupBy("period", "year").agg(F.sum("n_rows").alias("n")).groupBy("period").agg(
        F.array_sort(F.collect_list(F.when(F.col("n") < s.sparse_year, F.col("year")))).alias("sparse_years")
    )
    categories = cube.filter(not_null(CATEGORY)).groupBy("period", CATEGORY).agg(F.sum("n_rows").alias("n"))
    spread = categories.groupBy("period").agg(hhi(F.col("n")).alias("hhi"))
    sums = cube.groupBy("period").agg(
        F.sum("n_rows").alias("n"), *[pct(F.sum(f"n_{f}"), F.sum("n_rows")).alias(f"rate_{f}") for f in FLAGS]
    )
    out = period_table(cube, s.periods).join(sums, "period", "left").join(spread, "period", "left").join(
        years, "period", "left"
    )
    n = F.coalesce("n", F.lit(0))
    h = F.coalesce("hhi", F.lit(0.0))
    return out.select(
        "period", "period_label", "start_year", "end_year", n.alias("total_ads"), h.alias("hhi"),
        effective_categories(h).alias("effective_categories"), (n < s.sparse_period).alias("is_sparse_period"),
        F.coalesce("sparse_years", F.array().cast("array<int>")).alias("sparse_years"),
        *[F.coalesce(f"rate_{f}", F.lit(0.0)).alias(f"rate_{f}") for f in FLAGS],
    )


def _top_share_of_period(cubes, frame, column, k):
    """Top values of a period as a share of all its rows, whatever the frame filtered out."""
    totals = _in_period(cubes, cubes.cube("year")).groupBy("period").agg(F.sum("n_rows").alias("_n"))
    counts = _in_period(cubes, frame).filter(F.col(column).isNotNull()).groupBy("period", column).agg(
        F.sum("n_rows").alias("count")
    )
    top = top_per_group(counts, "period", descending("count", column), k)
    return top.join(totals, "period").withColumn("share", pct(F.col("count"), F.col("_n"))).drop("_n")


@section("deep_dive.top_categories")
def deep_dive_categories(cubes, k=5):
    return _top_share_of_period(cubes, cubes.cube("year", CATEGORY), CATEGORY, k)


@section("deep_dive.top_locations")
def deep_dive_locations(cubes, k=5):
    return _top_share_of_period(cubes, cubes.cube("year", PLACE), PLACE, k)


@section("deep_dive.top_companies")
def deep_dive_companies(cubes, k=5):
    return _top_share_of_period(cubes, clean_companies(cubes), COMPANY, k)


@section("deep_dive.top_keywords")
def deep_dive_keywords(cubes, k=10):
    top = _top_share_of_period(cubes, cubes.token_counts().withColumnRenamed("token", "keyword"), "keyword", k)
    return top.withColumnRenamed("share", "share_of_ads")


@section("deep_dive.seniority")
def deep_dive_seniority(cubes):
    counts = _in_period(cubes, cubes.cube("year", "seniority")).filter(not_null("seniority")).groupBy(
        "period", "seniority"
    ).agg(F.sum("n_rows").alias("count"))
    return add_share(counts, "period").drop("count")
