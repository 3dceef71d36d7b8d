"""Distributions, cross tables, internship, gender-marker, vulnerability and work-model sections."""

from pyspark.sql import functions as F

from jobstrata.config import FLAGS
from jobstrata.functions.metrics import descending, pct, period_name, ratio, rounded
from jobstrata.functions.text import word_count
from jobstrata.operators.aggregates import (
    UNKNOWN, add_share, describe_counts, flag_profile, flag_totals, not_null, pearson_matrix, rate_by,
    total_of, value_counts, value_counts_share,
)
from jobstrata.plans.quality import label_columns, source_table
from jobstrata.plans.registry import section


# --- distributions ------------------------------------------------------------------

@section("dist.category")
def dist_category(cubes):
    return value_counts_share(cubes.cube("job_category"), "job_category")


@section("dist.seniority")
def dist_seniority(cubes):
    return value_counts_share(cubes.cube("seniority"), "seniority")


@section("dist.flags")
def dist_flags(cubes):
    return flag_totals(cubes.cube("year")).select(
        F.col("flag").alias("metric"), F.col("positives").alias("count"),
        pct(F.col("positives"), F.col("total")).alias("rate"),
        (F.col("positives") >= cubes.settings.min_flag_positives).alias("reliable"),
    )


def _title_stats(cubes, measure):
    titles = cubes.rows("title").filter("title IS NOT NULL")
    return describe_counts(titles.groupBy(measure.alias("v")).agg(F.count(F.lit(1)).alias("n")), "v")


@section("dist.title_char_length")
def dist_title_char_length(cubes):
    return _title_stats(cubes, F.length("title"))


@section("dist.title_word_count")
def dist_title_word_count(cubes):
    return _title_stats(cubes, word_count(F.col("title")))


# --- cross tables ---------------------------------------------------------------------

def _pair_counts(cube, a, b):
    return cube.filter(not_null(a, b)).groupBy(a, b).agg(F.sum("n_rows").alias("count"))


@section("xt.category_x_seniority")
def category_x_seniority(cubes):
    return add_share(_pair_counts(cubes.cube("job_category", "seniority"), "job_category", "seniority"),
                     "job_category")


@section("xt.category_x_location_top10")
def category_x_location(cubes, k=10):
    cube = cubes.cube("job_category", "location_extracted")
    top = value_counts(cube, "location_extracted").orderBy(*descending("count", "location_extracted")).limit(k)
    pairs = _pair_counts(cube, "job_category", "location_extracted").join(top, "location_extracted", "left_semi")
    return add_share(pairs, "location_extracted")


def period_distribution(cubes, column):
    """Share of each value (missing as "Unknown") in each period."""
    periods = cubes.settings.periods
    in_period = cubes.cube("year", column).withColumn("period", period_name(F.col("year"), periods)).filter(
        "period IS NOT NULL"
    )
    counts = in_period.groupBy("period", F.coalesce(F.col(column), F.lit(UNKNOWN)).alias(column)).agg(
        F.sum("n_rows").alias("count")
    )
    return add_share(counts, "period").select("*", *label_columns(F.col("period"), periods))


def period_comparison(cubes, column):
    """One row per value: share per period, change and multiplier between first and last."""
    periods = cubes.settings.periods
    first, last = periods[0].name, periods[-1].name

    def share_in(p):
        return F.sum(F.when(F.col("period") == p, F.col("share")).otherwise(0.0)).alias(p)

    wide = period_distribution(cubes, column).groupBy(column).agg(*[share_in(p.name) for p in periods])
    return wide.select(
        "*", rounded(F.col(last) - F.col(first)).alias("share_delta"),
        rounded(ratio(F.col(last), F.col(first)), 2).alias("relative_multiplier"),
    )


def _movers(cubes, column, rising):
    order = F.col("share_delta").desc() if rising else F.col("share_delta").asc()
    return period_comparison(cubes, column).orderBy(order, column).limit(cubes.settings.movers)


for _prefix, _column in (("category", "job_category"), ("seniority", "seniority")):
    section(f"xt.{_prefix}_period_distribution")(lambda c, col=_column: period_distribution(c, col))
    section(f"xt.{_prefix}_share_gainers")(lambda c, col=_column: _movers(c, col, True))
    section(f"xt.{_prefix}_share_losers")(lambda c, col=_column: _movers(c, col, False))


@section("xt.seniority_x_flags")
def seniority_x_flags(cubes):
    return flag_profile(cubes.cube("seniority"), "seniority")


@section("xt.category_x_flags")
def category_x_flags(cubes):
    return flag_profile(cubes.cube("job_category"), "job_category")


@section("xt.flag_correlations")
def flag_correlations(cubes):
    s = cubes.settings
    used = [f for f in FLAGS if f != s.suppressed_flag]
    return pearson_matrix(cubes.flag_cube(), used, s.min_flag_positives)


# --- internship -------------------------------------------------------------------------

def _internship(cubes):
    cube = cubes.cube("job_category")
    interns, ads = total_of(cube, "n_is_internship"), total_of(cube)
    raw = rate_by(cube, "job_category", "is_internship", "intern_count", "raw_rate", digits=None)
    return raw.select(
        "job_category", "total", "intern_count", "raw_rate", rounded(F.col("raw_rate")).alias("intern_rate"),
        rounded(ratio(F.col("intern_count"), interns)).alias("share_of_all_interns"),
        interns.alias("interns"), ads.alias("ads"),
    )


@section("internship.by_category")
def internship_by_category(cubes):
    market = ratio(F.col("interns"), F.col("ads"))
    return _internship(cubes).select(
        "job_category", "total", "intern_count", "intern_rate", "share_of_all_interns",
        rounded(F.try_divide(F.col("intern_rate"), market), 2).alias("vs_market_avg"),
    )


@section("internship.by_year")
def internship_by_year(cubes):
    return rate_by(cubes.cube("year"), "year", "is_internship")


@section("internship.by_category_year")
def internship_by_category_year(cubes):
    return rate_by(cubes.cube("year", "job_category"), ["year", "job_category"], "is_internship",
                   "intern_count", "intern_rate")


@section("internship.summary")
def internship_summary(cubes, k=2):
    top = _internship(cubes).orderBy(F.col("raw_rate").desc(), "job_category").limit(k)
    held = top.agg(
        rounded(F.sum("share_of_all_interns")).alias("top2_category_intern_share"),
        F.sum("total").alias("top_total"),
    )
    cube = cubes.cube("job_category")
    interns, ads = total_of(cube, "n_is_internship"), total_of(cube)
    return held.select(
        interns.alias("total_internship_ads"), pct(interns, ads).alias("market_intern_rate"),
        "top2_category_intern_share", pct(F.col("top_total"), ads).alias("top2_volume_share"),
    )


# --- gender marker ------------------------------------------------------------------------

@section("gender.by_category")
def gender_by_category(cubes):
    return rate_by(cubes.cube("job_category"), "job_category", "gender_marker", "gm_count", "gm_rate")


@section("gender.decomposition")
def gender_decomposition(cubes):
    """Yearly rate against what the year's source mix alone would give."""
    mix = cubes.cube("year", "source")
    rates = source_table(cubes, ("gender_marker",)).select(
        "source", rounded(F.col("rate_gender_marker"), 6).alias("rate"))
    known = F.when(F.col("source").isNotNull(), F.col("n_rows"))
    per_year = mix.join(rates, "source", "left").groupBy("year").agg(
        F.sum("n_rows").alias("n"), ratio(F.sum("n_gender_marker"), F.sum("n_rows")).alias("raw"),
        ratio(F.sum(known * F.col("rate")), F.sum(known)).alias("expected"),
    )
    raw, expected = F.col("raw"), F.coalesce(F.col("expected"), F.lit(0.0))
    return per_year.select(
        "year", "n", rounded(raw).alias("gm_rate_raw"), rounded(expected).alias("gm_rate_expected_from_source_mix"),
        rounded(raw - expected).alias("residual_true_signal"),
        rounded(F.try_divide(F.abs(expected), F.abs(raw)), 3).alias("pct_explained_by_source_mix"),
    )


# --- vulnerability --------------------------------------------------------------------------

@section("vulnerability")
def vulnerability(cubes):
    s = cubes.settings
    intern_w, gender_w, senior_w = s.vulnerability_weights
    n = F.sum("n_rows")
    senior = F.sum(F.when(F.col("seniority").isin(list(s.senior_levels)), F.col("n_rows")).otherwise(0))
    profile = cubes.cube("job_category", "seniority").filter("job_category IS NOT NULL").groupBy("job_category").agg(
        F.sum("n_ids").alias("total"), rounded(ratio(F.sum("n_is_internship"), n)).alias("intern_rate"),
        rounded(ratio(F.sum("n_gender_marker"), n)).alias("gm_rate"), rounded(ratio(senior, n)).alias("senior_rate"),
    )
    index = F.col("intern_rate") * intern_w + F.col("gm_rate") * gender_w + F.col("senior_rate") * senior_w
    return profile.withColumn("vulnerability_index", rounded(index))


# --- work model -------------------------------------------------------------------------------

def _per_flag(cubes, key):
    """Rates of every reliable flag by one key: a single aggregation, then one row per flag."""
    keys = (key,) if key == "year" else ("year", key)
    cube = cubes.cube(*keys)
    sums = cube.groupBy(key).agg(F.sum("n_ids").alias("total"), F.sum("n_rows").alias("rows"),
                                 *[F.sum(f"n_{f}").alias(f) for f in FLAGS])
    long = sums.filter(F.col(key).isNotNull()).select(
        key, "total", "rows",
        F.inline(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("count")) for f in FLAGS])),
    )
    reliable = flag_totals(cube).filter(F.col("positives") >= cubes.settings.min_flag_positives)
    return long.join(reliable, "flag", "left_semi").select(
        "flag", key, "total", "count", rounded(ratio(F.col("count"), F.col("rows"))).alias("rate")
    )


@section("work_model.by_year")
def work_model_by_year(cubes):
    return _per_flag(cubes, "year")


@section("work_model.by_category")
def work_model_by_category(cubes):
    return _per_flag(cubes, "job_category")


@section("work_model.by_seniority")
def work_model_by_seniority(cubes):
    return _per_flag(cubes, "seniority")


@section("work_model.suppressed")
def work_model_suppressed(cubes):
    low = F.col("positives") < cubes.settings.min_flag_positives
    return flag_totals(cubes.cube("year")).filter(low).select(
        "flag", "positives", F.lit(True).alias("suppressed"),
        F.lit(cubes.settings.min_flag_positives).alias("minimum"),
    )
