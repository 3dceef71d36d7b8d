"""Source weights, archive confidence, data quality and headline figures."""

from pyspark.sql import functions as F

from jobstrata.config import FLAGS
from jobstrata.functions.metrics import pct, period_name, ratio, rounded
from jobstrata.operators.aggregates import (
    coverage, duplicates, flag_totals, value_counts,
)
from jobstrata.plans.registry import section


def source_table(cubes, flags=FLAGS):
    """Per source: baseline weight and the rate of each flag.

    The adjusted flag's rate is rounded to 6 digits, the others are not.  One aggregation
    serves all flags, since weights and rates share the key.
    """
    s = cubes.settings
    lo, hi = s.baseline_years
    base_rows = F.when(F.col("year").between(lo, hi), F.col("n_rows")).otherwise(0)
    by_year = cubes.cube("year", "source").filter("source IS NOT NULL")
    per_source = by_year.groupBy("source").agg(
        F.sum(base_rows).alias("n_base"), F.sum("n_rows").alias("n"),
        *[F.sum(f"n_{f}").alias(f) for f in flags],
    )

    def rate(f):
        r = ratio(F.col(f), F.col("n"))
        return (rounded(r, 6) if f == s.adjusted_flag else r).alias(f"rate_{f}")

    return per_source.select(
        "source", "n_base", pct(F.col("n_base"), by_year.agg(F.sum(base_rows)).scalar(), 6).alias("weight"),
        *[rate(f) for f in flags],
    )


@section("source_weights")
def source_weights(cubes):
    return source_table(cubes, ()).filter("n_base > 0").select("source", "weight")


@section("source_rates")
def source_rates(cubes):
    f = cubes.settings.adjusted_flag
    return source_table(cubes, (f,)).select("source", F.col(f"rate_{f}").alias("rate"))


def _adjusted(flag):
    return F.coalesce(rounded(F.sum(F.col("weight") * F.col(f"rate_{flag}"))), F.lit(0.0))


@section("composition_adjusted_rate")
def composition_adjusted_rate(cubes):
    """Rate of every flag if the source mix stayed at the baseline."""
    sums = source_table(cubes).agg(*[_adjusted(f).alias(f) for f in FLAGS])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("flag"), F.col(f).alias("adjusted_rate")) for f in FLAGS])))


def adjusted_rate(cubes):
    """Scalar subquery of the adjusted rate of the configured flag."""
    f = cubes.settings.adjusted_flag
    return source_table(cubes, (f,)).agg(_adjusted(f)).scalar()


@section("archive_confidence")
def archive_confidence(cubes):
    s = cubes.settings
    by_source = cubes.cube("year", "source")
    known = F.when(F.col("source").isNotNull(), F.col("n_rows").cast("double"))
    sources = by_source.select("source").distinct().agg(F.count(F.lit(1))).scalar()
    per_year = by_source.groupBy("year").agg(
        F.sum("n_rows").alias("n_ads"), F.count("source").alias("n_sources"),
        F.sum(known).alias("known"), F.sum(known * F.log2(known)).alias("log_sum"),
    )
    spread = F.log2(F.col("known")) - F.col("log_sum") / F.col("known")
    volume = 1 / (1 + F.exp(F.lit(-s.volume_slope) * (F.col("n_ads") - F.lit(s.volume_midpoint))))
    scored = per_year.select(
        "year", "n_ads", "n_sources",
        rounded(volume, 3).alias("volume_score"),
        F.when(F.col("n_sources") > 1, rounded(spread / F.log2(F.col("n_sources").cast("double")), 3))
        .otherwise(0.0).alias("source_entropy_score"),
        pct(F.col("n_sources"), sources, 3).alias("source_count_score"),
    ).withColumn(
        "confidence",
        rounded((F.col("volume_score") + F.col("source_entropy_score") + F.col("source_count_score")) / 3, 3),
    )
    return scored.withColumn("is_sparse", F.col("n_ads") < s.sparse_year).withColumn(
        "reliability_tier",
        F.when(F.col("confidence") >= 0.65, "high").when(F.col("confidence") >= 0.40, "medium").otherwise("low"),
    )


@section("dq.coverage")
def dq_coverage(cubes):
    return coverage(cubes.rows("record_id", "year", "title", "source", *FLAGS, "job_category", "seniority",
                               "location_extracted", "company_extracted", "date_archived"))


@section("dq.duplicates")
def dq_duplicates(cubes):
    return duplicates(cubes.rows("record_id", "title", "year"))


@section("dq.snapshot_dates")
def dq_snapshot_dates(cubes):
    return cubes.rows("date_archived").agg(
        F.min("date_archived").cast("string").alias("first_date"),
        F.max("date_archived").cast("string").alias("last_date"),
    )


@section("dq.year_quality")
def dq_year_quality(cubes):
    sparse = F.col("records") < cubes.settings.sparse_year
    return cubes.cube("year").select("year", F.col("n_rows").alias("records")).select(
        "year", "records", sparse.alias("is_sparse"),
        F.when(sparse, "sparse_archive").otherwise("ok").alias("flag"),
    )


@section("dq.sources_by_year")
def dq_sources_by_year(cubes):
    return cubes.cube("year", "source").groupBy("year").agg(F.count("source").alias("n_sources"))


@section("dq.flag_reliability")
def dq_flag_reliability(cubes):
    s = cubes.settings
    reliable = F.col("positives") >= s.min_flag_positives
    return flag_totals(cubes.cube("year")).select(
        "flag", "positives", pct(F.col("positives"), F.col("total")).alias("rate"), reliable.alias("reliable"),
        F.when(~reliable, F.lit("suppressed: too few positives"))
        .when(F.col("flag") == s.adjusted_flag, F.lit("cross-sectional use only"))
        .otherwise(F.lit("ok")).alias("note"),
    )


@section("dq.place_names_as_company")
def dq_place_names_as_company(cubes):
    noisy = F.lower("company_extracted").isin(list(cubes.settings.place_noise))
    return value_counts(cubes.companies().filter(noisy), "company_extracted")


def _missing(cubes, finish):
    """Missing shares and the weight of the dominant seniority level; ``finish`` rounds."""
    s = cubes.settings
    n = F.sum("n_rows")

    def share(cond):
        return finish(ratio(F.sum(F.when(cond, F.col("n_rows")).otherwise(0)), n))

    companies = cubes.companies()
    return cubes.cube("seniority", "location_extracted").agg(
        share(F.col("seniority") == s.dominant_seniority).alias("dominant_seniority_rate"),
        share(F.col("location_extracted").isNull()).alias("location_missing_rate"),
        F.sum(f"n_{s.suppressed_flag}").alias("suppressed_flag_positives"),
    ).withColumn(
        "company_missing_rate",
        companies.agg(share(F.col("company_extracted").isNull())).scalar(),
    )


@section("dq.missing_rates")
def dq_missing_rates(cubes):
    return _missing(cubes, lambda x: F.coalesce(rounded(x), F.lit(0.0)))


@section("dq.warnings")
def dq_warnings(cubes):
    """The report's warning texts, filled from the measured rates."""
    s = cubes.settings
    m = _missing(cubes, lambda x: rounded(x * 100, 1).cast("string"))
    percent = F.col

    texts = [
        F.concat(F.lit(f"{s.adjusted_flag}: read the source-adjusted rate; the raw series follows the source mix")),
        F.concat(F.lit(f"{s.suppressed_flag}: only "), F.col("suppressed_flag_positives").cast("string"),
                 F.lit(" positives")),
        F.concat(F.lit("location_extracted missing in "), percent("location_missing_rate"), F.lit("% of records")),
        F.concat(F.lit("company_extracted missing in "), percent("company_missing_rate"), F.lit("% of records")),
        F.concat(F.lit(f"seniority={s.dominant_seniority} is "), percent("dominant_seniority_rate"),
                 F.lit("% of records")),
    ]
    return m.select(F.posexplode(F.array(*texts)).alias("ord", "warning"))


def clean_companies(cubes):
    """Company counts without nulls and place names (lower-cased, not folded)."""
    noisy = F.lower("company_extracted").isin(list(cubes.settings.place_noise))
    return cubes.companies().filter(F.col("company_extracted").isNotNull() & ~noisy)


@section("kpis")
def kpis(cubes):
    s = cubes.settings
    cube = cubes.cube("year", "job_category", "location_extracted")
    by_year = cube.groupBy("year").agg(F.sum("n_rows").alias("n"))
    years = by_year.agg(
        F.count(F.lit(1)).alias("year_span"), F.min("year").alias("year_min"), F.max("year").alias("year_max"),
        F.max_by("year", F.struct(F.col("n"), -F.col("year"))).alias("peak_year"), F.max("n").alias("peak_year_count"),
        F.min_by("year", F.struct(F.col("n"), F.col("year"))).alias("trough_year"),
        F.min("n").alias("trough_year_count"), F.sum("n").alias("total_ads"),
    )
    located = F.when(F.col("location_extracted").isNotNull(), F.col("n_rows")).otherwise(0)
    totals = cube.agg(F.struct(
        F.count_distinct("job_category").alias("categories"), F.count_distinct("location_extracted").alias("places"),
        F.sum(located).alias("located"), F.sum(f"n_{s.adjusted_flag}").alias("gender"),
        F.sum("n_is_internship").alias("interns"),
    )).scalar()
    companies = clean_companies(cubes).agg(F.struct(
        F.count_distinct("company_extracted").alias("names"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("ads"),
    )).scalar()
    joined = years.withColumns({"t": totals, "c": companies, "gender_marker_rate_adjusted": adjusted_rate(cubes)})
    return joined.select(
        "total_ads", F.col("t.categories").alias("unique_categories"), F.col("t.places").alias("unique_locations"),
        F.col("c.names").alias("unique_companies_clean"), "year_span", "year_min", "year_max", "peak_year",
        "peak_year_count", "trough_year", "trough_year_count",
        (F.col("trough_year_count") < s.sparse_year).alias("trough_is_sparse_archive"),
        F.col("t.located").alias("ads_with_location"), F.col("c.ads").alias("ads_with_company_clean"),
        pct(F.col("t.gender"), F.col("total_ads")).alias("gender_marker_rate_raw"), "gender_marker_rate_adjusted",
        pct(F.col("t.interns"), F.col("total_ads")).alias("internship_rate"),
        F.lit(True).alias("remote_hint_suppressed"),
    )


@section("metadata")
def metadata(cubes):
    years = cubes.cube("year")
    return years.agg(
        F.sum("n_rows").alias("records"), F.min("year").alias("year_min"), F.max("year").alias("year_max"),
        F.array_sort(F.collect_set("year")).alias("years"),
    )


@section("metadata.periods")
def metadata_periods(cubes):
    """Configured periods with their record counts; a period without records counts zero."""
    periods = cubes.settings.periods
    counted = cubes.cube("year").groupBy(period_name(F.col("year"), periods).alias("period")).agg(
        F.sum("n_rows").alias("n")
    )
    return period_table(counted, periods).join(counted, "period", "left").select(
        "period", "period_label", "start_year", "end_year", F.coalesce("n", F.lit(0)).alias("records")
    )


def period_table(frame, periods):
    """The configured periods as a tiny frame."""
    items = [F.struct(F.lit(p.name).alias("period"), F.lit(p.label).alias("period_label"),
                      F.lit(p.start).alias("start_year"), F.lit(p.end).alias("end_year")) for p in periods]
    return frame.sparkSession.range(1).select(F.inline(F.array(*items)))



def label_columns(period, periods):
    """Label and bounds of a period name column."""
    def lookup(attribute):
        out = None
        for p in periods:
            hit, value = period == p.name, F.lit(getattr(p, attribute))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out

    return [lookup("label").alias("period_label"), lookup("start").alias("start_year"),
            lookup("end").alias("end_year")]
