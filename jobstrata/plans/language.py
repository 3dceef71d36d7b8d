"""Keyword and bigram sections over title tokens.

Stopwords are dropped inside the token array, before anything is exploded, and counts are
combined in the map tasks, so a hot token costs one small row per task in the shuffle.
"""

from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from jobstrata.functions.metrics import descending, pct, period_name, rounded
from jobstrata.operators.aggregates import label_of, most_frequent, top_per_group
from jobstrata.plans.registry import section


def _with_period(cubes, frame):
    return frame.withColumn("period", period_name(F.col("year"), cubes.settings.periods)).filter("period IS NOT NULL")


def _with_share(cubes, top, term):
    periods = cubes.settings.periods
    ads = _with_period(cubes, cubes.cube("year")).groupBy("period").agg(F.sum("n_rows").alias("_ads"))
    return top.join(ads, "period").select(
        term, "count", "period", label_of(F.col("period"), periods).alias("period_label"),
        pct(F.col("count"), F.col("_ads")).alias("share_of_ads"),
    )


@section("lang.keywords_by_period")
def keywords_by_period(cubes, k=30):
    counts = cubes.token_counts().withColumnRenamed("token", "keyword")
    per_term = _with_period(cubes, counts).groupBy("period", "keyword").agg(F.sum("n_rows").alias("count"))
    return _with_share(cubes, top_per_group(per_term, "period", descending("count", "keyword"), k), "keyword")


@section("lang.bigrams_by_period")
def bigrams_by_period(cubes, k=15):
    return _with_share(cubes, most_frequent(_with_period(cubes, cubes.bigram_rows()), "period", "bigram", k), "bigram")


@section("lang.bigrams_global")
def bigrams_global(cubes, k=40):
    top = most_frequent(cubes.bigram_rows().select(F.lit(0).alias("every"), "bigram"), "every", "bigram", k)
    return top.select("bigram", "count").orderBy(*descending("count", "bigram")).limit(k)


def _place(rows, order):
    """What orders the rows. A single whole number, as here, leaves room for a position within 2^31 to be added: Spark holds the
    minimum of a decimal in a hash table, while that of a struct makes every task sort all its tokens."""
    if len(order) > 1 or not isinstance(rows.schema[order[0]].dataType, IntegralType):
        return F.struct(*order)
    number = F.coalesce(F.col(order[0]).cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)))
    return (number * F.lit(Decimal(2**31))).cast("decimal(37,0)")


def emergence_table(cubes, candidates="first_seen"):
    """Share change of candidate keywords between the first and the last period.

    ``first_seen`` takes the first N distinct tokens of each period in row order, ``top``
    the N most frequent.  One aggregation gives count and first position of each token.
    """
    s = cubes.settings
    first, last = s.periods[0], s.periods[-1]
    in_first = F.col("year").between(first.start, first.end)
    in_last = F.col("year").between(last.start, last.end)
    rows = cubes.title_tokens().filter(in_first | in_last)
    # distinct tokens of a title keep their order of first use; counts ride along
    kept = rows.select(in_last.alias("is_last"), _place(rows, cubes.order).alias("ord"), "kept")
    seen = kept.select("is_last", "ord", F.posexplode("kept").alias("pos", "keyword"))
    at = F.struct("ord", "pos") if isinstance(seen.schema["ord"].dataType, StructType) else F.col("ord") + F.col("pos")
    per_token = seen.groupBy("keyword").agg(
        F.count_if(~F.col("is_last")).alias("n_first"), F.count_if("is_last").alias("n_last"),
        F.min(F.when(~F.col("is_last"), at)).alias("at_first"), F.min(F.when(F.col("is_last"), at)).alias("at_last"),
    )

    def chosen(side, other):
        order = [F.col(f"at_{side}").asc()] if candidates == "first_seen" else [F.col(f"n_{side}").desc()]
        # the last sort keys never decide; they keep both branches on one aggregation, so the texts are read once
        return per_token.filter(F.col(f"n_{side}") > 0).orderBy(
            *order, "keyword", f"at_{other}", f"at_{side}", "n_first", "n_last").limit(s.emergence_candidates)

    counted = chosen("first", "last").union(chosen("last", "first")).select("keyword", "n_first", "n_last").distinct()
    years = cubes.cube("year")
    ads_first = years.agg(F.coalesce(F.sum(F.when(in_first, F.col("n_rows"))), F.lit(0))).scalar()
    ads_last = years.agg(F.coalesce(F.sum(F.when(in_last, F.col("n_rows"))), F.lit(0))).scalar()
    shared = counted.select(
        "keyword", pct(F.col("n_first"), ads_first).alias("first_period_share"),
        pct(F.col("n_last"), ads_last).alias("last_period_share"),
        ads_first.alias("n_first_period"), ads_last.alias("n_last_period"),
    )
    low = F.least("n_first_period", "n_last_period") < s.sparse_period
    return shared.withColumn(
        "share_delta", rounded(F.col("last_period_share") - F.col("first_period_share"))
    ).withColumn("low_n_warning", low)


@section("lang.emergence")
def emergence(cubes, k=20):
    return cubes.once("emergence", lambda: emergence_table(cubes)).orderBy(F.col("share_delta").desc(), "keyword").limit(k)


@section("lang.decline")
def decline(cubes, k=20):
    return cubes.once("emergence", lambda: emergence_table(cubes)).orderBy(F.col("share_delta").asc(), "keyword").limit(k)
