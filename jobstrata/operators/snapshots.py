"""Choosing archive snapshots from an index table (site, seed_priority, base_url, ts, statuscode)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobstrata import vocab
from jobstrata.operators.rows import dedup_first


def snapshot_day(ts):
    """Calendar day of a 14-digit timestamp; null when it is no date."""
    return F.try_to_date(F.substring(ts, 1, 8), "yyyyMMdd")


def seed_era_rule(df: DataFrame, token: str, cutoff_year: int) -> DataFrame:
    """Drop snapshots of seeds whose URL holds a token, from a year on."""
    return df.filter(~(F.col("base_url").contains(token) & (F.substring("ts", 1, 4).try_cast("int") >= cutoff_year)))


def merge_seeds(df: DataFrame, first_year: int, last_year: int, mode: str = "first") -> DataFrame:
    """One snapshot per site and day.

    ``first``: the earlier seed wins, inside a seed the earliest timestamp.  ``last``: later
    entries overwrite earlier ones, so the last seed and timestamp win.
    """
    in_range = df.filter(F.substring("ts", 1, 4).try_cast("int").between(first_year, last_year)).withColumn(
        "day8", F.substring("ts", 1, 8))
    if mode == "first":
        order = [F.col("seed_priority"), F.col("ts"), F.col("base_url")]
    elif mode == "last":
        order = [F.col("seed_priority").desc(), F.col("ts").desc(), F.col("base_url").desc()]
    else:
        raise ValueError(f"unknown mode: {mode}")
    return dedup_first(in_range, ["site", "day8"], order)


def min_gap_sample(df: DataFrame, key, ts: str = "ts", days: int = 14, order=()) -> DataFrame:
    """Greedy thinning: keep the first snapshot, then the next at least ``days`` after the last kept.

    Reduced to one row per key and day first, so the array walked per key is bounded by the
    calendar whatever the number of rows.
    """
    key = [key] if isinstance(key, str) else list(key)
    dated = df.withColumn("_day", snapshot_day(F.col(ts))).filter("_day IS NOT NULL")
    daily = dedup_first(dated, [*key, "_day"], [ts, *order])
    rest = [c for c in daily.columns if c not in (*key, "_day")]
    entry = F.struct("_day", *rest)

    def step(acc, x):
        far = acc["last"].isNull() | (F.date_diff(x["_day"], acc["last"]) >= days)
        return F.when(far, F.struct(x["_day"].alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))
                      ).otherwise(acc)

    per_key = daily.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    start = F.struct(F.lit(None).cast("date").alias("last"), F.slice("_all", 1, 0).alias("kept"))
    kept = per_key.select(*key, F.inline(F.aggregate("_all", start, step, lambda acc: acc["kept"])))
    return kept.select(*df.columns)


def by_year(key, ts: str = "ts"):
    """A key that also separates years: the gap rule starts anew with each."""
    return [*([key] if isinstance(key, str) else key), F.substring(ts, 1, 4).alias("_year")]


def min_gap_sample_yearly(df: DataFrame, key, ts: str = "ts", days: int = 14, order=()) -> DataFrame:
    """The gap rule for each key and year on its own."""
    *names, year = by_year(key, ts)
    return min_gap_sample(df.withColumn("_year", year), [*names, "_year"], ts, days, order).select(*df.columns)


def min_gap_sample_success(df: DataFrame, key, yielded: str = "yielded", ts: str = "ts", days: int = 14, order=()):
    """Only snapshots that yielded something start a gap; empty ones never do; every year starts anew."""
    return min_gap_sample_yearly(df.filter(F.col(yielded) > 0), key, ts, days, order)


def cap_per_year(df: DataFrame, key, ts: str = "ts", limits=None, default=vocab.SNAPSHOTS_PER_YEAR_DEFAULT):
    """At most N productive snapshots per key and year, earliest first; apply after the gap rule."""
    key = [key] if isinstance(key, str) else list(key)
    limits = vocab.SNAPSHOTS_PER_YEAR if limits is None else limits
    year = F.substring(ts, 1, 4).cast("int")
    allowed = F.lit(default)
    if limits:
        table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
        allowed = F.coalesce(F.try_element_at(table, year), F.lit(default))
    w = Window.partitionBy(*key, "_year").orderBy(ts)
    return df.withColumn("_year", year).withColumn("_rn", F.row_number().over(w)).filter(
        F.col("_rn") <= allowed).drop("_rn", "_year")


#: The archive's own rule: pages equal so far count as the same snapshot.
ARCHIVE_PREFIX = 4096


def dedup_content(df: DataFrame, content: str, order, prefix_bytes: int = None) -> DataFrame:
    """Keep the first page of each content fingerprint, over the whole content or its first ``prefix_bytes``."""
    body = F.col(content).cast("binary")
    body = body if prefix_bytes is None else F.substring(body, 1, prefix_bytes)
    marked = df.withColumn("_fingerprint", F.md5(body))
    return dedup_first(marked, "_fingerprint", order).drop("_fingerprint")


def crawl_stats(log: DataFrame) -> DataFrame:
    """Per year: pages fetched and failed, postings found, saved and skipped, rate limits, timeouts."""
    ok = F.col("http_code") == 200
    return log.groupBy("year").agg(
        F.count_if(ok).alias("pages_ok"), F.count_if(~ok).alias("pages_err"),
        F.sum(F.when(ok, F.col("found")).otherwise(0)).alias("jobs_found"),
        F.sum(F.when(ok, F.col("saved")).otherwise(0)).alias("saved"),
        F.sum(F.when(ok, F.col("found") - F.col("saved")).otherwise(0)).alias("skipped"),
        F.count_if(F.col("http_code") == 429).alias("rate_429"), F.count_if(F.col("http_code") == 0).alias("timeouts"),
    )


def http_code_histogram(log: DataFrame) -> DataFrame:
    return log.filter(F.col("http_code") != 200).groupBy("year", "http_code").agg(F.count(F.lit(1)).alias("pages"))
