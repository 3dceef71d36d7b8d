"""Reusable aggregation operators over counted frames.

A "counted frame" is already grouped: one row per combination of keys with additive
columns.  Everything here is additive over it, so rows are shuffled once, pre-aggregated,
and all later steps work on small data.  Group totals come from a second aggregation that
is joined back: Spark reuses the first exchange, and no group is ever gathered whole in
one window task.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.config import FLAGS
from jobstrata.functions.metrics import descending, pct, period_name, ratio, rounded

UNKNOWN = "Unknown"
MEASURES = ["n_rows", "n_ids", *[f"n_{f}" for f in FLAGS]]


def count_cube(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows → counted frame: row count, non-null id count and positives per flag."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("record_id").alias("n_ids"),
        *[F.sum(F.col(f).cast("long")).alias(f"n_{f}") for f in FLAGS],
    )


def roll_up(cube: DataFrame, *keys: str) -> DataFrame:
    """Counted frame → coarser counted frame."""
    return cube.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in MEASURES])


def total_of(frame: DataFrame, column: str = "n_rows"):
    """Scalar subquery: grand total of an additive column."""
    return frame.agg(F.coalesce(F.sum(column), F.lit(0))).scalar()


def add_share(counts: DataFrame, group, count: str = "count", share: str = "share", digits: int = 4):
    """Share of each row in its group total; group keys must not be null."""
    group = [group] if isinstance(group, str) else list(group)
    totals = counts.groupBy(*group).agg(F.sum(count).alias("_group_total"))
    return counts.join(totals, group).withColumn(share, pct(F.col(count), F.col("_group_total"), digits)).drop(
        "_group_total"
    )


def value_counts(cube: DataFrame, column: str, include_missing: bool = False) -> DataFrame:
    source = cube if include_missing else cube.filter(F.col(column).isNotNull())
    key = F.coalesce(F.col(column), F.lit(UNKNOWN)) if include_missing else F.col(column)
    return source.groupBy(key.alias(column)).agg(F.sum("n_rows").alias("count"))


def value_counts_share(cube: DataFrame, column: str, top_n: int = None, include_missing: bool = False,
                       denominator: str = "all_rows") -> DataFrame:
    """Counts of a column, most frequent first, with share of all rows or of non-null rows."""
    if denominator not in ("all_rows", "non_null"):
        raise ValueError(f"unknown denominator: {denominator}")
    whole = cube if denominator == "all_rows" else cube.filter(F.col(column).isNotNull())
    out = value_counts(cube, column, include_missing)
    if top_n:
        out = out.orderBy(*descending("count", column)).limit(top_n)
    out = out.withColumn("share", pct(F.col("count"), total_of(whole)))
    return out.orderBy(*descending("count", column))


def yearly_dimension(cube: DataFrame, column: str) -> DataFrame:
    """Counts by year and value, missing values kept as "Unknown", with share in year."""
    counts = cube.groupBy("year", F.coalesce(F.col(column), F.lit(UNKNOWN)).alias(column)).agg(
        F.sum("n_rows").alias("count")
    )
    return add_share(counts, "year")


def rate_by(cube: DataFrame, keys, flag: str, count: str = "count", rate: str = "rate",
            digits: int = 4) -> DataFrame:
    """Ids, positives and positive rate over all rows; null keys are dropped."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    out = cube.filter(not_null(*keys)).groupBy(*keys).agg(
        F.sum("n_ids").alias("total"),
        F.sum(f"n_{flag}").alias(count),
        ratio(F.sum(f"n_{flag}"), F.sum("n_rows")).alias(rate),
    )
    return out if digits is None else out.withColumn(rate, rounded(F.col(rate), digits))


def flag_profile(cube: DataFrame, key: str) -> DataFrame:
    rows = F.sum("n_rows")
    return cube.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.sum("n_ids").alias("total"),
        rounded(ratio(F.sum("n_gender_marker"), rows)).alias("gender_rate"),
        rounded(ratio(F.sum("n_is_internship"), rows)).alias("internship_rate"),
        rounded(ratio(F.sum("n_part_time_hint"), rows)).alias("part_time_rate"),
    )


def flag_totals(cube: DataFrame) -> DataFrame:
    """One row per flag: positives and total rows."""
    sums = cube.agg(F.sum("n_rows").alias("total"), *[F.sum(f"n_{f}").alias(f) for f in FLAGS])
    pairs = ", ".join(f"'{f}', coalesce({f}, 0L)" for f in FLAGS)
    return sums.selectExpr("coalesce(total, 0L) AS total", f"stack({len(FLAGS)}, {pairs}) AS (flag, positives)")


def top_per_group(frame: DataFrame, group, order, k: int) -> DataFrame:
    """First k rows of each group.  Spark prunes to k rows per group and map task first."""
    group = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*group).orderBy(*order)
    return frame.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def most_frequent(rows: DataFrame, group: str, term: str, k: int, cells: int = 1 << 16, first: int = 1000) -> DataFrame:
    """The k most frequent terms of each group of a few, ties to the smaller term: group, term, count; counted when called.

    Where most terms are rare, counting them all shuffles nearly every row.  So cells of a hash are counted
    first: no term is more frequent than its cell.  The terms of the ``first`` fullest cells of a group are
    counted exactly, and if the k-th of them is above every other cell, they are the result.  If not, the terms
    of all cells that reach it are counted, so the result is exact in any case.
    """
    placed = rows.withColumn("_cell", F.xxhash64(term).bitwiseAND(F.lit(cells - 1)))
    loads = placed.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_load"))
    spark, fullest = rows.sparkSession, {}
    for r in top_per_group(loads, group, [F.col("_load").desc(), "_cell"], first + 1).collect():
        fullest.setdefault(r[group], []).append((r["_load"], r["_cell"]))

    def counted(wanted):
        exact = placed.join(wanted, [group, "_cell"], "left_semi").groupBy(group, term).agg(F.count(F.lit(1)).alias("count"))
        return top_per_group(exact, group, [F.col("count").desc(), term], k)

    kind, others, chosen = rows.schema[group].dataType.simpleString(), {}, []
    for value, held in fullest.items():
        held.sort(key=lambda x: (-x[0], x[1]))
        others[value] = held[first][0] if len(held) > first else 0
        chosen += [(value, cell) for _, cell in held[:first]]
    top = counted(spark.createDataFrame(chosen, f"`{group}` {kind}, _cell long"))
    found = top.collect()
    least = {value: 1 for value in fullest}
    for value in fullest:
        counts = [r["count"] for r in found if r[group] == value]
        if len(counts) == k:
            least[value] = min(counts)
    if all(least[value] > others[value] for value in fullest):
        return spark.createDataFrame(found, top.schema)
    bounds = spark.createDataFrame(list(least.items()), f"`{group}` {kind}, _least long")
    return counted(loads.join(bounds, group).where("_load >= _least").select(group, "_cell"))


def top_by_period(cube: DataFrame, column: str, periods, k: int, denominator: str = "period_rows") -> DataFrame:
    """Top values of each period with their share of the period.

    ``period_rows`` divides by every row of the frame in the period, ``non_null`` by the
    rows that hold a value.
    """
    in_period = cube.withColumn("period", period_name(F.col("year"), periods)).filter("period IS NOT NULL")
    present = in_period.filter(F.col(column).isNotNull())
    whole = in_period if denominator == "period_rows" else present
    totals = whole.groupBy("period").agg(F.sum("n_rows").alias("_total"))
    counts = present.groupBy("period", column).agg(F.sum("n_rows").alias("count"))
    top = top_per_group(counts, "period", descending("count", column), k)
    return (
        top.join(totals, "period")
        .withColumn("share", pct(F.col("count"), F.col("_total")))
        .drop("_total")
        .withColumn("period_label", label_of(F.col("period"), periods))
    )


def label_of(period, periods):
    out = None
    for p in periods:
        hit = period == p.name
        out = F.when(hit, F.lit(p.label)) if out is None else out.when(hit, F.lit(p.label))
    return out


def not_null(*columns):
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return cond


def coverage(rows: DataFrame) -> DataFrame:
    """Present and missing values of every column, in one pass."""
    counted = rows.agg(F.count(F.lit(1)).alias("_total"), *[F.count(F.col(c)).alias(c) for c in rows.columns])
    types = dict(rows.dtypes)
    entries = ", ".join(f"'{c}', `{c}`, '{types[c]}'" for c in rows.columns)
    return counted.selectExpr(
        "_total", f"stack({len(rows.columns)}, {entries}) AS (column_name, present, data_type)"
    ).select(
        "column_name", "present", (F.col("_total") - F.col("present")).alias("missing"),
        pct(F.col("present"), F.col("_total")).alias("coverage_rate"), "data_type",
    )


def duplicates(rows: DataFrame) -> DataFrame:
    """Rows beyond the first per record id and per (title, year); null is one value.

    Both counts group by the key first, so a hot key collapses in the map tasks.
    """
    ids = rows.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    titles = rows.groupBy("title", "year").agg(F.count(F.lit(1)).alias("n"))
    surplus = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return ids.agg(surplus.alias("duplicate_record_ids")).withColumn(
        "duplicate_title_year", titles.agg(surplus).scalar()
    )


def describe_counts(histogram: DataFrame, value: str, count: str = "n") -> DataFrame:
    """Mean, median, p10, p90, extremes of a value with frequencies; exact."""
    q = F.expr(f"percentile({value}, array(0.5, 0.1, 0.9), {count})")
    stats = histogram.agg(
        ratio(F.sum(F.col(value) * F.col(count)), F.sum(count)).alias("mean"), q.alias("q"),
        F.max(value).cast("double").alias("max"), F.min(value).cast("double").alias("min"),
    )
    return stats.select(
        rounded(F.col("mean"), 1).alias("mean"), rounded(F.col("q")[0], 1).alias("median"),
        rounded(F.col("q")[1], 1).alias("p10"), rounded(F.col("q")[2], 1).alias("p90"), "max", "min",
    )


def pearson_matrix(flag_cube: DataFrame, flags, min_positives: int) -> DataFrame:
    """Correlation of every ordered pair of flags with enough positives.

    One aggregation over the joint-flag counts yields all sums and cross sums.
    """
    n = F.col("n_rows").cast("double")
    pairs = [(a, b) for i, a in enumerate(flags) for b in flags[i:]]
    sums = flag_cube.agg(
        F.sum(n).alias("n"),
        *[F.sum(F.when(F.col(a) & F.col(b), n).otherwise(0.0)).alias(f"{a}__{b}") for a, b in pairs],
    )
    entries = []
    for a in flags:
        for b in flags:
            first, second = (a, b) if (a, b) in pairs else (b, a)
            entries.append(F.struct(
                F.lit(a).alias("flag_a"), F.lit(b).alias("flag_b"), F.col("n").alias("n"),
                F.col(f"{a}__{a}").alias("x"), F.col(f"{b}__{b}").alias("y"),
                F.col(f"{first}__{second}").alias("xy"),
            ))
    x, y, xy, total = F.col("x"), F.col("y"), F.col("xy"), F.col("n")
    spread = F.sqrt(total * x - x * x) * F.sqrt(total * y - y * y)
    return (
        sums.select(F.inline(F.array(*entries)))
        .filter((x >= min_positives) & (y >= min_positives))
        .select("flag_a", "flag_b", rounded(F.try_divide(total * xy - x * y, spread)).alias("pearson_r"))
    )


def counts_by_year(rows: DataFrame) -> DataFrame:
    """Records per year; a missing year counts under 0."""
    return rows.groupBy(F.coalesce(F.col("year"), F.lit(0)).alias("year")).agg(F.count(F.lit(1)).alias("records"))
