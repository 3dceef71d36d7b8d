"""Keyword trends, suggestions, label matching and sampling over a search corpus.

The corpus is (year, title, category, url), with repaired texts.  Queries are matched in the folded
texts, where any run of separators stands for the space of a normal form.  A batch of queries meets the
corpus through an equality join on one word per query, never by comparing every query with every row.
"""

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from jobstrata import vocab
from jobstrata.functions.metrics import half_up, ratio
from jobstrata.functions.text import SEPARATORS, is_blank_repaired, let, repair_mojibake, search_fold, search_normalize
from jobstrata.functions.urls import safe_external_url
from jobstrata.operators.aggregates import top_per_group

MIN_QUERY_LENGTH = 3
MIN_MATCHES = 5
MIN_YEARS = 2
STABLE_BAND = 0.002


def search_corpus(df: DataFrame, fallback_url: str = "https://example.org/", untitled: bool = False) -> DataFrame:
    """Corpus rows with repaired texts; rows without year or title are dropped, or kept to be counted if ``untitled``."""
    titled = F.col("year").isNotNull() & F.col("title").isNotNull() & ~is_blank_repaired(F.col("title"))
    return (df if untitled else df.filter(titled)).withColumns({
        "title": repair_mojibake(F.col("title")),
        "category": repair_mojibake(F.coalesce("category", F.lit(""))),
        "url": safe_external_url(F.col("url"), fallback_url),
    })


def year_totals(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("year").agg(F.count(F.lit(1)).alias("total"))


def _normal(corpus: DataFrame, query: str) -> str:
    """The query's normal form as a constant, so that its pattern is compiled once and not for every row."""
    return corpus.sparkSession.range(1).select(search_normalize(F.lit(query))).head()[0]


def _boundary(query):
    """Pattern of a normal form between non-alphanumeric characters of a folded text."""
    words = F.replace(query, F.lit(" "), F.lit(rf"\E{SEPARATORS}\Q"))
    return F.concat(F.lit(r"(^|[^a-z0-9])\Q"), words, F.lit(r"\E($|[^a-z0-9])"))


def _hit(q: str):
    pattern = _boundary(F.lit(q))
    return F.lit(len(q) >= MIN_QUERY_LENGTH) & (
        F.rlike(search_fold(F.col("title")), pattern) | F.rlike(search_fold(F.col("category")), pattern))


def matches(corpus: DataFrame, query: str) -> DataFrame:
    """Rows whose title or category holds the query between non-alphanumeric characters."""
    return corpus.filter(_hit(_normal(corpus, query)))


def _share(count, total):
    return F.coalesce(half_up(ratio(count, total), 5), F.lit(0.0))


def keyword_trend(corpus: DataFrame, query: str, totals: DataFrame = None) -> DataFrame:
    """Matches per known year, zero-filled, with the share of the year; one pass over the texts. Rows without a year match nothing."""
    if totals is None:
        hit = F.col("year").isNotNull() & _hit(_normal(corpus, query))
        counted = corpus.groupBy("year").agg(F.count_if(hit).alias("count"), F.count(F.lit(1)).alias("total"))
        return counted.select("year", "count", "total", _share(F.col("count"), F.col("total")).alias("share"))
    counted = matches(corpus, query).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    count = F.coalesce("n", F.lit(0))
    return totals.join(counted, "year", "left").select(
        "year", count.alias("count"), "total", _share(count, F.col("total")).alias("share"))


def trend_summary(series: DataFrame, keys=()) -> DataFrame:
    """Significance, first and last share, change and verdict of yearly series."""
    point = F.when(F.col("year").isNotNull(), F.struct("year", "share"))
    ends = series.groupBy(*keys).agg(
        F.sum("count").alias("total_matches"), F.count_if(F.col("count") > 0).alias("years_with_matches"),
        F.min(point).alias("a"), F.max(point).alias("b"),
    )
    delta = half_up(F.col("b.share") - F.col("a.share"), 5)
    significant = (F.col("total_matches") >= MIN_MATCHES) & (F.col("years_with_matches") >= MIN_YEARS)
    change = half_up(F.try_divide(F.col("b.share") - F.col("a.share"), F.nullif(F.col("a.share"), F.lit(0.0))), 4)
    return ends.select(
        *keys, "total_matches", "years_with_matches", significant.alias("is_significant"),
        F.col("a.year").alias("first_year"), F.col("b.year").alias("last_year"),
        F.col("a.share").alias("first_share"), F.col("b.share").alias("last_share"), delta.alias("delta"),
        change.alias("relative_change"),
        F.when(delta < -STABLE_BAND, "decline").when(delta > STABLE_BAND, "rise").otherwise("stable").alias("verdict"),
    )


def sample_titles(corpus: DataFrame, query: str, order, k: int = 5, totals: DataFrame = None) -> DataFrame:
    """First k matching titles in row order; none when the trend is not significant."""
    order = [order] if isinstance(order, str) else list(order)
    enough = trend_summary(keyword_trend(corpus, query, totals)).select("is_significant").scalar()
    first = matches(corpus, query).orderBy(*order).limit(k).select(*order, "title", "url")
    return first.filter(enough)


def keyword_trend_batch(corpus: DataFrame, queries: DataFrame, query: str = "query",
                        totals: DataFrame = None) -> DataFrame:
    """Yearly series of many queries at once.

    Every alphanumeric run of a query must be a whole run of a matching text, so the longest
    run of a query serves as the key of an equality join; texts with symbols also carry the
    empty key, which serves queries made of symbols only.  The boundary match then decides.
    """
    totals = year_totals(corpus) if totals is None else totals
    normal = search_normalize(F.col(query))
    runs = F.array_sort(
        F.filter(F.split("q", "[^a-z0-9]+"), lambda r: r != ""),
        lambda x, y: F.when(F.length(x) > F.length(y), -1).when(F.length(x) < F.length(y), 1).otherwise(0),
    )
    asked = queries.select(F.col(query)).distinct().withColumn("q", normal)
    keyed = asked.filter(F.length("q") >= MIN_QUERY_LENGTH).withColumn(
        "key", F.coalesce(F.try_element_at(runs, F.lit(1)), F.lit("")))
    def words(folded):
        runs = F.array_distinct(F.array_remove(F.split(folded, "[^a-z0-9]+"), ""))
        return F.when(folded.rlike(r"[+#.\-]"), F.array_append(runs, F.lit(""))).otherwise(runs)

    # only a hash of the text passes the explode and the word join; the texts meet the few pairs that are left
    text_id = F.xxhash64("title", "category").alias("text_id")
    both = F.concat_ws(" ", search_fold(F.col("title")), search_fold(F.col("category")))
    pairs = corpus.select(text_id, F.explode(let(both, words)).alias("key")).join(keyed, "key").select(
        "text_id", query, "q").distinct()
    hit = F.rlike("folded_title", _boundary(F.col("q"))) | F.rlike("folded_category", _boundary(F.col("q")))
    texts = corpus.select(text_id, "year", search_fold(F.col("title")).alias("folded_title"),
                          search_fold(F.col("category")).alias("folded_category"))
    counted = texts.join(pairs, "text_id").filter(hit).groupBy(query, "year").agg(F.count(F.lit(1)).alias("n"))
    # zero-filling: one row per query and known year is the result itself
    known = totals.agg(F.collect_list(F.struct("year", "total"))).scalar()
    frame = asked.select(query, F.inline(known))
    count = F.coalesce("n", F.lit(0))
    return frame.join(counted, [query, "year"], "left").select(
        query, "year", count.alias("count"), "total", _share(count, F.col("total")).alias("share"))


def _leading(name):
    """The first 14 bytes of a string as one number, below zero for null: texts with a smaller number come first.

    Spark holds the minimum of a decimal in a hash table, while that of a string or struct makes every task sort all its rows.
    """
    digits = F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 14)), 28, "0")
    high, low = (F.conv(F.substring(digits, at, 14), 16, 10).cast("decimal(17,0)") for at in (1, 15))
    return F.coalesce((high * F.lit(Decimal(2**56)) + low).cast("decimal(36,0)"), F.lit(Decimal(-1)).cast("decimal(36,0)"))


def _spellings(pieces, place):
    """Every spelling with its count, normal form and first place: label, n, at, norm. Only distinct ones are normalised."""
    return pieces.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")).withColumn(
        "norm", search_normalize(F.col("label"))).filter(F.length("norm").between(MIN_QUERY_LENGTH, 72))


def _first_spellings(pieces, order):
    """The first spelling in row order and the count of each normal form: norm, n, label; counted when called for text order.

    Text orders rows by its leading bytes; only where several spellings of a form agree on these are their rows
    compared as a whole, in a second pass that is left out if there are none.
    """
    whole = F.struct(*order, "part")
    if len(order) > 1 or pieces.schema[order[0]].dataType != StringType():
        return _spellings(pieces, whole).groupBy("norm").agg(F.sum("n").alias("n"), F.min_by("label", "at").alias("label"))
    place = _leading(order[0])
    spelled = _spellings(pieces, place)
    counted = spelled.groupBy("norm").agg(
        F.sum("n").alias("n"), F.min("at").alias("at"), F.min_by("label", F.struct("at", "label")).alias("label"),
        F.max_by("label", F.struct(-F.col("at"), "label")).alias("other"))
    counted = counted.checkpoint() if pieces.sparkSession.sparkContext.getCheckpointDir() else counted.localCheckpoint()
    level = counted.filter("label <> other").select("norm", "at")
    if level.isEmpty():
        return counted.select("norm", "n", "label")
    level = level.join(spelled, ["norm", "at"]).select("norm", "at", "label")
    rows = pieces.join(level, "label").filter(place == F.col("at"))
    exact = rows.groupBy("norm").agg(F.min_by("label", F.struct(whole, "label")).alias("exact"))
    return counted.join(exact, "norm", "left").select("norm", "n", F.coalesce("exact", "label").alias("label"))


def suggestions(corpus: DataFrame, order, labels: DataFrame = None, k: int = 50) -> DataFrame:
    """Most frequent titles and categories by normal form; the first spelling is shown.

    ``labels`` are the report's category labels: each counts once more and comes first.
    """
    order = [order] if isinstance(order, str) else list(order)
    pieces = corpus.select(*order, F.inline(F.array(
        F.struct(F.lit(1).alias("part"), F.col("title").alias("label")),
        F.struct(F.lit(2).alias("part"), F.col("category").alias("label")),
    ))).filter("label <> ''")
    counted = _first_spellings(pieces, order)
    if labels is not None:
        named = labels.select(F.col("label").alias("given")).withColumn("norm", search_normalize(F.col("given")))
        named = named.filter(F.length("norm").between(MIN_QUERY_LENGTH, 72)).groupBy("norm").agg(
            F.count(F.lit(1)).alias("extra"), F.min("given").alias("given"))
        counted = counted.join(named, "norm", "full").select(
            "norm", (F.coalesce("n", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("n"),
            F.coalesce("given", "label").alias("label"))
    return counted.orderBy(F.col("n").desc(), "label", "norm").limit(k).select("label", F.col("n").alias("count"))


def label_match(labels: DataFrame, queries, label: str = "label", k: int = 12) -> DataFrame:
    """Autocomplete: exact 100, prefix 75, contained 50, subsequence 25; best k per query.

    ``queries`` is a short list held in the plan: each label is scored against it in place
    and only matches leave the row.
    """
    target = search_normalize(F.col(label))
    scored = []
    for text in dict.fromkeys(queries):
        q = search_normalize(F.lit(text))
        loose = F.array_join(F.transform(F.split(q, ""), lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))), ".*")
        score = (
            F.when(F.col("_t") == q, 100).when(F.col("_t").startswith(q), 75)
            .when(F.contains(F.col("_t"), q), 50).when(F.rlike("_t", loose), 25).otherwise(0)
        )
        scored.append(F.struct(F.lit(text).alias("query"), score.alias("score")))
    found = labels.select(label).distinct().withColumn("_t", target).select(
        label, F.inline(F.filter(F.array(*scored), lambda s: s["score"] > 0)))
    return top_per_group(found, "query", [F.col("score").desc(), F.col(label)], k).select("query", label, "score")


def peak_share(series: DataFrame, keys=()) -> DataFrame:
    """Year of the highest share, the earliest on ties."""
    best = F.max_by(F.struct("year", "share"), F.struct(F.col("share"), -F.col("year")))
    return series.groupBy(*keys).agg(best.alias("p")).select(
        *keys, F.col("p.year").alias("peak_year"), F.col("p.share").alias("peak_share"))


def sample_bucket(year, buckets=None):
    """Open-ended bucket of a year."""
    out = None
    for last, name in buckets or vocab.SAMPLE_BUCKETS:
        if last is None:
            return F.lit(name) if out is None else out.otherwise(F.lit(name))
        out = F.when(year <= last, F.lit(name)) if out is None else out.when(year <= last, F.lit(name))
    return out


def period_samples(corpus: DataFrame, row_id, n: int = 6, seed: int = 0, buckets=None, tech_words=None,
                   years: DataFrame = None) -> DataFrame:
    """n pseudo-random rows per bucket, the same for the same seed, marked tech or traditional."""
    row_id = [row_id] if isinstance(row_id, str) else list(row_id)
    rows = corpus if years is None else corpus.join(years.select("year").distinct(), "year", "left_semi")
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in row_id]).cast("binary"))
    words = "|".join(tech_words or vocab.TECH_WORDS)
    tech = F.lower("title").rlike(words) | F.lower("category").rlike(words)
    drawn = rows.withColumns({"bucket": sample_bucket(F.col("year"), buckets), "_draw": draw})
    return top_per_group(drawn, "bucket", ["_draw", *row_id], n).select(
        "bucket", *row_id, "title", "url", F.when(tech, "tech").otherwise("traditional").alias("type"))
