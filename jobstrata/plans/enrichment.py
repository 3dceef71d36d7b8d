"""Deterministic enrichment of titles and the whole cleaning job.

``enrich`` is one projection of built-in expressions: no UDF, no shuffle.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata import vocab
from jobstrata.config import DEFAULTS
from jobstrata.functions.extract import with_company, with_location
from jobstrata.functions.rules import archived_date, classify_category, classify_seniority, flag
from jobstrata.operators.annotations import attach_annotations, consolidate_categories, fill_from_annotations
from jobstrata.operators.rows import align_schema, deal, dedup_first, mark_accepted, split_accept_reject, union_sources


def enrich(df: DataFrame, source: str = None, ts: str = "arquivo_timestamp") -> DataFrame:
    title = F.col("title")
    out = df if source is None else df.withColumn("source", F.lit(source))
    if ts in df.columns:
        out = out.withColumn("date_archived", archived_date(F.col(ts)))
    added = {name: flag(title, pattern) for name, pattern in vocab.FLAG_PATTERNS.items()}
    added["seniority"] = classify_seniority(title)
    added["job_category"] = classify_category(title)
    return with_company(with_location(out.withColumns(added)))


def judged_titles(df: DataFrame) -> DataFrame:
    """Every different title with what the rules derive from it: titles repeat, and the rule tables cost far more than a join."""
    return enrich(deal(df.select("title").distinct(), "title"))


def _dated(df: DataFrame, ts: str = "arquivo_timestamp") -> DataFrame:
    return df.withColumn("date_archived", archived_date(F.col(ts))) if ts in df.columns else df


def _with_judged(df: DataFrame, titles: DataFrame = None) -> DataFrame:
    judged = (judged_titles(df) if titles is None else titles).withColumnRenamed("title", "_title")
    return df.join(judged, F.col("title").eqNullSafe(F.col("_title"))).drop("_title")


def enrich_by_title(df: DataFrame, ts: str = "arquivo_timestamp", titles: DataFrame = None) -> DataFrame:
    """``enrich`` with every different title judged once; ``titles`` are the judged titles where a job has saved them."""
    return _with_judged(_dated(df, ts), titles)


def mark_rows(df: DataFrame, names) -> DataFrame:
    """Rows of one frame that name their source, marked in one pass; other sources go."""
    return mark_accepted(df.filter(F.col("source").isin(list(names))))


def mark_sources(sources: dict) -> DataFrame:
    """All raw per-source frames in one, with cleaned titles and the mark ``accepted``: to be written once."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [mark_accepted(df, name) for name, df in sources.items() if df is not None])


def accepted_rows(marked: DataFrame, names) -> DataFrame:
    """The accepted rows of a marked table."""
    return marked.filter(F.col("accepted") & F.col("source").isin(list(names))).drop("accepted")


def build_marked(marked: DataFrame, names, annotations: DataFrame = None, order=("row_ord",), settings=DEFAULTS,
                 titles: DataFrame = None) -> DataFrame:
    """Final postings from the accepted rows of a marked table; ``names`` gives the priority of the sources.

    ``titles`` are the judged titles of these rows where a job has saved them: Spark knows the size of a saved table, and
    few titles then reach the rows without a shuffle.
    """
    names = list(names)
    if not names:
        raise ValueError("no input table found")
    priority = F.array_position(F.array(*map(F.lit, names)), F.col("source")).cast("int") - 1
    rows = _dated(accepted_rows(marked, names)).withColumn("source_priority", priority)
    return finished(rows, annotations, order, settings, titles)


def finished(postings: DataFrame, annotations, order, settings, titles: DataFrame = None) -> DataFrame:
    """One row a record id, with what its title tells, annotations and merged labels.

    The first row of an id is found before anything is added: nothing added decides it, and rows are narrowest then.
    """
    postings = dedup_first(postings, "record_id", ["source_priority", *order])
    if annotations is not None:
        postings = attach_annotations(postings, annotations, unique=True)
    postings = _with_judged(postings, titles)
    if annotations is not None:
        postings = fill_from_annotations(postings, settings.annotation_threshold, settings.category_threshold, settings.fallback_category)
    return align_schema(consolidate_categories(postings))


def build_dataset(sources: dict, annotations: DataFrame = None, order=("row_ord",), settings=DEFAULTS):
    """(final postings, rejected rows) from raw per-source frames.

    ``order`` names columns that give the row order inside a source; with the source
    priority they decide which of several equal record ids is kept.
    """
    kept, rejected = {}, {}
    for name, df in sources.items():
        if df is None:
            kept[name] = None
            continue
        good, bad = split_accept_reject(df, name)
        kept[name], rejected[name] = _dated(good), bad
    return finished(union_sources(kept), annotations, order, settings), union_sources(rejected)
