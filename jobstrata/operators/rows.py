"""Row-level table maintenance: alignment, union, deduplication, increments."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.config import FLAGS
from jobstrata.functions.rules import is_posting_title, strip_noise
from jobstrata.functions.text import repair_mojibake
from jobstrata.schemas import ENRICHED_POSTING

TEXT_COLUMNS = ["title", "job_category", "seniority", "location_extracted", "company_extracted"]
REQUIRED = ["record_id", "year", "title", "source", *FLAGS, "job_category", "seniority", "location_extracted",
            "company_extracted"]


def align_schema(df: DataFrame, schema=ENRICHED_POSTING) -> DataFrame:
    """Project to a fixed schema; columns the frame lacks become null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def union_sources(frames: dict) -> DataFrame:
    """Union of the present per-source frames, in the given order.

    Adds ``source`` and ``source_priority``; absent inputs (None) are skipped.
    """
    present = [(i, name, df) for i, (name, df) in enumerate(frames.items()) if df is not None]
    if not present:
        raise ValueError("no input table found")
    out = None
    for i, name, df in present:
        tagged = df.withColumn("source", F.lit(name)).withColumn("source_priority", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def dedup_first(df: DataFrame, key, order, keep_missing: bool = False) -> DataFrame:
    """First row of each key by a total order.

    The rank limit is applied in the map tasks before the shuffle, so a key holding a third
    of all rows sends one row per task.  A null key is one value, unless ``keep_missing``:
    then every row without a key stays.
    """
    key = [key] if isinstance(key, str) else list(key)
    order = [F.col(c) if isinstance(c, str) else c for c in ([order] if isinstance(order, str) else order)]
    parts = [F.col(k) for k in key]
    if keep_missing:
        absent = F.coalesce(F.col(key[0]).cast("string"), F.lit("")) == ""
        parts.append(F.when(absent, F.struct(*order)))
    w = Window.partitionBy(*parts).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def deal(df: DataFrame, key: str) -> DataFrame:
    """The rows over a fixed number of tasks, ahead of costly work on few narrow rows: those of a small shuffle would otherwise share one task."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def incremental_new(df: DataFrame, seen: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows whose key has not landed yet."""
    return df.join(seen.select(key), key, "left_anti")


def prepare_dataset(df: DataFrame) -> DataFrame:
    """Typed analytics input: repaired texts, null spellings, integer years, real booleans."""
    missing = sorted(set(REQUIRED) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    year = F.col("year").cast("string").try_cast("double")
    changed = {"year": F.when(~F.isnan(year), year).cast("int")}
    for c in TEXT_COLUMNS:
        text = repair_mojibake(F.col(c))
        changed[c] = F.when(~text.isin("", "nan", "None"), text)
    for f in FLAGS:
        changed[f] = F.coalesce(F.col(f).cast("string").try_cast("boolean"), F.lit(False))
    if "date_archived" in df.columns:
        changed["date_archived"] = F.col("date_archived").cast("string").try_cast("date")
    out = df.select(*[changed.get(c, F.col(c)).alias(c) for c in df.columns])
    return out.filter(F.col("year").isNotNull())


def mark_accepted(df: DataFrame, source: str = None) -> DataFrame:
    """Titles without platform noise, and ``accepted``: whether the title is one of a posting."""
    cleaned = df.withColumn("title", strip_noise(F.col("title")))
    if source is not None:
        cleaned = cleaned.withColumn("source", F.lit(source))
    return cleaned.withColumn("accepted", is_posting_title(F.col("title")))


def split_accept_reject(df: DataFrame, source: str = None):
    """(accepted, rejected) after removing platform noise from titles.

    A job that needs both writes ``mark_accepted`` once, partitioned by the mark, and reads the parts.
    """
    marked = mark_accepted(df, source)
    return marked.filter("accepted").drop("accepted"), marked.filter("NOT accepted").drop("accepted")
