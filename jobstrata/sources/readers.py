"""Readers with explicit schemas."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobstrata.operators.rows import dedup_first
from jobstrata.schemas import CONSOLIDATED, ENRICHED_CSV, RAW_POSTING

CORRUPT = "_corrupt"
#: Stands for a field without characters while CSV is read, so that a quoted empty text is not taken for null. Two
#: noncharacters, which Unicode keeps out of texts.
MISSING = "\uffff\ufffe"


def raw_glob(path: str) -> str:
    """Year directories only: state folders next to them are not data."""
    return f"{path.rstrip('/')}/[0-9]*/*.json"


def read_raw_json(spark: SparkSession, path: str, schema=RAW_POSTING) -> DataFrame:
    """One JSON file per posting; unreadable files are dropped.

    ``row_ord`` is the file path: it sorts by year folder, then by file name.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    df = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT).json(raw_glob(path))
    # the test on the id keeps a data column in every plan: Spark refuses to read the corrupt column alone
    readable = F.col(CORRUPT).isNull() & (F.coalesce(F.length("record_id"), F.lit(0)) >= 0)
    return df.select("*", F.col("_metadata.file_path").alias("row_ord")).filter(readable).drop(CORRUPT)


def compact_raw(df: DataFrame, order=("row_ord",), columns=CONSOLIDATED) -> DataFrame:
    """Consolidated records, first file wins; records without an id are all kept."""
    once = dedup_first(df, "record_id", list(order), keep_missing=True)
    return once.select(*columns, *order)


def read_csv_table(spark: SparkSession, path: str, schema=ENRICHED_CSV) -> DataFrame:
    """CSV with header; a field without characters is null, a quoted empty one an empty text."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option(
        "enforceSchema", False).option("nullValue", MISSING).csv(path)


def parse_index_lines(lines: DataFrame, line: str = "value", status_position: int = None) -> DataFrame:
    """Index lines (JSON arrays or objects) → ts, statuscode; lines without a timestamp are dropped."""
    raw = F.trim(F.col(line))
    ts = F.coalesce(F.get_json_object(raw, "$[0]"), F.get_json_object(raw, "$.timestamp"))
    status = F.get_json_object(raw, "$.statuscode")
    if status_position is not None:
        status = F.coalesce(F.get_json_object(raw, f"$[{status_position}]"), status)
    others = [c for c in lines.columns if c != line]
    return lines.select(*others, ts.alias("ts"), status.try_cast("int").alias("statuscode")).filter(
        F.coalesce("ts", F.lit("")) != "")


def snapshot_index_read(spark: SparkSession, path: str, site: str, seed_priority: int, base_url: str,
                        status_position: int = None) -> DataFrame:
    """One seed's index file; answers other than 200 are dropped."""
    parsed = parse_index_lines(spark.read.text(path), "value", status_position)
    return parsed.filter(F.coalesce("statuscode", F.lit(200)) == 200).select(
        F.lit(site).alias("site"), F.lit(seed_priority).alias("seed_priority"), F.lit(base_url).alias("base_url"),
        "ts", "statuscode")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations as JSON lines, one object with a record id each: any size, read by all tasks."""
    return spark.read.schema("record_id string, company string, company_conf double, location string, location_conf double, "
                             "category string, category_conf double").json(path)


def read_annotation_map(spark: SparkSession, path: str) -> DataFrame:
    """A checkpoint file holding one JSON object keyed by record id: one value, for files of a run.

    Larger sets belong into JSON lines (``read_annotations``).
    """
    value = ("struct<company:string,company_conf:double,location:string,location_conf:double,"
             "category:string,category_conf:double>")
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("record_id", "v")).select(
        "record_id", "v.*")


def read_custom_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels as written by ``write_custom_labels``: a JSON object a line, or an array of labels a line."""
    text = spark.read.text(path)
    one = F.from_json("value", "struct<category:string>")["category"]
    labels = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array(one))
    return text.select(F.explode(labels).alias("category")).filter("category IS NOT NULL")


def export_search_corpus(df: DataFrame, url: str = "wayback_url") -> DataFrame:
    """The columns the search side reads."""
    return df.select("year", "title", F.col("job_category").alias("category"), F.col(url).alias("url"))
