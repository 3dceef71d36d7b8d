"""Sinks.  Every writer is distributed; only the bounded report document is one file."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


RECORDS_PER_FILE = 5_000_000


def write_parquet(df: DataFrame, path: str, partitions=("source", "year")):
    """One directory per source and year.

    Rows are rebalanced by directory first: adaptive execution splits a directory that holds much into as many
    tasks as its bytes ask for and merges small ones, so neither a hot source nor the file count gets out of hand.
    """
    df.hint("rebalance", *[F.col(p) for p in partitions]).write.mode("overwrite").option(
        "maxRecordsPerFile", RECORDS_PER_FILE).partitionBy(*partitions).parquet(path)


def write_jsonl(df: DataFrame, path: str):
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str):
    """CSV with header, UTF-8 without a byte order mark. Texts keep white space at their ends; an empty text is quoted, null is not."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "UTF-8").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_custom_labels(labels: DataFrame, path: str):
    """The discovered labels, each once, one JSON string a line; any number of labels, written by all tasks."""
    labels.where("category is not null").select(F.to_json(F.struct("category")).alias("value")).distinct().write.mode(
        "overwrite").text(path)


def write_document(document: DataFrame, path: str):
    """One-row JSON document."""
    document.coalesce(1).write.mode("overwrite").text(path)
