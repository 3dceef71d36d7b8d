"""Incremental forms of ingest, enrichment, counting and the gap rule.

Each micro-batch writes one ``batch_id`` folder and compares only with earlier batches, so
a batch that is run again after a failure gives the same result.
"""

from copy import deepcopy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobstrata.operators.rows import dedup_first, incremental_new
from jobstrata.operators.snapshots import min_gap_sample_yearly, snapshot_day
from jobstrata.plans.enrichment import enrich
from jobstrata.schemas import RAW_POSTING
from jobstrata.sources.readers import CORRUPT, raw_glob
from jobstrata.streaming.files import landed, prepare_landing, run_to_end, write_batch


def raw_json_stream(spark: SparkSession, path: str, schema=RAW_POSTING) -> DataFrame:
    """New raw posting files as they arrive, with the file path as row order; unreadable files are dropped as in batch."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    files = spark.readStream.schema(full).option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT).json(raw_glob(path))
    readable = F.col(CORRUPT).isNull() & (F.coalesce(F.length("record_id"), F.lit(0)) >= 0)
    return files.select("*", F.col("_metadata.file_path").alias("row_ord")).filter(readable).drop(CORRUPT)


def stream_ingest(stream: DataFrame, path: str, checkpoint: str, key: str = "record_id", order=("row_ord",)):
    """Land each record id once; rows without an id are all kept, as in the batch form.

    No stream state grows: the batch is deduplicated and compared with the ids already
    landed, of which only the key column is read.
    """
    spark, schema = stream.sparkSession, deepcopy(stream.schema)
    prepare_landing(spark, path, stream.schema)

    def land(batch, batch_id):
        missing = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
        fresh = dedup_first(batch.filter(~missing), key, list(order))
        new = incremental_new(fresh, landed(spark, path, deepcopy(schema), batch_id), key)
        write_batch(new.unionByName(batch.filter(missing)), path, batch_id)

    run_to_end(stream.writeStream.foreachBatch(land), checkpoint)
    return landed(spark, path, deepcopy(schema)).drop("batch_id")


def stream_enrich(stream: DataFrame) -> DataFrame:
    """The batch projection, unchanged: it keeps no state."""
    return enrich(stream)


def stream_counts(stream: DataFrame, keys, ts: str, lateness: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts by keys and event-time window; a window is dropped from state once it is too late for it."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("records")).select(F.col("w.start").alias("day"), *keys, "records")


def run_counts(counts: DataFrame, path: str, checkpoint: str, keys) -> DataFrame:
    """Run an updating count to the end; the newest batch of each window is its count."""
    spark, schema = counts.sparkSession, deepcopy(counts.schema)
    prepare_landing(spark, path, counts.schema)
    run_to_end(counts.writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: write_batch(batch, path, batch_id)), checkpoint)
    return landed(spark, path, deepcopy(schema)).groupBy("day", *keys).agg(
        F.max_by("records", "batch_id").alias("records"))


def run_append(stream: DataFrame, path: str, checkpoint: str, transform=lambda df: df) -> DataFrame:
    """Append a stream to a table, each batch passed through a stateless projection."""
    spark, schema = stream.sparkSession, transform(stream).schema
    prepare_landing(spark, path, deepcopy(schema))
    run_to_end(stream.writeStream.foreachBatch(lambda b, i: write_batch(transform(b), path, i)), checkpoint)
    return landed(spark, path, deepcopy(schema)).drop("batch_id")


def stream_min_gap(stream: DataFrame, path: str, checkpoint: str, key, ts: str = "ts", days: int = 14, order=()):
    """The greedy gap rule online, per key (one column or several) and year, for timestamps that arrive in order.

    State is one row a key: its last kept day.  A batch first drops what lies within the gap of that day, then
    the batch rule runs on the rest; it reads and writes the state of the batch before, never the kept history.
    """
    key = [key] if isinstance(key, str) else list(key)
    spark, schema = stream.sparkSession, deepcopy(stream.schema)
    prepare_landing(spark, path, stream.schema)
    state = T.StructType([*[deepcopy(schema[k]) for k in key], T.StructField("_last", T.DateType())])
    prepare_landing(spark, f"{path}-state", state)

    def keep(batch, batch_id):
        day = snapshot_day(F.col(ts))
        last = spark.read.schema(state).parquet(f"{path}-state/batch_id={batch_id - 1}")
        far = F.col("_last").isNull() | (F.year("_last") < F.year(day)) | (F.date_diff(day, F.col("_last")) >= days)
        open_rows = batch.join(last, key, "left").filter(far).select(*schema.names)
        write_batch(min_gap_sample_yearly(open_rows, key, ts, days, order), path, batch_id)
        kept = spark.read.schema(deepcopy(schema)).parquet(f"{path}/batch_id={batch_id}").select(*key, day.alias("_last"))
        write_batch(last.unionByName(kept).groupBy(*key).agg(F.max("_last").alias("_last")), f"{path}-state", batch_id)

    run_to_end(stream.writeStream.foreachBatch(keep), checkpoint)
    return landed(spark, path, deepcopy(schema)).drop("batch_id")
