"""Where jobs and streams keep checkpoints and results, and how frames and batches are written once."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_DIR = "spark.checkpoint.dir"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder, which must be set."""
    shared = spark.conf.get(SHARED_DIR, None)
    if not shared:
        raise ValueError(f"set {SHARED_DIR} to a folder that driver and executors share")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, *partitions: str) -> DataFrame:
    """The frame, computed once and read back from its Parquet files.

    The driver also drops what it no longer refers to: only then does Spark delete the shuffle files behind the frame.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int):
    """Results of one micro-batch.  A repeated batch replaces its own folder, nothing else."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def prepare_landing(spark: SparkSession, path: str, schema):
    """Make the landing folder readable before the first batch."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch_id=-1")


def landed(spark: SparkSession, path: str, schema, before: int = None) -> DataFrame:
    df = spark.read.schema(schema.add("batch_id", "long") if "batch_id" not in schema.names else schema).parquet(path)
    df = df if before is None else df.filter(F.col("batch_id") < before)
    return df


def run_to_end(writer, checkpoint: str):
    """Process everything available, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
