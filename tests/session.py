"""Local session for tests."""

import os
import tempfile

from pyspark.sql import SparkSession


def make_session():
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName("jobstrata-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse").config("spark.local.dir", f"{scratch}/local")
        .config("spark.checkpoint.dir", f"{scratch}/checkpoint").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
