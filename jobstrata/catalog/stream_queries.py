"""The streaming jobs run to the end of the tables, checked against the batch result."""

from pyspark.sql import functions as F

from jobstrata.catalog.cleaning_queries import CATEGORY_SQL, DOC_TITLES, FLAG_SQL, SENIORITY_SQL
from jobstrata.catalog.search_queries import INDEX_SQL, greedy
from jobstrata.sources.tables import table
from jobstrata.streaming import jobs
from jobstrata.streaming.files import work_dir

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table_stream(spark, sf_dir, name):
    """A table's files as a stream, be the table one file or a folder of files.

    The last letter stands as a pattern: Spark takes a plain path for a folder.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("stream_ingest", """SELECT record_id, event_id, event_type FROM (SELECT CAST(user_id AS VARCHAR) AS record_id, event_id, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def ingest_query(spark, sf_dir):
    base = work_dir(spark, "ingest")
    stream = table_stream(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("record_id"), "event_id", "event_type")
    return jobs.stream_ingest(stream, f"{base}/landed", f"{base}/checkpoint", order=["event_id"])


@query("stream_enrich", f"""SELECT doc_id, {', '.join(f'{s} AS {f}' for f, s in FLAG_SQL.items())}, {SENIORITY_SQL} AS seniority,
    {CATEGORY_SQL} AS job_category FROM {DOC_TITLES}""")
def enrich_query(spark, sf_dir):
    base = work_dir(spark, "enrich")
    titles = table_stream(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title"))
    out = jobs.run_append(titles, f"{base}/out", f"{base}/checkpoint", jobs.stream_enrich)
    return out.select("doc_id", *FLAG_SQL, "seniority", "job_category")


@query("stream_counts", """SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS records FROM events GROUP BY ALL""")
def counts_query(spark, sf_dir):
    base = work_dir(spark, "counts")
    events = table_stream(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    counts = jobs.stream_counts(events, ["event_type"], "ts")
    out = jobs.run_counts(counts, f"{base}/out", f"{base}/checkpoint", ["event_type"])
    return out.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "records")


@query("stream_min_gap", f"WITH RECURSIVE {INDEX_SQL}, {greedy('idx', 14)} SELECT site, ts FROM days JOIN kept USING (site, d)")
def min_gap_query(spark, sf_dir):
    base = work_dir(spark, "min-gap")
    stream = table_stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("site"), F.date_format("ts", "yyyyMMddHHmmss").alias("ts"), "event_id")
    return jobs.stream_min_gap(stream, f"{base}/kept", f"{base}/checkpoint", "site", order=["event_id"]).select("site", "ts")
