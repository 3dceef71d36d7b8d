"""Postings views over the star-schema test tables.

The view joins only the dimensions that the requested columns need.  Dimensions are joined
to each other first (nation → customer → orders), so the fact table meets one already
narrow frame; no side is forced to broadcast, Spark decides by size at run time.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobstrata.config import FLAGS, Period, Settings

STAR_PERIODS = (
    Period("early_1995_1996", "Early", 1995, 1996),
    Period("middle_1997_1999", "Middle", 1997, 1999),
    Period("late_2000_2001", "Late", 2000, 2001),
)
STAR_SETTINGS = Settings(
    periods=STAR_PERIODS, baseline_years=(1996, 1998), sparse_year=6000, sparse_period=15000,
    focus_places=("NATION_1", "NATION_2"), place_noise=("nation_1", "nation_6"), volume_midpoint=8000.0,
    movers=3,
)
DOCUMENT_SETTINGS = Settings()

_SENIORITY = {
    "1-URGENT": "director", "2-HIGH": "manager", "3-MEDIUM": "senior", "4-NOT SPECIFIED": "mid", "5-LOW": "junior",
}
_FROM_PART = {"title"}
_FROM_SUPPLIER = {"company_extracted"}
_FROM_NATION = {"location_extracted"}
_FROM_CUSTOMER = {"job_category"} | _FROM_NATION
_FROM_ORDERS = {"year", "seniority"} | _FROM_CUSTOMER
ALL_COLUMNS = ("record_id", "year", "title", "source", *FLAGS, "job_category", "seniority", "location_extracted",
               "company_extracted", "date_archived")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int = None) -> DataFrame:
    """Even out rows ahead of costly per-row work, only when there are fewer splits than cores.

    Large inputs have more splits than cores and pass through untouched, unless ``rows`` says how many
    a task may hold: narrow rows are many in a split.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        wanted = max(wanted, -(-df.count() // rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def star_postings(spark: SparkSession, sf_dir: str, columns=ALL_COLUMNS) -> DataFrame:
    """lineitem as postings; see STAR_POSTINGS_SQL for the same view in SQL."""
    need = set(columns)
    f = table(spark, sf_dir, "lineitem")
    if need & _FROM_ORDERS:
        o = table(spark, sf_dir, "orders")
        if need & _FROM_CUSTOMER:
            c = table(spark, sf_dir, "customer")
            if need & _FROM_NATION:
                c = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            o = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        f = f.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    if need & _FROM_PART:
        f = f.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if need & _FROM_SUPPLIER:
        f = f.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    level = F.create_map(*[F.lit(x) for kv in _SENIORITY.items() for x in kv])
    made = {
        "record_id": F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")),
        "year": F.year("o_orderdate"),
        "title": F.col("p_name"),
        "source": F.col("l_returnflag"),
        "gender_marker": (F.col("l_discount") >= 0.08)
        | ((F.col("l_returnflag") == "A") & (F.col("l_discount") >= 0.03)),
        "is_internship": (F.col("l_linestatus") == "O") & (F.col("l_quantity") < 10),
        "remote_hint": (F.col("l_quantity") >= 50) & (F.col("l_tax") == 0) & (F.col("l_discount") == 0),
        "part_time_hint": F.col("l_tax") >= 0.06,
        "job_category": F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")),
        "seniority": level[F.col("o_orderpriority")],
        "location_extracted": F.when(F.col("n_regionkey") != 0, F.col("n_name")),
        "company_extracted": F.when(F.col("s_acctbal") < 500, F.lit(None).cast("string"))
        .when(F.col("s_nationkey").isin(1, 6), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")))
        .otherwise(F.col("s_name")),
        "date_archived": F.col("l_shipdate").cast("date"),
    }
    return f.select(*[made[c].alias(c) for c in dict.fromkeys(columns)])


STAR_POSTINGS_SQL = """postings AS (
  SELECT l_orderkey || '-' || l_linenumber AS record_id, CAST(year(o_orderdate) AS INTEGER) AS year,
    p_name AS title, l_returnflag AS source,
    (l_discount >= 0.08 OR (l_returnflag = 'A' AND l_discount >= 0.03)) AS gender_marker,
    (l_linestatus = 'O' AND l_quantity < 10) AS is_internship,
    (l_quantity >= 50 AND l_tax = 0 AND l_discount = 0) AS remote_hint,
    (l_tax >= 0.06) AS part_time_hint,
    CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS job_category,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'director' WHEN '2-HIGH' THEN 'manager'
      WHEN '3-MEDIUM' THEN 'senior' WHEN '4-NOT SPECIFIED' THEN 'mid' WHEN '5-LOW' THEN 'junior' END AS seniority,
    CASE WHEN n_regionkey <> 0 THEN n_name END AS location_extracted,
    CASE WHEN s_acctbal < 500 THEN NULL WHEN s_nationkey IN (1, 6) THEN 'NATION_' || s_nationkey
      ELSE s_name END AS company_extracted,
    CAST(l_shipdate AS DATE) AS date_archived
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey)"""


def document_postings(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    """documents as postings: whole texts as titles, one year per source number."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(
        F.col("doc_id").cast("string").alias("record_id"), "doc_id",
        (F.lit(2005) + F.substring("source", 4, 4).cast("int")).alias("year"), F.col("text").alias("title"),
        "source", F.col("lang").alias("job_category"),
        (F.length("text") > 2000).alias("gender_marker"), (F.length("text") < 200).alias("is_internship"),
        F.lit(False).alias("remote_hint"), (F.col("lang") == "de").alias("part_time_hint"),
    )


DOCUMENT_POSTINGS_SQL = """docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS record_id, doc_id, CAST(2005 + CAST(substr(source, 4) AS INTEGER) AS INTEGER) AS year,
    text AS title, source, lang AS job_category
  FROM documents)"""
