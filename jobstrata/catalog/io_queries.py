"""Round trips through the file formats, on data taken from the tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata.catalog.report_queries import LISTS, ON_DOCUMENTS, document_cubes, star_cubes
from jobstrata.catalog.report_sql import REPORT_SQL, star
from jobstrata.catalog.search_queries import LINE
from jobstrata.plans.registry import SECTIONS
from jobstrata.plans.report import OPEN_SECTIONS, build_report, report_document, section_path, write_report
from jobstrata.sources import readers, writers
from jobstrata.sources.tables import document_postings, table
from jobstrata.streaming.files import work_dir

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


@query("read_csv_table", """SELECT CAST(doc_id AS VARCHAR) AS record_id, md5(text) AS title_md5,
    CAST(2005 + CAST(substr(source, 4) AS INTEGER) AS VARCHAR) AS year, source FROM documents""")
def csv_query(spark, sf_dir):
    """Whole texts, with their line breaks and quotes, through the CSV sink and back."""
    path = f"{work_dir(spark, 'csv')}/postings"
    writers.write_csv(document_postings(spark, sf_dir).select("record_id", "year", "title", "source"), path)
    back = readers.read_csv_table(spark, path, "record_id string, year string, title string, source string")
    return back.select("record_id", "year", F.md5(F.col("title").cast("binary")).alias("title_md5"), "source")


@query("read_raw_json", "SELECT CAST(item_id AS VARCHAR) AS record_id, md5(text) AS title_md5, CAST(2010 AS INTEGER) AS year FROM benchmark")
def raw_json_query(spark, sf_dir):
    """One JSON file per record below a year folder, read by the posting schema."""
    path = f"{work_dir(spark, 'raw')}/raw"
    records = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("record_id"), F.lit(2010).alias("year"), F.col("text").alias("title"))
    records.write.option("maxRecordsPerFile", 1).json(f"{path}/2010")
    back = readers.read_raw_json(spark, path)
    return back.select("record_id", F.md5(F.col("title").cast("binary")).alias("title_md5"), "year")


#: Sections whose bodies are compared: text key and number of each row.
BODIES = {
    "ts.yearly_volume": ("year", "rolling_3y_avg"), "ts.category_by_year": ("year|job_category", "share"),
    "ts.flags_by_year": ("year", "rate_gender_marker_adjusted"), "dist.category": ("job_category", "share"),
    "dist.seniority": ("seniority", "share"), "xt.category_x_seniority": ("job_category|seniority", "share"),
    "internship.by_category": ("job_category", "intern_rate"), "gender.by_category": ("job_category", "gm_rate"),
    "market.category_hhi_by_year": ("year", "hhi"), "loc.top_locations": ("location_extracted", "share"),
    "company.top": ("company_extracted", "share"), "vulnerability": ("job_category", "vulnerability_index"),
}


def _keyed(columns):
    return " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns.split("|"))


@query("report_document_bodies", " UNION ALL ".join(
    f"SELECT '{name}' AS section, {_keyed(key)} AS row_key, CAST({value} AS DOUBLE) AS number FROM ({REPORT_SQL[name]})"
    for name, (key, value) in BODIES.items()))
def report_bodies_query(spark, sf_dir):
    """Twelve sections through the report document: built together, written, nested and read back by path."""
    cubes = star_cubes(spark, sf_dir)
    sections = build_report(cubes, BODIES)
    types = {name: dict(df.dtypes) for name, df in sections.items()}
    document = report_document(write_report(sections, f"{work_dir(spark, 'report')}/sections"))
    cubes.release()
    parts = []
    for name, (key, value) in BODIES.items():
        fields = ",".join(f"{c}:{types[name][c]}" for c in [*key.split("|"), value])
        group, _, leaf = name.partition(".")
        body = F.get_json_object("document", f"$.{group}.{leaf}" if leaf else f"$.{group}")
        rows = document.select(F.inline(F.from_json(body, f"array<struct<{fields}>>")))
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key.split("|")]
        parts.append(rows.select(F.lit(name).alias("section"), F.concat_ws("|", *keys).alias("row_key"), F.col(value).alias("number")))
    return reduce(DataFrame.unionByName, parts)


#: Values that are summed as numbers; all others as hashes of their text.
NUMBER = "^-?[0-9]+([.][0-9]*)?([eE][-+]?[0-9]+)?$"


def columns_sql(name, sql):
    """One row for each column of a section: rows, values, their sum and that of text hashes."""
    return f"""SELECT '{name}' AS section, column_name, count(*) AS n_rows, count(value) AS n_values,
        CAST(coalesce(sum(CAST(CASE WHEN regexp_matches(value, '{NUMBER}') THEN CAST(value AS DOUBLE) END AS DECIMAL(38, 6))), 0) AS DOUBLE) AS number_sum,
        CAST(coalesce(sum(CASE WHEN NOT regexp_matches(value, '{NUMBER}') THEN CAST('0x' || substr(md5(value), 1, 8) AS BIGINT) END), 0) AS BIGINT) AS text_sum
      FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ({sql})) UNPIVOT INCLUDE NULLS (value FOR column_name IN (*))
      GROUP BY column_name"""


def column_sums(rows):
    """The same of rows (section, fields), fields being a map from column name to value as text."""
    cells = rows.select("section", F.explode("fields").alias("column_name", "value"))
    lists = reduce(lambda a, b: a | b, [(F.col("section") == n) & (F.col("column_name") == c) for n, c in LISTS.items()])
    value = F.when(lists, F.regexp_replace("value", r"^\[|\]$", "")).otherwise(F.col("value"))
    number = F.when(value.rlike(NUMBER), value.cast("double").cast("decimal(38,6)"))
    text = F.when(~value.rlike(NUMBER), F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("long"))
    return cells.groupBy("section", "column_name").agg(
        F.count("*").alias("n_rows"), F.count("value").alias("n_values"), F.coalesce(F.sum(number), F.lit(0)).cast("double").alias("number_sum"),
        F.coalesce(F.sum(text), F.lit(0)).cast("long").alias("text_sum"))


@query("report_document_columns", " UNION ALL ".join(columns_sql(name, REPORT_SQL[name]) for name in SECTIONS))
def report_columns_query(spark, sf_dir):
    """All sections through the report documents, column by column: rows, values, their sum and that of text hashes.

    The sections that read titles are a report over the documents, all others one over the star tables. Each report is built at once,
    written, nested into its document, and the document is written and read back. Open sections are read from the table that
    the document names.
    """
    place, parts = work_dir(spark, "report"), []
    of_texts = {name for name in SECTIONS if name.startswith(ON_DOCUMENTS)}
    reports = (("star", star_cubes, [n for n in SECTIONS if n not in of_texts], ("base", "company"), None),
               ("documents", document_cubes, sorted(of_texts), ("token",), f"{place}/tokens"))
    for label, cubes_of, names, frames, folder in reports:
        cubes = cubes_of(spark, sf_dir)
        saved = write_report(build_report(cubes, names, frames, folder), f"{place}/{label}")
        cubes.release()
        report_document(saved).write.text(f"{place}/{label}-document")
        document = spark.read.text(f"{place}/{label}-document", wholetext=True)
        nested = [name for name in names if name not in OPEN_SECTIONS]
        bodies = F.explode(F.array(*(F.struct(F.lit(n).alias("section"), F.get_json_object("value", section_path(n, names)).alias("body")) for n in nested)))
        parts.append(document.select(bodies.alias("s")).select("s.section", F.explode(F.from_json("s.body", "array<map<string,string>>")).alias("fields")))
        for name in set(names) & set(OPEN_SECTIONS):
            fields = F.map_from_arrays(F.array(*map(F.lit, saved[name].columns)), F.array(*(F.col(c).cast("string") for c in saved[name].columns)))
            parts.append(saved[name].select(F.lit(name).alias("section"), fields.alias("fields")))
    return column_sums(reduce(DataFrame.unionByName, parts))


@query("custom_vocab_roundtrip", """SELECT DISTINCT p_name AS category FROM part""")
def custom_vocab_roundtrip_query(spark, sf_dir):
    """Labels of any number written by all tasks and read back."""
    path = f"{work_dir(spark, 'labels')}/labels"
    writers.write_custom_labels(table(spark, sf_dir, "part").select(F.col("p_name").alias("category")), path)
    return readers.read_custom_labels(spark, path)


@query("snapshot_index_file", """SELECT strftime(ts, '%Y%m%d%H%M%S') AS ts, CAST(CASE event_type WHEN 'view' THEN 200 END AS INTEGER) AS statuscode,
    'site' AS site, CAST(7 AS INTEGER) AS seed_priority, 'http://site.example/' AS base_url FROM events WHERE event_type IN ('view', 'purchase')""")
def snapshot_index_query(spark, sf_dir):
    """An index file through the reader: answers other than 200 and lines without a timestamp are dropped."""
    path = f"{work_dir(spark, 'index')}/lines"
    e = table(spark, sf_dir, "events").withColumn("ts14", F.date_format("ts", "yyyyMMddHHmmss"))
    e.select(F.expr(LINE).alias("value")).write.text(path)
    return readers.snapshot_index_read(spark, path, "site", 7, "http://site.example/", status_position=2)


@query("write_report_json", star("""SELECT '3.0' AS schema_version, CAST(count(*) AS VARCHAR) AS records,
    CAST(count(DISTINCT year) AS INTEGER) AS years, CAST(max(year) AS VARCHAR) AS last_year FROM postings"""))
def report_query(spark, sf_dir):
    """The JSON document of some sections, read back by path."""
    cubes = star_cubes(spark, sf_dir)
    chosen = {name: SECTIONS[name](cubes) for name in ("metadata", "ts.yearly_volume", "ts.category_by_year")}
    document = report_document(write_report(chosen, f"{work_dir(spark, 'report')}/sections"))
    volume = F.from_json(F.get_json_object("document", "$.ts.yearly_volume"), "array<struct<year:int,records:bigint>>")
    return document.select(
        F.get_json_object("document", "$.schema_version").alias("schema_version"),
        F.get_json_object("document", "$.metadata[0].records").alias("records"),
        F.size(volume).alias("years"),
        F.get_json_object("document", "$.metadata[0].year_max").alias("last_year"))
