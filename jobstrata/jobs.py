"""Job entry points for spark-submit; ship the package with --py-files (see README).

    spark-submit jobs.py snapshots     INDEX_PARQUET OUT FIRST_YEAR LAST_YEAR [first|last]
    spark-submit jobs.py pages         SNAPSHOTS PAGES_PARQUET OUT container|heading|era SOURCE DOMAIN
    spark-submit jobs.py dataset       OUT  name=RAW [name=RAW ...] [annotations=JSON_LINES]
    spark-submit jobs.py annotate-out  POSTINGS_PARQUET OUT [ANNOTATIONS]
    spark-submit jobs.py annotate-in   RESPONSES_JSON_LINES OUT
    spark-submit jobs.py report        POSTINGS_PARQUET OUT
    spark-submit jobs.py trend         POSTINGS_PARQUET QUERY

RAW is a folder of JSON files below year folders, or the output of the job ``pages``.
"""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from jobstrata.operators.annotations import (
    custom_labels, discovered_labels, latest_annotations, make_batches, needs_annotation, parse_annotation_response, pending,
    render_items, resolve_category,
)
from jobstrata.operators.listings import container_profile, era_profile, extract_listings, heading_profile
from jobstrata.operators.rows import prepare_dataset
from jobstrata.operators.search import keyword_trend, search_corpus
from jobstrata.operators.snapshots import cap_per_year, merge_seeds, min_gap_sample_success, min_gap_sample_yearly
from jobstrata.plans.enrichment import accepted_rows, build_marked, judged_titles, mark_sources
from jobstrata.plans.inputs import PostingCubes
from jobstrata.plans.report import build_report, report_document, write_report
from jobstrata.sources.readers import compact_raw, export_search_corpus, read_annotations, read_raw_json
from jobstrata.sources.writers import write_csv, write_custom_labels, write_document, write_jsonl, write_parquet

PROFILES = {"container": container_profile, "heading": heading_profile, "era": era_profile}


def snapshots_job(spark, index: str, out: str, first_year: int, last_year: int, mode: str = "first"):
    """Index table (site, seed_priority, base_url, ts, statuscode) → the snapshots to read, spaced within each year."""
    merged = merge_seeds(spark.read.parquet(index), first_year, last_year, mode)
    min_gap_sample_yearly(merged, "site", order=("base_url",)).write.mode("overwrite").parquet(out)


def pages_job(spark, chosen: str, pages: str, out: str, kind: str, source: str, domain: str):
    """Pages (site, ts, page_url, html) of the chosen snapshots → raw postings.

    Snapshots whose pages yield nothing start no gap, and a year keeps no more than its limit of productive ones.
    """
    picked = spark.read.parquet(pages).join(spark.read.parquet(chosen).select("site", "ts"), ["site", "ts"], "left_semi")
    found = extract_listings(picked.withColumn("year", F.substring("ts", 1, 4).try_cast("int")), PROFILES[kind](source, domain))
    found.write.mode("overwrite").parquet(f"{out}/extracted")
    records = spark.read.parquet(f"{out}/extracted")
    yielded = records.groupBy(F.col("arquivo_timestamp").alias("ts")).agg(F.count(F.lit(1)).alias("yielded"))
    kept = cap_per_year(min_gap_sample_success(yielded.withColumn("site", F.lit(source)), "site"), "site")
    rows = records.join(kept.select(F.col("ts").alias("arquivo_timestamp")), "arquivo_timestamp", "left_semi")
    rows.withColumn("row_ord", F.concat_ws("|", "arquivo_timestamp", "wayback_url", F.lpad(F.col("pos").cast("string"), 9, "0"))).drop(
        "pos").write.mode("overwrite").parquet(f"{out}/raw")


def raw_postings(spark, path: str):
    """A tree of JSON files, or the table that ``pages`` wrote."""
    return spark.read.parquet(path) if path.rstrip("/").endswith("/raw") and _is_table(spark, path) else compact_raw(read_raw_json(spark, path))


def _is_table(spark, path: str):
    """Whether a folder holds a finished Spark table."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def dataset_job(spark, out, sources: dict, annotations: str = None):
    """Raw postings → enriched postings, with the rejected titles on the side; the raw tree is read once."""
    mark_sources({name: raw_postings(spark, path) for name, path in sources.items()}).write.mode("overwrite").partitionBy(
        "accepted").parquet(f"{out}/marked")
    marked = spark.read.parquet(f"{out}/marked")
    ann = read_annotations(spark, annotations) if annotations else None
    judged_titles(accepted_rows(marked, sources)).write.mode("overwrite").parquet(f"{out}/titles")
    write_parquet(build_marked(marked, list(sources), ann, titles=spark.read.parquet(f"{out}/titles")), f"{out}/postings")
    write_csv(marked.filter("NOT accepted").select("record_id", "year", "title", "source"), f"{out}/rejected")


def annotate_out_job(spark, postings: str, out: str, done: str = None):
    """Postings that lack something → batches of request texts; those annotated before are left out."""
    open_rows = needs_annotation(spark.read.parquet(postings))
    if done:
        open_rows = pending(open_rows, read_annotations(spark, done))
    write_jsonl(render_items(make_batches(open_rows, ["record_id", "title"])), out)


def annotate_in_job(spark, responses: str, out: str):
    """Responses (batch_no, response) → one annotation a record with its final category, and the new labels."""
    raw = spark.read.schema("batch_no long, response string").json(responses)
    parsed = latest_annotations(parse_annotation_response(raw), "batch_no")
    write_jsonl(resolve_category(parsed).drop("batch_no"), f"{out}/annotations")
    write_custom_labels(custom_labels(discovered_labels(parsed)), f"{out}/labels")


def report_job(spark, postings: str, out: str):
    cubes = PostingCubes(prepare_dataset(spark.read.parquet(postings)))
    saved = write_report(build_report(cubes, folder=f"{out}/tokens"), f"{out}/sections")
    cubes.release()
    write_document(report_document(saved), f"{out}/document")


def trend_job(spark, postings: str, query: str):
    corpus = search_corpus(export_search_corpus(spark.read.parquet(postings)))
    keyword_trend(corpus, query).orderBy("year").show(200, False)


def main(argv):
    spark = SparkSession.builder.appName("jobstrata").getOrCreate()
    command, *rest = argv
    if command == "dataset":
        named = dict(x.split("=", 1) for x in rest[1:])
        dataset_job(spark, rest[0], {k: v for k, v in named.items() if k != "annotations"}, named.get("annotations"))
    elif command == "snapshots":
        snapshots_job(spark, *rest[:2], *map(int, rest[2:4]), *rest[4:])
    elif command in ("pages", "annotate-out", "annotate-in", "report", "trend"):
        {"pages": pages_job, "annotate-out": annotate_out_job, "annotate-in": annotate_in_job, "report": report_job,
         "trend": trend_job}[command](spark, *rest)
    else:
        raise SystemExit(__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
