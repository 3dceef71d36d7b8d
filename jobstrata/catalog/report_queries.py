"""The report sections as named queries over the test tables."""

from functools import partial

from pyspark.sql import functions as F

from jobstrata.catalog.report_sql import REPORT_SQL
from jobstrata.plans import language, profile, quality, structure, trends  # noqa: F401  (register sections)
from jobstrata.plans.inputs import PostingCubes
from jobstrata.plans.registry import SECTIONS
from jobstrata.sources.tables import (
    ALL_COLUMNS, DOCUMENT_SETTINGS, STAR_SETTINGS, document_postings, star_postings,
)

# sections that read titles run over the document texts
ON_DOCUMENTS = ("lang.", "dist.title_", "deep_dive.top_keywords")
# array columns are flattened so both engines print them alike
LISTS = {"metadata": "years", "deep_dive.summary": "sparse_years"}


def star_cubes(spark, sf_dir):
    return PostingCubes(lambda columns: star_postings(spark, sf_dir, columns or ALL_COLUMNS), STAR_SETTINGS)


def document_cubes(spark, sf_dir):
    return PostingCubes(lambda columns: document_postings(spark, sf_dir), DOCUMENT_SETTINGS, order=("doc_id",))


def run_section(name, spark, sf_dir):
    cubes = document_cubes if name.startswith(ON_DOCUMENTS) else star_cubes
    out = SECTIONS[name](cubes(spark, sf_dir))
    if name in LISTS:
        out = out.withColumn(LISTS[name], F.concat_ws(",", F.transform(LISTS[name], lambda y: y.cast("string"))))
    return out


def query_name(section_name):
    return section_name.replace(".", "_")


QUERIES = {query_name(s): partial(run_section, s) for s in SECTIONS}
ORACLES = {query_name(s): sql for s, sql in REPORT_SQL.items()}
