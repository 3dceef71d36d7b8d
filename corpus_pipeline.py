"""A training corpus from the documents table: language, quality, near-duplicates, repeated passages, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame whose result is written and read again as the
next one's docs. All but the last return the columns of documents.
"""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from jobstrata.llm import language_id, near_dedup, packing, quality_rules, suffix_dedup
from jobstrata.llm.queries import WORD_MERGES
from jobstrata.llm.shared import folder, saved

#: Lowest language score that is taken as a language. Clean texts lie far above, strange ones near zero.
LOWEST_SCORE = 0.3
#: Percent of common shingles from which documents are near-duplicates.
NEAR = 80


def _row_key():
    """A 64-bit hash of id and text: what tells rows apart, whether ids are null, repeated or shared by texts."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def language(spark, docs, sf_dir):
    """Documents in a known language: `und` and scores below LOWEST_SCORE go."""
    found = language_id.prediction(spark, language_id.learn(docs))(F.col("text"))
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= LOWEST_SCORE))


def quality(spark, docs, sf_dir):
    """Documents that the base rules and the certified cutoffs keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.kept_documents(docs, labels)


def near_duplicates(spark, docs, sf_dir):
    """One row of each group of near-duplicates: the one with the smallest id, where null ids are last.

    Rows are told apart by id and text, so each is judged by its own text; of rows with equal id and text one stays.
    """
    keys = docs.select(_row_key().alias("key"), F.col("doc_id").cast("long").alias("id")).distinct()
    found = near_dedup.near_duplicates(docs.select(_row_key().alias("doc_id"), "text"), NEAR).select(
        F.col("doc_id").alias("key"), "component_id").distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key"))
    kept = found.join(keys, "key").groupBy("component_id").agg(first.alias("first")).select(F.col("first.key").alias("_row_key"))
    one = Window.partitionBy("_row_key").orderBy(*(c for c in docs.columns if c != "text"))
    rows = docs.withColumn("_row_key", _row_key()).withColumn("_copy", F.row_number().over(one)).where("_copy = 1")
    return rows.join(kept, "_row_key", "left_semi").select(docs.columns)


def passages(spark, docs, sf_dir):
    """Documents without the passages that an earlier one holds; those left without a word go.

    Where ids are null or shared by rows, all rows are numbered by id (null ids last) and text, and the numbers stand for ids.
    """
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return suffix_dedup.without_repeats(docs)
    order = docs.select("doc_id", _row_key().alias("_row_key")).distinct().orderBy(F.col("doc_id").asc_nulls_last(), "_row_key")
    numbers = saved(order.select("_row_key", F.monotonically_increasing_id().alias("_number")))
    numbered = docs.withColumn("_row_key", _row_key()).join(numbers, "_row_key").drop("_row_key")
    cut = suffix_dedup.without_repeats(numbered.withColumnsRenamed({"doc_id": "_own_id", "_number": "doc_id"}))
    return cut.select([F.col("_own_id").alias("doc_id") if c == "doc_id" else c for c in docs.columns])


def pack(spark, docs, sf_dir):
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, WORD_MERGES)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", pack)]

#: Iterated components and tokenisers are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed pieces of the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{number}-{name}")
        docs = spark.read.parquet(f"{place}/{number}-{name}")
    return docs
