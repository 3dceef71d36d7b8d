"""Hand-over to and merge of externally produced annotations."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobstrata import vocab
from jobstrata.operators.rows import dedup_first

NULL_WORDS = ["outros", "other", "n/a", "none", "null"]


def needs_annotation(df: DataFrame, fallback=vocab.FALLBACK_CATEGORY) -> DataFrame:
    return df.filter(
        F.col("company_extracted").isNull() | F.col("location_extracted").isNull()
        | (F.coalesce(F.col("job_category"), F.lit(fallback)) == fallback)
    ).select("record_id", "title", "original_url")


def pending(df: DataFrame, done: DataFrame) -> DataFrame:
    """Rows without a finished annotation; a null id never counts as finished."""
    return df.join(done.select("record_id"), "record_id", "left_anti")


BUCKET_ROWS = 16_384


def bucket_digits_for(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Hex digits of the bucket hash so that a bucket holds about ``bucket_rows`` rows, two at least."""
    digits = 2
    while rows > bucket_rows * 16**digits:
        digits += 1
    return digits


def make_batches(df: DataFrame, order, size: int = 50, bucket_digits: int = None) -> DataFrame:
    """Request batches of at most ``size`` items, in order.

    Rows are numbered inside hash buckets, never in one global window.  The number of buckets
    follows the row count, so a bucket holds some thousand rows at any volume.  Every row
    lands in exactly one batch and only the last batch of a bucket may be short.
    """
    bucket_digits = bucket_digits_for(df.count()) if bucket_digits is None else bucket_digits
    order = [order] if isinstance(order, str) else list(order)
    spread = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in order]).cast("binary"))
    w = Window.partitionBy("bucket").orderBy(*order)
    numbered = df.withColumn("bucket", F.substring(spread, 1, bucket_digits)).withColumn(
        "_n", F.row_number().over(w) - 1
    )
    item = F.struct(F.col("_n").alias("ord"), "record_id", "title", "original_url")
    return numbered.groupBy("bucket", F.floor(F.col("_n") / size).alias("batch_no")).agg(
        F.array_sort(F.collect_list(item)).alias("items")
    ).select(F.concat_ws("-", "bucket", F.col("batch_no").cast("string")).alias("batch_id"), "items")


def render_items(batches: DataFrame) -> DataFrame:
    """One text line per item of a batch."""
    def line(x):
        return F.concat(
            F.lit("- id="), F.coalesce(x["record_id"], F.lit("")), F.lit(" | title="), F.coalesce(x["title"], F.lit("")),
            F.lit(" | url="), F.coalesce(x["original_url"], F.lit("")),
        )

    return batches.select(
        "batch_id", F.size("items").alias("n_items"), F.concat_ws("\n", F.transform("items", line)).alias("text")
    )


def clamp_conf(value):
    """Confidence in [0, 1]; anything unreadable is 0."""
    return F.when(F.isnan(value), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0.0))))
    )


def parse_annotation_response(df: DataFrame, text: str = "response") -> DataFrame:
    """Response texts → one row per record id.

    A text that is a JSON object is read as such; a text that is no JSON at all is searched
    for its outermost braces; other JSON and values that are not objects are dropped.
    """
    raw = F.col(text)
    is_json = F.try_parse_json(raw).isNotNull()
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    objects = F.from_json(F.when(is_json, raw).otherwise(inner), "map<string,string>")
    exploded = df.select(*[c for c in df.columns if c != text], F.explode(objects).alias("record_id", "value"))
    v = F.try_parse_json("value")

    def text_of(name):
        part = F.try_variant_get(v, f"$.{name}", "variant")
        found = F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
        return F.when(F.trim(found) != "", found)

    def conf_of(name):
        return clamp_conf(F.try_variant_get(v, f"$.{name}", "double"))

    return exploded.filter(F.ltrim("value").startswith("{") & v.isNotNull()).select(
        *[c for c in exploded.columns if c != "value"],
        F.try_variant_get(v, "$.is_job", "boolean").alias("is_job"),
        text_of("company").alias("company"), conf_of("company_conf").alias("company_conf"),
        text_of("location").alias("location"), conf_of("location_conf").alias("location_conf"),
        text_of("category").alias("category"), conf_of("category_conf").alias("category_conf"),
    )


def acceptable_new_label(category, conf, threshold: float = 0.75):
    return (
        F.length(category).between(3, 60) & (conf >= threshold) & ~F.lower(category).isin(NULL_WORDS)
        & ~category.rlike(r"""[{}\[\]"'\\]""")
    )


def discovered_labels(ann: DataFrame, labels=None, aliases=None, threshold: float = 0.75) -> DataFrame:
    """Labels that some confident annotation introduces (first pass)."""
    known = [*(labels or vocab.CATEGORY_LABELS), *(aliases or vocab.CATEGORY_ALIASES)]
    return ann.filter(
        ~F.col("category").isin(known) & acceptable_new_label(F.col("category"), F.col("category_conf"), threshold)
    ).select("category").distinct()


def resolve_category(ann: DataFrame, labels=None, aliases=None, threshold: float = 0.75,
                     fallback=vocab.FALLBACK_CATEGORY, discovered: DataFrame = None) -> DataFrame:
    """Final category of every annotation (second pass), independent of row order.

    ``discovered`` are the labels of the first pass where a job has saved them: as Spark knows the size of a saved table, few
    labels then cost the annotations no shuffle.
    """
    labels, aliases = labels or vocab.CATEGORY_LABELS, aliases or vocab.CATEGORY_ALIASES
    canonical = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    known = F.col("category").isin(list(labels))
    alias = F.try_element_at(canonical, F.col("category"))
    own = acceptable_new_label(F.col("category"), F.col("category_conf"), threshold)
    # only labels that need the lookup keep their text as the key; the others get a key of
    # their own that cannot match, so no value becomes hot in the join
    unresolved = ~F.coalesce(known, F.lit(False)) & alias.isNull() & ~F.coalesce(own, F.lit(False)) & F.col(
        "category").isNotNull()
    keyed = ann.withColumn(
        "_key", F.when(unresolved, F.concat(F.lit("="), "category")).otherwise(F.concat(F.lit("#"), "record_id"))
    )
    discovered = discovered_labels(ann, labels, aliases, threshold) if discovered is None else discovered
    found = discovered.select(
        F.concat(F.lit("="), "category").alias("_key"), F.lit(True).alias("_found")
    )
    keep = known | (alias.isNull() & (own | F.col("_found")))
    return keyed.join(found, "_key", "left").withColumns({
        "category_conf": F.when(keep | alias.isNotNull(), F.col("category_conf")).otherwise(0.0),
        "category": F.when(keep, F.col("category")).otherwise(F.coalesce(alias, F.lit(fallback))),
    }).drop("_key", "_found")


def latest_annotations(ann: DataFrame, batch: str) -> DataFrame:
    """The annotation of the last batch that holds a record."""
    return dedup_first(ann, "record_id", [F.col(batch).desc(), F.col("category_conf").desc(), F.col("category")])


ANSWERS = ["company", "company_conf", "location", "location_conf", "category", "category_conf"]


def attach_annotations(df: DataFrame, ann: DataFrame, unique: bool = False, drop_non_jobs: bool = False) -> DataFrame:
    """The most confident annotation of each posting, as columns of their own that ``fill_from_annotations`` uses up.

    A doubled id doubles no posting. Postings without an id match nothing; each gets a key of its own, so they gather in no task.
    Where ids are ``unique`` none can gather, and postings that lie by their id are not shuffled again.
    """
    named = ann.filter(F.coalesce("record_id", F.lit("")) != "")
    best = dedup_first(named, "record_id", [*[F.col(c).desc_nulls_last() for c in ANSWERS[1::2]], *ANSWERS[::2]])
    fields = [*[F.col(c).alias(f"_{c}") for c in ANSWERS], *([F.col("is_job").alias("_is_job")] if drop_non_jobs else [])]
    if unique:
        joined = df.join(best.select("record_id", *fields), "record_id", "left")
    else:
        own = F.concat(F.lit("#"), F.xxhash64(*[c for c in df.columns]).cast("string"))
        key = F.when(F.coalesce("record_id", F.lit("")) == "", own).otherwise(F.concat(F.lit("="), "record_id"))
        side = best.select(F.concat(F.lit("="), "record_id").alias("_key"), *fields)
        joined = df.withColumn("_key", key).join(side, "_key", "left").drop("_key")
    return joined.filter(F.coalesce("_is_job", F.lit(True))).drop("_is_job") if drop_non_jobs else joined


def fill_from_annotations(df: DataFrame, threshold: float = 0.75, category_threshold: float = 0.65,
                          fallback=vocab.FALLBACK_CATEGORY) -> DataFrame:
    """Fill missing company and place, and fallback categories, from the confident ones of the attached annotations."""
    def filled(column, value):
        use = F.col(column).isNull() & (F.coalesce(f"_{value}", F.lit("")) != "") & (
            F.col(f"_{value}_conf") >= threshold)
        return F.when(use, F.col(f"_{value}")).otherwise(F.col(column))

    better = (
        (F.col("job_category") == fallback) & (F.coalesce("_category", F.lit("")) != "")
        & (F.col("_category") != fallback) & (F.col("_category_conf") >= category_threshold)
    )
    return df.withColumns({
        "company_extracted": filled("company_extracted", "company"),
        "location_extracted": filled("location_extracted", "location"),
        "job_category": F.when(better, F.col("_category")).otherwise(F.col("job_category")),
    }).drop(*[f"_{c}" for c in ANSWERS])


def merge_annotations(df: DataFrame, ann: DataFrame, threshold: float = 0.75, category_threshold: float = 0.65,
                      fallback=vocab.FALLBACK_CATEGORY, drop_non_jobs: bool = False) -> DataFrame:
    """Fill missing company and place, and fallback categories, from confident annotations; the most confident of a record counts."""
    return fill_from_annotations(attach_annotations(df, ann, False, drop_non_jobs), threshold, category_threshold, fallback).select(*df.columns)


def annotation_stats(ann: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Mean confidence and count below the threshold, per field."""
    fields = ["category", "location", "company"]
    sums = ann.agg(*[F.avg(f"{f}_conf").alias(f"{f}_mean") for f in fields],
                   *[F.count_if(F.col(f"{f}_conf") < threshold).alias(f"{f}_below") for f in fields],
                   *[F.count(f"{f}_conf").alias(f"{f}_n") for f in fields])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.bround(f"{f}_mean", 2).alias("mean_conf"),
                 F.col(f"{f}_below").alias("below_threshold"), F.col(f"{f}_n").alias("n")) for f in fields
    ])))


def consolidate_categories(df: DataFrame, aliases=None, column: str = "job_category") -> DataFrame:
    """Fold redundant labels into their canonical one."""
    table = F.create_map(*[F.lit(x) for kv in (aliases or vocab.CATEGORY_ALIASES).items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))


def custom_labels(found: DataFrame, labels=None, aliases=None) -> DataFrame:
    """Discovered labels worth keeping: not built in and not an alias."""
    known = [*(labels or vocab.CATEGORY_LABELS), *(aliases or vocab.CATEGORY_ALIASES)]
    return found.filter(F.col("category").isNotNull() & ~F.col("category").isin(known)).select("category").distinct()


def merged_vocabulary(custom, labels=None) -> list:
    """Built-in labels with the custom ones inserted before the fallback label."""
    labels = list(labels or vocab.CATEGORY_LABELS)
    return [*labels[:-1], *[c for c in custom if c not in labels], labels[-1]]
