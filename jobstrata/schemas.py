"""Explicit schemas.  Nothing in the library infers a schema from data."""

from pyspark.sql import types as T

_S, _I, _B, _D = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RAW_POSTING = _struct(
    ("record_id", _S), ("year", _I), ("title", _S), ("company", _S), ("location", _S),
    ("date_posted", _S), ("original_url", _S), ("wayback_url", _S),
    ("arquivo_timestamp", _S), ("source", _S), ("scraped_at_utc", _S),
    ("date_archived", _S), ("http_status", _I), ("error", _S),
)

# columns kept when raw records are consolidated
CONSOLIDATED = [
    "record_id", "year", "title", "company", "location", "date_posted", "original_url",
    "wayback_url", "arquivo_timestamp", "source", "scraped_at_utc",
]

ENRICHED_POSTING = _struct(
    ("record_id", _S), ("year", _I), ("title", _S), ("company", _S), ("location", _S),
    ("date_posted", _S), ("original_url", _S), ("wayback_url", _S),
    ("arquivo_timestamp", _S), ("source", _S), ("scraped_at_utc", _S),
    ("date_archived", _S), ("gender_marker", _B), ("is_internship", _B),
    ("remote_hint", _B), ("part_time_hint", _B), ("seniority", _S), ("job_category", _S),
    ("location_extracted", _S), ("company_extracted", _S),
)

# every CSV column arrives as text; prepare_dataset gives the types
ENRICHED_CSV = T.StructType([T.StructField(f.name, _S, True) for f in ENRICHED_POSTING])

ANNOTATION_VALUE = _struct(
    ("is_job", _B), ("company", _S), ("company_conf", _S), ("location", _S),
    ("location_conf", _S), ("category", _S), ("category_conf", _S),
)

SEARCH_CORPUS = _struct(("year", _I), ("title", _S), ("category", _S), ("url", _S))

LISTING_RECORD = _struct(
    ("layout", _S), ("rank", _I), ("pos", _I), ("href", _S), ("title", _S), ("company", _S),
    ("location", _S), ("date_posted", _S), ("context", _S), ("stamp", _S),
)
