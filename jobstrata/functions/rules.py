"""Ordered rule tables and boolean flags as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobstrata import vocab
from jobstrata.functions.text import ICASE, WHITESPACE, fold, let, strip


def first_match(col: Column, rules, default, missing=None) -> Column:
    """Label of the first rule whose pattern occurs in ``col``."""
    out = F.when(col.isNull(), F.lit(missing)) if missing is not None else None
    for label, pattern in rules:
        hit = col.rlike(ICASE + pattern)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def classify_seniority(title, rules=None, default=vocab.SENIORITY_DEFAULT, missing=vocab.SENIORITY_MISSING):
    return first_match(title, rules or vocab.SENIORITY_RULES, default, missing)


def classify_category(title, rules=None, fallback=vocab.FALLBACK_CATEGORY):
    return first_match(title, rules or vocab.CATEGORY_RULES, fallback, fallback)


def flag(title: Column, pattern: str) -> Column:
    return F.coalesce(title.rlike(ICASE + pattern), F.lit(False))


def flag_gender_marker(title):
    return flag(title, vocab.FLAG_PATTERNS["gender_marker"])


def flag_internship(title):
    return flag(title, vocab.FLAG_PATTERNS["is_internship"])


def flag_remote(title):
    return flag(title, vocab.FLAG_PATTERNS["remote_hint"])


def flag_part_time(title):
    return flag(title, vocab.FLAG_PATTERNS["part_time_hint"])


def strip_noise(title: Column, suffix=vocab.PLATFORM_SUFFIX) -> Column:
    """Trim, and drop a platform name appended after a dash or pipe."""
    return strip(F.regexp_replace(strip(title), ICASE + suffix, ""))


def is_posting_title(title: Column, navigation=None) -> Column:
    """False for null, very short, URL-like and navigation titles."""
    nav = list(navigation or vocab.NAVIGATION_TITLES)
    return F.coalesce(let(strip_noise(title), lambda t: (
        (F.length(t) >= 4) & ~t.rlike("(?i)^https?://") & ~fold(t).isin(nav))), F.lit(False))


def archived_date(ts: Column) -> Column:
    """YYYY-MM-DD from a numeric timestamp of eight digits or more."""
    digits = F.regexp_extract(F.btrim(ts.cast("string"), F.lit(WHITESPACE)), r"^\+?0*([0-9]{8,})$", 1)
    return F.when(
        digits != "",
        F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)),
    )


def normalise_date_posted(text: Column, pattern=vocab.DATE_PATTERN) -> Column:
    """First dd.mm.yyyy-like date of a text; slashes and dashes become dots."""
    found = F.regexp_extract(text, UNICODE_DATE + pattern, 1)
    return F.regexp_replace(found, r"([0-9]{2})[/-]([0-9]{2})[/-]([0-9]{4})", "$1.$2.$3")


UNICODE_DATE = "(?U)"


def parse_named_date(text: Column, months=None) -> Column:
    """DateType from 'dd / Month / yyyy' with Portuguese or English month names."""
    table = F.create_map(*[F.lit(x) for kv in (months or vocab.MONTHS).items() for x in kv])
    pattern = r"(?U)^\s*([0-9]{1,2})\s*/\s*(\p{L}+)\s*/\s*([0-9]{4})\s*$"
    month = F.try_element_at(table, F.lower(F.regexp_extract(text, pattern, 2)))
    iso = F.concat_ws(
        "-",
        F.regexp_extract(text, pattern, 3),
        F.lpad(month.cast("string"), 2, "0"),
        F.lpad(F.regexp_extract(text, pattern, 1), 2, "0"),
    )
    return F.when(month.isNotNull(), F.try_to_date(iso, "yyyy-MM-dd"))
