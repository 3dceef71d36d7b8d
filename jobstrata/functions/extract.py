"""Place and company extraction from titles: ordered strategies, first hit wins."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobstrata import vocab
from jobstrata.functions.text import ICASE, UNICODE, fold, strip, title_case


def _names(gazetteer, longest_first):
    ordered = sorted(gazetteer, key=len, reverse=longest_first)
    return "|".join(re.escape(n).replace("\\ ", " ") for n in ordered)


def gazetteer_pattern(gazetteer=vocab.GAZETTEER) -> str:
    return ICASE + r"\b(" + _names(gazetteer, longest_first=False) + r")\b"


def _found(col: Column, pattern: str, group: int = 1) -> Column:
    """Capture group, or null when the pattern does not occur."""
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def _trim_chars(col, chars):
    return F.btrim(col, F.lit(chars))


def clean_location(loc: Column, blocklist=vocab.PLACE_BLOCKLIST) -> Column:
    """Trim punctuation, cut working-hour and gender suffixes, reject non-places."""
    return accept_location(trim_location(loc), blocklist)


def trim_location(loc: Column) -> Column:
    out = _trim_chars(loc, " -–/\\,()")
    out = strip(F.regexp_replace(out, UNICODE + r"\s+\d+h.*$", ""))
    return strip(F.regexp_replace(out, UNICODE + r"\s*\([MmFf]/[MmFf]\)", ""))


def accept_location(out: Column, blocklist=vocab.PLACE_BLOCKLIST) -> Column:
    keep = (
        (F.length(out) >= 3)
        & ~out.rlike(UNICODE + r"^[\d\s\-]+$")
        & ~fold(out).isin(list(blocklist))
    )
    shouting = (F.upper(out) == out) & (F.lower(out) != out)
    return F.when(keep, F.when(shouting, title_case(out)).otherwise(out))


# Both extractions below add their candidates as columns, one projection after the other.
# Each candidate is then computed once per row; nested into one expression it would be
# repeated at every use.

def with_location(df: DataFrame, title: str = "title", output: str = "location_extracted",
                  gazetteer=vocab.GAZETTEER, prepositions=vocab.PLACE_PREPOSITIONS,
                  blocklist=vocab.PLACE_BLOCKLIST) -> DataFrame:
    """Place named by a title: after a trailing dash, after a preposition, or anywhere."""
    t, known = F.col(title), gazetteer_pattern(gazetteer)
    tail = _found(t, UNICODE + r"[-–]\s*([A-ZÀ-Öa-zà-ö][A-ZÀ-Öa-zà-ö\s\./]{2,40})\s*$")
    preposed = ICASE + r"\b(?:" + prepositions + r")\s+(" + _names(gazetteer, longest_first=True) + r")\b"
    # every strategy needs a known name in the title
    out = df.withColumn("_known", t.rlike(known))
    out = out.withColumn("_tail", F.when(F.col("_known"), trim_location(strip(tail))))
    out = out.withColumn("_dash", accept_location(F.col("_tail"), blocklist))
    named = F.when(F.col("_dash").rlike(known), F.col("_dash"))
    other = F.coalesce(_found(t, preposed), F.regexp_extract(t, known, 1))
    out = out.withColumn("_dash", named).withColumn(
        "_other", F.when(F.col("_known") & F.col("_dash").isNull(), other))
    return out.withColumn(output, F.coalesce("_dash", title_case(F.col("_other")))).drop(
        "_known", "_tail", "_dash", "_other")


def with_company(df: DataFrame, title: str = "title", location: str = "location_extracted",
                 output: str = "company_extracted", gazetteer=vocab.GAZETTEER,
                 blocklist=vocab.COMPANY_BLOCKLIST) -> DataFrame:
    """Company named by a title: hiring phrase, preposition or 'grupo', trailing dash."""
    t, blocked = F.col(title), list(dict.fromkeys(blocklist))
    hiring = strip(_found(
        t,
        ICASE + r"^([A-ZÀ-Ö][A-Za-zÀ-Öà-ö\s\-&\.,]{2,40}?)\s+"
        r"(?:está a recrutar|recruta|procura|admite|contrata|precisa de|precisa-se de)\b",
    ))
    named = strip(_found(
        t, ICASE + r"\b(?:para a?|na|no|com a?|grupo)\s+([A-ZÀ-Ö][A-Za-zÀ-Öà-ö\s\-&\.]{2,35})\s*$",
    ))
    tail = strip(_found(t, UNICODE + r"[-–]\s*([A-ZÀ-Öa-zà-ö][A-Za-zÀ-Öà-ö\s\-&\.]{2,35})\s*$"))

    def usable(name, not_place=True):
        c, folded = F.col(name), fold(F.col(name))
        ok = F.length(c) >= 3
        if not_place:
            ok = ok & (folded != F.col("_place"))
        return ok & ~folded.isin(blocked)

    out = df.withColumn("_place", F.coalesce(fold(F.col(location)), F.lit("")))
    out = out.withColumn("_a", hiring).withColumn("_a", F.when(usable("_a", False), F.col("_a")))
    out = out.withColumn("_b", F.when(F.col("_a").isNull(), named)).withColumn(
        "_b", F.when(usable("_b"), F.col("_b")))
    out = out.withColumn("_c", F.when(F.coalesce("_a", "_b").isNull(), tail))
    company_like = F.col("_c").rlike("^[A-ZÀ-Ö]") & ~F.col("_c").rlike(gazetteer_pattern(gazetteer))
    out = out.withColumn("_c", F.when(company_like & usable("_c"), F.col("_c")))
    return out.withColumn(output, F.coalesce("_a", "_b", "_c")).drop("_place", "_a", "_b", "_c")
