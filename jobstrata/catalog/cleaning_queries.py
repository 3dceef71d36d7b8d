"""Text functions, classification, extraction, row maintenance and annotations as queries."""

from pyspark.sql import functions as F

from jobstrata import vocab
from jobstrata.catalog.report_sql import n, q, rnd
from jobstrata.functions import rules
from jobstrata.functions.extract import with_company, with_location
from jobstrata.functions.text import (
    bigrams, fold, heal_lost_bytes, normalize_text, repair_byte_pairs, repair_mojibake, search_normalize, tokens,
)
from jobstrata.operators import annotations as ann_ops
from jobstrata.operators.aggregates import coverage, counts_by_year, value_counts_share
from jobstrata.operators.rows import (
    align_schema, deal, dedup_first, incremental_new, prepare_dataset, split_accept_reject, union_sources,
)
from jobstrata.plans.enrichment import enrich
from jobstrata.schemas import ENRICHED_POSTING
from jobstrata.sources.readers import compact_raw, export_search_corpus
from jobstrata.sources.tables import STAR_POSTINGS_SQL, spread, star_postings, table
from jobstrata.sources.titles import TITLED_SQL, titled_postings

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- SQL side of Unicode-aware patterns -------------------------------------------------
# DuckDB's \b is ASCII.  The text is lower-cased and each accented letter is replaced by an
# upper-case stand-in, in the pattern too; then ASCII word boundaries are the Unicode ones.
ACCENTED = "áàâãéêèíóòôõúçñäöüßëïîûùæœ"
STAND_INS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain(text):
    return text.translate(str.maketrans(ACCENTED, STAND_INS))


def has(column, pattern):
    return f"regexp_matches(translate(lower({column}), '{ACCENTED}', '{STAND_INS}'), {q(plain(pattern))})"


def first_match_sql(column, table_, default, missing):
    arms = " ".join(f"WHEN {has(column, p)} THEN {q(label)}" for label, p in table_)
    return f"CASE WHEN {column} IS NULL THEN {q(missing)} {arms} ELSE {q(default)} END"


FLAG_SQL = {f: f"coalesce({has('title', p.replace('[MmFf]', '[mf]'))}, false)" for f, p in vocab.FLAG_PATTERNS.items()}
SENIORITY_SQL = first_match_sql("title", vocab.SENIORITY_RULES, vocab.SENIORITY_DEFAULT, vocab.SENIORITY_MISSING)
CATEGORY_SQL = first_match_sql("title", vocab.CATEGORY_RULES, vocab.FALLBACK_CATEGORY, vocab.FALLBACK_CATEGORY)

FOLDED = "strip_accents(lower({}))"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
BY_LENGTH = sorted(vocab.GAZETTEER, key=len)
KNOWN = rf"(?i)(?:^|{NOT_WORD})({'|'.join(BY_LENGTH)})(?:{NOT_WORD}|$)"
PREPOSED = rf"(?i)(?:^|{NOT_WORD})(?:{vocab.PLACE_PREPOSITIONS})\s+({'|'.join(reversed(BY_LENGTH))})(?:{NOT_WORD}|$)"
PLACE_BLOCKED = ", ".join(q(x) for x in vocab.PLACE_BLOCKLIST)
COMPANY_BLOCKED = ", ".join(q(x) for x in vocab.COMPANY_BLOCKLIST)


def title_case_sql(x):
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


# initial capitals on space-separated words are enough for the names that reach this point
RAW_PLACE = r"trim(regexp_extract(title, '[-–]\s*([A-ZÀ-Öa-zà-ö][A-ZÀ-Öa-zà-ö\s\./]{2,40})\s*$', 1))"
CLEAN_PLACE = rf"trim(regexp_replace(trim(trim(raw_place, ' -–/\,()')), '\s+\d+h.*$', ''))"
LOCATION_CTES = f"""loc0 AS (SELECT *, {RAW_PLACE} AS raw_place FROM src),
  loc1 AS (SELECT *, {CLEAN_PLACE} AS c FROM loc0),
  loc2 AS (SELECT *, CASE WHEN length(c) >= 3 AND {FOLDED.format('c')} NOT IN ({PLACE_BLOCKED})
      THEN CASE WHEN upper(c) = c AND lower(c) <> c THEN {title_case_sql('c')} ELSE c END END AS dash_place FROM loc1),
  located AS (SELECT * EXCLUDE (raw_place, c, dash_place), CASE
      WHEN regexp_matches(dash_place, '{KNOWN}') THEN dash_place
      WHEN regexp_matches(title, '{PREPOSED}') THEN {title_case_sql(f"regexp_extract(title, '{PREPOSED}', 1)")}
      WHEN regexp_matches(title, '{KNOWN}') THEN {title_case_sql(f"regexp_extract(title, '{KNOWN}', 1)")} END
    AS location_extracted FROM loc2)"""
# "Viana do Castelo" and the like keep title case on every word, as str.title() gives
HIRING = rf"(?i)^([A-ZÀ-Ö][A-Za-zÀ-Öà-ö\s\-&\.,]{{2,40}}?)\s+(?:está a recrutar|recruta|procura|admite|contrata|precisa de|precisa-se de)(?:{NOT_WORD}|$)"
NAMED = rf"(?i)(?:^|{NOT_WORD})(?:para a?|na|no|com a?|grupo)\s+([A-ZÀ-Ö][A-Za-zÀ-Öà-ö\s\-&\.]{{2,35}})\s*$"
TAIL = r"[-–]\s*([A-ZÀ-Öa-zà-ö][A-Za-zÀ-Öà-ö\s\-&\.]{2,35})\s*$"
COMPANY_CTES = f"""comp AS (SELECT *, trim(regexp_extract(title, '{HIRING}', 1)) AS h, trim(regexp_extract(title, '{NAMED}', 1)) AS m,
      trim(regexp_extract(title, '{TAIL}', 1)) AS t, coalesce({FOLDED.format('location_extracted')}, '') AS fl FROM located),
  companied AS (SELECT * EXCLUDE (h, m, t, fl), CASE
      WHEN length(h) >= 3 AND {FOLDED.format('h')} NOT IN ({COMPANY_BLOCKED}) THEN h
      WHEN length(m) >= 3 AND {FOLDED.format('m')} NOT IN ({COMPANY_BLOCKED}) AND {FOLDED.format('m')} <> fl THEN m
      WHEN length(t) >= 3 AND regexp_matches(t, '^[A-ZÀ-Ö]') AND {FOLDED.format('t')} NOT IN ({COMPANY_BLOCKED})
        AND NOT regexp_matches(t, '{KNOWN}') AND {FOLDED.format('t')} <> fl THEN t END AS company_extracted FROM comp)"""


def title():
    return F.col("title")


def titles(spark, sf_dir, *keys):
    """Every different title, and its rows: what is judged by the title alone is judged once a title."""
    return counted_titles(titled_postings(spark, sf_dir).groupBy("title", *keys).agg(F.count(F.lit(1)).alias("n")))


def counted_titles(counted):
    """Counted titles over all tasks; the title is tied to the count, or filters on it would move below the count and judge every row."""
    return deal(counted, "title").withColumn("title", F.when(F.col("n") > 0, F.col("title")))


def per_title(df, *columns):
    return df.groupBy("title", *columns).agg(F.sum("n").alias("n"))


SRC = f"WITH {TITLED_SQL}, src AS (SELECT * FROM titled)"


# --- text ------------------------------------------------------------------------------------

def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def digest(col):
    return F.md5(col.cast("binary"))


@query("fold", f"SELECT doc_id, md5({FOLDED.format('text')}) AS folded FROM documents")
def fold_query(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", digest(fold(F.col("text"))).alias("folded"))


@query("normalize_text", "SELECT doc_id, md5(lower(strip_accents(trim(text, ' ' || chr(10))))) AS normalized FROM documents")
def normalize_query(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", digest(normalize_text(F.col("text"))).alias("normalized"))


@query("repair_mojibake", "SELECT doc_id, md5(trim(text, ' ' || chr(10))) AS repaired FROM documents")
def repair_query(spark, sf_dir):
    """Texts are first garbled as UTF-8 read as Latin-1; the repair must give them back."""
    garbled = F.decode(F.col("text").cast("binary"), "ISO-8859-1")
    return documents(spark, sf_dir).select("doc_id", digest(repair_mojibake(garbled)).alias("repaired"))


@query("repair_byte_pairs", """SELECT doc_id, md5('€ ' || text) AS by_pairs, md5(text) AS as_whole FROM documents""")
def byte_pairs_query(spark, sf_dir):
    """Letters are garbled one by one in a text that no decoding repairs, and all at once in one that is repaired whole."""
    pairs = F.create_map(*[F.lit(x) for pair, letter in vocab.BYTE_PAIRS for x in (letter, pair)])
    garbled = F.transform(F.split("text", ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c))
    mixed = F.concat(F.lit("€ "), F.array_join(garbled, ""))
    whole = F.decode(F.col("text").cast("binary"), "ISO-8859-1")
    return documents(spark, sf_dir).select(
        "doc_id", digest(repair_byte_pairs(mixed, vocab.BYTE_PAIRS)).alias("by_pairs"),
        digest(repair_byte_pairs(whole, vocab.BYTE_PAIRS)).alias("as_whole"))


@query("search_normalize", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(strip_accents(lower(text)),
    '[^a-z0-9+#.\s-]', ' ', 'g'), '\s+', ' ', 'g'))) AS normalized FROM documents""")
def search_normalize_query(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", digest(search_normalize(F.col("text"))).alias("normalized"))


def _healed_sql():
    x = "replace(replace(upper(replace(text, 'ß', 'ss')), 'É', chr(65533)), 'Ó', chr(65533))"
    for pattern, replacement in vocab.LOST_BYTE_REPAIRS:
        if pattern.endswith("(?![A-Za-z0-9_])"):
            # \b: the last letter of the pattern is a word character, so only what follows decides
            # twice, because the character consumed behind a match may start the next one
            head = q(pattern[:-len("(?![A-Za-z0-9_])")])
            for _ in range(2):
                x = f"regexp_replace({x}, {head} || '([^A-Za-z0-9_]|$)', {q(replacement)} || '\\1', 'g')"
        else:
            x = f"replace({x}, {q(pattern)}, {q(replacement)})"
    return x


@query("heal_lost_bytes", f"SELECT doc_id, md5({_healed_sql()}) AS healed FROM documents")
def heal_query(spark, sf_dir):
    """Upper-cased texts whose É and Ó were lost on the way."""
    lost = F.translate(F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))), "ÉÓ", "\ufffd\ufffd")
    return documents(spark, sf_dir).select("doc_id", digest(heal_lost_bytes(lost, vocab.LOST_BYTE_REPAIRS)).alias("healed"))


STOPS = ", ".join(q(w) for w in dict.fromkeys(vocab.STOPWORDS))
KEPT_SQL = rf"""list_filter(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9+#.]{{2,}}'),
    lambda t: NOT list_contains([{STOPS}], t) AND NOT regexp_full_match(t, '[0-9]+'))"""


@query("tokenize", f"SELECT doc_id, CAST(len(k) AS INTEGER) AS n_tokens, md5(array_to_string(k, ' ')) AS token_text FROM (SELECT doc_id, {KEPT_SQL} AS k FROM documents)")
def tokenize_query(spark, sf_dir):
    kept = documents(spark, sf_dir).select("doc_id", tokens(F.col("text"), vocab.STOPWORDS).alias("k"))
    return kept.select("doc_id", F.size("k").alias("n_tokens"), digest(F.concat_ws(" ", "k")).alias("token_text"))


@query("bigrams", f"""SELECT doc_id, CAST(greatest(len(k) - 1, 0) AS INTEGER) AS n_bigrams,
    md5(array_to_string(list_transform(list_zip(k[1:len(k) - 1], k[2:]), lambda z: z[1] || ' ' || z[2]), '|')) AS bigram_text
    FROM (SELECT doc_id, {KEPT_SQL} AS k FROM documents)""")
def bigrams_query(spark, sf_dir):
    kept = documents(spark, sf_dir).select("doc_id", bigrams(tokens(F.col("text"), vocab.STOPWORDS)).alias("b"))
    return kept.select("doc_id", F.size("b").alias("n_bigrams"), digest(F.concat_ws("|", "b")).alias("bigram_text"))


# --- classification over whole document texts and over titles -----------------------------------

def _as_titles(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.col("text").alias("title"))


DOC_TITLES = "(SELECT doc_id, text AS title FROM documents)"


@query("flags_documents", f"SELECT doc_id, {', '.join(f'{s} AS {f}' for f, s in FLAG_SQL.items())} FROM {DOC_TITLES}")
def flags_documents(spark, sf_dir):
    return _as_titles(spark, sf_dir).select(
        "doc_id", *[rules.flag(title(), p).alias(f) for f, p in vocab.FLAG_PATTERNS.items()])


@query("classify_documents", f"SELECT doc_id, {SENIORITY_SQL} AS seniority, {CATEGORY_SQL} AS job_category FROM {DOC_TITLES}")
def classify_documents(spark, sf_dir):
    return _as_titles(spark, sf_dir).select(
        "doc_id", rules.classify_seniority(title()).alias("seniority"), rules.classify_category(title()).alias("job_category"))


def _flag_query(name, fn, column):
    @query(name, f"{SRC} SELECT title, {FLAG_SQL[column]} AS {column}, {n()} AS n FROM src GROUP BY ALL")
    def run(spark, sf_dir):
        df = titles(spark, sf_dir).withColumn(column, fn(title()))
        return per_title(df, column)


_flag_query("flag_gender_marker", rules.flag_gender_marker, "gender_marker")
_flag_query("flag_internship", rules.flag_internship, "is_internship")
_flag_query("flag_remote", rules.flag_remote, "remote_hint")
_flag_query("flag_part_time", rules.flag_part_time, "part_time_hint")


@query("classify_seniority", f"{SRC} SELECT title, {SENIORITY_SQL} AS seniority, {n()} AS n FROM src GROUP BY ALL")
def seniority_query(spark, sf_dir):
    return per_title(titles(spark, sf_dir).withColumn("seniority", rules.classify_seniority(title())), "seniority")


@query("classify_category", f"{SRC} SELECT title, {CATEGORY_SQL} AS job_category, {n()} AS n FROM src GROUP BY ALL")
def category_query(spark, sf_dir):
    return per_title(titles(spark, sf_dir).withColumn("job_category", rules.classify_category(title())), "job_category")


@query("extract_location", f"{SRC}, {LOCATION_CTES} SELECT title, location_extracted, {n()} AS n FROM located GROUP BY ALL")
def location_query(spark, sf_dir):
    return per_title(with_location(titles(spark, sf_dir)), "location_extracted")


@query("extract_company", f"{SRC}, {LOCATION_CTES}, {COMPANY_CTES} SELECT title, company_extracted, {n()} AS n FROM companied GROUP BY ALL")
def company_query(spark, sf_dir):
    return per_title(with_company(with_location(titles(spark, sf_dir))), "company_extracted")


# --- filters and the enrichment projection ----------------------------------------------------------
NAV = ", ".join(q(x) for x in vocab.NAVIGATION_TITLES)
STRIPPED = r"trim(regexp_replace(trim(title), '(?i)\s*[\-|]\s*mobijake\b.*$', ''))"
ACCEPTED = f"coalesce(length(title) >= 4 AND NOT regexp_matches(title, '(?i)^https?://') AND {FOLDED.format('title')} NOT IN ({NAV}), false)"


@query("strip_noise", f"{SRC} SELECT title, {STRIPPED} AS stripped, {n()} AS n FROM src GROUP BY ALL")
def strip_noise_query(spark, sf_dir):
    return per_title(titles(spark, sf_dir).withColumn("stripped", rules.strip_noise(title())), "stripped")


SPLIT = f"{SRC}, clean AS (SELECT * EXCLUDE (title), {STRIPPED} AS title FROM src)"


@query("is_posting_title", f"{SPLIT} SELECT title, {ACCEPTED} AS accepted, {n()} AS n FROM clean GROUP BY ALL")
def posting_title_query(spark, sf_dir):
    df = titles(spark, sf_dir).withColumn("title", rules.strip_noise(title()))
    return per_title(df.withColumn("accepted", rules.is_posting_title(title())), "accepted")


@query("split_accept_reject", f"""{SPLIT} SELECT source, {ACCEPTED} AS accepted, {n()} AS records, count(DISTINCT title) AS titles
    FROM clean GROUP BY ALL""")
def split_query(spark, sf_dir):
    good, bad = split_accept_reject(titles(spark, sf_dir, "source"))
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.groupBy("source", "accepted").agg(
        F.sum("n").alias("records"), F.count_distinct("title").alias("titles"))


ENRICHED_SQL = f"""{SPLIT.replace(', src AS', ', raw AS').replace('FROM src)', 'FROM raw)')},
  src AS (SELECT * FROM clean WHERE {ACCEPTED}), {LOCATION_CTES}, {COMPANY_CTES},
  enriched AS (SELECT *, {', '.join(f'{s} AS {f}' for f, s in FLAG_SQL.items())}, {SENIORITY_SQL} AS seniority,
    {CATEGORY_SQL} AS job_category, strftime(l_shipdate, '%Y-%m-%d') AS date_archived FROM companied)"""
DERIVED = ["gender_marker", "is_internship", "remote_hint", "part_time_hint", "seniority", "job_category",
           "location_extracted", "company_extracted"]


def enriched_postings(spark, sf_dir):
    """Accepted titles with their number of rows and first timestamp."""
    counted = counted_titles(titled_postings(spark, sf_dir).groupBy("title").agg(
        F.min("l_shipdate").alias("first"), F.count(F.lit(1)).alias("n")))
    stamped = counted.withColumn("arquivo_timestamp", F.date_format("first", "yyyyMMddHHmmss"))
    return enrich(split_accept_reject(stamped)[0])


@query("enrich", f"{ENRICHED_SQL} SELECT title, {', '.join(DERIVED)}, min(date_archived) AS first_archived, {n()} AS n FROM enriched GROUP BY ALL")
def enrich_query(spark, sf_dir):
    return enriched_postings(spark, sf_dir).groupBy("title", *DERIVED).agg(
        F.min("date_archived").alias("first_archived"), F.sum("n").alias("n"))


@query("archived_date", """SELECT strftime(l_shipdate, '%Y%m%d%H%M%S') AS ts, strftime(l_shipdate, '%Y-%m-%d') AS archived,
    count(*) AS n FROM lineitem GROUP BY ALL""")
def archived_date_query(spark, sf_dir):
    ts = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyyMMddHHmmss").alias("ts"))
    return ts.select("ts", rules.archived_date(F.col("ts")).alias("archived")).groupBy("ts", "archived").agg(
        F.count(F.lit(1)).alias("n"))


PT_MONTHS = [m for m in vocab.MONTHS][:12]
MONTH_SQL = "CASE month(o_orderdate) " + " ".join(f"WHEN {i + 1} THEN '{m.title()}'" for i, m in enumerate(PT_MONTHS)) + " END"


@query("parse_named_date", f"""SELECT day(o_orderdate) || ' / ' || {MONTH_SQL} || ' / ' || year(o_orderdate) AS posted,
    CAST(o_orderdate AS DATE) AS parsed, count(*) AS n FROM orders GROUP BY ALL""")
def named_date_query(spark, sf_dir):
    posted = F.expr(f"day(o_orderdate) || ' / ' || {MONTH_SQL} || ' / ' || year(o_orderdate)")
    df = table(spark, sf_dir, "orders").select(posted.alias("posted"))
    return df.withColumn("parsed", rules.parse_named_date(F.col("posted"))).groupBy("posted", "parsed").agg(
        F.count(F.lit(1)).alias("n"))


@query("normalise_date_posted", """SELECT strftime(o_orderdate, '%d.%m.%Y') AS posted, count(*) AS n FROM orders GROUP BY ALL""")
def date_posted_query(spark, sf_dir):
    text = F.concat(F.lit("Publicado em "), F.date_format("o_orderdate", "dd/MM-yyyy"), F.lit(" | "),
                    F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(rules.normalise_date_posted(text).alias("posted")).groupBy(
        "posted").agg(F.count(F.lit(1)).alias("n"))


# --- row maintenance ---------------------------------------------------------------------------------
ROW_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
ROW_ORDER_SQL = ", ".join(ROW_ORDER)


@query("dedup_first", f"""WITH {TITLED_SQL} SELECT record_id, title, l_shipdate, l_partkey FROM (SELECT *,
    row_number() OVER (PARTITION BY record_id ORDER BY {ROW_ORDER_SQL}) AS rn FROM titled) WHERE rn = 1""")
def dedup_query(spark, sf_dir):
    return dedup_first(titled_postings(spark, sf_dir), "record_id", ROW_ORDER).select(
        "record_id", "title", "l_shipdate", "l_partkey")


@query("compact_raw", f"""WITH {TITLED_SQL}, raw AS (SELECT *, CASE WHEN l_quantity = 7 THEN '' ELSE record_id END AS rid FROM titled),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY {ROW_ORDER_SQL}) AS rn FROM raw)
    SELECT year(l_shipdate)::INTEGER AS year, (rid = '') AS without_id, {n()} AS records, count(DISTINCT rid) AS ids
    FROM ranked WHERE rid = '' OR rn = 1 GROUP BY ALL""")
def compact_query(spark, sf_dir):
    """Records without an id are all kept, the others once."""
    raw = titled_postings(spark, sf_dir).withColumns({
        "record_id": F.when(F.col("l_quantity") == 7, "").otherwise(F.col("record_id")),
        "year": F.year("l_shipdate"), "row_ord": F.struct(*ROW_ORDER, "l_orderkey", "l_linenumber")})
    once = compact_raw(raw, columns=["record_id", "year", "title"])
    return once.groupBy("year", (F.col("record_id") == "").alias("without_id")).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("record_id").alias("ids"))


@query("union_sources", f"""WITH {STAR_POSTINGS_SQL}, u AS (SELECT *, row_number() OVER (PARTITION BY record_id
      ORDER BY CASE source WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, date_archived, title, company_extracted,
        job_category, location_extracted) AS rn FROM postings)
    SELECT source, CAST(CASE source WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS INTEGER) AS source_priority,
      {n()} AS records, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM u GROUP BY ALL""")
def union_query(spark, sf_dir):
    rows = star_postings(spark, sf_dir)
    parts = {s: rows.filter(F.col("source") == s).drop("source") for s in ("N", "R", "A")}
    whole = union_sources({**parts, "absent": None})
    order = ["source_priority", "date_archived", "title", "company_extracted", "job_category", "location_extracted"]
    kept = dedup_first(whole, "record_id", [F.col(c).asc_nulls_last() for c in order])
    left = whole.groupBy("source", "source_priority").agg(F.count(F.lit(1)).alias("records"))
    return left.join(kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept")), "source")


HELD = ("record_id", "year", "title", "source", *DERIVED, "date_archived")


@query("align_schema", f"WITH {STAR_POSTINGS_SQL} " + " UNION ALL ".join(
    f"SELECT {q(f.name)} AS column_name, {q(f.dataType.simpleString())} AS data_type, "
    + (f"count({f.name})" if f.name in HELD else "count(NULL)") + " AS present FROM postings"
    for f in ENRICHED_POSTING))
def align_query(spark, sf_dir):
    return coverage(align_schema(star_postings(spark, sf_dir))).select("column_name", "data_type", "present")


@query("prepare_dataset", f"""WITH {STAR_POSTINGS_SQL} SELECT year, seniority, location_extracted, gender_marker,
      (is_internship AND source <> 'R') AS is_internship, {n()} AS records FROM postings
    WHERE seniority <> 'junior' GROUP BY ALL""")
def prepare_query(spark, sf_dir):
    """Typed again from text columns with null spellings, bad years and missing flags."""
    text = star_postings(spark, sf_dir).select(
        "record_id", "title", "source", "job_category", "company_extracted", "remote_hint", "part_time_hint",
        F.when(F.col("seniority") == "junior", "n/d").otherwise(F.concat(F.col("year").cast("string"), F.lit(".0"))).alias("year"),
        F.concat(F.lit(" "), F.col("seniority")).alias("seniority"),
        F.coalesce("location_extracted", F.when(F.col("source") == "A", "nan").when(F.col("source") == "N", "None")
                   .otherwise(" ")).alias("location_extracted"),
        F.when(F.col("gender_marker"), "True").otherwise("False").alias("gender_marker"),
        F.when(F.col("source") != "R", F.col("is_internship").cast("string")).alias("is_internship"),
    )
    return prepare_dataset(text).groupBy(
        "year", "seniority", "location_extracted", "gender_marker", "is_internship").agg(F.count(F.lit(1)).alias("records"))


@query("counts_by_year", f"""SELECT CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(year(o_orderdate) AS INTEGER) END AS year,
    {n()} AS records FROM orders GROUP BY 1""")
def counts_query(spark, sf_dir):
    year = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))
    return counts_by_year(table(spark, sf_dir, "orders").select(year.alias("year")))


@query("value_distribution_log", f"""WITH {STAR_POSTINGS_SQL} SELECT 'job_category' AS dimension, job_category AS value, {n()} AS count
    FROM postings WHERE job_category IS NOT NULL GROUP BY ALL UNION ALL
    SELECT 'source', source, {n()} FROM postings WHERE source IS NOT NULL GROUP BY ALL""")
def distribution_log(spark, sf_dir):
    out = []
    for c in ("job_category", "source"):
        cube = star_postings(spark, sf_dir, (c,)).groupBy(c).agg(F.count(F.lit(1)).alias("n_rows"))
        out.append(value_counts_share(cube, c).select(F.lit(c).alias("dimension"), F.col(c).alias("value"), "count"))
    return out[0].unionByName(out[1])


@query("export_search_corpus", f"""WITH {STAR_POSTINGS_SQL} SELECT year, title, job_category AS category,
    'example.org/' || title AS url, {n()} AS n FROM postings GROUP BY ALL""")
def corpus_query(spark, sf_dir):
    rows = star_postings(spark, sf_dir, ("year", "title", "job_category")).withColumn(
        "wayback_url", F.concat(F.lit("example.org/"), "title"))
    return export_search_corpus(rows).groupBy("year", "title", "category", "url").agg(F.count(F.lit(1)).alias("n"))


@query("incremental_new", """SELECT l_orderkey || '-' || l_linenumber AS record_id, count(*) AS n FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1""")
def incremental_query(spark, sf_dir):
    """Lines of orders that have not landed (here: not finished) yet."""
    landed = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    new = incremental_new(table(spark, sf_dir, "lineitem"), landed, "l_orderkey")
    rid = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return new.groupBy(rid.alias("record_id")).agg(F.count(F.lit(1)).alias("n"))


# --- annotations -----------------------------------------------------------------------------------
# One response per labelled document.  The wrapping and the values vary with the columns so
# that every branch of the parser is taken; the SQL side states the expected fields directly.
ANN_CATEGORY = """(CASE WHEN l.toxic = 1 THEN 'Hotelaria' WHEN d.lang = 'de' THEN 'Agricultura & Ambiente'
  WHEN d.lang = 'es' THEN 'IT' WHEN d.lang = 'fr' AND l.quality = 0 THEN 'ab' WHEN d.lang = 'fr' THEN 'Outros'
  ELSE 'Eventos' END)"""
ANN_CATEGORY_CONF = "(CASE WHEN l.quality = 1 THEN 0.9 ELSE 0.7 END)"
ANN_BODY = f"""('{{"' || d.doc_id || '": {{"is_job": ' || (CASE WHEN l.toxic = 1 THEN 'false' ELSE 'true' END)
  || ', "company": ' || (CASE WHEN d.lang = 'en' THEN '"' || d.source || '"' ELSE 'null' END)
  || ', "company_conf": ' || (CASE WHEN l.quality = 1 THEN '1.7' ELSE '"bad"' END)
  || ', "location": "' || (CASE WHEN d.lang = 'es' THEN ' ' ELSE 'Porto' END) || '", "location_conf": "0.8"'
  || ', "category": "' || {ANN_CATEGORY} || '", "category_conf": ' || {ANN_CATEGORY_CONF} || '}}, "note": 3}}')"""
ANN_TEXT = f"(CASE WHEN l.quality = 1 THEN {ANN_BODY} WHEN d.n_chars > 3000 THEN '[' || {ANN_BODY} || ']' ELSE 'Result: ' || {ANN_BODY} || ' done' END)"
ANN_SQL = f"""ann AS (SELECT CAST(d.doc_id AS VARCHAR) AS record_id, l.toxic = 0 AS is_job,
    CASE WHEN d.lang = 'en' THEN d.source END AS company, CASE WHEN l.quality = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS company_conf,
    CASE WHEN d.lang <> 'es' THEN 'Porto' END AS location, 0.8::DOUBLE AS location_conf, {ANN_CATEGORY} AS category,
    {ANN_CATEGORY_CONF}::DOUBLE AS category_conf
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality = 1 OR d.n_chars <= 3000)"""
LABELS = ", ".join(q(x) for x in vocab.CATEGORY_LABELS)
# every new label of the fixture passes the acceptance rule in some confident row
RESOLVED_SQL = f"""{ANN_SQL}, accepted AS (SELECT DISTINCT category FROM ann WHERE category NOT IN ({LABELS}, 'Hotelaria')
    AND length(category) BETWEEN 3 AND 60 AND category_conf >= 0.75),
  resolved AS (SELECT ann.* EXCLUDE (category, category_conf),
    CASE WHEN category = 'Hotelaria' THEN 'Restauração & Hotelaria'
      WHEN category IN ({LABELS}) OR category IN (SELECT category FROM accepted) THEN category ELSE 'Outros' END AS category,
    CASE WHEN category = 'Hotelaria' OR category IN ({LABELS}) OR category IN (SELECT category FROM accepted)
      THEN category_conf ELSE 0.0 END AS category_conf FROM ann)"""


def parsed_annotations(spark, sf_dir):
    """Responses of the labelled documents, parsed."""
    joined = table(spark, sf_dir, "labels").alias("l").join(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").alias("d"),
        F.col("l.doc_id") == F.col("d.doc_id"))
    return ann_ops.parse_annotation_response(joined.select(F.expr(ANN_TEXT).alias("response")))


@query("parse_annotation_response", f"WITH {ANN_SQL} SELECT * FROM ann")
def parse_query(spark, sf_dir):
    return parsed_annotations(spark, sf_dir)


@query("clamp_conf", "SELECT l_orderkey, l_linenumber, least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_discount * 20 - 0.5)) AS conf, count(*) AS n FROM lineitem GROUP BY ALL")
def clamp_query(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", ann_ops.clamp_conf(F.col("l_discount") * 20 - 0.5).alias("conf")
    ).groupBy("l_orderkey", "l_linenumber", "conf").agg(F.count(F.lit(1)).alias("n"))


@query("resolve_category", f"WITH {RESOLVED_SQL} SELECT * FROM resolved")
def resolve_query(spark, sf_dir):
    return ann_ops.resolve_category(parsed_annotations(spark, sf_dir))


@query("custom_vocab", f"WITH {RESOLVED_SQL} SELECT category FROM accepted WHERE category <> 'Outros'")
def custom_vocab_query(spark, sf_dir):
    return ann_ops.custom_labels(ann_ops.discovered_labels(parsed_annotations(spark, sf_dir)))


@query("annotation_stats", f"WITH {RESOLVED_SQL} " + " UNION ALL ".join(
    f"""SELECT '{f}' AS field, {rnd(f'avg({f}_conf)', 2)} AS mean_conf,
    CAST(sum(CASE WHEN {f}_conf < 0.75 THEN 1 ELSE 0 END) AS BIGINT) AS below_threshold, {n(f'{f}_conf')} AS n FROM resolved"""
    for f in ("category", "location", "company")))
def annotation_stats_query(spark, sf_dir):
    return ann_ops.annotation_stats(ann_ops.resolve_category(parsed_annotations(spark, sf_dir)))


def doc_postings(spark, sf_dir):
    """Documents as enriched postings that still miss fields."""
    d = documents(spark, sf_dir)
    return d.select(
        F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("title"),
        F.concat(F.lit("http://example.org/"), F.col("doc_id").cast("string")).alias("original_url"),
        F.when(F.col("lang") == "de", F.col("source")).alias("company_extracted"),
        F.when(F.col("n_chars") > 1500, F.lit("Lisboa")).alias("location_extracted"),
        F.when(F.col("lang") == "fr", F.lit("Outros")).when(F.col("lang") == "en", F.lit("Banca"))
        .otherwise(F.lit("IT")).alias("job_category"),
    )


DOCP_SQL = """docp AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, text AS title, 'http://example.org/' || doc_id AS original_url,
    CASE WHEN lang = 'de' THEN source END AS company_extracted, CASE WHEN n_chars > 1500 THEN 'Lisboa' END AS location_extracted,
    CASE lang WHEN 'fr' THEN 'Outros' WHEN 'en' THEN 'Banca' ELSE 'IT' END AS job_category FROM documents)"""


@query("merge_annotations", f"""WITH {RESOLVED_SQL}, {DOCP_SQL} SELECT p.record_id,
    CASE WHEN company_extracted IS NULL AND company <> '' AND company_conf >= 0.75 THEN company ELSE company_extracted END AS company_extracted,
    CASE WHEN location_extracted IS NULL AND location <> '' AND location_conf >= 0.75 THEN location ELSE location_extracted END AS location_extracted,
    CASE WHEN job_category = 'Outros' AND category <> 'Outros' AND category_conf >= 0.65 THEN category ELSE job_category END AS job_category
    FROM docp p LEFT JOIN resolved r ON p.record_id = r.record_id""")
def merge_query(spark, sf_dir):
    resolved = ann_ops.resolve_category(parsed_annotations(spark, sf_dir))
    return ann_ops.merge_annotations(doc_postings(spark, sf_dir), resolved).select(
        "record_id", "company_extracted", "location_extracted", "job_category")


@query("latest_annotations", f"""WITH {ANN_SQL}, b AS (SELECT *, 1 AS batch FROM ann UNION ALL
      SELECT * REPLACE ('IT' AS category), 2 AS batch FROM ann WHERE company IS NOT NULL)
    SELECT record_id, category, batch FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY batch DESC) AS rn FROM b) WHERE rn = 1""")
def latest_query(spark, sf_dir):
    first = parsed_annotations(spark, sf_dir).withColumn("batch", F.lit(1))
    again = first.filter("company IS NOT NULL").withColumns({"category": F.lit("IT"), "batch": F.lit(2)})
    return ann_ops.latest_annotations(first.unionByName(again), "batch").select("record_id", "category", "batch")


@query("consolidate_categories", f"""WITH {DOCP_SQL} SELECT CASE job_category WHEN 'Banca' THEN 'Finanças & Contab.' ELSE job_category END AS job_category,
    {n()} AS records FROM docp GROUP BY 1""")
def consolidate_query(spark, sf_dir):
    return ann_ops.consolidate_categories(doc_postings(spark, sf_dir)).groupBy("job_category").agg(
        F.count(F.lit(1)).alias("records"))


NEEDED = f"""{DOCP_SQL}, needed AS (SELECT record_id, title, original_url FROM docp
    WHERE company_extracted IS NULL OR location_extracted IS NULL OR job_category = 'Outros')"""
PENDING = f"""{NEEDED}, pending AS (SELECT * FROM needed WHERE record_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels))"""
BATCHES = f"""{PENDING}, numbered AS (SELECT *, substr(md5(record_id), 1, 2) AS bucket,
      row_number() OVER (PARTITION BY substr(md5(record_id), 1, 2) ORDER BY record_id) - 1 AS k FROM pending),
    batches AS (SELECT bucket || '-' || CAST(floor(k / 3.0) AS BIGINT) AS batch_id,
      string_agg('- id=' || record_id || ' | title=' || title || ' | url=' || original_url, chr(10) ORDER BY k) AS text,
      CAST(count(*) AS INTEGER) AS n_items FROM numbered GROUP BY 1)"""


def pending_postings(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("record_id"))
    return ann_ops.pending(ann_ops.needs_annotation(doc_postings(spark, sf_dir)), done)


@query("needs_annotation", f"WITH {NEEDED} SELECT record_id, original_url, md5(title) AS title_md5 FROM needed")
def needs_query(spark, sf_dir):
    return ann_ops.needs_annotation(doc_postings(spark, sf_dir)).select(
        "record_id", "original_url", digest(F.col("title")).alias("title_md5"))


@query("pending", f"WITH {PENDING} SELECT record_id FROM pending")
def pending_query(spark, sf_dir):
    return pending_postings(spark, sf_dir).select("record_id")


@query("make_batches", f"WITH {BATCHES} SELECT batch_id, n_items FROM batches")
def batches_query(spark, sf_dir):
    return ann_ops.make_batches(pending_postings(spark, sf_dir), "record_id", size=3).select(
        "batch_id", F.size("items").alias("n_items"))


@query("render_items", f"WITH {BATCHES} SELECT batch_id, n_items, md5(text) AS text_md5 FROM batches")
def render_query(spark, sf_dir):
    batches = ann_ops.make_batches(pending_postings(spark, sf_dir), "record_id", size=3)
    return ann_ops.render_items(batches).select("batch_id", "n_items", digest(F.col("text")).alias("text_md5"))
