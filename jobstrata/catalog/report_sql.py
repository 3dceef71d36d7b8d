"""DuckDB statements equal to the report sections, for the driver's side-by-side check."""

from jobstrata import vocab
from jobstrata.config import FLAGS
from jobstrata.sources.tables import (
    DOCUMENT_POSTINGS_SQL, DOCUMENT_SETTINGS, STAR_POSTINGS_SQL, STAR_SETTINGS,
)

S = STAR_SETTINGS


def q(text):
    return "'" + str(text).replace("'", "''") + "'"


def pct(part, whole, digits=4):
    return f"coalesce(round_even(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0), {digits}), 0.0)"


def rnd(x, digits=4):
    return f"round_even({x}, {digits})"


def n(x="*"):
    return f"CAST(count({x}) AS BIGINT)"


def total(x):
    return f"CAST(sum({x}) AS BIGINT)"


def case_period(periods, attribute="name", year="year", default="NULL"):
    arms = " ".join(
        f"WHEN {year} BETWEEN {p.start} AND {p.end} THEN "
        + (q(getattr(p, attribute)) if isinstance(getattr(p, attribute), str) else str(getattr(p, attribute)))
        for p in periods
    )
    return f"CASE {arms} ELSE {default} END"


def label_case(periods, attribute, column="period"):
    arms = " ".join(
        f"WHEN {q(p.name)} THEN "
        + (q(getattr(p, attribute)) if isinstance(getattr(p, attribute), str) else str(getattr(p, attribute)))
        for p in periods
    )
    return f"CASE {column} {arms} END"


def hhi(c):
    return rnd(f"sum(CAST({c} AS DOUBLE) * {c}) / pow(CAST(sum({c}) AS DOUBLE), 2)")


def star(body, extra=""):
    return f"WITH {STAR_POSTINGS_SQL}{',' + extra if extra else ''}\n{body}"


def docs(body, extra=""):
    return f"WITH {DOCUMENT_POSTINGS_SQL}{',' + extra if extra else ''}\n{body}"


LABEL = label_case(S.periods, "label")
P_NAME = case_period(S.periods)
FLAG_ROWS = " UNION ALL ".join(
    f"SELECT {q(f)} AS flag, {total(f'CAST({f} AS INTEGER)')} AS positives, count(*) AS total FROM postings"
    for f in FLAGS
)
NOISE = ", ".join(q(x) for x in S.place_noise)
CLEAN = f"clean AS (SELECT * FROM postings WHERE company_extracted IS NOT NULL AND lower(company_extracted) NOT IN ({NOISE}))"
LOCATED = "located AS (SELECT * FROM postings WHERE location_extracted IS NOT NULL)"
LO, HI = S.baseline_years


def source_table(flag, digits=6):
    rate = f"sum(CAST({flag} AS INTEGER)) / CAST(count(*) AS DOUBLE)"
    rate = rnd(rate, digits) if digits else rate
    in_base = f"sum(CASE WHEN year BETWEEN {LO} AND {HI} THEN 1 ELSE 0 END)"
    return f"""SELECT source, {in_base} AS n_base,
      {pct(in_base, f'sum({in_base}) OVER ()', 6)} AS weight, {rate} AS rate
      FROM postings WHERE source IS NOT NULL GROUP BY source"""


ADJUSTED = f"SELECT round_even(sum(weight * rate), 4) FROM ({source_table('gender_marker')})"


def yearly(column, source="postings"):
    return f"""SELECT year, coalesce({column}, 'Unknown') AS {column}, {n()} AS count,
      {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY year)')} AS share
      FROM {source} GROUP BY year, coalesce({column}, 'Unknown')"""


def value_counts(column):
    return star(f"""SELECT {column}, {n()} AS count, {pct('count(*)', '(SELECT count(*) FROM postings)')} AS share
      FROM postings WHERE {column} IS NOT NULL GROUP BY {column}""")


def profile(column, source="postings", having=""):
    return f"""SELECT {column}, {n('record_id')} AS total,
      {rnd('avg(CAST(gender_marker AS DOUBLE))')} AS gender_rate,
      {rnd('avg(CAST(is_internship AS DOUBLE))')} AS internship_rate,
      {rnd('avg(CAST(part_time_hint AS DOUBLE))')} AS part_time_rate
      FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} {having}"""


def rate_by(keys, flag, count="count", rate="rate"):
    where = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return f"""SELECT {keys}, {n('record_id')} AS total, {total(f'CAST({flag} AS INTEGER)')} AS {count},
      {rnd(f'avg(CAST({flag} AS DOUBLE))')} AS {rate} FROM postings WHERE {where} GROUP BY {keys}"""


def period_distribution(column):
    return f"""SELECT period, {column}, count, {pct('count', 'sum(count) OVER (PARTITION BY period)')} AS share,
      {LABEL} AS period_label, CAST({label_case(S.periods, 'start')} AS INTEGER) AS start_year,
      CAST({label_case(S.periods, 'end')} AS INTEGER) AS end_year
      FROM (SELECT {P_NAME} AS period, coalesce({column}, 'Unknown') AS {column}, {n()} AS count
        FROM postings GROUP BY 1, 2) WHERE period IS NOT NULL"""


def movers(column, direction):
    first, last = S.periods[0].name, S.periods[-1].name
    cols = ", ".join(
        f"sum(CASE WHEN period = {q(p.name)} THEN share ELSE 0.0 END) AS {p.name}" for p in S.periods
    )
    return star(f"""SELECT *, {rnd(f'{last} - {first}')} AS share_delta,
      {rnd(f'{last} / nullif({first}, 0)', 2)} AS relative_multiplier
      FROM (SELECT {column}, {cols} FROM ({period_distribution(column)}) GROUP BY {column})
      ORDER BY share_delta {direction}, {column} LIMIT {S.movers}""")


def top_by_period(column, k, source, whole, share="share", name=None):
    name = name or column
    return f"""SELECT * EXCLUDE (rn, n), {pct('count', 'n')} AS {share}
      FROM (SELECT t.*, w.n, row_number() OVER (PARTITION BY t.period ORDER BY count DESC, {name}) AS rn
        FROM (SELECT {P_NAME} AS period, {column} AS {name}, {n()} AS count FROM {source}
          WHERE {column} IS NOT NULL GROUP BY 1, 2) t
        JOIN (SELECT {P_NAME} AS period, count(*) AS n FROM {whole} GROUP BY 1) w ON t.period = w.period)
      WHERE rn <= {k}"""


def long_run():
    return f"""SELECT job_category, first_year, last_year, first_count, last_count,
      last_count - first_count AS count_delta, first_share, last_share,
      {rnd('last_share - first_share')} AS share_delta,
      CASE WHEN first_count > 0 AND last_count > 0 AND last_year > first_year
        THEN {rnd('pow(CAST(last_count AS DOUBLE) / first_count, 1.0 / (last_year - first_year)) - 1')} END AS count_cagr,
      peak_year, peak_count
      FROM (SELECT job_category, first_year, last_year,
        {total('CASE WHEN year = first_year THEN count ELSE 0 END')} AS first_count,
        {total('CASE WHEN year = last_year THEN count ELSE 0 END')} AS last_count,
        {rnd('sum(CASE WHEN year = first_year THEN share ELSE 0.0 END)')} AS first_share,
        {rnd('sum(CASE WHEN year = last_year THEN share ELSE 0.0 END)')} AS last_share,
        arg_min(year, (-count, year)) AS peak_year, max(count) AS peak_count
        FROM ({yearly('job_category')}) y,
          (SELECT min(year) AS first_year, max(year) AS last_year FROM postings) b
        GROUP BY ALL)"""


def edge(column, direction, source="lr"):
    return f"SELECT * FROM {source} WHERE {column} IS NOT NULL ORDER BY {column} {direction}, job_category LIMIT {S.movers}"


LR = f"lr AS ({long_run()})"


def per_flag(key):
    arms = " UNION ALL ".join(
        f"""SELECT {q(f)} AS flag, {key}, {n('record_id')} AS total, {total(f'CAST({f} AS INTEGER)')} AS count,
        {rnd(f'avg(CAST({f} AS DOUBLE))')} AS rate FROM postings WHERE {key} IS NOT NULL GROUP BY {key}"""
        for f in FLAGS
    )
    return star(f"""SELECT a.* FROM ({arms}) a JOIN ({FLAG_ROWS}) t ON a.flag = t.flag
      WHERE t.positives >= {S.min_flag_positives}""")


def title_stats(measure):
    return docs(f"""SELECT {rnd('avg(v)', 1)} AS mean, {rnd('quantile_cont(v, 0.5)', 1)} AS median,
      {rnd('quantile_cont(v, 0.1)', 1)} AS p10, {rnd('quantile_cont(v, 0.9)', 1)} AS p90,
      CAST(max(v) AS DOUBLE) AS max, CAST(min(v) AS DOUBLE) AS min
      FROM (SELECT CAST({measure} AS DOUBLE) AS v FROM docs WHERE title IS NOT NULL)""")


# --- tokens of whole document texts ----------------------------------------------------
STOPS = ", ".join(q(w) for w in dict.fromkeys(vocab.STOPWORDS))
TOKENS = rf"""toks AS (
  SELECT doc_id, year, list_filter(regexp_extract_all(lower(strip_accents(title)), '[a-z0-9+#.]{{2,}}'),
    lambda t: NOT list_contains([{STOPS}], t) AND NOT regexp_full_match(t, '[0-9]+')) AS kept FROM docs)"""
TOKEN_ROWS = TOKENS + """, tok AS (SELECT doc_id, year, unnest(kept) AS token, generate_subscripts(kept, 1) AS pos FROM toks)"""
BIGRAM_ROWS = TOKENS + """, big AS (SELECT year, unnest(list_transform(list_zip(kept[1:len(kept)-1], kept[2:]),
  lambda z: z[1] || ' ' || z[2])) AS bigram FROM toks WHERE len(kept) > 1)"""
D = DOCUMENT_SETTINGS
D_NAME = case_period(D.periods)


def top_terms(rows, term, k, extra, cols):
    return docs(f"""SELECT {cols} FROM (
      SELECT t.*, w.n, row_number() OVER (PARTITION BY t.period ORDER BY count DESC, {term}) AS rn
      FROM (SELECT {D_NAME} AS period, {rows[1]} AS {term}, {n()} AS count FROM {rows[0]} GROUP BY 1, 2) t
      JOIN (SELECT {D_NAME} AS period, count(*) AS n FROM docs GROUP BY 1) w ON t.period = w.period)
      WHERE rn <= {k}""", extra)


FIRST_P, LAST_P = D.periods[0], D.periods[-1]
EMERGENCE = TOKEN_ROWS + f""", edges AS (
    SELECT (year BETWEEN {LAST_P.start} AND {LAST_P.end}) AS is_last, token AS keyword, count(*) AS c,
      min((doc_id, pos)) AS first_at FROM tok
    WHERE year BETWEEN {FIRST_P.start} AND {FIRST_P.end} OR year BETWEEN {LAST_P.start} AND {LAST_P.end}
    GROUP BY 1, 2),
  chosen AS (SELECT DISTINCT keyword FROM (SELECT keyword,
      row_number() OVER (PARTITION BY is_last ORDER BY first_at, keyword) AS rn FROM edges)
    WHERE rn <= {D.emergence_candidates}),
  sizes AS (SELECT
      {total(f'CASE WHEN year BETWEEN {FIRST_P.start} AND {FIRST_P.end} THEN 1 ELSE 0 END')} AS n_first_period,
      {total(f'CASE WHEN year BETWEEN {LAST_P.start} AND {LAST_P.end} THEN 1 ELSE 0 END')} AS n_last_period FROM docs),
  em AS (SELECT keyword, first_period_share, last_period_share,
      {rnd('last_period_share - first_period_share')} AS share_delta, n_first_period, n_last_period,
      (n_first_period < {D.sparse_period} OR n_last_period < {D.sparse_period}) AS low_n_warning
    FROM (SELECT keyword, n_first_period, n_last_period,
        {pct('sum(CASE WHEN is_last THEN 0 ELSE c END)', 'n_first_period')} AS first_period_share,
        {pct('sum(CASE WHEN is_last THEN c ELSE 0 END)', 'n_last_period')} AS last_period_share
      FROM edges SEMI JOIN chosen USING (keyword), sizes GROUP BY keyword, n_first_period, n_last_period))"""

CORR = " UNION ALL ".join(
    f"SELECT {q(a)} AS flag_a, {q(b)} AS flag_b, {rnd(f'corr(CAST({a} AS INTEGER), CAST({b} AS INTEGER))')} AS pearson_r FROM postings"
    for a in FLAGS for b in FLAGS if S.suppressed_flag not in (a, b)
)
COVERAGE = " UNION ALL ".join(
    f"""SELECT {q(c)} AS column_name, {n(c)} AS present, {n()} - {n(c)} AS missing, {pct(f'count({c})', 'count(*)')} AS coverage_rate,
    {q(t)} AS data_type FROM postings"""
    for c, t in [("record_id", "string"), ("year", "int"), ("title", "string"), ("source", "string"),
                 *[(f, "boolean") for f in FLAGS], ("job_category", "string"), ("seniority", "string"),
                 ("location_extracted", "string"), ("company_extracted", "string"), ("date_archived", "date")]
)
def missing(digits):
    def share(cond):
        part = f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)"
        return pct(part, "count(*)") if digits == 4 else f"CAST({rnd(f'{part} / CAST(count(*) AS DOUBLE) * 100', 1)} AS VARCHAR)"

    return f"""SELECT {share(f"seniority = {q(S.dominant_seniority)}")} AS dominant_seniority_rate,
    {share('location_extracted IS NULL')} AS location_missing_rate,
    {total('CAST(remote_hint AS INTEGER)')} AS suppressed_flag_positives,
    {share('company_extracted IS NULL')} AS company_missing_rate FROM postings"""


a, b = S.focus_places
i_w, g_w, s_w = S.vulnerability_weights
SENIOR = ", ".join(q(x) for x in S.senior_levels)
INTERN = f"""SELECT job_category, {n('record_id')} AS total, {total('CAST(is_internship AS INTEGER)')} AS intern_count,
  avg(CAST(is_internship AS DOUBLE)) AS raw_rate, {rnd('avg(CAST(is_internship AS DOUBLE))')} AS intern_rate,
  {rnd('sum(CAST(is_internship AS INTEGER)) / CAST((SELECT sum(CAST(is_internship AS INTEGER)) FROM postings) AS DOUBLE)')} AS share_of_all_interns
  FROM postings WHERE job_category IS NOT NULL GROUP BY job_category"""
MARKET = "(SELECT sum(CAST(is_internship AS INTEGER)) / CAST(count(*) AS DOUBLE) FROM postings)"

REPORT_SQL = {
    "source_weights": star(f"SELECT source, weight FROM ({source_table('gender_marker')}) WHERE n_base > 0"),
    "source_rates": star(f"SELECT source, rate FROM ({source_table('gender_marker')})"),
    "composition_adjusted_rate": star(" UNION ALL ".join(
        f"SELECT {q(f)} AS flag, {rnd('sum(weight * rate)')} AS adjusted_rate FROM "
        f"({source_table(f, 6 if f == S.adjusted_flag else None)})" for f in FLAGS)),
    "archive_confidence": star(f"""SELECT year, n_ads, n_sources, volume_score, source_entropy_score, source_count_score,
        confidence, n_ads < {S.sparse_year} AS is_sparse,
        CASE WHEN confidence >= 0.65 THEN 'high' WHEN confidence >= 0.40 THEN 'medium' ELSE 'low' END AS reliability_tier
      FROM (SELECT *, {rnd('(volume_score + source_entropy_score + source_count_score) / 3', 3)} AS confidence
      FROM (SELECT year, {total('c')} AS n_ads, {n('source')} AS n_sources,
          {rnd(f'1 / (1 + exp(-{S.volume_slope} * (sum(c) - {S.volume_midpoint})))', 3)} AS volume_score,
          CASE WHEN count(source) > 1 THEN {rnd('sum(CASE WHEN source IS NOT NULL THEN -(c / t) * log2(c / t) END) / log2(count(source))', 3)}
            ELSE 0.0 END AS source_entropy_score,
          {pct('count(source)', '(SELECT count(*) FROM (SELECT DISTINCT source FROM postings))', 3)} AS source_count_score
        FROM (SELECT year, source, c, sum(CASE WHEN source IS NOT NULL THEN c END) OVER (PARTITION BY year) AS t
          FROM (SELECT year, source, CAST(count(*) AS DOUBLE) AS c FROM postings GROUP BY ALL)) GROUP BY year))"""),
    "dq.coverage": star(COVERAGE),
    "dq.duplicates": star(f"""SELECT
        {n()} - (SELECT count(*) FROM (SELECT DISTINCT record_id FROM postings)) AS duplicate_record_ids,
        {n()} - (SELECT count(*) FROM (SELECT DISTINCT title, year FROM postings)) AS duplicate_title_year FROM postings"""),
    "dq.snapshot_dates": star("""SELECT CAST(min(date_archived) AS VARCHAR) AS first_date,
        CAST(max(date_archived) AS VARCHAR) AS last_date FROM postings"""),
    "dq.year_quality": star(f"""SELECT year, {n()} AS records, count(*) < {S.sparse_year} AS is_sparse,
        CASE WHEN count(*) < {S.sparse_year} THEN 'sparse_archive' ELSE 'ok' END AS flag FROM postings GROUP BY year"""),
    "dq.sources_by_year": star("SELECT year, count(DISTINCT source) AS n_sources FROM postings GROUP BY year"),
    "dq.flag_reliability": star(f"""SELECT flag, positives, {pct('positives', 'total')} AS rate,
        positives >= {S.min_flag_positives} AS reliable,
        CASE WHEN positives < {S.min_flag_positives} THEN 'suppressed: too few positives'
          WHEN flag = 'gender_marker' THEN 'cross-sectional use only' ELSE 'ok' END AS note FROM ({FLAG_ROWS})"""),
    "dq.place_names_as_company": star(f"""SELECT company_extracted, {n()} AS count FROM postings
        WHERE lower(company_extracted) IN ({NOISE}) GROUP BY 1"""),
    "dq.missing_rates": star(missing(4)),
    "dq.warnings": star(f"""SELECT CAST(ord AS INTEGER) AS ord, warning FROM (SELECT
        unnest([0, 1, 2, 3, 4]) AS ord,
        unnest(['gender_marker: read the source-adjusted rate; the raw series follows the source mix',
         'remote_hint: only ' || suppressed_flag_positives || ' positives',
         'location_extracted missing in ' || location_missing_rate || '% of records',
         'company_extracted missing in ' || company_missing_rate || '% of records',
         'seniority={S.dominant_seniority} is ' || dominant_seniority_rate || '% of records']) AS warning
        FROM ({missing(1)}))"""),
    "kpis": star(f"""SELECT p.*, y.*, y.trough_year_count < {S.sparse_year} AS trough_is_sparse_archive,
        c.*, ({ADJUSTED}) AS gender_marker_rate_adjusted, true AS remote_hint_suppressed
      FROM (SELECT {n()} AS total_ads, count(DISTINCT job_category) AS unique_categories,
          count(DISTINCT location_extracted) AS unique_locations, count(DISTINCT year) AS year_span,
          min(year) AS year_min, max(year) AS year_max, {n('location_extracted')} AS ads_with_location,
          {pct('sum(CAST(gender_marker AS INTEGER))', 'count(*)')} AS gender_marker_rate_raw,
          {pct('sum(CAST(is_internship AS INTEGER))', 'count(*)')} AS internship_rate FROM postings) p,
        (SELECT arg_min(year, (-c, year)) AS peak_year, max(c) AS peak_year_count,
          arg_min(year, (c, year)) AS trough_year, min(c) AS trough_year_count
          FROM (SELECT year, {n()} AS c FROM postings GROUP BY year)) y,
        (SELECT count(DISTINCT company_extracted) AS unique_companies_clean, {n()} AS ads_with_company_clean FROM clean) c""", CLEAN),
    "metadata": star(f"""SELECT {n()} AS records, min(year) AS year_min, max(year) AS year_max,
        string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years FROM postings"""),
    "metadata.periods": star(f"""SELECT period, {LABEL} AS period_label,
        CAST({label_case(S.periods, 'start')} AS INTEGER) AS start_year,
        CAST({label_case(S.periods, 'end')} AS INTEGER) AS end_year, {n()} AS records
        FROM (SELECT {P_NAME} AS period FROM postings) WHERE period IS NOT NULL GROUP BY period"""),
    "ts.yearly_volume": star(f"""SELECT year, records, {rnd('CAST(records AS DOUBLE) / lag(records) OVER w - 1')} AS yoy_growth,
        coalesce(records - lag(records) OVER w, 0) AS yoy_delta,
        CASE WHEN count(*) OVER (ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 3 THEN
          {rnd('avg(records) OVER (ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)', 1)} END AS rolling_3y_avg,
        CAST(sum(records) OVER (ORDER BY year) AS BIGINT) AS cumulative,
        {case_period(S.periods, default="'unknown'")} AS period
        FROM (SELECT year, {n('record_id')} AS records FROM postings GROUP BY year) WINDOW w AS (ORDER BY year)"""),
    "ts.diversity_by_year": star(f"""SELECT year, {total('c')} AS records, {hhi('k')} AS category_hhi,
        {rnd('sum(-(k / t) * log2(k / t + 1e-12))')} AS category_entropy,
        {pct('sum(CASE WHEN rn <= 3 THEN k END)', 'sum(k)')} AS top3_share,
        {rnd(f'1 / nullif({hhi("k")}, 0)', 2)} AS effective_categories
        FROM (SELECT *, sum(k) OVER (PARTITION BY year) AS t,
            row_number() OVER (PARTITION BY year ORDER BY k DESC NULLS LAST, job_category) AS rn
          FROM (SELECT year, job_category, count(*) AS c,
            CASE WHEN job_category IS NOT NULL THEN CAST(count(*) AS DOUBLE) END AS k
            FROM postings GROUP BY year, job_category))
        GROUP BY year"""),
    "ts.category_by_year": star(yearly("job_category")),
    "ts.seniority_by_year": star(yearly("seniority")),
    "ts.top_locations_by_year": star(f"""SELECT * FROM ({yearly('location_extracted', 'located')})
        WHERE location_extracted IN (SELECT location_extracted FROM located GROUP BY 1
          ORDER BY count(*) DESC, location_extracted LIMIT 20)""", LOCATED),
    "ts.geographic_concentration": star(f"""SELECT year, n_located, {pct('x', 'n_located')} AS first_place_share,
        {pct('y', 'n_located')} AS second_place_share, {pct('x + y', 'n_located')} AS combined_share,
        {rnd('CAST(x AS DOUBLE) / nullif(y, 0)', 2)} AS place_ratio
        FROM (SELECT year, {n()} AS n_located, sum(CASE WHEN location_extracted = {q(a)} THEN 1 ELSE 0 END) AS x,
          sum(CASE WHEN location_extracted = {q(b)} THEN 1 ELSE 0 END) AS y FROM located GROUP BY year)
        WHERE n_located >= {S.min_located_per_year}""", LOCATED),
    "ts.flags_by_year": star(f"""SELECT year, {n('record_id')} AS total,
        {', '.join(f"{total(f'CAST({f} AS INTEGER)')} AS {f}" for f in FLAGS)},
        {', '.join(f"{rnd(f'sum(CAST({f} AS INTEGER)) / CAST(count(record_id) AS DOUBLE)')} AS rate_{f}_raw" for f in FLAGS)},
        ({ADJUSTED}) AS rate_gender_marker_adjusted, true AS remote_hint_suppressed FROM postings GROUP BY year"""),
    "momentum.long_run": star("SELECT * FROM lr", LR),
    "momentum.share_risers": star(edge("share_delta", "DESC"), LR),
    "momentum.share_fallers": star(edge("share_delta", "ASC", "(SELECT * FROM lr ANTI JOIN r USING (job_category))"),
                                   LR + f", r AS ({edge('share_delta', 'DESC')})"),
    "momentum.cagr_risers": star(edge("count_cagr", "DESC"), LR),
    "momentum.cagr_fallers": star(edge("count_cagr", "ASC", "(SELECT * FROM lr ANTI JOIN r USING (job_category))"),
                                  LR + f", r AS ({edge('count_cagr', 'DESC')})"),
    "momentum.rolling_share": star(f"""SELECT *, CASE WHEN count(*) OVER w = 3 THEN {rnd('avg(share) OVER w')} END AS rolling_3y_share
        FROM ({yearly('job_category')})
        WINDOW w AS (PARTITION BY job_category ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""),
    "dist.category": value_counts("job_category"),
    "dist.seniority": value_counts("seniority"),
    "dist.flags": star(f"""SELECT flag AS metric, positives AS count, {pct('positives', 'total')} AS rate,
        positives >= {S.min_flag_positives} AS reliable FROM ({FLAG_ROWS})"""),
    "dist.title_char_length": title_stats("length(title)"),
    "dist.title_word_count": title_stats(r"len(list_filter(regexp_split_to_array(title, '\s+'), lambda w: w <> ''))"),
    "xt.category_x_seniority": star(f"""SELECT job_category, seniority, {n()} AS count,
        {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY job_category)')} AS share
        FROM postings WHERE job_category IS NOT NULL AND seniority IS NOT NULL GROUP BY job_category, seniority"""),
    "xt.category_x_location_top10": star(f"""SELECT job_category, location_extracted, {n()} AS count,
        {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY location_extracted)')} AS share
        FROM located WHERE job_category IS NOT NULL AND location_extracted IN (SELECT location_extracted FROM located
          GROUP BY 1 ORDER BY count(*) DESC, location_extracted LIMIT 10) GROUP BY job_category, location_extracted""", LOCATED),
    "xt.category_period_distribution": star(period_distribution("job_category")),
    "xt.category_share_gainers": movers("job_category", "DESC"),
    "xt.category_share_losers": movers("job_category", "ASC"),
    "xt.seniority_period_distribution": star(period_distribution("seniority")),
    "xt.seniority_share_gainers": movers("seniority", "DESC"),
    "xt.seniority_share_losers": movers("seniority", "ASC"),
    "xt.seniority_x_flags": star(profile("seniority")),
    "xt.category_x_flags": star(profile("job_category")),
    "xt.flag_correlations": star(f"""SELECT c.* FROM ({CORR}) c JOIN ({FLAG_ROWS}) x ON c.flag_a = x.flag
        JOIN ({FLAG_ROWS}) y ON c.flag_b = y.flag
        WHERE x.positives >= {S.min_flag_positives} AND y.positives >= {S.min_flag_positives}"""),
    "internship.by_category": star(f"""SELECT job_category, total, intern_count, intern_rate, share_of_all_interns,
        {rnd(f'intern_rate / {MARKET}', 2)} AS vs_market_avg FROM ({INTERN})"""),
    "internship.by_year": star(rate_by("year", "is_internship")),
    "internship.by_category_year": star(rate_by("year, job_category", "is_internship", "intern_count", "intern_rate")),
    "internship.summary": star(f"""SELECT (SELECT {total('CAST(is_internship AS INTEGER)')} FROM postings) AS total_internship_ads,
        {rnd(MARKET)} AS market_intern_rate, {rnd('sum(share_of_all_interns)')} AS top2_category_intern_share,
        {pct('sum(total)', '(SELECT count(*) FROM postings)')} AS top2_volume_share
        FROM (SELECT * FROM ({INTERN}) ORDER BY raw_rate DESC, job_category LIMIT 2)"""),
    "gender.by_category": star(rate_by("job_category", "gender_marker", "gm_count", "gm_rate")),
    "gender.decomposition": star(f"""SELECT year, n, {rnd('raw')} AS gm_rate_raw, {rnd('expected')} AS gm_rate_expected_from_source_mix,
        {rnd('raw - expected')} AS residual_true_signal, {rnd('abs(expected) / nullif(abs(raw), 0)', 3)} AS pct_explained_by_source_mix
        FROM (SELECT year, {n()} AS n, avg(CAST(gender_marker AS DOUBLE)) AS raw,
          avg(CASE WHEN source IS NOT NULL THEN rate END) AS expected
          FROM postings LEFT JOIN ({source_table('gender_marker')}) r USING (source) GROUP BY year)"""),
    "vulnerability": star(f"""SELECT *, {rnd(f'intern_rate * {i_w} + gm_rate * {g_w} + senior_rate * {s_w}')} AS vulnerability_index
        FROM (SELECT job_category, {n('record_id')} AS total, {rnd('avg(CAST(is_internship AS DOUBLE))')} AS intern_rate,
          {rnd('avg(CAST(gender_marker AS DOUBLE))')} AS gm_rate,
          {rnd(f'avg(CASE WHEN seniority IN ({SENIOR}) THEN 1.0 ELSE 0.0 END)')} AS senior_rate
          FROM postings WHERE job_category IS NOT NULL GROUP BY job_category)"""),
    "work_model.by_year": per_flag("year"),
    "work_model.by_category": per_flag("job_category"),
    "work_model.by_seniority": per_flag("seniority"),
    "work_model.suppressed": star(f"""SELECT flag, positives, true AS suppressed, CAST({S.min_flag_positives} AS INTEGER) AS minimum
        FROM ({FLAG_ROWS}) WHERE positives < {S.min_flag_positives}"""),
    "market.category_hhi_by_year": star(f"""SELECT year, {rnd('sum(share * share)')} AS hhi,
        {rnd('1 / sum(share * share)', 2)} AS effective_categories, {rnd('sum(-(count / t) * log2(count / t + 1e-12))')} AS category_entropy,
        {n()} AS n_categories_active, {rnd('sum(CASE WHEN rn <= 3 THEN share END)')} AS top3_share
        FROM (SELECT *, sum(count) OVER (PARTITION BY year) AS t,
          row_number() OVER (PARTITION BY year ORDER BY count DESC, job_category) AS rn FROM ({yearly('job_category')}))
        GROUP BY year"""),
    "market.location_hhi_by_year": star(f"""SELECT year, {rnd('sum(share * share)')} AS location_hhi, {n()} AS unique_locations
        FROM ({yearly('location_extracted', 'located')}) GROUP BY year HAVING count(*) >= {S.min_places_per_year}""", LOCATED),
    "market.top_categories_by_period": star(f"""SELECT job_category, share, period, {LABEL} AS period_label
        FROM ({top_by_period('job_category', 3, 'postings', '(SELECT * FROM postings WHERE job_category IS NOT NULL)')})"""),
    "loc.coverage": star(f"""SELECT {n('location_extracted')} AS records_with_location,
        {pct('count(location_extracted)', 'count(*)')} AS location_coverage_rate,
        count(DISTINCT location_extracted) AS unique_locations,
        {pct('count(*) - count(location_extracted)', 'count(*)')} AS share_missing FROM postings"""),
    "loc.top_locations": star(f"""SELECT location_extracted, {n()} AS count, {pct('count(*)', '(SELECT count(*) FROM located)')} AS share
        FROM located GROUP BY 1 ORDER BY count DESC, location_extracted LIMIT 30""", LOCATED),
    "loc.by_period": star(f"""SELECT *, {LABEL} AS period_label
        FROM ({top_by_period('location_extracted', 10, 'located', 'located')})""", LOCATED),
    "loc.category_mix": star(f"""SELECT location_extracted, job_category, count, share FROM (
        SELECT location_extracted, job_category, {n()} AS count,
          {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY location_extracted)')} AS share,
          row_number() OVER (PARTITION BY location_extracted ORDER BY count(*) DESC, job_category) AS rn
        FROM located WHERE job_category IS NOT NULL GROUP BY location_extracted, job_category) WHERE rn <= 5""", LOCATED),
    "loc.flags_min20": star(profile("location_extracted", having=f"HAVING count(record_id) >= {S.min_ads_per_place}")),
    "loc.focus_yearly": star(f"""SELECT year, location_extracted, {n()} AS count FROM postings
        WHERE location_extracted IN ({q(a)}, {q(b)}) GROUP BY ALL"""),
    "company.coverage": star(f"""SELECT {n('company_extracted')} AS records_with_company_raw,
        (SELECT {n()} FROM clean) AS records_with_company_clean,
        {pct('(SELECT count(*) FROM clean)', 'count(*)')} AS company_coverage_rate_clean,
        (SELECT count(DISTINCT company_extracted) FROM clean) AS unique_companies_clean,
        {n('company_extracted')} - (SELECT {n()} FROM clean) AS geo_noise_removed FROM postings""", CLEAN),
    "company.top": star(f"""SELECT company_extracted, {n()} AS count, {pct('count(*)', '(SELECT count(*) FROM clean)')} AS share
        FROM clean GROUP BY 1 ORDER BY count DESC, company_extracted LIMIT 40""", CLEAN),
    "company.profiles": star(f"""SELECT company_extracted, {n('record_id')} AS total_ads, min(year) AS first_year, max(year) AS last_year,
        count(DISTINCT year) AS active_years, {rnd('avg(CAST(gender_marker AS DOUBLE))')} AS gender_rate,
        {rnd('avg(CAST(is_internship AS DOUBLE))')} AS internship_rate, {rnd('avg(CAST(part_time_hint AS DOUBLE))')} AS part_time_rate
        FROM clean WHERE company_extracted IN (SELECT company_extracted FROM clean GROUP BY 1
          ORDER BY count(*) DESC, company_extracted LIMIT 40) GROUP BY 1""", CLEAN),
    "company.hhi_by_year": star(f"""SELECT year, {hhi('c')} AS company_hhi, {n()} AS unique_companies_active
        FROM (SELECT year, company_extracted, count(*) AS c FROM clean GROUP BY ALL) GROUP BY year
        HAVING count(*) >= {S.min_companies_per_year}""", CLEAN),
    "deep_dive.summary": star(f"""SELECT period, {LABEL} AS period_label, CAST({label_case(S.periods, 'start')} AS INTEGER) AS start_year,
        CAST({label_case(S.periods, 'end')} AS INTEGER) AS end_year, {n()} AS total_ads, any_value(h) AS hhi,
        {rnd('1 / nullif(any_value(h), 0)', 2)} AS effective_categories, count(*) < {S.sparse_period} AS is_sparse_period,
        any_value(sparse_years) AS sparse_years,
        {', '.join(f"{pct(f'sum(CAST({f} AS INTEGER))', 'count(*)')} AS rate_{f}" for f in FLAGS)}
        FROM (SELECT *, {P_NAME} AS period FROM postings)
        JOIN (SELECT period, {hhi('c')} AS h FROM (SELECT {P_NAME} AS period, job_category, count(*) AS c FROM postings
          WHERE job_category IS NOT NULL GROUP BY ALL) GROUP BY period) USING (period)
        JOIN (SELECT period, coalesce(string_agg(CASE WHEN c < {S.sparse_year} THEN CAST(year AS VARCHAR) END, ',' ORDER BY year), '') AS sparse_years
          FROM (SELECT {P_NAME} AS period, year, count(*) AS c FROM postings GROUP BY ALL) GROUP BY period) USING (period)
        GROUP BY period"""),
    "deep_dive.top_categories": star(top_by_period("job_category", 5, "postings", "postings")),
    "deep_dive.top_locations": star(top_by_period("location_extracted", 5, "postings", "postings")),
    "deep_dive.top_companies": star(top_by_period("company_extracted", 5, "clean", "postings"), CLEAN),
    "deep_dive.top_keywords": top_terms(("tok", "token"), "keyword", 10, TOKEN_ROWS,
                                        f"period, keyword, count, {pct('count', 'n')} AS share_of_ads"),
    "deep_dive.seniority": star(f"""SELECT period, seniority, {pct('count', 'sum(count) OVER (PARTITION BY period)')} AS share
        FROM (SELECT {P_NAME} AS period, seniority, {n()} AS count FROM postings WHERE seniority IS NOT NULL GROUP BY ALL)"""),
    "lang.keywords_by_period": top_terms(("tok", "token"), "keyword", 30, TOKEN_ROWS,
        f"keyword, count, period, {label_case(D.periods, 'label')} AS period_label, {pct('count', 'n')} AS share_of_ads"),
    "lang.bigrams_by_period": top_terms(("big", "bigram"), "bigram", 15, BIGRAM_ROWS,
        f"bigram, count, period, {label_case(D.periods, 'label')} AS period_label, {pct('count', 'n')} AS share_of_ads"),
    "lang.bigrams_global": docs(f"SELECT bigram, {n()} AS count FROM big GROUP BY 1 ORDER BY count DESC, bigram LIMIT 40", BIGRAM_ROWS),
    "lang.emergence": docs("SELECT * FROM em ORDER BY share_delta DESC, keyword LIMIT 20", EMERGENCE),
    "lang.decline": docs("SELECT * FROM em ORDER BY share_delta ASC, keyword LIMIT 20", EMERGENCE),
}
