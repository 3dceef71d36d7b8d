"""URL rules and page extraction as queries.

Apart from the ``pages`` table, listing pages are rendered from ``orders`` rows, one page
per row, in the mark-up of each layout; the SQL side states the records they hold.
"""

from pyspark.sql import functions as F

from jobstrata import vocab
from jobstrata.catalog.cleaning_queries import has
from jobstrata.functions.urls import SiteRules, canonical_url, record_key
from jobstrata.operators.listings import (
    ListingProfile, container_profile, era_profile, extract_listings, heading_profile, text_blocked,
)
from jobstrata.operators.snapshots import ARCHIVE_PREFIX, dedup_content
from jobstrata.sources.tables import spread, table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


EXAMPLE = SiteRules(domain="example.com", job_patterns=(r"example\.(?:com|net|org)/[a-z]{2}/\d{3,8}(?:\.html|/)?$",),
                    nav_pattern=r"^https?://m\.")
REPLAY = "'https://archive.example/noFrame/replay/20100102030405/'"


@query("canonical_url", r"""SELECT page_id, CASE WHEN regexp_matches(url, 'example\.(?:com|net|org)/[a-z]{2}/\d{3,8}(?:\.html|/)?$')
    AND NOT regexp_matches(url, '(?i)\.(css|js|gif|jpg|jpeg|png|ico|swf|pdf|zip|xml|rss)(\?|$)')
    AND NOT regexp_matches(url, '^https?://m\.') THEN url END AS canonical FROM pages""")
def canonical_query(spark, sf_dir):
    """Page URLs, half of them behind an archive replay prefix."""
    wrapped = F.when(F.length("html") > 3000, F.concat(F.expr(REPLAY), "url")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", canonical_url(wrapped, EXAMPLE).alias("canonical"))


@query("record_key", """SELECT page_id, substr(sha256(url), 1, 16) AS by_url, substr(sha256('20100102|' || url), 1, 16) AS by_snapshot,
    substr(sha256('20100102|' || 'T' || page_id || '|20100102'), 1, 16) AS without_url FROM pages""")
def record_key_query(spark, sf_dir):
    ts, title = F.lit("20100102"), F.concat(F.lit("T"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select(
        "page_id", record_key(F.col("url")).alias("by_url"),
        record_key(F.col("url"), ts, title, "snapshot_url").alias("by_snapshot"),
        record_key(F.lit(""), ts, title, "snapshot_url").alias("without_url"))


@query("dedup_content_prefix", """SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY md5(encode(body)[1:4096])
    ORDER BY page_id, copy) AS rn FROM (SELECT *, html AS body, 1 AS copy FROM pages
    UNION ALL SELECT *, html || '<!-- later -->', 2 FROM pages)) WHERE rn = 1""")
def dedup_content_query(spark, sf_dir):
    """Each page comes twice; the second copy has a comment added at its end."""
    p = table(spark, sf_dir, "pages")
    both = p.withColumn("copy", F.lit(1)).unionByName(
        p.withColumns({"html": F.concat("html", F.lit("<!-- later -->")), "copy": F.lit(2)}))
    return dedup_content(both, "html", ["page_id", "copy"], ARCHIVE_PREFIX).select("page_id", "url")


BLOCKED = " OR ".join(has("text", p) for p in (
    vocab.CHROME_TEXT_PATTERN, vocab.NAV_TEXT_PATTERN, vocab.EDITORIAL_TEXT_PATTERN))


@query("text_blocklists", f"""SELECT doc_id, blocked, count(*) AS sentences FROM (
    SELECT doc_id, (length(text) NOT BETWEEN 8 AND 150 OR {BLOCKED}) AS blocked
    FROM (SELECT doc_id, unnest(string_split(text, '.')) AS text FROM documents)) GROUP BY ALL""")
def blocklist_query(spark, sf_dir):
    """Sentences of whole documents."""
    docs = spread(table(spark, sf_dir, "documents"))
    sentences = docs.select("doc_id", F.explode(F.split("text", r"\.")).alias("text"))
    return sentences.select("doc_id", text_blocked(F.col("text")).alias("blocked")).groupBy("doc_id", "blocked").agg(
        F.count(F.lit(1)).alias("sentences"))


ANY_LINK = SiteRules(domain="example.com", job_patterns=(r"^http://example\.com/.+",))


def _unescaped(x):
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{code}', '{char}')"
    return x


@query("extract_listings_anchor_fallback", f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href,
      unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS txt,
      generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1), 1) AS pos FROM pages),
    u AS (SELECT page_id, 'http://example.com' || {_unescaped('href')} AS original_url, trim({_unescaped('txt')}) AS title, pos FROM a)
    SELECT page_id, original_url, title, substr(sha256(original_url), 1, 16) AS record_id FROM (SELECT *,
      row_number() OVER (PARTITION BY page_id, original_url ORDER BY pos) AS rn FROM u) WHERE rn = 1
      AND NOT regexp_matches(original_url, '(?i)\\.(css|js|gif|jpg|jpeg|png|ico|swf|pdf|zip|xml|rss)(\\?|$)')
      AND length(original_url) > length('http://example.com/')""")
def anchors_query(spark, sf_dir):
    profile = ListingProfile("pages", ANY_LINK, ("structured", "anchor_fallback"))
    pages = spread(table(spark, sf_dir, "pages")).select(
        F.col("page_id").cast("string").alias("page_url"), F.lit("20100102030405").alias("ts"),
        F.lit(2010).alias("year"), "html")
    return extract_listings(pages, profile).select(
        F.col("wayback_url").cast("long").alias("page_id"), "original_url", "title", "record_id")


# --- pages rendered from orders ------------------------------------------------------------------

#: Pages that a task reads at most.
PAGES = 50_000


def _pages(spark, sf_dir, markup, year="year(o_orderdate)"):
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"), PAGES)
    return o.select(F.col("o_orderkey").cast("string").alias("page_url"),
                    F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("ts"),
                    F.expr(f"CAST({year} AS INT)").alias("year"), F.expr(markup).alias("html"))


RECORD = ["record_id", "year", "title", "company", "location", "date_posted", "original_url", "wayback_url",
          "arquivo_timestamp", "source"]
DAY = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"
MONTH = "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')"

STRUCTURED_PAGE = f"""'<html><body><div class="x">menu</div><ul><li class="oferta"><a href="/' || (10000 + o_orderkey) || '/vaga-' || o_custkey
  || '"><b>ver</b></a><h2>' || o_orderpriority || ' &amp; mais</h2><span class="empresa big"> Cliente ' || o_custkey
  || ' </span><span class="cidade">Porto</span><p class="data">' || {DAY} || '-' || {MONTH} || '</p></li>'
  || '<li class="oferta"><a href="http://www.jobs.example/' || (10000 + o_orderkey) || '/vaga-' || o_custkey || '">again</a></li>'
  || CASE WHEN o_orderstatus = 'F' THEN '<li class="oferta"><a href="/noFrame/replay/20100102030405/http://www.jobs.example/detalhe_anuncio.asp?REF=' || o_custkey || '">Antigo</a></li>' ELSE '' END
  || '<li class="oferta"><a href="/estilo.css">folha</a></li></ul><div class="vaga"><a href="/99999/outra-vaga">late</a></div></body></html>'"""


@query("extract_listings_structured", """WITH p AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y%m%d%H%M%S') AS ts,
      'http://jobs.example/' || (10000 + o_orderkey) || '/vaga-' || o_custkey AS url, o_orderpriority || ' & mais' AS title,
      'Cliente ' || o_custkey AS company, 'Porto' AS location, strftime(o_orderdate, '%d-%m') AS date_posted FROM orders
    UNION ALL SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER), strftime(o_orderdate, '%Y%m%d%H%M%S'),
      'http://www.jobs.example/' || (10000 + o_orderkey) || '/vaga-' || o_custkey, 'again', '', '', '' FROM orders
    UNION ALL SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER), strftime(o_orderdate, '%Y%m%d%H%M%S'),
      'http://www.jobs.example/detalhe_anuncio.asp?REF=' || o_custkey, 'Antigo', '', '', '' FROM orders WHERE o_orderstatus = 'F')
    SELECT substr(sha256(url), 1, 16) AS record_id, year, title, company, location, date_posted, url AS original_url,
      CAST(o_orderkey AS VARCHAR) AS wayback_url, ts AS arquivo_timestamp, 'board' AS source FROM p""")
def structured_query(spark, sf_dir):
    pages = _pages(spark, sf_dir, STRUCTURED_PAGE)
    pages = pages.withColumn("html", F.replace("html", F.lit('"/noFrame'), F.lit('"http://archive.example/noFrame')))
    return extract_listings(pages, container_profile("board", "jobs.example")).select(*RECORD)


HEADINGS_PAGE = f"""CASE WHEN o_orderstatus = 'O' THEN
    '<div class="post hot"><h2 class="entry-title"><a href="http://blog.example/2019/03/12/cargo-' || o_orderkey || '/">Cargo ' || o_custkey || ' livre</a></h2><time>'
    || {DAY} || ' / Março</time></div><div class="entry"><h3><a href="/page/2/">Página seguinte</a></h3></div>'
  ELSE '<h2><a href="https://archive.example/wayback/20100102030405/http://www.blog.example/cargo-' || o_orderkey || '">Cargo ' || o_custkey
    || ' livre</a></h2><h3><a href="http://blog.example/cargo-xyz">curto</a></h3><h3>sem link</h3>' END"""


@query("extract_listings_headings", """WITH p AS (SELECT *, CASE WHEN o_orderstatus = 'O' THEN 'http://blog.example/2019/03/12/cargo-' || o_orderkey || '/'
      ELSE 'http://www.blog.example/cargo-' || o_orderkey END AS url FROM orders)
    SELECT substr(sha256(url), 1, 16) AS record_id, CAST(year(o_orderdate) AS INTEGER) AS year, 'Cargo ' || o_custkey || ' livre' AS title,
      '' AS company, '' AS location, CASE WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%d') || ' / Março' ELSE '' END AS date_posted,
      url AS original_url, CAST(o_orderkey AS VARCHAR) AS wayback_url, strftime(o_orderdate, '%Y%m%d%H%M%S') AS arquivo_timestamp, 'blog' AS source FROM p""")
def headings_query(spark, sf_dir):
    return extract_listings(_pages(spark, sf_dir, HEADINGS_PAGE), heading_profile("blog", "blog.example")).select(*RECORD)


ERA_YEAR = "2006 + 2 * (year(o_orderdate) - 1995)"
STAMP = f"{DAY} || '/' || {MONTH} || '/' || year(o_orderdate)"
ERA_PAGE = f"""CASE WHEN year(o_orderdate) <= 1996 THEN
    '<table><tr><td><a href="/emprego/vaga-' || o_orderkey || '">Cargo ' || o_custkey || ' livre</a> ' || {STAMP} || '</td><td>Cliente ' || o_custkey
    || '</td></tr></table><a href="/emprego/login">Login no portal</a><a href="/outra">Sem padrao de vaga</a>'
  WHEN year(o_orderdate) <= 1998 THEN
    '<div class="ofertasMiddle"><a href="/x">abc</a><a href="/emprego/vaga-' || o_orderkey || '/">Cargo ' || o_custkey || ' livre</a><br>' || {STAMP}
    || '<span>Cliente ' || o_custkey || '</span></div>'
  WHEN year(o_orderdate) = 1999 THEN
    '<div class="item"><div class="c1"><a href="/emprego/vaga-' || o_orderkey || '/">Cargo ' || o_custkey || ' livre</a></div><div class="c2">Anónimo</div>'
    || '<div class="c3">Porto</div><div class="c4">' || {STAMP} || '</div></div>'
  ELSE '<div class="resultadosBox"><h3><a href="/emprego/vaga-' || o_orderkey || '/">Cargo ' || o_custkey || ' livre</a></h3><p class="empresa">Cliente '
    || o_custkey || '</p><p>' || {STAMP} || ' Porto | Ref 1</p></div>' END"""


@query("extract_listings_by_era", """WITH p AS (SELECT *, CAST(2006 + 2 * (year(o_orderdate) - 1995) AS INTEGER) AS y,
      strftime(o_orderdate, '%Y%m%d%H%M%S') AS ts, 'http://era.example/emprego/vaga-' || o_orderkey
        || CASE WHEN year(o_orderdate) <= 1996 THEN '' ELSE '/' END AS url FROM orders)
    SELECT substr(sha256(ts || '|' || url), 1, 16) AS record_id, y AS year, 'Cargo ' || o_custkey || ' livre' AS title,
      CASE WHEN year(o_orderdate) = 1999 THEN '' ELSE 'Cliente ' || o_custkey END AS company,
      CASE WHEN year(o_orderdate) >= 1999 THEN 'Porto' ELSE '' END AS location, strftime(o_orderdate, '%d.%m.%Y') AS date_posted,
      url AS original_url, CAST(o_orderkey AS VARCHAR) AS wayback_url, ts AS arquivo_timestamp, 'eras' AS source FROM p""")
def era_query(spark, sf_dir):
    return extract_listings(_pages(spark, sf_dir, ERA_PAGE, ERA_YEAR), era_profile("eras", "era.example")).select(*RECORD)
