"""Tables as large ones come: folders of files, many rows a group."""

import random
import re

import pytest
from pyspark.sql import functions as F

from jobstrata.catalog import cleaning_queries, search_queries, stream_queries
from jobstrata.functions.text import search_normalize
from jobstrata.operators import listings, search
from jobstrata.plans.enrichment import enrich, enrich_by_title
from jobstrata.sources.tables import spread


@pytest.fixture(scope="module")
def folders(spark, sf_dir, tmp_path_factory):
    """The smallest tables that streams read, each a folder of three files."""
    place = str(tmp_path_factory.mktemp("folders"))
    for name in ("documents", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(f"{place}/{name}.parquet")
    return place


@pytest.mark.parametrize("name", ["stream_enrich", "stream_ingest", "stream_counts"])
def test_streams_read_tables_in_folders(spark, sf_dir, folders, name):
    run = stream_queries.QUERIES[name]
    assert sorted(map(tuple, run(spark, folders).collect())) == sorted(map(tuple, run(spark, sf_dir).collect())) != []


PAGE_PARTS = [
    '<div class="oferta">', "</div>", '<li class="job x">', "</li>", '<a href="/12345/abc-d">', "</a>", "<br>", "<br/>", '<img src="a>b">', "a < b",
    "&amp; x", "&lt", "<!-- c -->", '<script>var a="<p>";</script>', "<h2>", "</h2>", "<a href='/x?ref=1'>", "Texto 01/02/2010", '<DIV CLASS="item">',
    "<!DOCTYPE html>", '<div class="ofertasMiddle"/>', "&", "<", "</p >", "<template>", "</template>", '<a href="/emprego/x" class="dt  date">', "<div data-x>"]


def test_plain_reading_equals_the_full_parser(monkeypatch):
    """Plain tags and text are read without the full parser, and both build the same page."""
    draw = random.Random(3)
    texts = ["".join(draw.choice(PAGE_PARTS) for _ in range(draw.randint(0, 40))) for _ in range(2000)]
    plain = [listings.Page(t) for t in texts]
    with monkeypatch.context() as m:
        m.setattr(listings.Page, "_read_plain", lambda self, html: html)
        full = [listings.Page(t) for t in texts]
    assert [(p.nodes, p.texts) for p in plain] == [(p.nodes, p.texts) for p in full]
    with monkeypatch.context() as m:
        m.setattr(listings.Page, "feed", None)  # a plain page never comes to the full parser
        page = listings.Page('<ul><li class="oferta"><a href="/1">x &amp; y</a><br/></li></ul>')
    assert page.text(page.one("li.oferta a")) == "x & y"


def test_pages_are_dealt_by_their_number(spark):
    """Narrow rows that become pages: a task holds at most so many of them."""
    assert spread(spark.range(0, 1000, 1, 1), 50).rdd.getNumPartitions() == 20


def test_titles_are_judged_once(spark, sf_dir):
    """The rule tables lie above the count of titles, so rows with one title are judged together."""
    for name in ("enrich", "extract_company", "classify_category", "split_accept_reject"):
        plan = cleaning_queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("\n")
        counts = [i for i, line in enumerate(plan) if "Aggregate [title" in line or "Aggregate [_groupingexpression" in line or "Aggregate [CASE" in line]
        judged = [i for i, line in enumerate(plan) if "RLIKE" in line or "mobijake" in line]
        assert judged and max(judged) < max(counts), name


def test_enriching_by_title_equals_enriching_rows(spark):
    rows = spark.createDataFrame([("a", "Estágio Marketing - Lisboa", "20100102"), ("b", "Estágio Marketing - Lisboa", None), ("c", None, "20110203")],
                                 "record_id string, title string, arquivo_timestamp string")
    assert sorted(map(str, enrich_by_title(rows).select(enrich(rows).columns).collect())) == sorted(map(str, enrich(rows).collect()))


def test_texts_are_folded_once_a_pass(spark, sf_dir):
    """A match folds title and category once each, however often the fold uses its value, and its pattern is a constant."""
    corpus = search_queries.document_corpus(spark, sf_dir)
    plan = search.matches(corpus, "The Theré").select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2
    assert r"(^|[^a-z0-9])\Qthe\E[^a-z0-9+#.-]+\Qthere\E($|[^a-z0-9])" in plan


def test_folded_texts_match_as_normal_forms_do(spark):
    """Separators in a folded text stand for the spaces of the normal form, at its ends too."""
    texts = ["The  --  Theré", "the\n\tthere", "the-there", "the+there", "xthe there", "¡the, there!\n", "a the ß there", "the  theres",
             "of c++ and", "c++x", "x　the there ", "Ã©the there", "the" + " " * 20000 + "there", ""]
    rows = spark.createDataFrame([(2000 + i % 2, t, c, i) for i, t in enumerate(texts) for c in ("k", None)], "year int, title string, category string, id int")
    corpus = search.search_corpus(rows.withColumn("url", F.lit("x")))
    for query in ("the there", "c++", "The", "of C++", "k", "***"):
        form = spark.range(1).select(search_normalize(F.lit(query))).head()[0]
        pattern = re.compile(f"(^|[^a-z0-9]){re.escape(form)}($|[^a-z0-9])")
        normal = corpus.select("id", search_normalize(F.col("title")).alias("t"), search_normalize(F.col("category")).alias("c")).collect()
        want = sorted(r.id for r in normal if len(form) >= 3 and (pattern.search(r.t) or pattern.search(r.c)))
        assert sorted(r.id for r in search.matches(corpus, query).select("id").collect()) == want, query
        batch = search.keyword_trend_batch(corpus, spark.createDataFrame([(query,)], "query string"))
        assert batch.agg(F.sum("count")).head()[0] == len(want), query
