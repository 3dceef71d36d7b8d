"""Operators on small frames: order, skew, files, streams and plans."""

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from jobstrata.config import DEFAULTS
from jobstrata.functions.metrics import period_name
from jobstrata.operators import annotations, listings, search, snapshots
from jobstrata.operators.aggregates import add_share
from jobstrata.operators.rows import dedup_first, prepare_dataset, union_sources
from jobstrata.plans.enrichment import build_dataset, enrich
from jobstrata.plans.inputs import PostingCubes
from jobstrata.plans.registry import SECTIONS
from jobstrata.plans.report import build_report, report_document, write_report
from jobstrata.schemas import ENRICHED_POSTING
from jobstrata.sources import readers, writers
from jobstrata.sources.tables import STAR_SETTINGS, star_postings
from jobstrata.streaming import jobs
from jobstrata.streaming.files import work_dir


def plan(df):
    return df._jdf.queryExecution().toString()


def test_min_gap(spark):
    days = ["0101", "0110", "0115", "0128", "0129", "0301"]
    df = spark.createDataFrame([("s", f"2008{d}000000") for d in days] + [("s", "20081399")], "site string, ts string")
    got = sorted(r.ts[4:8] for r in snapshots.min_gap_sample(df, "site").collect())
    assert got == ["0101", "0115", "0129", "0301"]


def test_min_gap_matches_brute_force(spark):
    start = date(2010, 1, 1)
    rows = [(f"s{i % 7}", (start + timedelta(days=(i * i * 31) % 700)).strftime("%Y%m%d") + f"{i % 24:02d}0000", i % 3)
            for i in range(900)]
    expected = set()
    for site in {r[0] for r in rows}:
        last = None
        for ts in sorted(r[1] for r in rows if r[0] == site and r[2] > 0):
            d = date(int(ts[:4]), int(ts[4:6]), int(ts[6:8]))
            if last is None or last.year != d.year or (d - last).days >= 14:  # every year starts anew
                expected.add((site, ts))
                last = d
    df = spark.createDataFrame(rows, "site string, ts string, yielded int").repartition(5)
    got = snapshots.min_gap_sample_success(df, "site").select("site", "ts").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_merge_modes(spark):
    df = spark.createDataFrame(
        [("s", 0, "a", "20100101120000"), ("s", 1, "b", "20100101010000"), ("s", 0, "a", "20100101130000"),
         ("s", 0, "a", "20300101130000")], "site string, seed_priority int, base_url string, ts string")
    assert [r.ts for r in snapshots.merge_seeds(df, 2008, 2025, "first").collect()] == ["20100101120000"]
    assert [r.ts for r in snapshots.merge_seeds(df, 2008, 2025, "last").collect()] == ["20100101010000"]


def test_dedup_is_idempotent_and_skew_safe(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    once = dedup_first(df, "k", "id")
    assert once.count() == 2001 and dedup_first(once, "k", "id").count() == 2001
    assert once.filter("k = 'hot'").first().id == 0
    assert "WindowGroupLimit" in plan(once) and "Partial" in plan(once)


def test_union_sources(spark):
    one = spark.createDataFrame([("1",)], "record_id string")
    out = union_sources({"a": None, "b": one, "c": one.withColumn("x", F.lit(1))})
    assert {(r.source, r.source_priority, r.x) for r in out.collect()} == {("b", 1, None), ("c", 2, 1)}
    with pytest.raises(ValueError):
        union_sources({"a": None})


def test_prepare_requires_columns(spark):
    with pytest.raises(ValueError, match="Missing required columns: .*source"):
        prepare_dataset(spark.createDataFrame([("1", "2010")], "record_id string, year string"))


def test_shares_sum_to_one(spark, sf_dir):
    cubes = PostingCubes(lambda c: star_postings(spark, sf_dir, c), STAR_SETTINGS)
    shares = add_share(cubes.cube("year", "seniority").select("year", "seniority", F.col("n_rows").alias("count")), "year")
    for r in shares.groupBy("year").agg(F.sum("share").alias("s"), F.count("*").alias("k")).collect():
        assert abs(r.s - 1) <= r.k * 5e-5 + 1e-9


def test_periods(spark):
    df = spark.createDataFrame([(2007,), (2008,), (2024,)], "y int")
    got = [r[0] for r in df.select(period_name(F.col("y"), DEFAULTS.periods, default="unknown")).collect()]
    assert got == ["unknown", "pre_crisis_baseline_2008_2011", "post_pandemic_2022_2024"]


# --- annotations ----------------------------------------------------------------------

def test_parse_responses(spark):
    good = '{"1": {"company": "X", "company_conf": 2, "category": 5, "category_conf": "NaN"}, "2": 7}'
    texts = [good, f"Sure! {good} bye", f"[{good}]", "junk", None]
    out = annotations.parse_annotation_response(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string"))
    rows = out.orderBy("i").collect()
    assert [(r.i, r.record_id, r.company, r.company_conf, r.category, r.category_conf) for r in rows] == [
        (0, "1", "X", 1.0, None, 0.0), (1, "1", "X", 1.0, None, 0.0)]


def test_merge_thresholds(spark):
    posts = spark.createDataFrame([(str(i), None, None, "Outros") for i in range(4)],
                                  "record_id string, company_extracted string, location_extracted string, job_category string")
    ann = spark.createDataFrame(
        [("0", "C", 0.74, "", 0.0, "IT", 0.64), ("1", "C", 0.75, "Porto", 0.75, "IT", 0.65), ("2", "C", 1.0, None, 1.0, "Outros", 1.0)],
        "record_id string, company string, company_conf double, location string, location_conf double, category string, category_conf double")
    got = {r.record_id: tuple(r)[1:] for r in annotations.merge_annotations(posts, ann).collect()}
    assert got == {"0": (None, None, "Outros"), "1": ("C", "Porto", "IT"), "2": ("C", None, "Outros"), "3": (None, None, "Outros")}


def test_label_growth_is_order_free(spark):
    ann = spark.createDataFrame([("1", "Novo Ramo", 0.3), ("2", "Novo Ramo", 0.9), ("3", "Turismo", 0.9), ("4", "n/a", 0.9), ("5", None, 0.9)],
                                "record_id string, category string, category_conf double")
    got = {r.record_id: (r.category, r.category_conf) for r in annotations.resolve_category(ann).collect()}
    assert got == {"1": ("Novo Ramo", 0.3), "2": ("Novo Ramo", 0.9), "3": ("Restauração & Hotelaria", 0.9),
                   "4": ("Outros", 0.0), "5": ("Outros", 0.0)}
    assert annotations.merged_vocabulary(["Novo Ramo"])[-2:] == ["Novo Ramo", "Outros"]


def test_batches_hold_every_row_once(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("record_id"), F.lit("t").alias("title"), F.lit("u").alias("original_url"))
    rows = annotations.make_batches(df, "record_id", size=7).collect()
    ids = [i.record_id for r in rows for i in r["items"]]
    assert len(ids) == len(set(ids)) == 1000 and max(len(r["items"]) for r in rows) <= 7


# --- search ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(2010, "unit test", "x"), (2010, "it-support", "x"), (2011, "C++ (dev)", "IT"), (2011, "Saúde pública", "+++"),
            (2012, "", "IT"), (2012, "Programador", None), (2012, "foo +++ bar", "x")]
    df = spark.createDataFrame([(i, *r, "a.b") for i, r in enumerate(rows)], "i int, year int, title string, category string, url string")
    return search.search_corpus(df)


def test_boundaries(corpus):
    assert search.matches(corpus, "unit").count() == 1
    assert search.matches(corpus, "support").count() == 1
    assert search.matches(corpus, "it").count() == 0  # shorter than three characters
    assert search.matches(corpus, "SAUDE").count() == 1


def test_batch_equals_single(spark, corpus):
    asked = ["unit", "support", "saude publica", "+++", "it", "dev", "c++", "programador", "t-s"]
    frame = spark.createDataFrame([(a,) for a in asked], "query string")
    batch = {(r["query"], r["year"]): r["count"] for r in search.keyword_trend_batch(corpus, frame).collect()}
    single = {(a, r["year"]): r["count"] for a in asked for r in search.keyword_trend(corpus, a).collect()}
    assert batch == single


def test_significance(spark):
    def summary(years):
        df = spark.createDataFrame([(y, n, 10, n / 10) for y, n in years], "year int, count long, total long, share double")
        return search.trend_summary(df).first()

    assert not summary([(2010, 5), (2011, 0)]).is_significant
    assert summary([(2010, 4), (2011, 1)]).is_significant
    assert summary([(2010, 4), (2011, 1)]).verdict == "decline"


# --- pages ---------------------------------------------------------------------------------

def read_page(spark, html, profile, year=2010):
    df = spark.createDataFrame([("p", "20100101000000", year, html)], "page_url string, ts string, year int, html string")
    return listings.extract_listings(df, profile).orderBy("pos").collect()


def test_first_productive_selector_wins(spark):
    html = ('<li class="oferta"><a href="/nothing">x</a></li><div class="job"><a href="/12345/aaa-b">One &amp; two</a>'
            '<span class="empresa"> ACME </span></div><div class="vaga"><a href="/99999/ccc-d">late</a></div>')
    rows = read_page(spark, html, listings.container_profile("s", "jobs.example"))
    assert [(r.title, r.company, r.original_url) for r in rows] == [("One & two", "ACME", "http://jobs.example/12345/aaa-b")]


def test_anchor_fallback(spark):
    html = '<div><p><a href="12345/aaa-b">T<script>x</script></a></p><i class="local">Faro</i></div><a href="/12345/aaa-b">again</a>'
    rows = read_page(spark, html, listings.container_profile("s", "jobs.example"))
    assert [(r.title, r.location) for r in rows] == [("T", "Faro")]


def test_era_context_filter(spark):
    html = ('<div><p><a href="/emprego/abc">Programador Web</a></p> ACME SA <b>02-03-2009</b></div>'
            '<div>culpa governo <a href="/emprego/def">Outro texto longo</a></div><a href="/emprego/login">Login aqui mesmo</a>')
    rows = read_page(spark, html, listings.era_profile("s", "era.example"), 2009)
    assert [(r.title, r.company, r.original_url) for r in rows] == [("Programador Web", "ACME SA", "http://era.example/emprego/abc")]


def test_era_looks_at_three_siblings(spark):
    """White space and empty elements count; a link at top level has the page around it."""
    far = '<div><a href="/emprego/abc">Programador Web</a>\n<br>\n<b>ACME SA</b></div>'
    rows = read_page(spark, far, listings.era_profile("s", "era.example"), 2009)
    assert [(r.title, r.company) for r in rows] == [("Programador Web", "")]
    near = '<div><p><a href="/emprego/abc">Programador Web</a></p>\n<b>ACME SA</b></div>'
    assert [r.company for r in read_page(spark, near, listings.era_profile("s", "era.example"), 2009)] == ["ACME SA"]
    top = '<p>culpa governo</p><a href="/emprego/abc">Programador Web</a>'
    assert read_page(spark, top, listings.era_profile("s", "era.example"), 2009) == []


def test_pages_without_year(spark):
    html = '<li class="oferta"><a href="/12345/aaa-b">One and two</a></li>'
    assert [r.title for r in read_page(spark, html, listings.container_profile("s", "jobs.example"), None)] == ["One and two"]
    assert read_page(spark, html, listings.era_profile("s", "era.example"), None) == []


def test_large_pages_stay_linear():
    import time

    html = "".join(f'<p><a href="/emprego/vaga-{i}">Cargo numero {i} livre</a> texto 01/02/2008</p>\n' for i in range(4000))
    start = time.perf_counter()
    found = list(listings._by_era(listings.Page(html), listings.era_profile("s", "era.example"), 2008))
    assert len(found) == 4000 and sum(len(str(e)) for e in found) < 300 * 4000 and time.perf_counter() - start < 20


def test_annotations_of_missing_and_doubled_ids(spark):
    schema = "record_id string, title string, company_extracted string, location_extracted string, job_category string"
    rows = [(None, "a", None, None, "Outros"), ("", "b", None, None, "Outros"), ("1", "c", None, None, "Outros")]
    ann = [("1", "Weak", 0.8, None, 0.0, None, 0.0), ("1", "Strong", 0.9, None, 0.0, None, 0.0), ("", "No", 0.9, None, 0.0, None, 0.0),
           (None, "No", 0.9, None, 0.0, None, 0.0)]
    out = annotations.merge_annotations(spark.createDataFrame(rows, schema), spark.createDataFrame(
        ann, "record_id string, company string, company_conf double, location string, location_conf double, category string, category_conf double"))
    assert sorted((r.title, r.company_extracted) for r in out.collect()) == [("a", None), ("b", None), ("c", "Strong")]


def test_era_falls_back_to_second_layout(spark):
    html = '<div class="item"><div class="c1"><a href="/emprego/x/">Cargo bom</a></div><div class="c4">hoje mesmo sim</div></div>'
    rows = read_page(spark, html, listings.era_profile("s", "era.example"), 2017)
    assert [(r.title, r.date_posted, r.company) for r in rows] == [("Cargo bom", "hoje mesmo", "")]


# --- files and whole jobs --------------------------------------------------------------------

def raw(rid, title, year=2010):
    return {"record_id": rid, "year": year, "title": title, "arquivo_timestamp": f"{year}0102030405", "original_url": "u",
            "wayback_url": "w", "source": "x", "company": "", "location": "", "date_posted": "", "scraped_at_utc": ""}


@pytest.fixture()
def raw_tree(tmp_path):
    for name, body in {
        "2010/a.json": raw("1", "Programador Java - Porto"), "2010/b.json": raw("1", "later copy"),
        "2011/c.json": raw("2", "abc", 2011), "2011/d.json": raw("", "Pedreiro em Lisboa", 2011),
        "2011/e.json": raw("", "Vigilante", 2011), "_state/s.json": raw("9", "state"),
    }.items():
        f = tmp_path / "raw" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(json.dumps(body, indent=2, ensure_ascii=False))
    (tmp_path / "raw/2010/z.json").write_text("{ not json")
    return str(tmp_path / "raw")


def test_raw_to_dataset(spark, raw_tree, tmp_path):
    df = readers.read_raw_json(spark, raw_tree)
    assert df.count() == 5
    compact = readers.compact_raw(df)
    assert sorted((r.record_id, r.title) for r in compact.collect()) == [
        ("", "Pedreiro em Lisboa"), ("", "Vigilante"), ("1", "Programador Java - Porto"), ("2", "abc")]
    final, rejected = build_dataset({"s": compact, "t": None})
    assert final.columns == ENRICHED_POSTING.fieldNames()
    rows = {r.title: r for r in final.collect()}
    assert set(rows) == {"Programador Java - Porto", "Pedreiro em Lisboa"}  # one empty id stays
    top = rows["Programador Java - Porto"]
    assert (top.job_category, top.location_extracted, top.date_archived, top.source) == ("IT", "Porto", "2010-01-02", "s")
    assert [r.title for r in rejected.collect()] == ["abc"]
    writers.write_csv(final, str(tmp_path / "csv"))
    back = readers.read_csv_table(spark, str(tmp_path / "csv"))
    assert prepare_dataset(back).count() == 2
    writers.write_parquet(final, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_small_file_layouts(spark, tmp_path):
    (tmp_path / "ann.json").write_text('{"1": {"company": "A", "company_conf": 0.9}}')
    assert readers.read_annotation_map(spark, str(tmp_path / "ann.json")).first().company == "A"
    (tmp_path / "cats.json").write_text('["Novo", null, "IT", "Turismo"]')
    custom = annotations.custom_labels(readers.read_custom_labels(spark, str(tmp_path / "cats.json")))
    assert [r.category for r in custom.collect()] == ["Novo"]
    writers.write_custom_labels(custom, str(tmp_path / "out"))
    assert [r.category for r in readers.read_custom_labels(spark, str(tmp_path / "out")).collect()] == ["Novo"]
    (tmp_path / "idx").write_text('["20100101000000", "u", "200"]\n{"timestamp": "20100102000000"}\nnope\n["20100103000000", "u", "404"]\n')
    idx = readers.snapshot_index_read(spark, str(tmp_path / "idx"), "s", 0, "b", 2)
    assert sorted(r.ts for r in idx.collect()) == ["20100101000000", "20100102000000"]


def test_report_document(spark, sf_dir, tmp_path):
    rows = star_postings(spark, sf_dir)
    cubes = PostingCubes(rows, STAR_SETTINGS, order=("record_id",))
    sections = build_report(cubes, [
        "metadata", "kpis", "ts.yearly_volume", "ts.category_by_year", "dist.flags", "loc.category_mix", "company.top",
        "lang.bigrams_by_period", "deep_dive.summary", "vulnerability"])
    saved = write_report(sections, str(tmp_path / "r"))
    direct = PostingCubes(lambda c: star_postings(spark, sf_dir, c), STAR_SETTINGS)
    for name in ("ts.category_by_year", "kpis", "company.top"):
        assert sorted(map(str, saved[name].collect())) == sorted(map(str, SECTIONS[name](direct).collect()))
    text = report_document(saved, separate=["loc.category_mix"]).first().document
    doc = json.loads(text)
    assert doc["schema_version"] == "3.0" and doc["kpis"][0]["total_ads"] == rows.count()
    assert doc["loc"]["category_mix"] == {"table": "loc.category_mix"}
    cubes.release()


# --- streams equal batches -----------------------------------------------------------------------

def test_stream_ingest_over_several_batches(spark, raw_tree):
    base = work_dir(spark, "t")
    stream = spark.readStream.schema(readers.RAW_POSTING).option("multiLine", True).option("maxFilesPerTrigger", 1).json(
        readers.raw_glob(raw_tree)).select("*", F.col("_metadata.file_path").alias("row_ord"))
    out = jobs.stream_ingest(stream.filter("record_id IS NOT NULL"), f"{base}/l", f"{base}/c")
    assert sorted(r.record_id for r in out.collect()) == ["", "", "1", "2"]
    again = jobs.stream_ingest(jobs.raw_json_stream(spark, raw_tree), f"{base}/m", f"{base}/d")
    batch = readers.compact_raw(readers.read_raw_json(spark, raw_tree))
    assert sorted((r.record_id, r.title) for r in again.collect()) == sorted((r.record_id, r.title) for r in batch.collect())


def test_stream_min_gap_starts_anew_each_year(spark, tmp_path):
    rows = [("s", k, f"{day}000000") for k in (1, 2) for day in ("20101201", "20101220", "20101230", "20110101", "20110110", "20110115")]
    for i in range(3):
        spark.createDataFrame([r for r in rows if rows.index(r) % 6 // 2 == i], "site string, k int, ts string").coalesce(
            1).write.parquet(f"{tmp_path}/in/{i}")
    src = spark.readStream.schema("site string, k int, ts string").option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    base = work_dir(spark, "y")
    got = jobs.stream_min_gap(src, f"{base}/k", f"{base}/c", ["site", "k"]).collect()
    assert sorted(r.ts[:8] for r in got if r.k == 1) == ["20101201", "20101220", "20110101", "20110115"]
    batch = snapshots.min_gap_sample_yearly(spark.createDataFrame(rows, "site string, k int, ts string"), ["site", "k"])
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.collect()))


def test_stream_min_gap_over_several_batches(spark, tmp_path):
    rows = [("s", f"2010{m:02d}{d:02d}000000") for m in (1, 2, 3) for d in (1, 9, 14, 20, 28)]
    for i in range(3):
        spark.createDataFrame(rows[i * 5:i * 5 + 5], "site string, ts string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    src = spark.readStream.schema("site string, ts string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    base = work_dir(spark, "g")
    got = jobs.stream_min_gap(src, f"{base}/k", f"{base}/c", "site").select("ts").collect()
    batch = snapshots.min_gap_sample(spark.createDataFrame(rows, "site string, ts string"), "site").select("ts").collect()
    assert sorted(got) == sorted(batch)


# --- plans ------------------------------------------------------------------------------------------

def test_enrich_is_one_native_projection(spark):
    df = spark.createDataFrame([("t", "20100101")], "title string, arquivo_timestamp string")
    text = enrich(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text.replace("PythonRDD", "") and "Exchange" not in text


def test_cube_needs_one_shuffle(spark, sf_dir):
    cubes = PostingCubes(lambda c: star_postings(spark, sf_dir, c), STAR_SETTINGS)
    text = cubes.cube("source", "part_time_hint")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "ReadSchema: struct<" in cubes.cube("source")._jdf.queryExecution().executedPlan().toString()
