"""The dataset job moves a row by its id once, and by its title only where titles are many."""

import re

from jobstrata.catalog import dataset_queries
from jobstrata.operators import annotations
from jobstrata.plans.enrichment import build_marked, judged_titles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_shuffled_once(spark, sf_dir):
    """One exchange of postings and one of annotations, both by record id."""
    text = plan(dataset_queries.build_dataset_query(spark, sf_dir))
    assert re.findall(r"Exchange hashpartitioning\((\w+)", text) == ["record_id"] * 2


def test_saved_and_computed_titles_agree(spark, tmp_path):
    rows = [(i, f"{i % 5}" if i % 7 else None, t, s, f"2010010{1 + i % 3}000000", i % 4 != 3) for i, (t, s) in enumerate(
        (t, s) for t in ("Programador Java - Porto", "Enfermeiro em Lisboa", "Xpto", "Vendedor (M/F)") for s in ("a", "b", "c") for _ in range(4))]
    marked = spark.createDataFrame(rows, "row_ord int, record_id string, title string, source string, arquivo_timestamp string, accepted boolean")
    ann = spark.createDataFrame([("1", "ACME", 0.9, None, 0.0, "IT", 0.9), ("1", "Worse", 0.8, "Braga", 0.9, "IT", 0.1), ("3", "Low", 0.1, "Faro", 0.9, "IT", 0.9),
                                 ("", "None", 0.9, "Faro", 0.9, "IT", 0.9)],
                                "record_id string, company string, company_conf double, location string, location_conf double, category string, category_conf double")
    judged_titles(marked).write.parquet(f"{tmp_path}/titles")
    outs = [build_marked(marked, ["b", "a"], ann, titles=t).collect() for t in (None, spark.read.parquet(f"{tmp_path}/titles"))]
    assert sorted(map(str, outs[0])) == sorted(map(str, outs[1]))
    # the first accepted row of an id in the order of sources and rows, whatever is added later
    want = {}
    for i, rid, t, s, _, ok in sorted((r for r in rows if r[5] and r[3] in "ab"), key=lambda r: (r[3] != "b", r[0])):
        want.setdefault(rid, (s, t))
    assert {r.record_id: (r.source, r.title) for r in outs[0]} == want and len(outs[0]) == len(want)
    assert next(r for r in outs[0] if r.record_id == "1").company_extracted in ("ACME", None)


def test_attached_by_unique_ids_or_by_key(spark):
    posts = spark.createDataFrame([("1", "t"), ("2", "t"), ("", "t"), (None, "t")], "record_id string, title string")
    ann = spark.createDataFrame([("1", "A", 0.9), ("1", "B", 0.8), ("", "C", 0.9), (None, "D", 0.9)], "record_id string, company string, company_conf double").selectExpr(
        "*", "'' AS location", "0D AS location_conf", "'IT' AS category", "1D AS category_conf", "true AS is_job")
    got = [sorted(map(str, annotations.attach_annotations(posts, ann, unique).select("record_id", "title", "_company").collect())) for unique in (False, True)]
    assert got[0] == got[1] and len(got[0]) == 4 and sum("None" not in g for g in got[0]) == 1


def test_tables_in_between_hold_used_columns_only(spark, sf_dir, monkeypatch):
    held, write = {}, dataset_queries.written

    def noted(df, path, *partitions):
        held[path.rsplit("/", 1)[1]] = set(df.columns)
        return write(df, path, *partitions)

    monkeypatch.setattr(dataset_queries, "written", noted)
    dataset_queries.dataset_report_query(spark, sf_dir)
    assert set(held) == {"marked", "titles", "postings"}
    assert "title" not in held["postings"] and not {"l_orderkey", "l_linenumber"} & held["marked"]
