"""The jobs end to end, from index and pages to the report."""

import json

from jobstrata import jobs


def test_chain(spark, tmp_path):
    index = [("s", 0, "http://s/", f"{y}{m:02d}{d:02d}000000", 200) for y in (2010, 2011) for m in (1, 6) for d in (1, 3, 20)]
    spark.createDataFrame(index, "site string, seed_priority int, base_url string, ts string, statuscode int").write.parquet(f"{tmp_path}/index")
    jobs.snapshots_job(spark, f"{tmp_path}/index", f"{tmp_path}/chosen", 2010, 2011)
    chosen = sorted(r.ts[:8] for r in spark.read.parquet(f"{tmp_path}/chosen").collect())
    assert chosen == [f"{y}{m:02d}{d:02d}" for y in (2010, 2011) for m in (1, 6) for d in (1, 20)]

    titles = ["Programador Java - Porto", "Enfermeiro em Lisboa", "Vendedor (M/F)"]
    pages = [("s", ts, f"p{ts}", "".join(f'<li class="oferta"><a href="/{10000 + n}/vaga-{ts[:8]}">{t}</a></li>' for n, t in enumerate(titles))
              if ts[4:6] == "01" else "<p>nada</p>") for _, _, _, ts, _ in index]
    spark.createDataFrame(pages, "site string, ts string, page_url string, html string").write.parquet(f"{tmp_path}/pages")
    jobs.pages_job(spark, f"{tmp_path}/chosen", f"{tmp_path}/pages", f"{tmp_path}/s", "container", "s", "jobs.example")
    raw = spark.read.parquet(f"{tmp_path}/s/raw")
    assert raw.count() == 12 and {r.arquivo_timestamp[4:6] for r in raw.collect()} == {"01"}

    jobs.dataset_job(spark, f"{tmp_path}/data", {"s": f"{tmp_path}/s/raw"})
    postings = spark.read.parquet(f"{tmp_path}/data/postings")
    assert postings.count() == 12 and {r.title for r in postings.collect()} == set(titles)

    jobs.annotate_out_job(spark, f"{tmp_path}/data/postings", f"{tmp_path}/requests")
    requests = spark.read.json(f"{tmp_path}/requests").collect()
    ids = [line.split("id=")[1].split(" |")[0] for r in requests for line in r.text.split("\n")]
    assert sum(r.n_items for r in requests) == len(ids) > 0
    answer = {i: {"company": "ACME", "company_conf": 0.9, "category": "Robotica", "category_conf": 0.9} for i in ids}
    (tmp_path / "responses.json").write_text(json.dumps({"batch_no": 1, "response": json.dumps(answer)}))
    jobs.annotate_in_job(spark, f"{tmp_path}/responses.json", f"{tmp_path}/answers")
    assert "Robotica" in spark.read.text(f"{tmp_path}/answers/labels").first().value
    jobs.annotate_out_job(spark, f"{tmp_path}/data/postings", f"{tmp_path}/requests2", f"{tmp_path}/answers/annotations")
    assert spark.read.text(f"{tmp_path}/requests2").count() == 0

    jobs.dataset_job(spark, f"{tmp_path}/data2", {"s": f"{tmp_path}/s/raw"}, f"{tmp_path}/answers/annotations")
    final = spark.read.parquet(f"{tmp_path}/data2/postings")
    assert {r.company_extracted for r in final.collect() if r.record_id in ids} == {"ACME"}
    jobs.report_job(spark, f"{tmp_path}/data2/postings", f"{tmp_path}/report")
    document = json.loads(spark.read.text(f"{tmp_path}/report/document").first().value)
    assert document["metadata"]["rows"][0]["records"] == 12 and len(document["ts"]["yearly_volume"]) == 2
