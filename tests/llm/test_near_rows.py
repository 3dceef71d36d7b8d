"""Rows that the near-duplicate steps make for a large group."""

import re

from jobstrata.llm import near_dedup
from tests.llm.test_dedup import family


def test_no_row_for_each_shingle_of_a_center(spark):
    docs = family(1, 60)
    texts = spark.createDataFrame(docs, "rep long, text string")
    rows = spark.createDataFrame([(i % 4, i, i % 3) for i, _ in docs], "key long, rep long, component long").crossJoin(spark.sql("SELECT 0L AS n, 0L AS common"))
    centers = {r.key: r.center for r in near_dedup._middles(rows).collect()}
    placed = near_dedup._placed(rows, texts)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not re.search(r"Join.*center#\d+L? = .*shingle#\d+L? = ", plan)

    sets = {i: {tuple(t.split()[j:j + 5]) for j in range(len(t.split()) - 4)} for i, t in docs}
    got = {(r.key, r.rep): (r.inside, r.outside) for r in placed.collect()}
    assert len(got) == len(docs)
    for i, _ in docs:
        shared = sets[i] & set().union(*(sets[j] for j, _ in docs if j % 3 != i % 3))
        inside = len(shared & sets[centers[i % 4]])
        assert got[i % 4, i] == (inside, len(shared) - inside)
