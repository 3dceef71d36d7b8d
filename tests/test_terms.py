"""Frequent and emerging terms without counting or sorting every token of the texts."""

import random
from collections import Counter

import pytest

from jobstrata.catalog import report_queries
from jobstrata.operators.aggregates import most_frequent
from jobstrata.plans.inputs import PostingCubes
from jobstrata.plans.language import emergence_table


@pytest.mark.parametrize("cells, first", [(64, 3), (1 << 16, 1000), (1, 1), (64, 1)])
def test_most_frequent_equals_counting(spark, cells, first):
    rng = random.Random(3)
    rows = [(g, f"t{int(rng.paretovariate(0.6)) % 500}") for g in (1, 2, 2, 2, 3) for _ in range(400)] + [(4, "only"), (4, "two")]
    got = most_frequent(spark.createDataFrame(rows, "g int, term string"), "g", "term", 5, cells, first).collect()
    want = [(g, t, n) for k in (1, 2, 3, 4)
            for (g, t), n in sorted(Counter(r for r in rows if r[0] == k).items(), key=lambda x: (-x[1], x[0][1]))[:5]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_most_frequent_of_no_rows(spark):
    assert most_frequent(spark.createDataFrame([], "g int, term string"), "g", "term", 5).collect() == []


def test_emergence_sorts_no_tokens(spark, sf_dir):
    cubes = report_queries.document_cubes(spark, sf_dir)
    assert "SortAggregate" not in emergence_table(cubes)._jdf.queryExecution().executedPlan().toString()


def test_emergence_is_in_row_order(spark):
    rows = [(2, 2024, "late words"), (None, 2024, "first words"), (-5, 2009, "old words"), (2**60, 2009, "old end"), (1, 2010, "mid words end")]
    texts = spark.createDataFrame(rows, "doc_id long, year int, title string").selectExpr(
        "*", "'r' AS record_id", *(f"false AS {f}" for f in ("gender_marker", "is_internship", "remote_hint", "part_time_hint")))
    by_number, by_struct = (PostingCubes(texts, order=order) for order in (("doc_id",), ("doc_id", "record_id")))
    for n in range(1, 7):
        few = [emergence_table(PostingCubes(texts, c.settings.with_(emergence_candidates=n), c.order)).collect() for c in (by_number, by_struct)]
        assert sorted(few[0]) == sorted(few[1]) != []
