"""First spellings by row order without sorting every row."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobstrata.catalog import search_queries
from jobstrata.operators import search

SPELLINGS = ["Red Ring", "red ring", "RED  RING", "réd ring", "Blue", "blue", "BLUE", "ab", "***", ""]
LONG = "https://example.org/"


def test_titles_are_counted_without_a_sort(spark, sf_dir):
    corpus = search_queries.star_corpus(spark, sf_dir)
    pieces = corpus.select("record_id", F.lit(1).alias("part"), F.col("title").alias("label"))
    plan = search._spellings(pieces, search._leading("record_id"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[label" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("ids", [
    ["1-1", "10-1", "1-2", "2-1"], [None, "a", "é", "\U0001f600", "", "\uffff"], [LONG + x for x in ("a", "b", "ab", "é")] + ["a" * 14, "a" * 15, "a" * 13],
    ["a", "a\0", "a\0\0"], ["same"]])
def test_the_first_spelling_is_shown(spark, ids):
    draw = random.Random(str(ids))
    for _ in range(3):
        rows = list({i: (i, draw.choice(SPELLINGS), draw.choice(SPELLINGS)) for i in draw.sample(ids, len(ids))}.values())
        corpus = spark.createDataFrame(rows, "record_id string, title string, category string")
        seen = defaultdict(list)
        for i, *labels in rows:
            for part, label in enumerate(labels):
                norm = " ".join(label.lower().replace("é", "e").replace("*", " ").split())
                if len(norm) > 2:
                    seen[norm].append((i is not None, (i or "").encode(), part, label))
        want = sorted((min(v)[3], len(v)) for v in seen.values())
        assert sorted(map(tuple, search.suggestions(corpus, "record_id").collect())) == want
        assert sorted(map(tuple, search.suggestions(corpus, ["record_id", "title"]).collect())) == want
