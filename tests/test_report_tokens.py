"""The tokens of the report are taken from the texts once."""

import pytest
from pyspark.sql import functions as F

from jobstrata.catalog import report_queries
from jobstrata.functions.text import bigrams, tokens
from jobstrata.plans.inputs import PostingCubes
from jobstrata.plans.report import build_report, write_report
from jobstrata.streaming.files import written

TEXTS = ("lang.keywords_by_period", "lang.bigrams_by_period", "lang.bigrams_global", "lang.emergence", "lang.decline", "deep_dive.top_keywords")


def counted_cubes(spark, sf_dir, taken):
    """Cubes that count how often a text's tokens could be taken: every frame made with its titles."""
    direct = report_queries.document_cubes(spark, sf_dir)

    def rows(columns):
        if "title" in columns:
            taken.append(columns)
        return direct.rows(*columns)

    return PostingCubes(rows, direct.settings, order=("doc_id",))


def test_saved_tokens_give_the_same_sections(spark, sf_dir, tmp_path):
    taken = []
    cubes = counted_cubes(spark, sf_dir, taken)
    saved = write_report(build_report(cubes, TEXTS, ("token",), f"{tmp_path}/tokens"), f"{tmp_path}/sections")
    assert len(taken) == 1
    cubes.release()
    cubes = counted_cubes(spark, sf_dir, taken)
    for name in TEXTS:
        got, want = (sorted(map(str, df.collect())) for df in (saved[name], build_report(cubes, [name], ("token",))[name]))
        assert got == want != [], name
    cubes.release()


@pytest.mark.parametrize("words", [["x1"], [], ["x1", "x2"], ["x1", "x2", "x1", "x2", "x3"]])
def test_bigram_rows_are_all_pairs(spark, words):
    cubes = PostingCubes(spark.createDataFrame([(2010, " ".join(words), "r"), (2011, None, "r")], "year int, title string, record_id string"))
    kept = tokens(F.lit(" ".join(words)), cubes.settings.stopwords)
    want = spark.range(1).select(F.explode(bigrams(kept))).collect()
    assert sorted(r.bigram for r in cubes.bigram_rows().collect()) == sorted(r[0] for r in want)


def test_a_frame_is_written_again(spark, tmp_path):
    for n in (5, 3):
        assert written(spark.range(n), f"{tmp_path}/frame").count() == n
