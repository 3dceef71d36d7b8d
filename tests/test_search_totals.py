"""Trends over documents equal their SQL where texts are missing or blank and where a share lies between two roundings."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from jobstrata.catalog import search_queries
from jobstrata.operators import search
from tests.compare import compare


@pytest.fixture(scope="module")
def odd(tmp_path_factory, sf_dir):
    """29 of 1600 texts match in one year (0.018125); the other years hold blank and missing texts and a missing source."""
    texts = [("src4", "the there of the" if i < 29 else "words only") for i in range(1600)]
    texts += [("src1", t) for t in ("", " ", None, "\n", "the there")] + [("src14", t) for t in (None, "the  Theré")] + [(None, "the there")]
    folder = tmp_path_factory.mktemp("odd")
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": [t for _, t in texts], "source": [s for s, _ in texts],
                             "lang": ["en"] * len(texts)}), folder / "documents.parquet")
    pq.write_table(pq.read_table(f"{sf_dir}/region.parquet"), folder / "region.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    return con, str(folder)


@pytest.mark.parametrize("name", ["keyword_trend", "keyword_trend_batch", "trend_summary_batch", "peak_share"])
def test_trend_equals_sql(spark, odd, name):
    con, folder = odd
    assert compare(spark, con, name, search_queries.QUERIES[name], search_queries.ORACLES[name], folder) == ""


def test_corpus_drops_rows_without_title_unless_they_are_to_count(spark, odd):
    rows = spark.read.parquet(f"{odd[1]}/documents.parquet").selectExpr(
        "2000 + CAST(substring(source, 4) AS INT) AS year", "text AS title", "source AS category", "'x' AS url")
    assert search.search_corpus(rows).count() == 1602
    assert search.search_corpus(rows, untitled=True).count() == rows.count() == 1608
