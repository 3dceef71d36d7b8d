import pytest

from tests.compare import connect


def edge_rows():
    """Nulls, empty and white texts, repeated rows and ids, ties, copies and one very long text."""
    prose = " ".join(f"word{i}" for i in range(120))
    near = prose.replace("word60", "other")
    return [
        (1, prose, "en"), (2, prose.upper(), "en"), (3, near, None), (4, None, "en"), (5, "", "en"), (6, " \t\n\v\f\r ", None),
        (7, "a", "fr"), (7, "a", "fr"), (8, "one two three four", "fr"), (9, "x" * 50_000 + " " + "tok " * 20_000, "de"),
        (None, prose, "en"), (None, None, None), (10, "é ñ 日本 🙂 it's 'll\n\nline\nline", "de"), (11, "123 !!! ###", "es"),
        (12, "intro words here " + prose + " and a tail", "en"), (13, prose, "en"), (1, prose, "en"),
    ]


#: Columns that operators use inside, to see that they do not clash.
CLASHING = ["rep", "key", "component", "low", "place", "group", "h", "s", "start", "stratum", "shard", "n_words", "p", "n", "v", "ids"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, lang, "src", len(t or ""), *(["clash"] * len(CLASHING))) for i, t, lang in edge_rows()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def con(sf_dir):
    return connect(sf_dir)
