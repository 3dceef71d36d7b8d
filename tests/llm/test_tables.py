"""Quality rules, sharding, search, pages, the pipeline and the named queries."""

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobstrata.llm import html_extraction, near_dedup, packing, quality_rules, sharding, suffix_dedup, topk_search
from jobstrata.llm.queries import ORACLES, QUERIES, WORD_MERGES
from tests.compare import compare
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in ORACLES:
        assert compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir) == ""
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_base_counts(edge_docs):
    texts = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    rows = quality_rules.measures(edge_docs).collect()
    got = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rows)
    assert got == sorted(str((i, *brute.base_counts(t))) for i, t in texts)


def test_binomial_tail(spark):
    cases = [(n, k, p) for n in (1, 5, 40, 3000) for k in (0, 1, 3, n // 2, n) for p in (0.01, 0.3) if k <= n]
    for n, k, p in cases:
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p)
                                  + (n - i) * math.log1p(-p)) for i in range(k + 1))
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n), F.lit(k), p).alias("t")).head().t
        if k <= n * p:
            assert got == pytest.approx(want, rel=1e-9), (n, k, p)
        else:
            assert got == 1


def test_certified_cutoffs(spark):
    """A measure that tells bad texts gets a cutoff where labels suffice; one that does not gets none; small strata get none."""
    rng = random.Random(0)
    prose = " ".join(f"word{i}" for i in range(60))
    docs, labels = [], []
    for i in range(4000):
        bad = rng.random() < 0.2
        docs.append((i, prose + (" ###" * 40 if bad else ""), "en" if i % 40 else "fr"))
        labels.append((i, 0 if bad else 1))
    docs += [(9000, prose + " ###" * 40, "en"), (9001, prose, "en"), (9002, prose + " ###" * 40, "fr"), (9003, prose, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labels + [(None, 0), (5, None)], "doc_id long, quality int")
    cuts = quality_rules.cutoffs(quality_rules.measures(docs), labels).collect()
    assert {r.stratum for r in cuts} == {"en"} and {"symbol_share"} <= {r.rule for r in cuts} <= {"symbol_share", "repeat_share"}
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    assert (kept[9000], kept[9001], kept[9002], kept[9003]) == (False, True, False, True) or kept[9002]
    assert all(r.kept == (not r.base_failed) for r in quality_rules.judge(docs, labels.limit(0)).collect())


def test_joint_rule_of_few_labels(spark):
    """Some 200 good holdout labels a stratum certify a joint rule: clear junk goes, good texts stay, noise gets no rule."""
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(1500):
        lang, bad = ("en", "de", "xx")[i % 3], rng.random() < 0.15
        prose = " ".join(f"word{rng.randrange(10**6)}" for _ in range(80))
        junk = rng.choice([" ###" * 20, " !" * 90]) if bad and lang != "xx" else ""
        docs.append((i, prose + junk, lang))
        labels.append((i, 0 if bad else 1))
    bad = {i for i, q in labels if q == 0 and docs[i][2] != "xx"}
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    passing = {r.doc_id for r in rows if not r.base_failed}
    assert bad & passing and passing - {r.doc_id for r in rows if r.kept} == bad & passing


def test_quality_query_equals_brute_force(spark):
    """The whole result over the tables of sf0.01, where a joint rule is certified, against plain counting."""
    place = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{place}/labels.parquet").select("doc_id", "quality").collect()]
    rules = brute.joint_rules(docs, labels, quality_rules.RULES)
    want = {}
    for i, text, stratum in docs:
        values, fails = brute.measured(text)
        rejected = any(values[rule] > cut for rule, cut in rules.get(stratum, {}).items())
        want[i] = (*brute.base_counts(text), fails, not fails and not rejected)
    rows = QUERIES["op4_quality_rules"](spark, place).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert {r.doc_id: tuple(r[c] for c in names) for r in rows} == want and len(rows) == len(docs)
    assert rules and sum(not w[-1] and not w[-2] for w in want.values()) > 0


def test_quality_edges(edge_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count()
    assert {r.doc_id: r.kept for r in rows if r.doc_id is not None} == {i: i in (1, 2, 3, 12, 13) for i in [*range(1, 14)]}
    assert quality_rules.judge(no_docs, labels).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharding(spark, shards, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "NEXT_BITS", 3)
    rng = random.Random(shards)
    texts = ["t" * rng.choice([0, 1, 5, 40, 400]) + str(rng.randrange(60)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_documents(docs, shards).toPandas()
    keys = docs.select("doc_id", F.xxhash64("text").alias("key")).toPandas().set_index("doc_id").key
    rows["key"] = keys.loc[rows.doc_id].to_numpy()
    groups = rows.groupby("key")["size"].sum().sort_index()
    assert rows.groupby("shard")["size"].sum().max() == brute.smallest_capacity(groups.tolist(), shards)
    assert (rows.groupby("key").shard.nunique() == 1).all()
    assert rows.sort_values("key").shard.is_monotonic_increasing
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_even_cuts():
    """Cuts keep the smallest capacity and the number of shards, and leave no shard empty beside a large group."""
    rng = random.Random(4)
    for _ in range(400):
        cells = [(i, i, rng.choice([1, rng.randrange(1, 30), rng.randrange(1, 400)]), 1, 64) for i in range(rng.randrange(1, 40))]
        shards, sizes = rng.randrange(1, 20), [c[2] for c in cells]
        capacity = sharding._smallest(cells, shards, max(sizes), sum(sizes), False)
        cuts = sharding._even(cells, capacity, shards)
        bounds = [0, *cuts, len(cells)]
        parts = [sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:])]
        assert len(parts) <= shards and all(parts) and max(parts) == capacity == brute.smallest_capacity(sizes, shards)


def test_sharding_beside_a_huge_group(spark):
    """One text holds a third of all rows: its shard is as large as it must be, all others share the rest."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('copy ', 20) ELSE repeat(concat('t', id, ' '), 15) END AS text")
    rows = sharding.shard_documents(docs).toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    huge = rows["size"][rows.doc_id == 0].iloc[0] * 2000
    assert len(sizes) == 16 and sizes.max() == huge and sorted(rows.doc_id) == list(range(6000))
    others = sizes[sizes < huge]
    assert len(others) == 15 and others.max() < 1.5 * others.mean()


def test_sharding_edges(edge_docs, no_docs):
    rows = sharding.shard_documents(edge_docs).collect()
    assert len(rows) == edge_docs.count() and {r.law for r in rows} == {"bytes"}
    assert all(r.size == 1 and r.text_crc32 == 0 for r in rows if r.doc_id in (4, 5))
    assert sharding.shard_documents(no_docs).count() == 0


def test_search(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 1 / 3, 2.0]) for _ in range(6)], "x") for i in range(160)]
    rows += [(200 + i, [0.5] * 6, "x") for i in range(40)] + [(300, None, "x"), (301, [1.0, None] + [1.0] * 4, "x"),
             (302, [float("nan")] * 6, "x"), (303, [float("inf")] * 6, "x"), (350, [1.0, 2.0], "x"), (351, [3.0, 2.0], "x"), (None, [1.0] * 6, "x"),
             (50, rows[50][1], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cutoff string")
    vectors = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows
               if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in vectors:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
            want += [(q, r, i, -s) for r, (s, i) in enumerate(found[:5], 1)]
    for slices in (2, 3):
        assert sorted(map(tuple, topk_search.top_k(frame, slices=slices).collect())) == sorted(want)
    assert topk_search.top_k(frame.limit(0)).count() == 0


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATES", 40)
    monkeypatch.setattr(topk_search, "QUERIES", 2)
    test_search(spark)


def test_pages(spark):
    page = ('<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">More</a>'
            '</li></ul></nav><div class="ad">Buy this now.</div><article><h1>Caf&eacute; &amp; bar</h1><p>First  line of\n text here, with <b>bold</b> '
            'words.<p>Second part &#8211; it goes on for a while, and then it ends.</p></article><div class="comments"><p>Nice one!</p></div>'
            '<footer>&copy; 2020</footer></body></html>')
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<<<&&& <p", "x"), (4, "u", "<![weird", "x")]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    want = "Café & bar First line of text here, with bold words. Second part – it goes on for a while, and then it ends."
    assert got[0].text == got[1].text == want and got[2].text == got[3].text == ""
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_with_open_head():
    """The end tag of a head and the tags of a body may be missing; titles, scripts and other head content stay hidden."""
    for ending in ("", "<body>", "</head>", "</head><body>", "<noscript><body>", "<head><body>"):
        tree = html_extraction.Tree(f"<html><head><title>x</title><noscript><p>no</p></noscript><meta a=b><style>p{{}}</style>\n{ending}<p>One.<p>Two.")
        assert [t for t in tree.text if t] == ["One.", "Two."], ending
    assert [t for t in html_extraction.Tree("<head><title>x</title>Plain <b>text</b>").text if t] == ["Plain text"]
    body = "<article><h1>Title of it</h1><p>First line of text here, with more words in it.</p></article></body></html>"
    closed, opened = (f"<html><head><title>T</title>{end}<body>{body}" for end in ("</head>", ""))
    want = "Title of it First line of text here, with more words in it."
    assert html_extraction.extractor().extract([closed, opened]) == [want, want]


def test_pages_with_odd_sections():
    """Unknown marked sections are comments; what stands behind them is read."""
    for page, want in (("<p>a</p><![weird[x]]><p>b</p>", ["a", "b"]), ("<p>if a[i]<![0] then</p><p>b</p>", ["if a[i]", "b"]),
                       ("<p>a</p><![ x><p>b</p>", ["a", "b"]), ("<p>a</p><![if !IE]><p>b</p><![endif]>", ["a", "b"]),
                       ("<p>a</p><![cdata-x[y]]><p>b", ["a", "b"]), ("<p>a</p><![CDATA[x>y]]><p>b", ["a", "b"]),
                       ("<p>a</p><![>b", ["a", "b"]), ("<p>a<![0] b", ["a<![0] b"]), ("<![weird", ["<![weird"])):
        assert [t for t in html_extraction.Tree(page).text if t] == want, page
    rng = random.Random(5)
    for _ in range(20_000):
        html_extraction.Tree("".join(rng.choice(["<![", "<!", "<", ">", "]", "]]>", "if", "cdata", "-", "--", " ", "x", "&", "/", "a"]) for _ in range(9)))


def test_capitals_of_long_runs():
    """The share of capitals counts the whole run, however long."""
    trees = [html_extraction.Tree("<p>" + "Ab " * n) for n in (100, 3000)]
    assert [html_extraction.features(t)[-1, 7] for t in trees] == [pytest.approx(1 / 3, rel=0.01)] * 2


def test_pages_of_strange_layouts():
    """Layouts drawn with another seed than those learned from."""
    model, wrong = html_extraction.extractor(), 0
    pages = list(html_extraction.training_pages(150, 77))
    for page, mark in pages:
        want = " ".join(t for t in html_extraction.Tree(page).text if t and mark in t)
        wrong += model.extract([page]) != [want]
    assert wrong <= 0.08 * len(pages)


def test_stages_on_edge_docs(spark, sf_dir, edge_docs):
    """Repeated rows leave one row, rows that share an id are judged one by one, all columns return."""
    prose, other = (" ".join(f"{w}{i}" for i in range(120)) for w in ("word", "thing"))
    near = prose.replace("word60", "else")
    extra = [(1, other), (20, near), (20, near), (20, other + " end"), (21, "few words"), (None, other), (None, None)]
    added = spark.createDataFrame(extra, "doc_id long, text string").join(edge_docs.drop("doc_id", "text").limit(1)).select(edge_docs.columns)
    docs = edge_docs.union(added)

    def rows(frame):
        assert frame.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)

    judged = rows(corpus_pipeline.quality(spark, docs, sf_dir))
    assert judged == sorted(((i, t) for i, t in rows(docs) if (c := brute.base_counts(t))[0] >= 50 and 2 * c[4] <= c[0]), key=str)
    left = rows(corpus_pipeline.near_duplicates(spark, docs, sf_dir))
    assert len(left) == len(set(left)) and (1, prose) in left and (1, other) in left and (7, "a") in left
    groups = [t for _, t in left if brute.words((t or "").lower())[:2] in (["word0", "word1"], ["thing0", "thing1"], ["intro", "words"])]
    assert sorted(groups) == sorted([prose, other])
    assert left.count((None, None)) == 1 and (4, None) in left and (21, "few words") in left
    assert len(rows(corpus_pipeline.passages(spark, docs.where("text is null or length(text) < 5"), sf_dir))) == 6
    cut = rows(corpus_pipeline.passages(spark, docs.where("doc_id = 20 or (doc_id is null and text like 'thing%')").distinct(), sf_dir))
    assert len(cut) == 2 and {i for i, _ in cut} == {20}
    assert corpus_pipeline.pack(spark, docs, sf_dir).count() >= len([1 for _, t in rows(docs) if brute.words(t)])


def test_language_without_ids(spark, sf_dir):
    """Rows without an id are judged by their text, like any other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    nameless = docs.where("doc_id < 40").withColumn("doc_id", F.lit(None).cast("long"))
    kept = corpus_pipeline.language(spark, docs.union(nameless), sf_dir)
    texts = [sorted(r.text for r in kept.where(c).collect()) for c in ("doc_id < 40", "doc_id is null")]
    assert texts[0] == texts[1] and len(texts[0]) > 20


def test_pipeline(spark, sf_dir):
    """Every stage on what the one before kept, against plain code or the operator's own tested verdicts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES)
    assert names == ("language", "quality", "near_duplicates", "passages", "packing")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}

    first = stages[0](spark, docs, sf_dir)
    assert first.columns == docs.columns
    one = {r.doc_id: r.text for r in first.collect()}
    assert set(one) == {i for i, t in texts.items() if any(map(str.isalpha, t or ""))}

    second = stages[1](spark, first, sf_dir)
    two = {r.doc_id for r in second.collect()}
    assert second.columns == docs.columns
    assert two == {r.doc_id for r in quality_rules.judge(first, labels).collect() if r.kept}
    passing = {i for i, t in one.items() if (c := brute.base_counts(t))[0] >= 50 and 2 * c[4] <= c[0]}
    assert two <= passing and len(two) > 0.5 * len(passing)

    third = stages[2](spark, second, sf_dir)
    three = {r.doc_id for r in third.collect()}
    components = brute.near_components([(i, one[i]) for i in two], 80)
    assert three == {i for i, c in components.items() if i == c} and third.columns == docs.columns

    fourth = stages[3](spark, third, sf_dir)
    four = {r.doc_id: r for r in fourth.collect()}
    _, cut = brute.repeated_words([(i, one[i]) for i in three])
    left = {i: [w for k, w in enumerate(brute.words(one[i])) if k not in cut.get(i, ())] for i in three}
    assert {i: brute.words(r.text) for i, r in four.items()} == {i: w for i, w in left.items() if w}
    assert fourth.columns == docs.columns and all(r.n_chars == len(r.text) for r in four.values())

    last = sorted(map(str, stages[4](spark, fourth, sf_dir).drop("sequence_id", "offset").collect()))
    assert last == sorted(map(str, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect()))
    assert {near_dedup, suffix_dedup, packing} and WORD_MERGES
