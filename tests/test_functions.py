"""Column functions on literal rows, against expectations worked out by hand."""

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobstrata import vocab
from jobstrata.functions import metrics, rules, text
from jobstrata.functions.extract import clean_location, with_company, with_location
from jobstrata.functions.urls import canonical_url, era_site, numbered_site, record_key, safe_external_url, slug_site


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_gender_marker(spark):
    assert apply(spark, ["X (M/F)", "X (m/f)", "X M/F", None], rules.flag_gender_marker) == [True, True, False, False]


def test_other_flags(spark):
    assert apply(spark, ["Estagiária", "estágios de verão", "trainees"], rules.flag_internship) == [True, True, False]
    assert apply(spark, ["Work from home", "REMOTO", "remotos"], rules.flag_remote) == [True, True, False]
    assert apply(spark, ["Part-Time", "20 horas semanais", "imparcial"], rules.flag_part_time) == [True, True, False]


def test_seniority(spark):
    got = apply(spark, ["Diretor Sénior", "Programador", None, "Sr. Engenheiro", "RECÉM LICENCIADO"],
                rules.classify_seniority)
    assert got == ["director", "mid", "na", "senior", "junior"]


def test_category(spark):
    titles = ["consultor .net", "MÉDICO dentista", "Designer de Software", "Cozinheiro - hotel", None, "asp.net"]
    got = apply(spark, titles, rules.classify_category)
    assert got == ["Outros", "Saúde", "IT", "Restauração & Hotelaria", "Outros", "IT"]


def test_posting_title(spark):
    titles = ["abc", "https://a.b", "Pesquisa Avançada", None, "Pedreiro", "Pedreiro | Mobijake xyz"]
    assert apply(spark, titles, rules.is_posting_title) == [False, False, False, False, True, True]
    assert apply(spark, [" Pedreiro - MOBIJAKE 3 "], rules.strip_noise) == ["Pedreiro"]


def test_archived_date(spark):
    assert apply(spark, ["20140905132935", "2014", "x", None], rules.archived_date) == ["2014-09-05", None, None, None]


def test_dates(spark):
    assert apply(spark, ["em 03/04-2010 aqui", "nada"], rules.normalise_date_posted) == ["03.04.2010", ""]
    got = apply(spark, ["12 / Março / 2019", "1 / May / 2008", "x"], rules.parse_named_date)
    assert [str(d) for d in got] == ["2019-03-12", "2008-05-01", "None"]


def test_extraction(spark):
    rows = [
        ("Empregado de Mesa (M/F) - Porto", "Porto", None),
        ("Programador Java Sénior - Novabase", None, "Novabase"),
        ("Gestor de Marketing Digital Urgente Lisboa", "Lisboa", None),
        ("Técnico de RH - Grupo Jerónimo Martins - Setúbal", "Setúbal", None),
        ("Novabase recruta programador em CASTELO BRANCO", "Castelo Branco", "Novabase"),
        ("Vendedor para a Worten Portugal", None, "Worten Portugal"),
        ("Vendedor para Worten Portugal", None, None),  # the pattern wants "para a" or two spaces
        ("Motorista - London", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, title string")
    got = with_company(with_location(df)).orderBy("i").collect()
    assert [g.location_extracted for g in got] == [r[1] for r in rows]
    assert [g.company_extracted for g in got] == [r[2] for r in rows]


def test_clean_location(spark):
    got = apply(spark, ["LISBOA", " - Porto 8h/dia", "12 - 3", "ab", "Urgente", "Faro (m/f) sul", "Évora,"], clean_location)
    assert got == ["Lisboa", "Porto", None, None, None, "Faro sul", "Évora"]


def test_repair_mojibake(spark):
    got = apply(spark, ["ConstruÃ§Ã£o", "Olá Ã©", "€ Ã", "  ok ", None], text.repair_mojibake)
    assert got == ["Construção", "Olá Ã©", "€ Ã", "ok", None]


def test_bigrams(spark):
    got = apply(spark, [[], ["a"], ["a", "b", "c"]], text.bigrams, "array<string>")
    assert got == [[], [], ["a b", "b c"]]


def test_tokens(spark):
    got = apply(spark, ["Programador C++ e .NET (M/F) 2019 c# para Lisboa", "para parar 3d"],
                lambda c: text.tokens(c, vocab.STOPWORDS))
    assert got == [["programador", "c++", ".net", "c#"], ["parar", "3d"]]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn", "Cf")),
                        max_size=20), min_size=1, max_size=40))
def test_fold_equals_unicodedata(spark, values):
    def reference(s):
        return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")

    plain = [v for v in values if "İ" not in v and "Σ" not in v]
    assert apply(spark, plain, text.fold) == [reference(v) for v in plain]


def test_title_case(spark):
    assert apply(spark, ["VIANA DO CASTELO", "beja/algarve", "d'ávila"], text.title_case) == [
        "Viana Do Castelo", "Beja/Algarve", "D'Ávila"]


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 32.0), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(metrics.pct(F.col("a"), F.col("b"))).collect()] == [0.0312, 0.0]
    c = spark.createDataFrame([(0, 5, 3), (1, 8, 3)], "a int, b int, n int")
    assert [r[0] for r in c.select(metrics.cagr(F.col("a"), F.col("b"), F.col("n"))).collect()] == [None, 1.0]
    even = spark.createDataFrame([(1,)] * 4, "n int")
    h = even.agg(metrics.hhi(F.col("n")).alias("h"), metrics.entropy(F.col("n")).alias("e")).select(
        "h", metrics.effective_categories(F.col("h")).alias("k"), "e").first()
    assert tuple(h) == (0.25, 4.0, 2.0)


@pytest.mark.parametrize("rules_,href,expected", [
    (numbered_site("jobs.example"), "/12345/vaga-x", "http://jobs.example/12345/vaga-x"),
    (numbered_site("jobs.example"), "http://a.example/wayback/20100102030405/http://jobs.example/12345/vaga-x",
     "http://jobs.example/12345/vaga-x"),
    (numbered_site("jobs.example"), "/noFrame/replay/20100102030405/http://other.example/12345/vaga", None),
    (numbered_site("jobs.example"), "/style.css", None),
    (slug_site("blog.example"), "http://blog.example/2019/03/12/designer-27/", "http://blog.example/2019/03/12/designer-27/"),
    (slug_site("blog.example"), "http://blog.example/page/2/", None),
    (slug_site("blog.example"), "/relative-slug", None),
    (era_site("era.example"), "/emprego/x", "http://era.example/emprego/x"),
    (era_site("era.example"), "https://a/noFrame/replay/20100102030405im_/http://era.example/y", "http://era.example/y"),
])
def test_canonical_url(spark, rules_, href, expected):
    assert apply(spark, [href], lambda c: canonical_url(c, rules_)) == [expected]


def test_record_key(spark):
    df = spark.createDataFrame([("u", "1"), ("u", "2")], "u string, t string")
    assert df.select(record_key(F.col("u"))).distinct().count() == 1
    assert df.select(record_key(F.col("u"), F.col("t"), None, "snapshot_url")).distinct().count() == 2


def test_safe_url(spark):
    got = apply(spark, ["http://a.b/c", "//x.y", "Archive.PT/p", " ", None, "two words"],
                lambda c: safe_external_url(c, "F"))
    assert got == ["http://a.b/c", "https://x.y", "https://archive.pt/p", "F", "F", "F"]
