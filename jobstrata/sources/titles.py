"""Postings with realistic titles, derived from the star tables by one SQL expression.

The expression is plain SQL that Spark and DuckDB both run, so the check side sees the
same titles.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobstrata.sources.tables import spread, table

ROLES = [
    "Programador Java", "Enfermeiro", "Empregado de Mesa", "Técnico de Vendas Sénior", "Gestor de Marketing Digital",
    "Técnico de RH", "Advogado Fiscalista", "Designer Gráfico", "Consultor Imobiliário", "Motorista de Distribuição",
    "Pedreiro", "Engenheiro Civil", "Contabilista", "Professor de Inglês", "Assistente Administrativo",
    "Cabeleireira", "Vigilante", "Colaborador Polivalente", "Diretor Comercial", "Estágio Marketing",
    "Head of Sales", "Scrum Master", "Part-time Loja", "Teletrabalho Call Center", "MÉDICO Dentista",
]
PLACES = [
    "Lisboa", "Porto", "Braga", "Coimbra", "Setúbal", "Aveiro", "Faro", "Évora", "Castelo Branco", "Viana do Castelo",
    "LISBOA", "London", "Urgente", "Porto 8h diárias", "Vila Real", "Gaia", "Full Time", "Bragança", "Ponta Delgada",
    "Beja/Algarve", "Zona Norte", "Sintra", "guarda", "Matosinhos", "Suíça",
]


def _case(column, values, numbers):
    arms = " ".join(f"WHEN {n} THEN '{v}'" for n, v in zip(numbers, values))
    return f"(CASE {column} {arms} END)"


ROLE = _case("p_brand", ROLES, [f"'Brand#{i + 1}'" for i in range(25)])
PLACE = _case("s_nationkey", PLACES, range(25))
COMPANY = "(upper(substr(p_name, 1, 1)) || substr(p_name, 2))"
TITLE = f"""(CASE l_returnflag || l_linestatus
  WHEN 'AO' THEN {ROLE} || ' (M/F) - ' || {PLACE}
  WHEN 'AF' THEN {COMPANY} || ' recruta ' || {ROLE} || ' em ' || {PLACE}
  WHEN 'NO' THEN {ROLE} || ' para ' || {COMPANY}
  WHEN 'NF' THEN {ROLE} || ' - ' || {COMPANY}
  WHEN 'RO' THEN '  ' || {ROLE} || ' ' || {PLACE} || ' | Mobijake portugal'
  ELSE CASE WHEN l_quantity = 1 THEN NULL WHEN l_quantity = 2 THEN 'https://' || l_partkey WHEN l_quantity = 3 THEN 'Pesquisa Avançada'
    WHEN l_quantity = 4 THEN 'ABC' ELSE 'Grupo ' || {COMPANY} || ' - ' || {ROLE} END END)"""

TITLED_SQL = f"""titled AS (SELECT l_orderkey || '-' || l_linenumber AS record_id, {TITLE} AS title, l_returnflag AS source,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def titled_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spread(table(spark, sf_dir, "lineitem"))
    f = f.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    f = f.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return f.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("record_id"),
        F.expr(TITLE).alias("title"), F.col("l_returnflag").alias("source"), "l_orderkey", "l_linenumber",
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
    )
