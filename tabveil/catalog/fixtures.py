"""The candidate view: a registry-like table from orders, customer, nation and
region, in DataFrame and in SQL form. Every row of ``orders`` is one candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.operators.sampling import halves
from tabveil.sources.readers import read_parquet


def table(spark: SparkSession, sf_dir: str, name: str, balance: bool = False) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", balance=balance)


def candidates(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The candidate view, or some of its columns."""
    joined = (
        table(spark, sf_dir, "orders", balance=True)
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    town = F.col("c_custkey") % 40
    born = F.date_format(F.add_months("o_orderdate", (-12 * (F.col("c_custkey") % 60)).cast("int")), "dd/MM/yyyy")
    segment, priority, status = F.col("c_mktsegment"), F.col("o_orderpriority"), F.col("o_orderstatus")
    view = joined.select(
        F.col("o_orderkey").alias("SQ_CANDIDATO"),
        F.col("c_name").alias("NM_URNA_CANDIDATO"),
        F.col("r_name").alias("SG_UF"),
        F.concat(F.lit("  "), F.lower("n_name"), F.lit(" "), town.cast("string"), F.lit(" ")).alias("NM_UE"),
        (F.col("c_nationkey").cast("long") * 100 + town).alias("SG_UE"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("r_name")).when(F.col("c_custkey") % 3 == 1, F.col("n_name"))
        .alias("SG_UF_NASCIMENTO"),
        priority.alias("CD_CARGO"),
        (F.col("c_custkey") % 45 + 10).alias("NR_PARTIDO"),
        F.concat(segment, F.lit("-"), (F.col("c_custkey") % 9).cast("string")).alias("SG_PARTIDO"),
        status.alias("CD_GENERO"),
        segment.alias("CD_GRAU_INSTRUCAO"),
        F.when(segment == "BUILDING", "Superior completo").when(segment == "MACHINERY", "Superior incompleto")
        .when(segment == "FURNITURE", "Ensino médio completo").otherwise("Lê e escreve").alias("DS_GRAU_INSTRUCAO"),
        F.substring(priority, 1, 1).cast("int").alias("CD_ESTADO_CIVIL"),
        F.when(F.substring(priority, 1, 1).isin("1", "2"), "Casado(a)").otherwise("Solteiro(a)").alias("DS_ESTADO_CIVIL"),
        F.floor(F.col("c_acctbal") / 2000).alias("CD_COR_RACA"),
        F.floor(F.col("o_totalprice") / 1000).alias("CD_OCUPACAO"),
        F.when(F.col("o_orderkey") % 97 == 0, F.lit(None)).when(F.col("o_orderkey") % 89 == 0, F.lit("sem data"))
        .otherwise(born).alias("DT_NASCIMENTO"),
        F.when(F.col("o_totalprice") > 250000, "Apto").otherwise("Inapto").alias("DS_SITUACAO_CANDIDATURA"),
        F.when(status == "F", "Eleito").when(status == "O", "Não eleito").otherwise("Suplente").alias("DS_SIT_TOT_TURNO"),
        F.col("o_totalprice").alias("VR_BENS"),
    )
    return view.select(*columns) if columns else view


CANDIDATES_SQL = """
cand AS (
  SELECT o_orderkey AS SQ_CANDIDATO,
         c_name AS NM_URNA_CANDIDATO,
         r_name AS SG_UF,
         '  ' || lower(n_name) || ' ' || CAST(c_custkey % 40 AS VARCHAR) || ' ' AS NM_UE,
         CAST(c_nationkey AS BIGINT) * 100 + c_custkey % 40 AS SG_UE,
         CASE WHEN c_custkey % 3 = 0 THEN r_name WHEN c_custkey % 3 = 1 THEN n_name END AS SG_UF_NASCIMENTO,
         o_orderpriority AS CD_CARGO,
         c_custkey % 45 + 10 AS NR_PARTIDO,
         c_mktsegment || '-' || CAST(c_custkey % 9 AS VARCHAR) AS SG_PARTIDO,
         o_orderstatus AS CD_GENERO,
         c_mktsegment AS CD_GRAU_INSTRUCAO,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Superior completo' WHEN 'MACHINERY' THEN 'Superior incompleto'
              WHEN 'FURNITURE' THEN 'Ensino médio completo' ELSE 'Lê e escreve' END AS DS_GRAU_INSTRUCAO,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS CD_ESTADO_CIVIL,
         CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'Casado(a)' ELSE 'Solteiro(a)' END AS DS_ESTADO_CIVIL,
         CAST(floor(c_acctbal / 2000) AS BIGINT) AS CD_COR_RACA,
         CAST(floor(o_totalprice / 1000) AS BIGINT) AS CD_OCUPACAO,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'sem data'
              ELSE strftime(CAST(CAST(o_orderdate AS DATE) - to_months(CAST(12 * (c_custkey % 60) AS INTEGER)) AS DATE),
                            '%d/%m/%Y') END AS DT_NASCIMENTO,
         CASE WHEN o_totalprice > 250000 THEN 'Apto' ELSE 'Inapto' END AS DS_SITUACAO_CANDIDATURA,
         CASE o_orderstatus WHEN 'F' THEN 'Eleito' WHEN 'O' THEN 'Não eleito' ELSE 'Suplente' END AS DS_SIT_TOT_TURNO,
         o_totalprice AS VR_BENS
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey)
"""


def unit_sql(key: str, seed: str) -> str:
    """SQL of the uniform draw of ``row_uniform``."""
    return f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8)) AS BIGINT) / 4294967296.0)"


def digest_sql(key: str, seed: str) -> str:
    """SQL of ``row_digest`` for one id."""
    return f"md5(CAST({key} AS VARCHAR) || '|{seed}')"


HALF_A = f"{unit_sql('SQ_CANDIDATO', 'half')} < 0.5"
HALF_B = f"{unit_sql('SQ_CANDIDATO', 'half')} >= 0.5"
HALVES_SQL = f"""{CANDIDATES_SQL},
ori AS (SELECT * FROM cand WHERE {HALF_A}),
syn AS (SELECT * FROM cand WHERE {HALF_B})
"""


def two_populations(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The candidate view in two disjoint halves, as original and observed table."""
    chosen = candidates(spark, sf_dir, *dict.fromkeys(["SQ_CANDIDATO", *columns])) if columns else candidates(spark, sf_dir)
    return halves(chosen, "SQ_CANDIDATO")
