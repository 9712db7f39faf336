"""Queries of derived features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabveil.catalog.fixtures import CANDIDATES_SQL, candidates, table
from tabveil.catalog.registry import query, r6
from tabveil.functions import text
from tabveil.operators import features
from tabveil.roles import TITLES

LABEL = "CASE WHEN upper(DS_SIT_TOT_TURNO) LIKE '%ELEITO%' THEN 1 ELSE 0 END"


@query("label_contains", f"WITH {CANDIDATES_SQL} SELECT SQ_CANDIDATO, {LABEL} AS label FROM cand")
def label_contains(spark, sf_dir):
    rows = candidates(spark, sf_dir, "SQ_CANDIDATO", "DS_SIT_TOT_TURNO")
    return rows.select("SQ_CANDIDATO", text.contains_flag(F.col("DS_SIT_TOT_TURNO"), "ELEITO").alias("label"))


@query("label_exact", f"""WITH {CANDIDATES_SQL}
SELECT SQ_CANDIDATO, CASE WHEN upper(DS_SIT_TOT_TURNO) LIKE '%ELEITO%' AND upper(DS_SIT_TOT_TURNO) NOT LIKE '%NÃO%'
  THEN 1 ELSE 0 END AS label FROM cand""")
def label_exact(spark, sf_dir):
    rows = candidates(spark, sf_dir, "SQ_CANDIDATO", "DS_SIT_TOT_TURNO")
    flag = text.contains_flag(F.col("DS_SIT_TOT_TURNO"), "ELEITO", excluding="NÃO")
    return rows.select("SQ_CANDIDATO", flag.alias("label"))


@query("collapse_two_way", f"""WITH {CANDIDATES_SQL}
SELECT SQ_CANDIDATO,
  CASE WHEN upper(DS_GRAU_INSTRUCAO) LIKE '%SUPERIOR COMPLETO%' THEN 'SUPERIOR' ELSE 'OUTROS' END AS education,
  CASE WHEN upper(DS_ESTADO_CIVIL) LIKE '%CASADO%' THEN 'CASADO' ELSE 'OUTROS' END AS marital FROM cand""")
def collapse_two_way(spark, sf_dir):
    rows = candidates(spark, sf_dir, "SQ_CANDIDATO", "DS_GRAU_INSTRUCAO", "DS_ESTADO_CIVIL")
    return rows.select(
        "SQ_CANDIDATO",
        text.collapse_two_way(F.col("DS_GRAU_INSTRUCAO"), "SUPERIOR COMPLETO", "SUPERIOR").alias("education"),
        text.collapse_two_way(F.col("DS_ESTADO_CIVIL"), "CASADO", "CASADO").alias("marital"),
    )


@query("title_flag", f"""
SELECT doc_id, CASE WHEN {" OR ".join(f"contains(upper(text), '{t}')" for t in TITLES)} THEN 1 ELSE 0 END AS has_title
FROM documents""")
def title_flag(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", balance=True)
    return docs.select("doc_id", text.title_flag(F.col("text")).alias("has_title"))


@query("title_flag_whole_word", f"""
SELECT doc_id, CASE WHEN regexp_matches(upper(text), '(^|[^\\p{{L}}\\p{{N}}])({"|".join(TITLES)})([^\\p{{L}}\\p{{N}}]|$)')
  THEN 1 ELSE 0 END AS has_title FROM documents""")
def title_flag_whole_word(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", balance=True)
    return docs.select("doc_id", text.title_flag(F.col("text"), whole_word=True).alias("has_title"))


@query("text_length", """
SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS n, CAST(coalesce(length(nullif(role, 'user')), 3) AS INTEGER) AS role_n
FROM conversations""")
def text_length(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        "conv_id", "turn", text.text_length(F.col("text")).alias("n"),
        text.text_length(F.expr("nullif(role, 'user')"), null_length=3).alias("role_n"),
    )


@query("equal_columns_flag", f"""WITH {CANDIDATES_SQL}
SELECT SQ_CANDIDATO, CASE WHEN SG_UF = SG_UF_NASCIMENTO THEN 1 ELSE 0 END AS home_base FROM cand""")
def equal_columns_flag(spark, sf_dir):
    rows = candidates(spark, sf_dir, "SQ_CANDIDATO", "SG_UF", "SG_UF_NASCIMENTO")
    return rows.select("SQ_CANDIDATO", features.equal_flag(F.col("SG_UF"), F.col("SG_UF_NASCIMENTO")).alias("home_base"))


@query("group_size_two_keys", f"""WITH {CANDIDATES_SQL}
SELECT SQ_CANDIDATO, count(SQ_CANDIDATO) OVER (PARTITION BY SG_UE, CD_CARGO) AS rivals FROM cand""")
def group_size_two_keys(spark, sf_dir):
    rows = candidates(spark, sf_dir, "SQ_CANDIDATO", "SG_UE", "CD_CARGO")
    return features.group_size(rows, ["SG_UE", "CD_CARGO"], "SQ_CANDIDATO", "rivals").select("SQ_CANDIDATO", "rivals")


@query("group_size_one_key", f"""WITH {CANDIDATES_SQL}
SELECT SQ_CANDIDATO, CASE WHEN born IS NOT NULL THEN count(SQ_CANDIDATO) OVER (PARTITION BY born) END AS group_size
FROM (SELECT *, SG_UF_NASCIMENTO AS born FROM cand)""")
def group_size_one_key(spark, sf_dir):
    rows = candidates(spark, sf_dir, "SQ_CANDIDATO", "SG_UF_NASCIMENTO")
    sized = features.group_size(rows, ["SG_UF_NASCIMENTO"], "SQ_CANDIDATO", "group_size")
    return sized.select("SQ_CANDIDATO", "group_size")


@query("engineered_features", f"""WITH {CANDIDATES_SQL}
SELECT SQ_CANDIDATO, CASE WHEN {" OR ".join(f"contains(upper(NM_URNA_CANDIDATO), '{t}')" for t in TITLES)} THEN 1 ELSE 0 END
    AS TEM_TITULO,
  CAST(length(NM_URNA_CANDIDATO) AS INTEGER) AS LEN_NM_URNA,
  CASE WHEN upper(DS_GRAU_INSTRUCAO) LIKE '%SUPERIOR COMPLETO%' THEN 'SUPERIOR' ELSE 'OUTROS' END AS DS_GRAU_INSTRUCAO,
  CASE WHEN upper(DS_ESTADO_CIVIL) LIKE '%CASADO%' THEN 'CASADO' ELSE 'OUTROS' END AS DS_ESTADO_CIVIL,
  CASE WHEN SG_UF = SG_UF_NASCIMENTO THEN 1 ELSE 0 END AS BASE_NATAL,
  count(*) OVER (PARTITION BY SG_UE, CD_CARGO) AS COMPETICAO_CARGO, count(*) OVER (PARTITION BY SG_PARTIDO) AS TAMANHO_PARTIDO
FROM cand""")
def engineered_features(spark, sf_dir):
    rows = candidates(
        spark, sf_dir, "SQ_CANDIDATO", "NM_URNA_CANDIDATO", "DS_GRAU_INSTRUCAO", "DS_ESTADO_CIVIL", "SG_UF",
        "SG_UF_NASCIMENTO", "SG_UE", "CD_CARGO", "SG_PARTIDO",
    )
    full = features.engineer(features.add_competition(rows))
    return full.select(
        "SQ_CANDIDATO", "TEM_TITULO", "LEN_NM_URNA", "DS_GRAU_INSTRUCAO", "DS_ESTADO_CIVIL", "BASE_NATAL",
        "COMPETICAO_CARGO", "TAMANHO_PARTIDO",
    )


@query("class_weight", """
SELECT l_linestatus, count(*) FILTER (l_returnflag <> 'R') AS negatives, count(*) FILTER (l_returnflag = 'R') AS positives,
  round(CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0
        THEN CAST(count(*) FILTER (l_returnflag <> 'R') AS DOUBLE) / count(*) FILTER (l_returnflag = 'R') ELSE 1.0 END, 6) + 0.0
    AS weight
FROM lineitem GROUP BY l_linestatus""")
def class_weight(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_linestatus", F.expr("int(l_returnflag = 'R') AS label"))
    return features.class_weight(lines, "label", ["l_linestatus"]).withColumn("weight", r6("weight"))


@query("competition_bin", f"""WITH {CANDIDATES_SQL},
sized AS (SELECT SQ_CANDIDATO, count(*) OVER (PARTITION BY SG_UE, CD_CARGO) AS rivals FROM cand),
sorted AS (SELECT rivals AS v, row_number() OVER (ORDER BY rivals) AS rn, count(*) OVER () AS n FROM sized),
cuts AS (SELECT DISTINCT min(v) AS cut FROM sorted, (SELECT unnest([0.25, 0.5, 0.75]) AS q) WHERE rn >= ceil(CAST(q AS DOUBLE) * n) GROUP BY q)
SELECT SQ_CANDIDATO, CAST(1 + (SELECT count(*) FROM cuts WHERE cut < rivals) AS INTEGER) AS COMPETICAO_BIN FROM sized""")
def competition_bin(spark, sf_dir):
    rows = candidates(spark, sf_dir, "SQ_CANDIDATO", "SG_UE", "CD_CARGO")
    sized = features.group_size(rows, ["SG_UE", "CD_CARGO"], "SQ_CANDIDATO", "COMPETICAO_CARGO")
    return features.competition_bin(sized).select("SQ_CANDIDATO", "COMPETICAO_BIN")
