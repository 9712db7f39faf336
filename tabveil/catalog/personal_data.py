"""Queries of personal-data detection and treatment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabveil.catalog.fixtures import table
from tabveil.catalog.registry import query, r6
from tabveil.operators import pii

LOOSE, STRICT = pii.CPF.regex, pii.CPF_STRICT.regex
NUMBER = "lpad(CAST(c_custkey * 7919 + 10000000000 AS VARCHAR), 11, '0')"
CUSTOMERS_SQL = f"""
people AS (SELECT c_custkey, c_name, c_mktsegment, {NUMBER} AS number,
  'doc ' || substr({NUMBER}, 1, 3) || '.' || substr({NUMBER}, 4, 3) || '.' || substr({NUMBER}, 7, 3) || '-' || substr({NUMBER}, 10, 2)
    || ' ok' AS remark,
  CASE WHEN c_custkey % 20 = 0 THEN {NUMBER} ELSE 'sem numero' END AS rare FROM customer)
"""


def _people(spark, sf_dir):
    number = F.lpad((F.col("c_custkey") * 7919 + 10_000_000_000).cast("string"), 11, "0")
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", number.alias("number"))
    dotted = F.concat(
        F.lit("doc "), F.substring("number", 1, 3), F.lit("."), F.substring("number", 4, 3), F.lit("."),
        F.substring("number", 7, 3), F.lit("-"), F.substring("number", 10, 2), F.lit(" ok"),
    )
    rare = F.when(F.col("c_custkey") % 20 == 0, F.col("number")).otherwise("sem numero")
    return base.withColumns({"remark": dotted, "rare": rare})


@query("cpf_loose", f"SELECT doc_id, regexp_matches(text, '{LOOSE}') AS hit FROM documents")
def cpf_loose(spark, sf_dir):
    return table(spark, sf_dir, "documents", balance=True).select("doc_id", pii.matches(F.col("text")).alias("hit"))


@query("cpf_strict", f"""
SELECT 'documents' AS source, count(*) FILTER (regexp_matches(text, '{STRICT}')) AS hits, count(*) AS n FROM documents
UNION ALL
SELECT 'conversations', count(*) FILTER (regexp_matches(text, '{STRICT}')), count(*) FROM conversations""")
def cpf_strict(spark, sf_dir):
    out = None
    for name in ("documents", "conversations"):
        hits = F.count_if(pii.matches(F.col("text"), [pii.CPF_STRICT]))
        row = table(spark, sf_dir, name).agg(hits.alias("hits"), F.count("*").alias("n"))
        row = row.select(F.lit(name).alias("source"), "hits", "n")
        out = row if out is None else out.unionByName(row)
    return out


FIRST = " + ".join(f"{10 - i} * CAST(substr(d, {i + 1}, 1) AS INTEGER)" for i in range(9))
SECOND = " + ".join(f"{11 - i} * CAST(substr(d, {i + 1}, 1) AS INTEGER)" for i in range(10))


@query("cpf_check_digits", f"""WITH {CUSTOMERS_SQL},
digits AS (SELECT c_custkey, regexp_replace(regexp_extract(remark, '{STRICT}', 2), '[^0-9]', '', 'g') AS d FROM people)
SELECT c_custkey, d AS cpf, ({FIRST}) * 10 % 11 % 10 = CAST(substr(d, 10, 1) AS INTEGER)
   AND ({SECOND}) * 10 % 11 % 10 = CAST(substr(d, 11, 1) AS INTEGER) AS valid FROM digits""")
def cpf_check_digits(spark, sf_dir):
    people = _people(spark, sf_dir).select("c_custkey", pii.cpf_digits(F.col("remark")).alias("cpf"))
    return people.withColumn("valid", pii.cpf_checks_out(F.col("cpf")))


SHARES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(CASE WHEN regexp_matches({c}, '{LOOSE}') THEN 1.0 ELSE 0.0 END) AS share FROM people"
    for c in ("c_name", "c_mktsegment", "number", "remark", "rare")
)


@query("pii_columns", f"WITH {CUSTOMERS_SQL} SELECT feature, round(share, 6) + 0.0 AS share, share > 0.1 AS is_pii FROM ({SHARES_SQL})")
def pii_columns(spark, sf_dir):
    return pii.pii_columns(_people(spark, sf_dir)).withColumn("share", r6("share"))


@query("pii_columns_documents", f"""
SELECT feature, round(share, 6) + 0.0 AS share, share > 0.1 AS is_pii FROM (
  SELECT 'text' AS feature, avg(CASE WHEN regexp_matches(text, '{LOOSE}') THEN 1.0 ELSE 0.0 END) AS share FROM documents
  UNION ALL SELECT 'lang', avg(CASE WHEN regexp_matches(lang, '{LOOSE}') THEN 1.0 ELSE 0.0 END) FROM documents
  UNION ALL SELECT 'source', avg(CASE WHEN regexp_matches(source, '{LOOSE}') THEN 1.0 ELSE 0.0 END) FROM documents)""")
def pii_columns_documents(spark, sf_dir):
    return pii.pii_columns(table(spark, sf_dir, "documents", balance=True)).withColumn("share", r6("share"))


@query("pii_drop", "SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 20 = 0 THEN "
       f"{NUMBER} ELSE 'sem numero' END AS rare FROM customer")
def pii_drop(spark, sf_dir):
    people = _people(spark, sf_dir)
    return pii.drop_flagged(people, pii.pii_columns(people))


@query("pii_report", f"""WITH {CUSTOMERS_SQL}
SELECT map_from_entries(list((feature, 'DROPPED') ORDER BY feature)) AS pii_report FROM ({SHARES_SQL}) WHERE share > 0.1""")
def pii_report(spark, sf_dir):
    return pii.pii_report(pii.pii_columns(_people(spark, sf_dir)))


@query("pii_treatments", f"""WITH {CUSTOMERS_SQL}
SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g')
    AS c_name, c_mktsegment, sha256('sal' || number) AS number, regexp_replace(remark, '{LOOSE}', '<CPF>', 'g') AS remark,
  regexp_replace(rare, '{LOOSE}', '<CPF>', 'g') AS rare
FROM people""")
def pii_treatments(spark, sf_dir):
    return pii.treat(_people(spark, sf_dir), {
        "c_name": pii.masked(F.col("c_name")), "number": pii.hashed(F.col("number"), "sal"),
        "remark": pii.redacted(F.col("remark")), "rare": pii.redacted(F.col("rare")),
    })


@query("redact_documents", f"""
SELECT doc_id, md5(regexp_replace(text, '{LOOSE}', '<CPF>', 'g')) AS digest FROM documents""")
def redact_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents", balance=True).select("doc_id", F.md5(pii.redacted(F.col("text"))).alias("digest"))


# --- patterns of unlike certainty ---------------------------------------------
SCORED = [pii.CPF, pii.Pattern("YEAR", r"(19|20)[0-9][0-9]", 0.3), pii.Pattern("MAIL", r"[A-Za-z0-9.]+@[A-Za-z0-9.]+", 0.6)]
CUTOFFS = [0.2, 0.4, 0.7, 0.9]


@query("pii_score_cutoff", " UNION ALL ".join(
    f"SELECT {c}e0 AS cutoff, count(*) FILTER ({' OR '.join(['false', *[f'''regexp_matches(text, '{p.regex}')''' for p in SCORED if p.score >= c]])}) AS hits, "
    "count(*) AS n FROM documents" for c in CUTOFFS))
def pii_score_cutoff(spark, sf_dir):
    """Texts with a hit, by the least score that a pattern needs to count."""
    docs = table(spark, sf_dir, "documents", balance=True)
    hits = docs.agg(*[F.count_if(pii.matches(F.col("text"), SCORED, c)).alias(f"h{i}") for i, c in enumerate(CUTOFFS)], F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"h{i}").alias("hits"), F.col("n").alias("n")) for i, c in enumerate(CUTOFFS)])
    return hits.select(F.inline(rows))
