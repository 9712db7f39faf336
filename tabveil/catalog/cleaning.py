"""Queries of cleaning and null handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabveil.catalog.fixtures import CANDIDATES_SQL, candidates, table
from tabveil.catalog.registry import query, r6
from tabveil.functions import scores
from tabveil.operators import clean

# Nulls are made from given values, as the given tables have none.
HOLES = "nullif(o_orderpriority, '5-LOW') AS priority, CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_totalprice END AS price"


def _with_holes(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "nullif(o_orderpriority, '5-LOW') AS priority",
        "CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_totalprice END AS price",
    )


@query("scan_pruned", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1, 2
""")
def scan_pruned(spark, sf_dir):
    from tabveil.sources.readers import read_parquet

    lines = read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_returnflag", "l_linestatus", "l_linenumber"])
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query("select_available", "SELECT o_orderkey, o_orderstatus FROM orders")
def select_available(spark, sf_dir):
    return clean.select_available(table(spark, sf_dir, "orders"), ["o_orderkey", "DS_AUSENTE", "o_orderstatus"])


@query("drop_identifiers", f"""WITH {CANDIDATES_SQL}
SELECT * EXCLUDE (SQ_CANDIDATO, NM_URNA_CANDIDATO) FROM cand""")
def drop_identifiers(spark, sf_dir):
    from tabveil.roles import IDENTIFIER_COLUMNS

    return clean.drop_present(candidates(spark, sf_dir), IDENTIFIER_COLUMNS)


@query("dropna_any", f"""
SELECT * FROM (SELECT o_orderkey, o_orderstatus, {HOLES} FROM orders) WHERE priority IS NOT NULL AND price IS NOT NULL
""")
def dropna_any(spark, sf_dir):
    return clean.drop_incomplete(_with_holes(spark, sf_dir))


@query("dropna_subset", f"""
SELECT * FROM (SELECT o_orderkey, o_orderstatus, {HOLES} FROM orders) WHERE priority IS NOT NULL
""")
def dropna_subset(spark, sf_dir):
    return clean.drop_incomplete(_with_holes(spark, sf_dir), ["priority"])


@query("sentinels_to_null", """
SELECT o_orderkey, nullif(CASE WHEN o_orderstatus = 'P' THEN '#NULO' ELSE o_orderstatus END, '#NULO') AS status,
       nullif(CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN -3 ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END, -3)
         AS level
FROM orders
""")
def sentinels_to_null(spark, sf_dir):
    marked = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus = 'P' THEN '#NULO' ELSE o_orderstatus END AS status",
        "CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN -3 ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) END AS level",
    )
    return clean.sentinels_to_null(marked, ["status", "level"])


@query("fill_zero", f"""
SELECT o_orderkey, o_orderstatus, priority, coalesce(price, 0) AS price FROM (SELECT o_orderkey, o_orderstatus, {HOLES} FROM orders)
""")
def fill_zero(spark, sf_dir):
    return clean.fill_zero(_with_holes(spark, sf_dir))


@query("cast_all_text", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, coalesce(nullif(o_orderpriority, '5-LOW'), 'NULL') AS priority
FROM orders
""")
def cast_all_text(spark, sf_dir):
    return clean.all_text(_with_holes(spark, sf_dir).drop("price"))


@query("normalize_text", """
SELECT doc_id, CASE WHEN text IS NULL OR upper(trim(text, chr(9) || chr(10) || chr(13) || ' ')) = 'NAN' THEN 'NULL'
                    ELSE upper(trim(text, chr(9) || chr(10) || chr(13) || ' ')) END AS text,
       coalesce(upper(nullif(lang, 'de')), 'NULL') AS lang
FROM (SELECT doc_id, regexp_replace(text, '[^ -~\n\r\t]', '?', 'g') AS text, lang FROM documents)
""")
def normalize_text(spark, sf_dir):
    # Only ASCII is compared: engines map the case of other letters differently.
    docs = table(spark, sf_dir, "documents", balance=True).select(
        "doc_id", F.regexp_replace("text", r"[^ -~\n\r\t]", "?").alias("text"), F.expr("nullif(lang, 'de') AS lang")
    )
    return clean.normalize_text(docs, ["text", "lang"])


@query("carry_target", f"""WITH {CANDIDATES_SQL}
SELECT SG_UF, CD_CARGO, upper(DS_SIT_TOT_TURNO) AS DS_SIT_TOT_TURNO, count(*) AS n FROM cand GROUP BY ALL
""")
def carry_target(spark, sf_dir):
    """The target passes through the generalisation of the other columns."""
    from tabveil.operators.generalize import apply_wrangling, normalized_label

    base = ["SG_UF", "CD_CARGO"]
    kept = apply_wrangling(candidates(spark, sf_dir), keep=["DS_SIT_TOT_TURNO"], base=base)
    kept = kept.withColumn("DS_SIT_TOT_TURNO", normalized_label(F.col("DS_SIT_TOT_TURNO")))
    return kept.groupBy(*base, "DS_SIT_TOT_TURNO").agg(F.count("*").alias("n"))


@query("common_columns", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def common_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    shared = clean.common_columns(orders, orders.select("o_orderstatus"))
    return orders.groupBy(*shared).agg(F.count("*").alias("n"))


@query("safe_round", """
SELECT event_id, CASE WHEN value IS NULL OR isnan(value) THEN 0.0 ELSE round(value, 4) END AS rounded,
       coalesce(CASE WHEN value > 50 THEN NULL ELSE value END, 0.0) AS filled
FROM events
""")
def safe_round(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", scores.safe_round(F.col("value")).alias("rounded"),
        scores.zero_if_missing(F.expr("CASE WHEN value > 50 THEN NULL ELSE value END")).alias("filled"),
    )
