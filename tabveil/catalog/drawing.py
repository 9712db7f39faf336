"""Queries of samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabveil.catalog.fixtures import digest_sql, table, unit_sql
from tabveil.catalog.registry import query
from tabveil.operators import sampling

ORDER = f"{digest_sql('o_orderkey', '42')}, o_orderkey"


@query("sample_exact", f"SELECT * FROM orders ORDER BY {ORDER} LIMIT 700")
def sample_exact(spark, sf_dir):
    return sampling.sample_exact(table(spark, sf_dir, "orders"), 700, "o_orderkey")


@query("sample_guard", f"""
SELECT o_orderkey, o_custkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rn, count(*) OVER () AS n FROM orders) WHERE n <= 1000 OR rn <= 400""")
def sample_guard(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return sampling.sample_guard(orders, "o_orderkey", max_rows=1_000, n=400)


@query("split_random", f"SELECT o_orderkey, {unit_sql('o_orderkey', '42')} < 0.2 AS is_test FROM orders")
def split_random(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return sampling.split_random(orders, 0.2, "o_orderkey")


@query("split_stratified", f"""
SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {ORDER})
    <= CAST(round(0.2 * count(*) OVER (PARTITION BY o_orderstatus)) AS BIGINT) AS is_test FROM orders""")
def split_stratified(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.split_stratified(orders, "o_orderstatus", 0.2, "o_orderkey")


@query("split_disjoint", f"""
SELECT o_orderkey, CASE WHEN rn <= 200 THEN 'A' ELSE 'B' END AS part
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {ORDER}) AS rn FROM orders) WHERE rn <= 1000""")
def split_disjoint(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return sampling.split_disjoint(orders, 200, 800, "o_orderkey")


@query("first_rows", f"SELECT event_id, event_type FROM events ORDER BY {digest_sql('event_id', '7')}, event_id LIMIT 100")
def first_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.sample_exact(events, 100, "event_id", seed=7)
