"""Queries of statistical utility."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabveil.catalog.fixtures import CANDIDATES_SQL, HALF_A, HALF_B, candidates, table, two_populations
from tabveil.catalog.registry import query, r6, rounded
from tabveil.operators import generalize, utility

COLUMNS = ["l_returnflag", "l_linestatus", "p_brand", "p_type", "p_size"]
LINE = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR)"
LINES_SQL = f"""
lines AS (SELECT {LINE} AS row_id, nullif(l_returnflag, 'R') AS l_returnflag, l_linestatus, p_brand, p_type,
                 CAST(p_size AS VARCHAR) AS p_size, l_quantity, l_extendedprice
          FROM lineitem JOIN part ON l_partkey = p_partkey),
side AS (SELECT *, CASE WHEN CAST(('0x' || substr(md5(row_id || '|half'), 1, 8)) AS BIGINT) / 4294967296.0 < 0.5
                        THEN 'A' ELSE 'B' END AS half FROM lines)
"""


def _lines(spark, sf_dir):
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey")
    joined = table(spark, sf_dir, "lineitem", balance=True).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        key.alias("row_id"), F.expr("nullif(l_returnflag, 'R') AS l_returnflag"), "l_linestatus", "p_brand", "p_type",
        F.col("p_size").cast("string").alias("p_size"), "l_quantity", "l_extendedprice",
    )


def _halves(spark, sf_dir):
    from tabveil.operators.sampling import halves

    return halves(_lines(spark, sf_dir), "row_id")


def long_sql(columns, source="side"):
    return " UNION ALL ".join(f"SELECT half, '{c}' AS feature, {c} AS value FROM {source} WHERE {c} IS NOT NULL" for c in columns)


ALIGNED = f"""
long AS ({long_sql(COLUMNS)}),
counts AS (SELECT feature, value, count(*) FILTER (half = 'A') AS n_left, count(*) FILTER (half = 'B') AS n_right
           FROM long GROUP BY 1, 2),
aligned AS (SELECT *, n_left / CAST(sum(n_left) OVER (PARTITION BY feature) AS DOUBLE) AS p,
                   n_right / CAST(sum(n_right) OVER (PARTITION BY feature) AS DOUBLE) AS q FROM counts)
"""
DIVERGENCE = """sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
  + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)"""
DISTANCE = f"sqrt(greatest({DIVERGENCE}, 0.0))"


@query("marginals", f"""WITH {LINES_SQL}, long AS ({long_sql(COLUMNS)})
SELECT feature, value, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY feature) AS DOUBLE), 6) + 0.0 AS p
FROM long GROUP BY feature, value""")
def marginals(spark, sf_dir):
    return rounded(utility.marginals(_lines(spark, sf_dir), COLUMNS), "p")


@query("aligned_marginals", f"""WITH {LINES_SQL}, {ALIGNED}
SELECT feature, value, n_left, n_right, round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q FROM aligned""")
def aligned_marginals(spark, sf_dir):
    left, right = _halves(spark, sf_dir)
    return rounded(utility.aligned_marginals(left, right, COLUMNS), "p", "q")


@query("jsd_per_column", f"WITH {LINES_SQL}, {ALIGNED} SELECT feature, round({DISTANCE}, 6) + 0.0 AS jsd FROM aligned GROUP BY 1")
def jsd_per_column(spark, sf_dir):
    left, right = _halves(spark, sf_dir)
    return rounded(utility.jsd_per_column(left, right, COLUMNS), "jsd")


@query("utility_marginal", f"""WITH {LINES_SQL}, {ALIGNED}
SELECT round(1 - avg(jsd), 6) + 0.0 AS utility FROM (SELECT feature, {DISTANCE} AS jsd FROM aligned GROUP BY 1)""")
def utility_marginal(spark, sf_dir):
    left, right = _halves(spark, sf_dir)
    return rounded(utility.marginal_utility(left, right, COLUMNS), "utility")


PAIR_LONG = " UNION ALL ".join(
    f"SELECT half, '{a}' AS column_a, '{b}' AS column_b, {a} AS va, {b} AS vb FROM side WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for a, b in combinations(COLUMNS, 2)
)
PAIRS_SQL = f"""
long AS ({PAIR_LONG}),
counts AS (SELECT column_a, column_b, va, vb, count(*) FILTER (half = 'A') AS n_left, count(*) FILTER (half = 'B') AS n_right
           FROM long GROUP BY 1, 2, 3, 4),
aligned AS (SELECT *, n_left / CAST(sum(n_left) OVER w AS DOUBLE) AS p, n_right / CAST(sum(n_right) OVER w AS DOUBLE) AS q
            FROM counts WINDOW w AS (PARTITION BY column_a, column_b))
"""


@query("jsd_per_pair", f"WITH {LINES_SQL}, {PAIRS_SQL} SELECT column_a, column_b, round({DISTANCE}, 6) + 0.0 AS jsd FROM aligned GROUP BY 1, 2")
def jsd_per_pair(spark, sf_dir):
    left, right = _halves(spark, sf_dir)
    return rounded(utility.jsd_per_pair(left, right, COLUMNS), "jsd")


@query("utility_joint", f"""WITH {LINES_SQL}, {PAIRS_SQL}
SELECT round(1 - avg(jsd), 6) + 0.0 AS utility FROM (SELECT {DISTANCE} AS jsd FROM aligned GROUP BY column_a, column_b)""")
def utility_joint(spark, sf_dir):
    left, right = _halves(spark, sf_dir)
    return rounded(utility.joint_utility(left, right, COLUMNS), "utility")


FLAG_COLUMNS = ["c_mktsegment", "n_name", "o_orderpriority", "o_orderstatus"]
FLAG_SQL = """
src AS (SELECT upper(trim(c_mktsegment)) AS c_mktsegment, upper(trim(n_name)) AS n_name,
               upper(trim(o_orderpriority)) AS o_orderpriority, upper(trim(o_orderstatus)) AS o_orderstatus
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
top AS (SELECT n_name FROM src GROUP BY 1 ORDER BY count(*) DESC, n_name LIMIT 5),
side AS (SELECT 'A' AS half, * FROM src UNION ALL
         SELECT 'B', c_mktsegment, CASE WHEN n_name IN (SELECT n_name FROM top) THEN n_name ELSE 'OUTROS_GRUPOS' END,
                o_orderpriority, o_orderstatus FROM src)
"""
FLAG_ALIGNED = ALIGNED.replace(long_sql(COLUMNS), long_sql(FLAG_COLUMNS))


@query("generalisation_utility", f"""WITH {FLAG_SQL}, {FLAG_ALIGNED},
d AS (SELECT feature, {DISTANCE} AS jsd FROM aligned GROUP BY 1)
SELECT feature, round(jsd, 6) + 0.0 AS jsd, round(1 - avg(jsd) OVER (), 6) + 0.0 AS utility FROM d""")
def generalisation_utility(spark, sf_dir):
    """Cost of keeping the top 5 nations only, per column and overall."""
    from tabveil.operators.clean import normalize_text

    joined = (
        table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(*FLAG_COLUMNS)
    )
    source = normalize_text(joined)
    generalised = generalize.top_n_other(source, {"n_name": 5})
    distances = utility.jsd_per_column(source, generalised)
    overall = distances.agg(1 - F.avg("jsd")).scalar()
    return distances.select("feature", r6("jsd").alias("jsd"), r6(overall).alias("utility"))


@query("mean_gap", f"""WITH {LINES_SQL},
long AS (SELECT half, 'l_quantity' AS feature, l_quantity AS v FROM side UNION ALL SELECT half, 'l_extendedprice', l_extendedprice FROM side),
base AS (SELECT feature, avg(v) AS mean_original FROM long GROUP BY 1)
SELECT half, feature, round(mean_original, 4) AS mean_original, round(avg(v), 4) AS mean_copy,
       round(abs(mean_original - avg(v)), 4) AS gap FROM long JOIN base USING (feature) GROUP BY half, feature, mean_original""")
def mean_gap(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    left, right = _halves(spark, sf_dir)
    copies = left.withColumn("half", F.lit("A")).unionByName(right.withColumn("half", F.lit("B")))
    gaps = utility.mean_gap(lines, copies, ["l_quantity", "l_extendedprice"], by="half")
    return gaps.withColumns({c: F.round(c, 4) for c in ("mean_original", "mean_copy", "gap")})


@query("tables_equal", """
SELECT 'reordered' AS comparison, true AS identical
UNION ALL SELECT 'changed', NOT EXISTS (SELECT * FROM orders WHERE o_orderstatus = 'P')""")
def tables_equal(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    same = utility.tables_equal(orders, orders.orderBy("o_totalprice").select("o_totalprice", "o_orderkey", "o_orderstatus"))
    changed = orders.withColumn("o_orderstatus", F.regexp_replace("o_orderstatus", "P", "O"))
    other = utility.tables_equal(orders, changed)
    return same.select(F.lit("reordered").alias("comparison"), "identical").unionByName(
        other.select(F.lit("changed").alias("comparison"), "identical")
    )


@query("dp_gain", """
SELECT *, round(score_total - score_wrangling, 4) AS dp_gain FROM (
  SELECT c_mktsegment, round(1 - avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END), 4) AS score_total,
         round(1 - avg(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE 0.0 END), 4) AS score_wrangling
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)""")
def dp_gain(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    scores = joined.groupBy("c_mktsegment").agg(
        F.round(1 - F.avg((F.col("o_orderstatus") == "P").cast("double")), 4).alias("score_total"),
        F.round(1 - F.avg((F.col("o_orderpriority") == "5-LOW").cast("double")), 4).alias("score_wrangling"),
    )
    return utility.dp_gain(scores)


MI_COLUMNS = ["l_linestatus", "p_brand", "p_type", "p_size"]
MI_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS value, coalesce(l_returnflag, 'NULL') AS y FROM lines" for c in MI_COLUMNS
)
MI_SQL = f"""
long AS ({MI_LONG}),
cells AS (SELECT feature, value, y, CAST(count(*) AS DOUBLE) AS n FROM long GROUP BY 1, 2, 3),
margins AS (SELECT *, sum(n) OVER (PARTITION BY feature, value) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny,
                   sum(n) OVER (PARTITION BY feature) AS total FROM cells),
mi AS (SELECT feature, sum(n / total * ln(n * total / (nx * ny))) AS mi, count(DISTINCT value) AS cardinality FROM margins GROUP BY 1)
"""


@query("mutual_information", f"WITH {LINES_SQL}, {MI_SQL} SELECT feature, round(greatest(mi, 0.0), 6) + 0.0 AS mi, cardinality FROM mi")
def mutual_information(spark, sf_dir):
    return rounded(utility.mutual_information(_lines(spark, sf_dir), "l_returnflag", MI_COLUMNS), "mi")


@query("dp_efficiency", f"""WITH {LINES_SQL}, {MI_SQL}
SELECT feature, round(greatest(mi, 0.0), 4) AS mi_raw, cardinality,
       CASE WHEN cardinality > 1 THEN round(greatest(mi, 0.0) / log2(cardinality), 4) ELSE 0.0 END AS dp_efficiency FROM mi""")
def dp_efficiency(spark, sf_dir):
    return utility.dp_efficiency(_lines(spark, sf_dir), "l_returnflag", MI_COLUMNS)
