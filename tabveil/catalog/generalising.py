"""Queries of generalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabveil.catalog.fixtures import CANDIDATES_SQL, candidates, table
from tabveil.catalog.registry import query, r6
from tabveil.operators import generalize as g
from tabveil.operators import sketches
from tabveil.roles import BASE_COLUMNS, STRATEGIES

YEAR = "year(try_strptime(DT_NASCIMENTO, '%d/%m/%Y'))"
YEARS_SQL = f"""{CANDIDATES_SQL},
born AS (SELECT SQ_CANDIDATO, CAST({YEAR} AS INTEGER) AS y FROM cand),
years AS (SELECT SQ_CANDIDATO, coalesce(CAST(y AS DOUBLE), (SELECT quantile_cont(y, 0.5) FROM born)) AS year FROM born)
"""
BINS = """CASE WHEN year > 0 AND year <= 1960 THEN 'BOOMER' WHEN year > 1960 AND year <= 1975 THEN 'GEN_X'
 WHEN year > 1975 AND year <= 1985 THEN 'MILLENNIAL_FALDA' WHEN year > 1985 AND year <= 1995 THEN 'MILLENNIAL_NOVO'
 WHEN year > 1995 AND year <= 2005 THEN 'GEN_Z' WHEN year > 2005 AND year <= 2026 THEN 'NEW_GEN' END"""


def _born(spark, sf_dir):
    return candidates(spark, sf_dir, "SQ_CANDIDATO", "DT_NASCIMENTO")


@query("birth_year", f"WITH {YEARS_SQL} SELECT SQ_CANDIDATO, y AS year FROM born")
def birth_year(spark, sf_dir):
    return _born(spark, sf_dir).select("SQ_CANDIDATO", g.birth_year(F.col("DT_NASCIMENTO")).alias("year"))


@query("median_impute", f"WITH {YEARS_SQL} SELECT SQ_CANDIDATO, year FROM years")
def median_impute(spark, sf_dir):
    return g.with_birth_year(_born(spark, sf_dir), "DT_NASCIMENTO").select("SQ_CANDIDATO", "year")


@query("year_exact", f"WITH {YEARS_SQL} SELECT SQ_CANDIDATO, CAST(CAST(trunc(year) AS INTEGER) AS VARCHAR) AS year FROM years")
def year_exact(spark, sf_dir):
    years = g.with_birth_year(_born(spark, sf_dir), "DT_NASCIMENTO")
    return years.select("SQ_CANDIDATO", g.exact_year(F.col("year")).alias("year"))


@query("generation_bins", f"WITH {YEARS_SQL} SELECT SQ_CANDIDATO, {BINS} AS generation FROM years")
def generation_bins(spark, sf_dir):
    years = g.with_birth_year(_born(spark, sf_dir), "DT_NASCIMENTO")
    return years.select("SQ_CANDIDATO", g.fixed_bins(F.col("year")).alias("generation"))


TOP_SQL = """
counts AS (SELECT 'p_name' AS feature, p_name AS value, count(*) AS n FROM sold GROUP BY 2
           UNION ALL SELECT 'p_brand', p_brand, count(*) FROM sold GROUP BY 2
           UNION ALL SELECT 'l_returnflag', l_returnflag, count(*) FROM sold GROUP BY 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rk,
                  count(*) OVER (PARTITION BY feature) AS k FROM counts)
"""
SOLD_SQL = "sold AS (SELECT l_orderkey, l_linenumber, p_name, p_brand, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _sold(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("l_orderkey", "l_linenumber", "p_name", "p_brand", "l_returnflag")


@query("topn_other", f"""WITH {SOLD_SQL}, {TOP_SQL},
keep AS (SELECT feature, value FROM ranked WHERE rk <= CASE feature WHEN 'p_name' THEN 12 WHEN 'p_brand' THEN 6 ELSE 5 END
         OR k <= CASE feature WHEN 'p_name' THEN 12 WHEN 'p_brand' THEN 6 ELSE 5 END)
SELECT l_orderkey, l_linenumber,
  CASE WHEN p_name IN (SELECT value FROM keep WHERE feature = 'p_name') THEN p_name ELSE 'OUTROS_GRUPOS' END AS p_name,
  CASE WHEN p_brand IN (SELECT value FROM keep WHERE feature = 'p_brand') THEN p_brand ELSE 'OUTROS_GRUPOS' END AS p_brand,
  CASE WHEN l_returnflag IN (SELECT value FROM keep WHERE feature = 'l_returnflag') THEN l_returnflag
       ELSE 'OUTROS_GRUPOS' END AS l_returnflag
FROM sold""")
def topn_other(spark, sf_dir):
    return g.top_n_other(_sold(spark, sf_dir), {"p_name": 12, "p_brand": 6, "l_returnflag": 5})


@query("topn_other_unguarded", f"""WITH {SOLD_SQL}, {TOP_SQL}
SELECT l_orderkey, l_linenumber,
  CASE WHEN p_name IN (SELECT value FROM ranked WHERE feature = 'p_name' AND rk <= 15) THEN p_name ELSE 'OUTROS' END AS p_name,
  CASE WHEN p_brand IN (SELECT value FROM ranked WHERE feature = 'p_brand' AND rk <= 15) THEN p_brand ELSE 'OUTROS' END AS p_brand,
  l_returnflag
FROM sold""")
def topn_other_unguarded(spark, sf_dir):
    return g.top_15_other(_sold(spark, sf_dir), ["p_name", "p_brand"])


@query("distinct_counts", """
SELECT 'p_name' AS feature, count(DISTINCT p_name) AS n_distinct FROM part
UNION ALL SELECT 'p_brand', count(DISTINCT nullif(p_brand, (SELECT min(p_brand) FROM part))) FROM part
UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part
""")
def distinct_counts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    least = part.agg(F.min("p_brand")).scalar()
    holed = part.select("p_name", F.when(F.col("p_brand") != least, F.col("p_brand")).alias("p_brand"), "p_size")
    return g.distinct_counts(holed, ["p_name", "p_brand", "p_size"])


@query("cardinality_report", """
SELECT feature, k AS n_distinct, CASE WHEN k < 50 THEN '✅ SEGURO' ELSE '🚨 ALTO RISCO' END AS status FROM (
  SELECT 'p_name' AS feature, count(DISTINCT p_name) AS k FROM part
  UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part
  UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part
  UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part)
""")
def cardinality_report(spark, sf_dir):
    return g.cardinality_report(table(spark, sf_dir, "part"), ["p_name", "p_type", "p_size", "p_brand"])


CUTS_SQL = """
sorted AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS rn, count(*) OVER () AS n FROM orders),
cuts AS (SELECT q, min(v) AS cut FROM sorted, (SELECT unnest([0.25, 0.5, 0.75]) AS q) WHERE rn >= ceil(CAST(q AS DOUBLE) * n) GROUP BY q)
"""
BIN_OF = "1 + (SELECT count(*) FROM cuts WHERE cut < o_totalprice)"


@query("quantile_bins", f"WITH {CUTS_SQL} SELECT o_orderkey, CAST({BIN_OF} AS INTEGER) AS bin FROM orders")
def quantile_bins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return g.quantile_bins(orders, "o_totalprice", 4, "bin").select("o_orderkey", "bin")


@query("bin_midpoint", f"""WITH {CUTS_SQL},
edges AS (SELECT min(o_totalprice) AS e FROM orders UNION ALL SELECT cut FROM cuts UNION ALL SELECT max(o_totalprice) FROM orders),
bins AS (SELECT row_number() OVER (ORDER BY e) AS bin, (e + lead(e) OVER (ORDER BY e)) / 2 AS middle FROM edges)
SELECT o_orderkey, round(middle, 4) AS middle FROM (SELECT o_orderkey, {BIN_OF} AS b FROM orders) JOIN bins ON bin = b""")
def bin_midpoint(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    cuts = g.quantile_cuts(orders, "o_totalprice", 4)
    low, high = orders.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    binned = orders.withColumn("bin", g.bin_number(F.col("o_totalprice"), cuts))
    middle = g.with_midpoint(binned, "bin", [low, *cuts, high], "middle")
    return middle.select("o_orderkey", F.round("middle", 4).alias("middle"))


def wrangle_sql(profile: str) -> str:
    """Oracle of a whole profile: normalise, then group each column on its own."""
    plan = STRATEGIES[profile]
    present = [c for c in BASE_COLUMNS if c != "FAIXA_ETARIA"]
    age = "CAST(CAST(trunc(year) AS INTEGER) AS VARCHAR)" if plan.exact_year else BINS
    norm = ", ".join(
        f"coalesce(nullif(upper(trim(CAST({c} AS VARCHAR))), 'NAN'), 'NULL') AS {c}" for c in present
    )
    tops, outs = [], []
    for c in BASE_COLUMNS:
        if c in plan.skip:
            outs.append(c)
            continue
        k = plan.limit_of(c)
        tops.append(
            f"top_{c} AS (SELECT v, rk, k FROM (SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rk,"
            f" count(*) OVER () AS k FROM norm GROUP BY {c}) WHERE rk <= {k} OR k <= {k})"
        )
        outs.append(f"CASE WHEN {c} IN (SELECT v FROM top_{c}) THEN {c} ELSE 'OUTROS_GRUPOS' END AS {c}")
    return f"""WITH {YEARS_SQL},
norm AS (SELECT SQ_CANDIDATO, {norm}, coalesce({age}, 'NULL') AS FAIXA_ETARIA FROM cand JOIN years USING (SQ_CANDIDATO)),
{", ".join(tops)}
SELECT SQ_CANDIDATO, {", ".join(outs)} FROM norm"""


def _register(profile: str) -> None:
    @query(f"wrangle_{profile}", wrangle_sql(profile))
    def build(spark, sf_dir, profile=profile):
        return g.apply_wrangling(candidates(spark, sf_dir), profile, keep=["SQ_CANDIDATO"])


for _profile in STRATEGIES:
    _register(_profile)


@query("missing_birth_date", "SELECT 'NAO_INFORMADO' AS FAIXA_ETARIA, upper(o_orderstatus) AS CD_GENERO, count(*) AS n FROM orders GROUP BY 2")
def missing_birth_date(spark, sf_dir):
    bare = candidates(spark, sf_dir, "SQ_CANDIDATO", "CD_GENERO")
    wrangled = g.apply_wrangling(bare, "intensive")
    return wrangled.groupBy("FAIXA_ETARIA", "CD_GENERO").agg(F.count("*").alias("n"))


SKETCHED = ["NM_URNA_CANDIDATO", "NM_UE", "SG_PARTIDO", "CD_OCUPACAO", "SG_UF_NASCIMENTO", "VR_BENS"]


def _sketches(spark, sf_dir):
    """Sketches of the parts by gender, merged."""
    rows = candidates(spark, sf_dir, *SKETCHED, "CD_GENERO")
    return rows, sketches.sketch(rows, SKETCHED, by=["CD_GENERO"])


@query("sketched_cardinality", f"WITH {CANDIDATES_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct, true AS within FROM cand"
    for c in SKETCHED))
def sketched_cardinality(spark, sf_dir):
    """Exact distinct counts, and whether the merged sketches are within five per cent of them."""
    rows, parts = _sketches(spark, sf_dir)
    exact = g.distinct_counts(rows, SKETCHED)
    sizes = sketches.merged(parts).select("feature", "rows", "nulls")
    estimates = sketches.distinct_estimates(parts).select("feature", F.col("n_distinct").alias("estimate"))
    near = sketches.within(F.col("estimate"), F.col("n_distinct"), 0.05)
    return sizes.join(exact, "feature").join(estimates, "feature").select("feature", "rows", "nulls", "n_distinct", near.alias("within"))


FRACTIONS = [0.1, 0.25, 0.5, 0.75, 0.9]


@query("sketched_quantiles", "SELECT * FROM (VALUES ('CD_OCUPACAO', true), ('VR_BENS', true)) v(feature, within)")
def sketched_quantiles(spark, sf_dir):
    """Whether every sketched cut has its share of the rows, within two per cent of all."""
    rows, parts = _sketches(spark, sf_dir)
    out = None
    for r in sketches.quantiles(parts, FRACTIONS).collect():  # one row per numeric column
        c, cuts = r["feature"], r["cuts"]
        below = [F.avg((F.col(c) < v).cast("int")) <= f + 0.02 for f, v in zip(FRACTIONS, cuts)]
        upto = [F.avg((F.col(c) <= v).cast("int")) >= f - 0.02 for f, v in zip(FRACTIONS, cuts)]
        row = rows.agg(F.forall(F.array(*below, *upto), lambda ok: ok).alias("within")).select(F.lit(c).alias("feature"), "within")
        out = row if out is None else out.unionByName(row)
    return out
