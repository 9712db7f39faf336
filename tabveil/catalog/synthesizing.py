"""Queries of marginals, noise and synthetic tables. All noise here is derived
from a seed, so that it can be checked; such output protects nobody."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabveil.catalog.fixtures import CANDIDATES_SQL, candidates, table
from tabveil.catalog.registry import query, r6, rounded
from tabveil.functions.hashing import row_uniform
from tabveil.operators import adaptive, noise, sparse_noise, synthesis, utility
from tabveil.operators.budget import Ledger
from tabveil.operators.domains import declared_domain
from tabveil.session import materialize, scratch_path

COLUMNS = ["SG_UF", "CD_GENERO", "CD_CARGO", "CD_COR_RACA"]
PAIRS = [("SG_UF", "CD_GENERO"), ("CD_GENERO", "CD_CARGO"), ("CD_CARGO", "CD_COR_RACA")]
EPSILON, DELTA, SEED = 1.0, 1e-6, 11
PART = noise.zcdp_budget(EPSILON, DELTA) / 3
SCALE_ONE = noise.gaussian_scale(len(COLUMNS), PART)
SCALE_TWO = noise.gaussian_scale(len(PAIRS), PART)


def text_sql(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'NULL')"


LONG = " UNION ALL ".join(f"SELECT '{c}' AS a, {text_sql(c)} AS v FROM cand" for c in COLUMNS)
DOMAIN_SQL = f"""{CANDIDATES_SQL},
one AS (SELECT a, v AS value_a, CAST(row_number() OVER (PARTITION BY a ORDER BY v) - 1 AS INTEGER) AS code_a,
               CAST(count(*) AS DOUBLE) AS n FROM ({LONG}) GROUP BY a, v)
"""
SEEN = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {text_sql(a)} AS value_a, {text_sql(b)} AS value_b FROM cand" for a, b in PAIRS
)
EDGES = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
TWO_SQL = f"""{DOMAIN_SQL},
edges(a, b) AS (VALUES {EDGES}),
frame AS (SELECT e.a, e.b, x.value_a, y.value_a AS value_b, x.code_a, y.code_a AS code_b
          FROM edges e JOIN one x ON x.a = e.a JOIN one y ON y.a = e.b),
seen AS (SELECT a, b, value_a, value_b, count(*) AS k FROM ({SEEN}) GROUP BY ALL),
two AS (SELECT frame.*, CAST(coalesce(k, 0) AS DOUBLE) AS n FROM frame LEFT JOIN seen USING (a, b, value_a, value_b))
"""


def normal_sql(keys: list[str], seed: int = SEED) -> str:
    key = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)

    def u(part):
        return f"(CAST(('0x' || substr(md5({key} || '|{seed}-{part}'), 1, 8)) AS BIGINT) / 4294967296.0)"

    return f"(sqrt(-2 * ln(1 - {u('u')})) * cos({2 * math.pi} * {u('v')}))"


NOISY_SQL = f"""{TWO_SQL},
noisy_one AS (SELECT *, n + {SCALE_ONE} * {normal_sql(["a", "code_a"])} AS m FROM one),
noisy_two AS (SELECT *, n + {SCALE_TWO} * {normal_sql(["a", "b", "code_a", "code_b"])} AS m FROM two)
"""


def _table(spark, sf_dir):
    return candidates(spark, sf_dir, *COLUMNS)


def _exact(spark, sf_dir):
    rows = _table(spark, sf_dir)
    domain = synthesis.observed_domain(rows, COLUMNS)
    return domain, synthesis.exact_marginals(rows, domain)


def _noisy(spark, sf_dir):
    domain, exact = _exact(spark, sf_dir)
    one = noise.add_gaussian(synthesis.one_way(exact.cells, domain), "n", SCALE_ONE, "m", ["a", "code_a"], SEED)
    two = noise.add_gaussian(
        synthesis.two_way(exact.cells, domain, PAIRS), "n", SCALE_TWO, "m", ["a", "b", "code_a", "code_b"], SEED
    )
    return domain, exact, one, two


@query("marginals_one_way", f"WITH {DOMAIN_SQL} SELECT a, code_a, value_a, n FROM one")
def marginals_one_way(spark, sf_dir):
    domain, exact = _exact(spark, sf_dir)
    return synthesis.with_values(synthesis.one_way(exact.cells, domain), domain)


@query("marginals_two_way_zero_cells", f"WITH {TWO_SQL} SELECT a, b, code_a, code_b, value_a, value_b, n FROM two")
def marginals_two_way_zero_cells(spark, sf_dir):
    domain, exact = _exact(spark, sf_dir)
    return synthesis.with_values(synthesis.two_way(exact.cells, domain, PAIRS), domain)


@query("noisy_marginals", f"""WITH {NOISY_SQL}
SELECT a, NULL AS b, code_a, NULL AS code_b, n, round(m, 6) + 0.0 AS m FROM noisy_one
UNION ALL SELECT a, b, code_a, code_b, n, round(m, 6) + 0.0 FROM noisy_two""")
def noisy_marginals(spark, sf_dir):
    _, _, one, two = _noisy(spark, sf_dir)
    padded = one.select("a", F.lit(None).cast("string").alias("b"), "code_a", F.lit(None).cast("int").alias("code_b"), "n", "m")
    return rounded(padded.unionByName(two.select(*padded.columns)), "m")


@query("pair_scores", f"""WITH {NOISY_SQL},
total AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM cand)
SELECT w.a, w.b, round(sum(abs(w.n - greatest(x.m, 0.0) * greatest(y.m, 0.0) / t)), 4) + 0.0 AS score
FROM two w JOIN noisy_one x ON w.a = x.a AND w.code_a = x.code_a JOIN noisy_one y ON w.b = y.a AND w.code_b = y.code_a, total
GROUP BY w.a, w.b""")
def pair_scores(spark, sf_dir):
    _, exact, one, _ = _noisy(spark, sf_dir)
    scores = synthesis.pair_scores(exact.cells, one, PAIRS, exact.n)
    return scores.withColumn("score", F.round("score", 4) + F.lit(0.0))


CONDITIONAL_SQL = f"""{NOISY_SQL},
own AS (SELECT a, code_a, CASE WHEN sum(greatest(m, 0.0)) OVER w > 0 THEN greatest(m, 0.0) / sum(greatest(m, 0.0)) OVER w
        ELSE 1.0 / count(*) OVER w END AS p FROM noisy_one WINDOW w AS (PARTITION BY a)),
kids AS (SELECT t.a AS parent, t.b AS "column", t.code_a AS parent_code, t.code_b AS code,
   CASE WHEN sum(greatest(t.m, 0.0)) OVER w > 0 THEN greatest(t.m, 0.0) / sum(greatest(t.m, 0.0)) OVER w ELSE own.p END AS p
   FROM noisy_two t JOIN own ON own.a = t.b AND own.code_a = t.code_b
   WINDOW w AS (PARTITION BY t.a, t.b, t.code_a)),
model AS (SELECT a AS "column", CAST(0 AS INTEGER) AS parent_code, code_a AS code, p FROM own WHERE a = 'SG_UF'
   UNION ALL SELECT "column", parent_code, code, p FROM kids)
"""
ORDER = [("SG_UF", None), ("CD_GENERO", "SG_UF"), ("CD_CARGO", "CD_GENERO"), ("CD_COR_RACA", "CD_CARGO")]


@query("conditional_tables", f"WITH {CONDITIONAL_SQL} SELECT \"column\", parent_code, code, round(p, 6) + 0.0 AS p FROM model")
def conditional_tables(spark, sf_dir):
    domain, _, one, two = _noisy(spark, sf_dir)
    return rounded(synthesis.full_tables(synthesis.model_table(one, two, ORDER, domain), ORDER, domain), "p")


def _draw_sql() -> str:
    steps = []
    for i, (column, parent) in enumerate(ORDER):
        u = f"(CAST(('0x' || substr(md5(CAST(row_id AS VARCHAR) || '|5-{column}'), 1, 8)) AS BIGINT) / 4294967296.0)"
        before = "ids" if i == 0 else f"step{i - 1}"
        up = "0" if parent is None else f"r.c_{parent}"
        steps.append(
            f"step{i} AS (SELECT r.*, b.code AS c_{column} FROM {before} r JOIN bounds b ON b.\"column\" = '{column}' "
            f"AND b.parent_code = {up} AND b.lo <= {u} AND {u} < b.hi)"
        )
    return ", ".join(steps)


@query("synthesize_fixed_tree", f"""WITH {CONDITIONAL_SQL},
upper AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY "column", parent_code ORDER BY code DESC) = 1 THEN 1.0
     ELSE least(sum(p) OVER (PARTITION BY "column", parent_code ORDER BY code), 1.0) END AS hi FROM model),
bounds AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY "column", parent_code ORDER BY code), 0.0) AS lo FROM upper),
ids AS (SELECT unnest(range((SELECT count(*) FROM cand))) AS row_id),
{_draw_sql()}
SELECT row_id, {", ".join(f"o_{c}.value_a AS {c}" for c in COLUMNS)} FROM step{len(ORDER) - 1}
{" ".join(f"JOIN one o_{c} ON o_{c}.a = '{c}' AND o_{c}.code_a = c_{c}" for c in COLUMNS)}""")
def synthesize_fixed_tree(spark, sf_dir):
    """As many rows as candidates, drawn along a given tree with digest draws."""
    domain, exact, one, two = _noisy(spark, sf_dir)
    table = materialize(synthesis.model_table(one, two, ORDER, domain), "model")
    model = synthesis.SynthModel(domain, ORDER, table, exact.n, EPSILON, DELTA, private=False)
    return synthesis.generate(model, seed=5, uniform=lambda column, salt: row_uniform([column], salt))


@query("tree_edges")
def tree_edges(spark, sf_dir):
    """The edges a fit under the operating system's randomness chooses."""
    rows = _table(spark, sf_dir)
    model = synthesis.fit(rows, synthesis.observed_domain(rows, COLUMNS), epsilon=EPSILON, delta=DELTA)
    return spark.createDataFrame(model.edges, "parent string, child string")


@query("synthesize")
def synthesize(spark, sf_dir):
    rows = _table(spark, sf_dir)
    model = synthesis.fit(rows, synthesis.observed_domain(rows, COLUMNS), epsilon=EPSILON, delta=DELTA)
    return synthesis.generate(model)


@query("epsilon_sweep")
def epsilon_sweep(spark, sf_dir):
    """Marginal utility of one private copy per ε."""
    rows = _table(spark, sf_dir)
    copies = synthesis.epsilon_sweep(rows, synthesis.observed_domain(rows, COLUMNS), [0.1, 1.0, 10.0])
    out = None
    for epsilon in (0.1, 1.0, 10.0):
        copy = copies.filter(F.col("epsilon") == epsilon)
        row = utility.marginal_utility(rows, copy, COLUMNS).select(F.lit(epsilon).alias("epsilon"), r6("utility").alias("utility"))
        out = row if out is None else out.unionByName(row)
    return out


# --- a pair of columns with five million cells --------------------------------
PLACES = [str(100 * nation + town) for nation in range(25) for town in range(40)]
WIDE = {"SG_UE": PLACES, "LOCAL": [f"{p}/{k}" for p in PLACES for k in range(1, 6)]}
WIDE_SCALE = 0.4
WIDE_FRAME = sparse_noise.frame("SG_UE", "LOCAL", len(WIDE["SG_UE"]) * len(WIDE["LOCAL"]), WIDE_SCALE, passing=2_000)
WIDTH = len(WIDE_FRAME.steps)


def _draw(k: str) -> str:
    """SQL of the k-th uniform number of a stretch."""
    digest = f"md5('SG_UE|LOCAL|' || CAST(chunk AS VARCHAR) || '|' || CAST({k} AS VARCHAR) || '|{SEED}-empty')"
    return f"((CAST(('0x' || substr({digest}, 1, 8)) AS BIGINT) + 0.5e0) / 4294967296e0)"


STEPS = "[" + ", ".join(f"{x!r}::DOUBLE" for x in WIDE_FRAME.steps) + "]"
STRETCH = WIDE_FRAME.stretch


def _taken(j: str) -> str:
    place = f"CAST(floor({_draw('k + 1')} * ({j} + 1)) AS BIGINT)"
    return f"CASE WHEN list_contains(places, {place}) THEN {j} ELSE {place} END"


@query("marginals_wide_pair", f"""WITH RECURSIVE {CANDIDATES_SQL},
coded AS (SELECT SG_UE // 100 * 40 + SG_UE % 100 AS x, CD_ESTADO_CIVIL - 1 AS y FROM cand),
seen AS (SELECT 'SG_UE' AS a, 'LOCAL' AS b, x * {len(WIDE["LOCAL"])} + x * 5 + y AS cell, count(*) AS n FROM coded GROUP BY ALL),
noised AS (SELECT cell, n, n + {WIDE_SCALE} * {normal_sql(["a", "b", "cell"])} AS m FROM seen),
chunks AS (SELECT unnest(range({WIDE_FRAME.stretches})) AS chunk),
numbered AS (SELECT chunk, len(list_filter({STEPS}, lambda x: x <= u)) AS number FROM (SELECT chunk, {_draw('0')} AS u FROM chunks)),
floyd AS (SELECT chunk, number, 0 AS k, CAST([] AS BIGINT[]) AS places FROM numbered
  UNION ALL SELECT chunk, number, k + 1, list_append(places, {_taken(f'({STRETCH} - number + k)')}) FROM floyd WHERE k < number),
valued AS (SELECT chunk * {STRETCH} + places[k] AS cell, {WIDE_FRAME.share!r} * {_draw(f'{WIDTH} + k')} AS u
           FROM (SELECT chunk, places, unnest(range(1, number + 1)) AS k FROM floyd WHERE k = number)),
kept AS (SELECT cell, n, m FROM noised WHERE m >= {WIDE_FRAME.threshold!r}
  UNION ALL SELECT cell, 0, -{WIDE_SCALE}e0 * {sparse_noise.normal_quantile('u')} FROM valued
  WHERE cell < {WIDE_FRAME.cells} AND cell NOT IN (SELECT cell FROM seen))
SELECT CAST(cell // {len(WIDE["LOCAL"])} AS INTEGER) AS code_a, CAST(cell % {len(WIDE["LOCAL"])} AS INTEGER) AS code_b, n, round(m, 6) + 0.0 AS m FROM kept""")
def marginals_wide_pair(spark, sf_dir):
    """Noisy cells of a pair with five million cells: the seen ones and the empty ones that pass."""
    rows = candidates(spark, sf_dir, "SG_UE", "CD_ESTADO_CIVIL").select(
        F.col("SG_UE").cast("string").alias("SG_UE"), F.concat_ws("/", "SG_UE", "CD_ESTADO_CIVIL").alias("LOCAL"))
    domain = declared_domain(spark, WIDE)
    exact = synthesis.exact_marginals(rows, domain)
    pair = [("SG_UE", "LOCAL")]
    seen = synthesis.numbered_cells(exact.cells, domain, pair)
    noisy = sparse_noise.noisy_cells(seen, [WIDE_FRAME], WIDE_SCALE, SEED).join(seen, ["a", "b", "cell"], "left")
    k = len(WIDE["LOCAL"])
    return noisy.select(F.expr(f"cast(cell div {k} AS int)").alias("code_a"), (F.col("cell") % k).cast("int").alias("code_b"),
                        F.coalesce("n", F.lit(0)).alias("n"), r6("m").alias("m"))


@query("synthesize_adaptive")
def synthesize_adaptive(spark, sf_dir):
    """A copy from a fit in rounds under the operating system's randomness."""
    rows = _table(spark, sf_dir)
    model, _ = adaptive.fit_adaptive(rows, synthesis.observed_domain(rows, COLUMNS), epsilon=EPSILON, delta=DELTA)
    return synthesis.generate(model)


RHO_SQL = f"power(sqrt({math.log(1 / DELTA)!r} + r_regionkey + 1) - sqrt({math.log(1 / DELTA)!r}), 2)"


@query("budget_ledger", f"""WITH costs AS (SELECT CAST(r_regionkey AS BIGINT) AS number, r_name AS release, {RHO_SQL} AS rho FROM region),
upto AS (SELECT *, sum(rho) OVER (ORDER BY number) AS spent FROM costs)
SELECT number, release, round(rho, 9) AS rho, round(spent, 9) AS rho_spent,
       round(spent + 2 * sqrt(spent * {math.log(1 / DELTA)!r}), 6) AS epsilon_spent FROM upto""")
def budget_ledger(spark, sf_dir):
    """One release per region, each with its own ε, added up."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"), epsilon=50.0, delta=DELTA)
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        ledger.spend(r["r_name"], noise.zcdp_budget(r["r_regionkey"] + 1, DELTA))
    return ledger.releases().select("number", "release", F.round("rho", 9).alias("rho"), F.round("rho_spent", 9).alias("rho_spent"),
                                    F.round("epsilon_spent", 6).alias("epsilon_spent"))
