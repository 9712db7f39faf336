"""Queries of privacy risk. The two halves of the candidate view stand for the
original and the observed table; every row attacks unless a query draws."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabveil.catalog.fixtures import HALVES_SQL, table, two_populations
from tabveil.catalog.registry import query, r6, rounded
from tabveil.functions import scores
from tabveil.operators import mixed, risk
from tabveil.operators.clean import all_text
from tabveil.operators.conjunctions import ColumnSet
from tabveil.operators.neighbours import nearest, nearest_k
from tabveil.session import scratch_path
from tabveil.sources.commits import EpsilonStore

ID = "SQ_CANDIDATO"
AUX = ["SG_UF", "SG_PARTIDO", "CD_GENERO", "CD_CARGO"]
AUX_A, AUX_B = ["SG_UF", "SG_PARTIDO"], ["CD_GENERO", "CD_CARGO"]
SECRETS = ["CD_COR_RACA", "DS_GRAU_INSTRUCAO", "DS_ESTADO_CIVIL"]
SINGLED = ["SG_UF", "SG_PARTIDO", "CD_GENERO", "CD_CARGO", "CD_OCUPACAO"]
Z2 = scores.Z_95**2


def wilson_sql(s: str = "successes", n: str = "n") -> str:
    """risk, ci_low, ci_high of s successes in n attacks."""
    s, n = f"CAST({s} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    centre = f"(({s} + {Z2 / 2}) / ({n} + {Z2}))"
    half = f"({scores.Z_95} / ({n} + {Z2}) * sqrt({s} * ({n} - {s}) / {n} + {Z2 / 4}))"
    return (f"round({centre}, 6) + 0.0 AS risk, round(greatest({centre} - {half}, 0.0), 6) + 0.0 AS ci_low, "
            f"round(least({centre} + {half}, 1.0), 6) + 0.0 AS ci_high")


def _risks(df):
    return rounded(df, "risk", "ci_low", "ci_high")


COUNTS_SQL = """counts AS (SELECT n_name, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS successes
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"""


def _counts(spark, sf_dir):
    joined = (
        table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.groupBy("n_name").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("successes")
    )


@query("wilson_risk", f"WITH {COUNTS_SQL} SELECT n_name, n, successes, {wilson_sql()} FROM counts")
def wilson_risk(spark, sf_dir):
    return _risks(risk.with_risk(_counts(spark, sf_dir)))


BAND = """CASE WHEN r <= 0.05 THEN '✅ INSIGNIFICANTE' WHEN r <= 0.20 THEN '⚠️ MODERADO' WHEN r <= 0.50 THEN '🚨 ALTO'
 ELSE '🔥 CRÍTICO' END"""
SHARES = "shares AS (SELECT event_type, user_id, count(*) AS n, avg(value) / 100 AS r FROM events GROUP BY 1, 2)"


def _shares(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(
        F.count("*").alias("n"), (F.avg("value") / 100).alias("r")
    )


@query("risk_band", f"WITH {SHARES} SELECT event_type, user_id, n, {BAND} AS band FROM shares")
def risk_band(spark, sf_dir):
    return _shares(spark, sf_dir).select("event_type", "user_id", "n", scores.risk_band(F.col("r")).alias("band"))


@query("traffic_light", f"""WITH {SHARES} SELECT event_type, user_id, n,
  CASE WHEN r > 0.15 THEN '● Vulnerabilidade' WHEN r > 0.05 THEN '● Moderado' ELSE '● Seguro' END AS light FROM shares""")
def traffic_light(spark, sf_dir):
    return _shares(spark, sf_dir).select("event_type", "user_id", "n", scores.traffic_light(F.col("r")).alias("light"))


@query("privacy_score", f"""WITH {COUNTS_SQL}, r AS (SELECT n_name, {wilson_sql()} FROM counts)
SELECT n_name, round(1 - greatest(risk, ci_low, ci_high), 6) + 0.0 AS worst_case, round(1 - coalesce(nullif(risk, risk), 0.0), 6) AS none
FROM r""")
def privacy_score(spark, sf_dir):
    risks = _risks(risk.with_risk(_counts(spark, sf_dir)))
    return risks.select(
        "n_name", r6(scores.privacy_score(F.col("risk"), F.col("ci_low"), F.col("ci_high"))).alias("worst_case"),
        scores.privacy_score(F.nullif(F.col("risk"), F.col("risk"))).alias("none"),
    )


def text_sql(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'NULL')"


UNI_LONG = " UNION ALL ".join(
    f"SELECT {side} AS side, '{c}' AS feature, {text_sql(c)} AS value FROM {name}"
    for c in SINGLED for side, name in ((0, "ori"), (1, "syn"))
)


@query("singling_out_univariate", f"""WITH {HALVES_SQL}, long AS ({UNI_LONG}),
guess AS (SELECT feature, value, count(*) FILTER (side = 0) AS hits FROM long GROUP BY 1, 2 HAVING count(*) FILTER (side = 1) = 1),
ends AS (SELECT (SELECT count(*) FROM ori WHERE VR_BENS <= (SELECT min(VR_BENS) FROM syn)) AS hits
   UNION ALL SELECT (SELECT count(*) FROM ori WHERE VR_BENS >= (SELECT max(VR_BENS) FROM syn))),
counts AS (SELECT count(*) AS n, count(*) FILTER (hits = 1) AS successes FROM (SELECT hits FROM guess UNION ALL SELECT hits FROM ends))
SELECT 'Singling Out' AS attack, n, successes, {wilson_sql()} FROM counts""")
def singling_out_univariate(spark, sf_dir):
    original, observed = two_populations(spark, sf_dir, *SINGLED, "VR_BENS")
    return _risks(risk.singling_out_univariate(original, observed, SINGLED, numeric=["VR_BENS"]))


def sets_sql(columns, n_cols=3, prefix=""):
    return " UNION ALL ".join(
        f"SELECT {no} AS set_no, {side} AS side, concat_ws('~', {', '.join(text_sql(c) for c in s)}) AS value FROM {name}"
        for no, s in enumerate(combinations(columns, n_cols)) for side, name in ((0, "ori"), (1, "syn"))
    )


MULTI_SQL = f"""long AS ({sets_sql(SINGLED)}),
guess AS (SELECT set_no, value, count(*) FILTER (side = 0) AS hits FROM long GROUP BY 1, 2 HAVING count(*) FILTER (side = 1) = 1)"""


@query("singling_out_multivariate", f"""WITH {HALVES_SQL}, {MULTI_SQL},
counts AS (SELECT count(*) AS n, count(*) FILTER (hits = 1) AS successes FROM guess)
SELECT 'Singling Out' AS attack, n, successes, {wilson_sql()} FROM counts""")
def singling_out_multivariate(spark, sf_dir):
    original, observed = two_populations(spark, sf_dir, *SINGLED)
    return _risks(risk.singling_out_multivariate(original, observed, SINGLED))


SETS = list(combinations(SINGLED, 3))
DRAWN_SET = " ".join(
    f"WHEN {no} THEN concat_ws('~', {', '.join(text_sql(c) for c in s)})" for no, s in enumerate(SETS)
)


@query("singling_out_drawn", f"""WITH {HALVES_SQL}, {MULTI_SQL},
proposed AS (SELECT *, CAST(('0x' || substr(md5(CAST(SQ_CANDIDATO AS VARCHAR) || '|42-set'), 1, 8)) AS BIGINT) % {len(SETS)} AS set_no
             FROM syn),
keyed AS (SELECT set_no, CASE set_no {DRAWN_SET} END AS value,
                 min(md5(CAST(SQ_CANDIDATO AS VARCHAR) || '|42-draw')) AS drawn FROM proposed GROUP BY 1, 2),
first AS (SELECT hits FROM keyed JOIN guess USING (set_no, value) ORDER BY drawn LIMIT 300),
counts AS (SELECT count(*) AS n, count(*) FILTER (hits = 1) AS successes FROM first)
SELECT 'Singling Out' AS attack, n, successes, {wilson_sql()} FROM counts""")
def singling_out_drawn(spark, sf_dir):
    """300 attacks drawn as the evaluator does: a random row and random columns each."""
    original, observed = two_populations(spark, sf_dir, *SINGLED)
    return _risks(risk.singling_out_multivariate(original, observed, SINGLED, n_attacks=300, syn_id=ID))


RUNGS = {"complete": SINGLED, "reduced": SINGLED[:4], "critical": SINGLED[:3]}
RUNG_ROWS = ", ".join(
    f"('{name}', {len(cs)}, {SETS.index(s)})" for name, cs in RUNGS.items() for s in combinations(cs, 3)
)


@query("attribute_ladder", f"""WITH {HALVES_SQL}, {MULTI_SQL},
rungs(rung, n_columns, set_no) AS (VALUES {RUNG_ROWS}),
counts AS (SELECT rung, CAST(n_columns AS INTEGER) AS n_columns, count(value) AS n, count(*) FILTER (hits = 1) AS successes
           FROM rungs LEFT JOIN guess USING (set_no) GROUP BY 1, 2)
SELECT *, round(1 - risk, 6) + 0.0 AS privacy_score FROM (SELECT rung, n_columns, n, successes, {wilson_sql()} FROM counts)""")
def attribute_ladder(spark, sf_dir):
    original, observed = two_populations(spark, sf_dir, *SINGLED)
    return rounded(_risks(risk.attribute_ladder(original, observed, RUNGS)), "privacy_score")


# The oracle compares all pairs of distinct combinations, the Spark side never does.
def nearest_sql(name: str, columns, payload=()) -> str:
    own = ", ".join(columns)
    texts = ", ".join(f"{text_sql(c)} AS {c}" for c in columns)
    carried = "".join(f", arg_min({text_sql(c)}, {ID}) AS {c}_p" for c in payload)
    gap = " + ".join(f"(CASE WHEN t.{c} = s.{c} THEN 0 ELSE 1 END)" for c in columns)
    best = ", ".join(f"arg_min(s.{c}_p, ({gap}, s.id)) AS {c}_p" for c in payload)
    keys = ", ".join(f"t.{c}" for c in columns)
    return f"""{name}_t AS (SELECT DISTINCT {texts} FROM ori),
{name}_s AS (SELECT {texts}, min({ID}) AS id{carried} FROM syn GROUP BY {", ".join(str(i + 1) for i in range(len(columns)))}),
{name} AS (SELECT {keys}, CAST(min({gap}) AS INTEGER) AS distance, arg_min(s.id, ({gap}, s.id)) AS neighbour{", " + best if best else ""}
  FROM {name}_t t, {name}_s s GROUP BY {keys})"""


@query("nearest_neighbour", f"""WITH {HALVES_SQL}, {nearest_sql("nn", AUX, ["CD_COR_RACA"])}
SELECT {", ".join(AUX)}, distance, neighbour, CD_COR_RACA_p AS CD_COR_RACA FROM nn""")
def nearest_neighbour(spark, sf_dir):
    original, observed = two_populations(spark, sf_dir, *AUX, "CD_COR_RACA")
    return nearest(all_text(original, AUX), all_text(observed, [*AUX, "CD_COR_RACA"]), AUX, ID, ["CD_COR_RACA"])


K_GAP = " + ".join(f"(CASE WHEN t.{c} = s.{c} THEN 0 ELSE 1 END)" for c in AUX_B)


@query("nearest_three", f"""WITH {HALVES_SQL}, t AS (SELECT DISTINCT {", ".join(AUX_B)} FROM ori),
gaps AS (SELECT {", ".join("t." + c for c in AUX_B)}, {K_GAP} AS distance, s.{ID} AS neighbour FROM t, syn s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {", ".join(AUX_B)} ORDER BY distance, neighbour) AS rk FROM gaps)
SELECT {", ".join(AUX_B)}, CAST(rk AS INTEGER) AS rank, CAST(distance AS INTEGER) AS distance, neighbour FROM ranked WHERE rk <= 3""")
def nearest_three(spark, sf_dir):
    original, observed = two_populations(spark, sf_dir, *AUX_B)
    return nearest_k(all_text(original, AUX_B), all_text(observed, AUX_B), AUX_B, ID, 3)


def joined_sql(name: str, columns) -> str:
    return f"LEFT JOIN {name} ON " + " AND ".join(f"{name}.{c} = {text_sql('ori.' + c)}" for c in columns)


@query("inference_risk", f"""WITH {HALVES_SQL}, {nearest_sql("nn", AUX, ["CD_COR_RACA"])},
counts AS (SELECT count(*) AS n, count(*) FILTER ({text_sql("ori.CD_COR_RACA")} = nn.CD_COR_RACA_p) AS successes
           FROM ori {joined_sql("nn", AUX)})
SELECT 'Inference' AS attack, n, successes, {wilson_sql()} FROM counts""")
def inference_risk(spark, sf_dir):
    original, observed = two_populations(spark, sf_dir, *AUX, "CD_COR_RACA")
    return _risks(risk.inference(original, observed, AUX, "CD_COR_RACA", ID, ID))


@query("linkability_risk", f"""WITH {HALVES_SQL}, {nearest_sql("na", AUX_A)}, {nearest_sql("nb", AUX_B)},
counts AS (SELECT count(*) AS n, count(*) FILTER (na.neighbour = nb.neighbour) AS successes
           FROM ori {joined_sql("na", AUX_A)} {joined_sql("nb", AUX_B)})
SELECT 'Linkability' AS attack, n, successes, {wilson_sql()} FROM counts""")
def linkability_risk(spark, sf_dir):
    original, observed = two_populations(spark, sf_dir, *AUX)
    return _risks(risk.linkability(original, observed, AUX_A, AUX_B, ID, ID))


SECRET_COUNTS = " UNION ALL ".join(
    f"SELECT '{c}' AS secret, count(*) AS n, count(*) FILTER ({text_sql('ori.' + c)} = nn.{c}_p) AS successes "
    f"FROM ori {joined_sql('nn', AUX)}" for c in SECRETS
)
SECRETS_SQL = f"""{HALVES_SQL}, {nearest_sql("nn", AUX, SECRETS)}, counts AS ({SECRET_COUNTS}),
risks AS (SELECT secret, n, successes, {wilson_sql()} FROM counts)"""


def _secrets(spark, sf_dir):
    original, observed = two_populations(spark, sf_dir, *AUX, *SECRETS)
    return _risks(risk.inference_by_secret(original, observed, AUX, SECRETS, ID, ID))


@query("multi_secret_audit", f"WITH {SECRETS_SQL} SELECT *, {BAND.replace('r <', 'risk <')} AS band, "
       "CASE WHEN risk > 0.15 THEN '● Vulnerabilidade' WHEN risk > 0.05 THEN '● Moderado' ELSE '● Seguro' END AS light FROM risks")
def multi_secret_audit(spark, sf_dir):
    return risk.with_labels(_secrets(spark, sf_dir))


@query("multi_secret_summary", f"""WITH {SECRETS_SQL},
s AS (SELECT count(*) AS secrets, avg(risk) AS m, max(risk) AS w FROM risks)
SELECT secrets, round(m, 6) + 0.0 AS mean_risk, w AS worst_risk, {BAND.replace('r <', 'm <')} AS mean_band,
       {BAND.replace('r <', 'w <')} AS worst_band FROM s""")
def multi_secret_summary(spark, sf_dir):
    return rounded(risk.multi_secret_summary(_secrets(spark, sf_dir)), "mean_risk")


@query("control_excess", f"""WITH {HALVES_SQL}, {nearest_sql("nn", AUX, ["CD_COR_RACA"])},
{nearest_sql("nc", AUX, ["CD_COR_RACA"]).replace("FROM ori", "FROM syn")},
hits AS (SELECT 0 AS side, {text_sql("ori.CD_COR_RACA")} = nn.CD_COR_RACA_p AS hit FROM ori {joined_sql("nn", AUX)}
  UNION ALL SELECT 1, {text_sql("ori.CD_COR_RACA")} = nc.CD_COR_RACA_p FROM syn ori {joined_sql("nc", AUX)}),
counts AS (SELECT side, count(*) AS n, count(*) FILTER (hit) AS successes FROM hits GROUP BY 1),
risks AS (SELECT side, {wilson_sql()} FROM counts)
SELECT a.risk, c.risk AS control_risk, round((a.risk - c.risk) / (1 - c.risk), 6) + 0.0 AS excess
FROM risks a, risks c WHERE a.side = 1 AND c.side = 0""")
def control_excess(spark, sf_dir):
    """Attack on the observed rows themselves, with the other half as hold-out."""
    holdout, observed = two_populations(spark, sf_dir, *AUX, "CD_COR_RACA")
    attack = _risks(risk.inference(observed, observed, AUX, "CD_COR_RACA", ID, ID))
    control = _risks(risk.inference(holdout, observed, AUX, "CD_COR_RACA", ID, ID))
    return risk.with_control(attack, control).select("risk", "control_risk", r6("excess").alias("excess"))


@query("audit_sample", f"""WITH {HALVES_SQL},
a AS (SELECT * FROM ori ORDER BY md5(CAST({ID} AS VARCHAR) || '|42'), {ID} LIMIT 250),
b AS (SELECT * FROM syn ORDER BY md5(CAST({ID} AS VARCHAR) || '|42'), {ID} LIMIT 250)
SELECT 'original' AS side, {ID}, {text_sql("SG_UF_NASCIMENTO")} AS SG_UF_NASCIMENTO, {text_sql("CD_COR_RACA")} AS CD_COR_RACA FROM a
UNION ALL SELECT 'observed', {ID}, {text_sql("SG_UF_NASCIMENTO")}, {text_sql("CD_COR_RACA")} FROM b""")
def audit_sample(spark, sf_dir):
    original, observed = two_populations(spark, sf_dir, "SG_UF_NASCIMENTO", "CD_COR_RACA")
    left, right = risk.audit_sample(original, observed, ID, ID, 250)
    return left.select(F.lit("original").alias("side"), *left.columns).unionByName(
        right.select(F.lit("observed").alias("side"), *right.columns)
    )


@query("three_axis_audit", f"""WITH {HALVES_SQL}, {MULTI_SQL}, {nearest_sql("na", AUX_A)}, {nearest_sql("nb", AUX_B)},
{nearest_sql("nn", AUX, ["CD_COR_RACA"])},
counts AS (SELECT 'Singling Out' AS attack, count(*) AS n, count(*) FILTER (hits = 1) AS successes FROM guess
  UNION ALL SELECT 'Linkability', count(*), count(*) FILTER (na.neighbour = nb.neighbour)
    FROM ori {joined_sql("na", AUX_A)} {joined_sql("nb", AUX_B)}
  UNION ALL SELECT 'Inference', count(*), count(*) FILTER ({text_sql("ori.CD_COR_RACA")} = nn.CD_COR_RACA_p)
    FROM ori {joined_sql("nn", AUX)}),
risks AS (SELECT attack, n, successes, {wilson_sql()} FROM counts)
SELECT *, {BAND.replace('r <', 'risk <')} AS band,
  CASE WHEN risk > 0.15 THEN '● Vulnerabilidade' WHEN risk > 0.05 THEN '● Moderado' ELSE '● Seguro' END AS light FROM risks""")
def three_axis_audit(spark, sf_dir):
    original, observed = two_populations(spark, sf_dir, *SINGLED, "CD_COR_RACA")
    return _risks(risk.three_axis_audit(original, observed, SINGLED, AUX, AUX_A, AUX_B, "CD_COR_RACA", ID, ID))


THIRTEEN = ["SG_UF", "NM_UE", "CD_CARGO", "NR_PARTIDO", "SG_PARTIDO", "CD_GENERO", "CD_GRAU_INSTRUCAO", "CD_ESTADO_CIVIL", "CD_COR_RACA",
            "CD_OCUPACAO", "DT_NASCIMENTO", "DS_SITUACAO_CANDIDATURA", "DS_SIT_TOT_TURNO"]


@query("nearest_by_levels", f"""WITH {HALVES_SQL}, {nearest_sql("nn", THIRTEEN)}
SELECT {", ".join(THIRTEEN)}, distance, neighbour FROM nn""")
def nearest_by_levels(spark, sf_dir):
    """Nearest rows over thirteen columns, best sets first."""
    original, observed = two_populations(spark, sf_dir, *THIRTEEN)
    return nearest(all_text(original, THIRTEEN), all_text(observed, THIRTEEN), THIRTEEN, ID)


FAMILY_EPSILONS = [50.0, 35.0, 20.0, 10.0, 1.0, 0.1, 0.001]
STORED = FAMILY_EPSILONS[:-1]


def _copy_number(e: float) -> int:
    return STORED.index(e)


def _family_sql() -> str:
    """Copy k holds the observed rows whose key leaves another remainder than k."""
    parts, counts = [], []
    for e in STORED:
        k = _copy_number(e)
        s = f"syn{k}"
        parts.append(f"{s} AS (SELECT * FROM syn WHERE {ID} % {len(STORED)} <> {k})")
        for name, columns, payload in ((f"na{k}", AUX_A, []), (f"nb{k}", AUX_B, []), (f"nn{k}", AUX, ["CD_COR_RACA"])):
            parts.append(nearest_sql(name, columns, payload).replace("FROM syn ", f"FROM {s} "))
        parts.append(f"guess{k} AS (SELECT hits FROM (SELECT set_no, value, count(*) FILTER (side = 0) AS hits, count(*) FILTER (side = 1) AS k "
                     f"FROM ({sets_sql(SINGLED).replace('FROM syn', f'FROM {s}')}) GROUP BY 1, 2) WHERE k = 1)")
        counts += [
            f"SELECT {e}e0 AS epsilon, 'Singling Out' AS attack, count(*) AS n, count(*) FILTER (hits = 1) AS successes FROM guess{k}",
            f"SELECT {e}e0, 'Linkability', count(*), count(*) FILTER (na{k}.neighbour = nb{k}.neighbour) FROM ori {joined_sql(f'na{k}', AUX_A)} {joined_sql(f'nb{k}', AUX_B)}",
            f"SELECT {e}e0, 'Inference', count(*), count(*) FILTER ({text_sql('ori.CD_COR_RACA')} = nn{k}.CD_COR_RACA_p) FROM ori {joined_sql(f'nn{k}', AUX)}",
        ]
    return ",\n".join(parts) + ", counts AS (" + " UNION ALL ".join(counts) + ")"


@query("family_audit", f"""WITH {HALVES_SQL}, {_family_sql()},
wanted AS (SELECT CAST(e AS DOUBLE) AS epsilon, attack FROM (VALUES {", ".join(f"({e})" for e in FAMILY_EPSILONS)}) v(e),
           (VALUES ('Singling Out'), ('Linkability'), ('Inference')) w(attack))
SELECT epsilon, attack, n, successes, CASE WHEN n > 0 THEN risk END AS risk, CASE WHEN n > 0 THEN ci_low END AS ci_low,
       CASE WHEN n > 0 THEN ci_high END AS ci_high, CASE WHEN n IS NULL THEN 'missing' ELSE 'ok' END AS status
FROM wanted LEFT JOIN (SELECT epsilon, attack, n, successes, {wilson_sql()} FROM counts) c USING (epsilon, attack)""")
def family_audit(spark, sf_dir):
    """Six stored copies of seven wanted ε, attacked in one plan."""
    used = list(dict.fromkeys([*SINGLED, *AUX, "CD_COR_RACA"]))
    original, observed = two_populations(spark, sf_dir, *used)
    store = EpsilonStore(spark, scratch_path(spark, "family"))
    for e in STORED:
        store.write(observed.filter(F.col(ID) % len(STORED) != _copy_number(e)), e)
    audit = risk.audit_store(original, store, FAMILY_EPSILONS, SINGLED, AUX, AUX_A, AUX_B, "CD_COR_RACA", ID)
    return _risks(audit).select("epsilon", "attack", "n", "successes", "risk", "ci_low", "ci_high", "status")


MIXED_TEXT, MIXED_NUMBERS = ["SG_UF", "CD_CARGO"], ["VR_BENS", "NR_PARTIDO"]
MIXED_GAP = " + ".join([f"(CASE WHEN t.{c} = s.{c} THEN 0e0 ELSE 1e0 END)" for c in MIXED_TEXT]
                       + [f"least(abs(CAST(t.{c} AS DOUBLE) - CAST(s.{c} AS DOUBLE)) / e.e_{c}, 1e0)" for c in MIXED_NUMBERS])


@query("nearest_mixed", f"""WITH {HALVES_SQL}, chosen AS (SELECT * FROM ori WHERE {ID} % 50 = 0),
e AS (SELECT {", ".join(f"CAST(max({c}) - min({c}) AS DOUBLE) AS e_{c}" for c in MIXED_NUMBERS)} FROM cand),
pairs AS (SELECT {", ".join(f"t.{c}" for c in [*MIXED_TEXT, *MIXED_NUMBERS])}, {MIXED_GAP} AS distance, s.{ID} AS neighbour FROM chosen t, syn s, e)
SELECT {", ".join(MIXED_TEXT)}, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MIXED_NUMBERS)},
       round(min(distance), 9) + 0.0 AS distance, arg_min(neighbour, (distance, neighbour)) AS neighbour
FROM pairs GROUP BY {", ".join([*MIXED_TEXT, *MIXED_NUMBERS])}""")
def nearest_mixed(spark, sf_dir):
    """Nearest rows by two texts and two numbers, for every row whose id is divisible by 50, against all observed rows."""
    used = [*MIXED_TEXT, *MIXED_NUMBERS]
    original, observed = two_populations(spark, sf_dir, *used)
    ranges = mixed.column_ranges([original, observed], MIXED_NUMBERS)
    some = original.filter(F.col(ID) % 50 == 0)
    found = mixed.nearest_mixed(all_text(some, MIXED_TEXT), all_text(observed, MIXED_TEXT), MIXED_TEXT, MIXED_NUMBERS, ID, ranges)
    return found.withColumn("distance", F.round("distance", 9) + F.lit(0.0))


CONJUNCTIONS = [
    ColumnSet(("SG_UF", "CD_GENERO", "CD_CARGO"), ()), ColumnSet(("SG_UF", "SG_PARTIDO"), ("VR_BENS",)), ColumnSet(("CD_CARGO",), ("VR_BENS", "NR_PARTIDO")),
    ColumnSet((), ("NR_PARTIDO", "CD_OCUPACAO", "SG_UE")),
]


def _conjunction_sql(number: int, s: ColumnSet) -> str:
    """The distinct conjunctions of a set, the rows of both sides that satisfy each."""
    ops = [f"{c} > (SELECT quantile_disc({c}, 0.5) FROM syn)" for c in s.numeric]
    fields = [f"{text_sql(c)} AS t{i}" for i, c in enumerate(s.text)] + [
        f"{c} AS v{i}, {op} AS o{i}" for i, (c, op) in enumerate(zip(s.numeric, ops))]
    meets = [f"{text_sql('r.' + c)} = p.t{i}" for i, c in enumerate(s.text)] + [
        f"(CASE WHEN p.o{i} THEN r.{c} >= p.v{i} ELSE r.{c} <= p.v{i} END)" for i, c in enumerate(s.numeric)]
    on = " AND ".join(meets)
    return f"""p{number} AS (SELECT *, row_number() OVER () AS pid FROM (SELECT DISTINCT {", ".join(fields)} FROM syn)),
u{number} AS (SELECT p.pid FROM p{number} p JOIN syn r ON {on} GROUP BY p.pid HAVING count(*) = 1),
h{number} AS (SELECT {number} AS set_no, p.pid, count(r.{ID}) AS hits FROM (SELECT * FROM p{number} SEMI JOIN u{number} USING (pid)) p
  LEFT JOIN ori r ON {on} GROUP BY p.pid)"""


CONJUNCTIONS_SQL = ",\n".join(_conjunction_sql(i, s) for i, s in enumerate(CONJUNCTIONS))
HITS_SQL = " UNION ALL ".join(f"SELECT set_no, hits FROM h{i}" for i in range(len(CONJUNCTIONS)))


def _conjunction_tables(spark, sf_dir):
    return two_populations(spark, sf_dir, *dict.fromkeys(c for s in CONJUNCTIONS for c in (*s.text, *s.numeric)))


@query("conjunction_hits", f"""WITH {HALVES_SQL}, {CONJUNCTIONS_SQL}
SELECT CAST(set_no AS INTEGER) AS set_no, hits, count(*) AS predicates FROM ({HITS_SQL}) GROUP BY 1, 2""")
def conjunction_hits(spark, sf_dir):
    """How often unique conjunctions of equalities and ranges match 0, 1, 2 … original rows."""
    predicates = risk.conjunction_predicates(*_conjunction_tables(spark, sf_dir), CONJUNCTIONS)
    return predicates.groupBy("set_no", "hits").agg(F.count("*").alias("predicates"))


@query("singling_out_conjunctions", f"""WITH {HALVES_SQL}, {CONJUNCTIONS_SQL},
counts AS (SELECT count(*) AS n, count(*) FILTER (hits = 1) AS successes FROM ({HITS_SQL}))
SELECT 'Singling Out' AS attack, n, successes, {wilson_sql()} FROM counts""")
def singling_out_conjunctions(spark, sf_dir):
    return _risks(risk.singling_out_conjunctions(*_conjunction_tables(spark, sf_dir), CONJUNCTIONS))
