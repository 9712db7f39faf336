"""From a record table to a private synthetic copy and its report."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabveil.functions.scores import risk_band, safe_round, traffic_light
from tabveil.operators import pii, predictive, risk, synthesis, utility
from tabveil.operators.clean import common_columns
from tabveil.operators.generalize import apply_wrangling, cardinality_report
from tabveil.operators.sampling import sample_guard, train_test
from tabveil.roles import Roles, Strategy, require_columns
from tabveil.session import materialize
from tabveil.sources.readers import read_table
from tabveil.sources.sinks import write_parquet

RISK_COLUMNS = ["singling_out_risk", "linkability_risk", "inference_risk"]


@dataclass(frozen=True)
class Prepared:
    """The generalised table, with the row id in front, and its PII report."""

    table: DataFrame
    columns: list[str]
    pii: DataFrame
    cardinality: DataFrame


def prepare(df: DataFrame, roles: Roles, profile: str | Strategy = "intensive", keep: Sequence[str] = (),
            max_rows: int | None = None, detect_pii: bool = True, seed: int = 42) -> Prepared:
    """Generalise, look for personal data in what is left, drop flagged columns."""
    require_columns(df, [roles.row_id])
    working = sample_guard(df, roles.row_id, max_rows, seed=seed)
    table = materialize(apply_wrangling(
        working, profile, [roles.row_id, *keep], roles.identifiers, roles.base, roles.birth_date
    ), "generalised")
    columns = [c for c in table.columns if c != roles.row_id]
    report = pii.pii_columns(table, columns=columns)
    if detect_pii:
        flagged = set(pii.flagged(report))
        columns = [c for c in columns if c not in flagged]
    return Prepared(table.select(roles.row_id, *columns), columns, report, cardinality_report(table, columns))


@dataclass(frozen=True)
class Result:
    """A synthetic copy, what it was made from, and one report row."""

    synthetic: DataFrame
    prepared: Prepared
    report: DataFrame
    risks: DataFrame


def _axes(roles: Roles, columns: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """The known attributes that exist, and their two halves; the secret and the
    row id are never among them."""
    have = [c for c in columns if c not in (roles.secret, roles.row_id)]
    aux = [c for c in roles.aux if c in have]
    a, b = roles.linked_parts()
    a, b = [c for c in a if c in have], [c for c in b if c in have]
    if not a or not b:
        a, b = aux[: len(aux) // 2], aux[len(aux) // 2:]
    return aux, a, b


def audit(original: DataFrame, synthetic: DataFrame, roles: Roles, syn_id: str, n_attacks: int | None = None,
          sample_size: int | None = None, seed: int = 42) -> DataFrame:
    """The three attacks on the columns both tables share."""
    shared = common_columns(original, synthetic, without=[roles.row_id, syn_id])
    aux, a, b = _axes(roles, shared)
    require_columns(original, [roles.secret])
    left, right = risk.audit_sample(original, synthetic, roles.row_id, syn_id, sample_size, seed)
    return risk.three_axis_audit(left, right, shared, aux, a, b, roles.secret, roles.row_id, syn_id, n_attacks, seed)


def anonymize(df: DataFrame, roles: Roles, epsilon: float = 1.0, delta: float = 1e-6,
              profile: str | Strategy = "high_fidelity", domain: Mapping[str, Sequence[str]] | None = None,
              max_rows: int | None = None, detect_pii: bool = True, n_attacks: int | None = None,
              sample_size: int | None = None, seed: int = 42,
              noise_seed: int | None = None) -> Result:
    """One private copy of a table with utility and risks.

    The budget covers the synthesis. Generalisation, an undeclared domain and
    the audit itself look at the real rows without spending any of it.
    """
    prepared = prepare(df, roles, profile, max_rows=max_rows, detect_pii=detect_pii, seed=seed)
    rows = prepared.table.select(*prepared.columns)
    model = synthesis.fit(
        rows, domain or synthesis.observed_domain(rows, prepared.columns), epsilon, delta, noise_seed
    )
    started = time.perf_counter()
    synthetic = materialize(synthesis.generate(model, seed=seed), "synthetic")
    gen_seconds = time.perf_counter() - started
    risks = materialize(audit(prepared.table, synthetic, roles, "row_id", n_attacks, sample_size, seed), "risks")
    scores = utility.marginal_utility(rows, synthetic, prepared.columns)
    joint = utility.joint_utility(rows, synthetic, prepared.columns)
    wide = risk.audit_row(risks)
    report = wide.select(
        F.lit(float(epsilon)).alias("epsilon"), F.lit(float(delta)).alias("delta"),
        F.lit(model.private).alias("private"), F.lit(model.n).alias("rows"),
        scores.scalar().alias("utility"), joint.scalar().alias("joint_utility"),
        *[F.col(c) for c in RISK_COLUMNS], F.col("privacy_score"),
        *[risk_band(F.col(c)).alias(c.replace("_risk", "_band")) for c in RISK_COLUMNS],
        *[traffic_light(F.col(c)).alias(c.replace("_risk", "_light")) for c in RISK_COLUMNS],
        pii.pii_report(prepared.pii, "DROPPED" if detect_pii else "REPORTED").scalar().alias("pii_report"),
        F.lit(model.fit_seconds).alias("train_sec"), F.lit(gen_seconds).alias("gen_sec"),
    )
    return Result(synthetic, prepared, report, risks)


def run_file(spark: SparkSession, path: str, output: str, roles: Roles, epsilon: float = 1.0,
             schema: T.StructType | str | None = None, **kwargs) -> Result:
    """Read by file type, anonymise, write the copy as parquet."""
    result = anonymize(read_table(spark, path, schema), roles, epsilon, **kwargs)
    write_parquet(result.synthetic, output)
    return result


# --- scenarios -------------------------------------------------------------
@dataclass(frozen=True)
class Scenario:
    name: str
    profile: str
    epsilon: float | None


# --- fixed values: the scenario matrix and the ε ladders -------------------
SCENARIOS = [
    Scenario("High-Fidelity", "high_fidelity", 1.0),
    Scenario("Wrangling-Only", "intensive", None),
    Scenario("Intensive-eps-0.1", "intensive", 0.1),
    Scenario("Intensive-eps-1.0", "intensive", 1.0),
    Scenario("Intensive-eps-10.0", "intensive", 10.0),
]
SWEEP_EPSILONS = [50.0, 35.0, 20.0, 10.0, 1.0, 0.1, 0.001]
COMPARED_EPSILONS = [0.1, 1.0, 10.0, 100.0]

REPORT_SCHEMA = T.StructType([
    T.StructField("scenario", T.StringType()), T.StructField("epsilon", T.DoubleType()),
    T.StructField("jsd_utility", T.DoubleType()),
    *[T.StructField(c, T.DoubleType()) for c in RISK_COLUMNS],
    T.StructField("privacy_score", T.DoubleType()),
    T.StructField("models", T.MapType(T.StringType(), T.StructType([
        T.StructField("f1_real", T.DoubleType()), T.StructField("f1_syn", T.DoubleType()),
        T.StructField("acc_delta", T.DoubleType()),
    ]))),
    T.StructField("status", T.StringType()),
])


def run_scenario(scenario: Scenario, prepared: Prepared, roles: Roles, models: Mapping[str, object],
                 n_attacks: int | None, seed: int, noise_seed: int | None,
                 exact: synthesis.ExactMarginals | None) -> DataFrame:
    """One report row."""
    if scenario.epsilon is None:
        copy, syn_id = prepared.table, roles.row_id
    else:
        model = synthesis.fit(exact, epsilon=scenario.epsilon, seed=noise_seed)
        copy, syn_id = materialize(synthesis.generate(model, seed=seed), "synthetic"), "row_id"
    risks = risk.audit_row(audit(prepared.table, copy, roles, syn_id, n_attacks, seed=seed))
    jsd = utility.marginal_utility(prepared.table, copy, prepared.columns)
    features = [c for c in prepared.columns if c != roles.target]
    if models:
        gaps = predictive.tstr_gap(
            predictive.tstr(prepared.table, copy, features, roles.target, roles.row_id, models, seed=seed)
        )
        # One entry per model.
        entry = F.struct("model", F.struct(*[safe_round(F.col(c)).alias(c) for c in ("f1_real", "f1_syn", "acc_delta")]))
        scored = gaps.agg(F.map_from_entries(F.collect_list(entry))).scalar()
    else:
        scored = F.lit(None)
    return risks.select(
        F.lit(scenario.name).alias("scenario"), F.lit(scenario.epsilon).cast("double").alias("epsilon"),
        safe_round(jsd.scalar()).alias("jsd_utility"), *[safe_round(F.col(c)).alias(c) for c in RISK_COLUMNS],
        safe_round(F.col("privacy_score")).alias("privacy_score"),
        scored.cast(REPORT_SCHEMA["models"].dataType).alias("models"), F.lit("ok").alias("status"),
    )


def scenario_matrix(df: DataFrame, roles: Roles, scenarios: Sequence[Scenario] = SCENARIOS,
                    models: Mapping[str, object] | None = None, n_attacks: int | None = None, seed: int = 42,
                    noise_seed: int | None = None, isolate_errors: bool = True) -> DataFrame:
    """One row per scenario: utility, risks, model scores.

    The generalised table and the exact marginals of a profile are made once and
    shared by its scenarios. With ``isolate_errors`` a scenario that fails leaves
    a row whose status says why, and the others go on.
    """
    spark = df.sparkSession
    shared: dict[str, tuple[Prepared, synthesis.ExactMarginals | None]] = {}
    rows = []
    for scenario in scenarios:
        try:
            if scenario.profile not in shared:
                shared[scenario.profile] = (prepare(df, roles, scenario.profile, seed=seed), None)
            prepared, exact = shared[scenario.profile]
            if scenario.epsilon is not None and exact is None:
                table = prepared.table.select(*prepared.columns)
                exact = synthesis.exact_marginals(table, synthesis.observed_domain(table, prepared.columns))
                shared[scenario.profile] = (prepared, exact)
            row = run_scenario(scenario, prepared, roles, models or {}, n_attacks, seed, noise_seed, exact)
            rows.append(materialize(row, "scenario"))
        except Exception as error:
            if not isolate_errors:
                raise
            failed = {"scenario": scenario.name, "epsilon": scenario.epsilon, "status": f"failed: {error}"[:500]}
            values = tuple(failed.get(f.name) for f in REPORT_SCHEMA.fields)
            rows.append(spark.createDataFrame([values], REPORT_SCHEMA))
    return reduce(DataFrame.unionByName, rows)


COMPARISON_SCHEMA = T.StructType([
    T.StructField("epsilon", T.DoubleType()), T.StructField("privacy_score", T.DoubleType()), T.StructField("risk_linkability", T.DoubleType()),
    T.StructField("risk_inference", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("utility_jsd", T.DoubleType()),
    T.StructField("f1_synthetic", T.DoubleType()), T.StructField("f1_drop", T.DoubleType()), T.StructField("error", T.StringType()),
])


def compare_epsilons(df: DataFrame, roles: Roles, epsilons: Sequence[float] = COMPARED_EPSILONS,
                     profile: str = "high_fidelity", n_attacks: int | None = None, trees: int = 100, depth: int = 10,
                     test_fraction: float = 0.2, seed: int = 42, noise_seed: int | None = None, isolate_errors: bool = True) -> DataFrame:
    """Per ε: worst of linkability and inference, its band, utility, F1 of a
    forest trained on the copy and the F1 lost against the generalised table.

    Copies are made from training rows and all forests are scored on the same
    held-out rows; the forest of the generalised table is fitted once. With
    ``isolate_errors`` an ε that fails leaves a row with its ``error``; if all
    fail, the last error is raised.
    """
    prepared = prepare(df, roles, profile, seed=seed)
    train, test = train_test(prepared.table, test_fraction, roles.row_id, seed)
    table = train.select(*prepared.columns)
    exact = synthesis.exact_marginals(table, synthesis.observed_domain(table, prepared.columns))
    features = [c for c in prepared.columns if c != roles.target]
    aux, a, b = _axes(roles, prepared.columns)
    f1_real = float(predictive.forest_score(train, test, features, roles.target, trees, depth, seed).first()["weighted_f1"])
    rows, failed, error = [], 0, None
    for epsilon in epsilons:
        try:
            copy = materialize(synthesis.generate(synthesis.fit(exact, epsilon=epsilon, seed=noise_seed), seed=seed), "synthetic")
            link = risk.linkability(train, copy, a, b, roles.row_id, "row_id", n_attacks, seed=seed)
            guess = risk.inference(train, copy, aux, roles.secret, roles.row_id, "row_id", n_attacks, seed)
            f1 = float(predictive.forest_score(copy, test, features, roles.target, trees, depth, seed).first()["weighted_f1"])
            row = risk.audit_row(link.unionByName(guess)).select(
                F.lit(float(epsilon)).alias("epsilon"), safe_round(F.col("privacy_score")).alias("privacy_score"),
                safe_round(F.col("linkability_risk")).alias("risk_linkability"),
                safe_round(F.col("inference_risk")).alias("risk_inference"),
                risk_band(1 - F.col("privacy_score")).alias("status"),
                safe_round(utility.marginal_utility(table, copy, prepared.columns).scalar()).alias("utility_jsd"),
                safe_round(F.lit(f1)).alias("f1_synthetic"), safe_round(F.lit(f1_real - f1)).alias("f1_drop"),
                F.lit(None).cast("string").alias("error"),
            )
            rows.append(materialize(row, "comparison"))
        except Exception as caught:
            if not isolate_errors:
                raise
            failed, error = failed + 1, caught
            values = (float(epsilon), *[None] * (len(COMPARISON_SCHEMA) - 2), f"{type(caught).__name__}: {caught}"[:500])
            rows.append(df.sparkSession.createDataFrame([values], COMPARISON_SCHEMA))
    if error is not None and failed == len(rows):
        raise error
    return reduce(DataFrame.unionByName, rows)


def retention_report(real_train: DataFrame, real_test: DataFrame, family: DataFrame, epsilons: Sequence[float],
                     features: Sequence[str], label: str, wrangle: Sequence[str], rounds: int = 100,
                     seed: int = 42) -> DataFrame:
    """Weighted F1 of boosted trees per ε, raw and with top-15 training columns,
    and the share of the real generalised score that is kept. ε null is real.

    The tables are written first; each is passed over several times."""
    columns = [*features, label]
    real_train, real_test = materialize(real_train.select(*columns), "train"), materialize(real_test.select(*columns), "test")
    family = materialize(family.select("epsilon", *columns), "family")

    def scored(train: DataFrame, epsilon: float | None) -> DataFrame:
        raw = predictive.train_score(train, real_test, features, label, rounds=rounds, seed=seed)
        grouped = predictive.train_score(train, real_test, features, label, wrangle, rounds=rounds, seed=seed)
        return raw.select(
            F.lit(epsilon).cast("double").alias("epsilon"), F.col("weighted_f1").alias("f1_raw"),
            grouped.select("weighted_f1").scalar().alias("f1_wrangled"),
        )

    real = scored(real_train, None)
    copies = [scored(family.filter(F.col("epsilon") == e), e) for e in sorted(epsilons, reverse=True)]
    base = real.select("f1_wrangled").scalar()
    rows = reduce(DataFrame.unionByName, copies, real)
    return predictive.with_retention(rows.withColumn("f1_base", base), "f1_wrangled", "f1_base").drop("f1_base")


def experiment_row(report: DataFrame, wrangling_score: float) -> DataFrame:
    """A run's row for the experiment log; the gain is over generalisation alone."""
    scored = report.select(
        F.current_timestamp().alias("timestamp"), "epsilon", F.round("privacy_score", 4).alias("score_total"),
        F.lit(float(wrangling_score)).alias("score_wrangling"), F.round("utility", 4).alias("util_marginal"),
        F.round("joint_utility", 4).alias("util_joint"), F.round("train_sec", 2).alias("train_sec"),
        F.round("gen_sec", 2).alias("gen_sec"), "rows",
    )
    order = ["timestamp", "epsilon", "score_total", "score_wrangling", "dp_gain", "util_marginal", "util_joint",
             "train_sec", "gen_sec", "rows"]
    return utility.dp_gain(scored).select(*order)


def status_table(report: DataFrame) -> DataFrame:
    """The report as (metric, value, status) lines."""
    def line(name: str, status=None):
        status = F.lit(None).cast("string") if status is None else status
        return F.struct(F.lit(name).alias("metric"), F.col(name).alias("value"), status.alias("status"))

    lines = F.array(
        line("epsilon"), line("utility"), *[line(c, traffic_light(F.col(c))) for c in RISK_COLUMNS], line("privacy_score")
    )
    return report.select(F.inline(lines))
