import pytest
from pyspark.sql import functions as F

from tabveil.catalog.fixtures import candidates
from tabveil.catalog.reporting import ROLES
from tabveil.plans import anonymize as plans
from tabveil.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def test_latin1_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("NOME;UF\nJOSÉ DA CONCEIÇÃO;PA\n;SP\n".encode("latin-1"))
    rows = readers.read_table(spark, str(tmp_path / "in.csv"), "NOME string, UF string").collect()
    assert [tuple(r) for r in rows] == [("JOSÉ DA CONCEIÇÃO", "PA"), (None, "SP")]
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "in.csv"))


def test_ragged_experiment_log(spark, tmp_path):
    header = "timestamp,epsilon,score_total,score_wrangling,dp_gain,util_marginal,util_joint,train_sec,gen_sec,rows"
    (tmp_path / "log.csv").write_text(
        header + "\n2026-02-01 11:52:56,100.0,0.9962,0.9942,0.0020,0.5723,0.3612,0.69,27.61,100000\n"
        "2026-02-01 13:58:21,100.0,0.9962,0.9957,0.0005,0.5348,100000\n"
    )
    rows = readers.read_experiment_log(spark, str(tmp_path / "log.csv")).orderBy("timestamp").collect()
    assert [r.score_total for r in rows] == [0.9962, 0.9962] and rows[1]["rows"] is None
    (tmp_path / "bad.csv").write_text(header + "\n2026-02-01 11:52:56,many,0.1,0.1,0,0,0,0,0,1\n")
    with pytest.raises(Exception):
        readers.read_experiment_log(spark, str(tmp_path / "bad.csv")).collect()
    assert readers.read_experiment_log(spark, str(tmp_path / "bad.csv"), strict=False).first()["epsilon"] is None


def test_epsilon_family(spark, tmp_path):
    folder = str(tmp_path)
    for epsilon, n in ((0.001, 3), (10.0, 5)):
        sinks.write_epsilon_copy(spark.range(n), folder, epsilon)
    counts = {r["epsilon"]: r["count"] for r in readers.read_epsilon_family(spark, folder).groupBy("epsilon").count().collect()}
    assert counts == {0.001: 3, 10.0: 5}
    assert [r["epsilon"] for r in readers.listed_epsilons(spark, folder).collect()] == [10.0, 0.001]
    assert readers.missing_epsilons(spark, [50.0, 10.0, 0.1, 0.001], folder) == [50.0, 0.1]
    assert readers.missing_epsilons(spark, [1.0], str(tmp_path / "none")) == [1.0]


def test_column_list_prunes_the_scan(spark):
    df = readers.read_parquet(spark, f"{SF}/lineitem.parquet", ["l_orderkey", "l_tax"]).filter("l_tax > 0.05")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in plan and "GreaterThan(l_tax,0.05)" in plan


def test_audit_summary_shape(spark, tmp_path):
    details = spark.createDataFrame([("b", 0.2, "x"), ("a", 0.4, "y")], "secret string, risk double, label string")
    summary = sinks.audit_summary(details, 0.01, "2026-02-01 17:14:36")
    sinks.write_json(summary, str(tmp_path / "s"))
    row = spark.read.schema(summary.schema).json(str(tmp_path / "s")).first()
    assert row["inference_avg_risk"] == pytest.approx(0.3) and row["details"]["a"]["risk"] == 0.4


def test_anonymize(spark):
    people = candidates(spark, SF)
    few = plans.prepare(people, ROLES, "intensive")
    assert "SQ_CANDIDATO" in few.table.columns and "NM_URNA_CANDIDATO" not in few.columns
    result = plans.anonymize(people, ROLES, 5.0, profile="intensive", n_attacks=100)
    row = result.report.first()
    assert row["rows"] == 1500 and row["private"] and 0 < row["utility"] <= 1
    assert row["privacy_score"] == pytest.approx(1 - max(row[c] for c in plans.RISK_COLUMNS))
    assert result.synthetic.count() == 1500
    lines = {r["metric"]: r["value"] for r in plans.status_table(result.report).collect()}
    assert lines["epsilon"] == 5.0 and len(lines) == 6
    log = plans.experiment_row(result.report, 0.5).first()
    assert log["dp_gain"] == pytest.approx(round(log["score_total"] - 0.5, 4))


def test_failing_scenario_leaves_a_row(spark):
    people = candidates(spark, SF, "SQ_CANDIDATO", "SG_UF", "SG_PARTIDO", "CD_GENERO", "CD_COR_RACA", "DS_SIT_TOT_TURNO")
    scenarios = [plans.Scenario("good", "intensive", None), plans.Scenario("bad", "intensive", -1.0)]
    rows = {r["scenario"]: r for r in plans.scenario_matrix(people, ROLES, scenarios, n_attacks=50).collect()}
    assert rows["good"]["status"] == "ok" and rows["good"]["jsd_utility"] == 1.0
    assert rows["bad"]["status"].startswith("failed") and rows["bad"]["jsd_utility"] is None
    with pytest.raises(ValueError):
        plans.scenario_matrix(people, ROLES, scenarios[1:], isolate_errors=False)
