"""Queries that write to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabveil.catalog.attacking import SECRETS_SQL, BAND, _secrets
from tabveil.catalog.fixtures import CANDIDATES_SQL, candidates, table
from tabveil.catalog.registry import query, r6
from tabveil.operators import risk
from tabveil.session import scratch_path
from tabveil.sources import readers, sinks
from tabveil.sources.commits import CommittedTable, EpsilonStore

KEPT = ["SQ_CANDIDATO", "DS_GRAU_INSTRUCAO", "DS_SIT_TOT_TURNO", "SG_UF_NASCIMENTO", "VR_BENS"]


@query("scan_csv_latin1", f"WITH {CANDIDATES_SQL} SELECT {', '.join(KEPT)} FROM cand")
def scan_csv_latin1(spark, sf_dir):
    rows = candidates(spark, sf_dir, *KEPT)
    path = sinks.write_csv(rows, scratch_path(spark, "csv"), encoding="ISO-8859-1")
    return readers.read_table(spark, path, rows.schema)


@query("roundtrip_sinks", """
SELECT 'parquet' AS sink, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders
UNION ALL SELECT 'csv', count(*), CAST(sum(o_custkey) AS BIGINT) FROM orders
UNION ALL SELECT 'json', count(*), CAST(sum(o_custkey) AS BIGINT) FROM orders
UNION ALL SELECT 'appended', 2 * count(*), CAST(2 * sum(o_custkey) AS BIGINT) FROM orders""")
def roundtrip_sinks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    parquet = readers.read_table(spark, sinks.write_parquet(orders, scratch_path(spark, "rt") + ".parquet"))
    csv = readers.read_csv(spark, sinks.write_csv(orders, scratch_path(spark, "rt")), orders.schema, encoding="UTF-8")
    json = spark.read.schema(orders.schema).json(sinks.write_json(orders, scratch_path(spark, "rt")))
    log = scratch_path(spark, "log")
    for _ in range(2):
        sinks.append_run(orders, log)
    out = None
    for name, df in (("parquet", parquet), ("csv", csv), ("json", json), ("appended", spark.read.parquet(log))):
        row = df.agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total")).select(F.lit(name).alias("sink"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


FAMILY = {10.0: "o_totalprice > 100000", 1.0: "o_totalprice > 200000", 0.1: "o_totalprice > 300000"}


def _family(spark, sf_dir):
    folder = scratch_path(spark, "family")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    for epsilon, rule in FAMILY.items():
        sinks.write_epsilon_copy(orders.filter(rule), folder, epsilon)
    return folder


@query("scan_eps_family", " UNION ALL ".join(
    f"SELECT CAST({e} AS DOUBLE) AS epsilon, o_orderstatus, count(*) AS n FROM orders WHERE {rule} GROUP BY 2"
    for e, rule in FAMILY.items()
))
def scan_eps_family(spark, sf_dir):
    family = readers.read_epsilon_family(spark, _family(spark, sf_dir))
    return family.groupBy("epsilon", "o_orderstatus").agg(F.count("*").alias("n")).orderBy(F.desc("epsilon"), "o_orderstatus")


@query("partitioned_eps_family", f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {FAMILY[1.0]}")
def partitioned_eps_family(spark, sf_dir):
    """The family as one table; a filter on epsilon reads one partition."""
    family = readers.read_epsilon_family(spark, _family(spark, sf_dir))
    path = sinks.write_epsilon_family(family, scratch_path(spark, "partitioned"))
    return spark.read.parquet(path).filter(F.col("epsilon") == 1.0).drop("epsilon")


@query("resume_missing_eps", """
SELECT CAST(e AS DOUBLE) AS epsilon, (SELECT count(*) FROM orders) AS rows_to_fit FROM (VALUES (50.0), (0.001)) v(e)""")
def resume_missing_eps(spark, sf_dir):
    """The ε of a sweep that still have to be made."""
    missing = readers.missing_epsilons(spark, [50.0, 10.0, 1.0, 0.1, 0.001], _family(spark, sf_dir))
    rows = table(spark, sf_dir, "orders").agg(F.count("*")).scalar()
    wanted = spark.createDataFrame([(e,) for e in missing], "epsilon double")
    return wanted.select("epsilon", rows.alias("rows_to_fit"))


@query("experiment_log", """
WITH s AS (SELECT o_orderpriority AS epsilon, avg(o_totalprice) AS a, min(o_totalprice) AS b FROM orders GROUP BY 1)
SELECT CAST(substr(epsilon, 1, 1) AS DOUBLE) AS epsilon, round(a, 2) AS score_total, round(b, 2) AS score_wrangling FROM s""")
def experiment_log(spark, sf_dir):
    """A run log written as text and read back with its scores as numbers."""
    runs = table(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("epsilon")).agg(
        F.round(F.avg("o_totalprice"), 2).alias("score_total"), F.round(F.min("o_totalprice"), 2).alias("score_wrangling"),
        F.count("*").alias("rows"),
    )
    empty = F.lit(None).cast("string")
    full = runs.select(
        F.lit("2026-02-01 11:52:56").alias("timestamp"), "epsilon", "score_total", "score_wrangling",
        *[empty.alias(c) for c in ("dp_gain", "util_marginal", "util_joint", "train_sec", "gen_sec")], "rows",
    )
    log = readers.read_experiment_log(spark, sinks.write_csv(full, scratch_path(spark, "log"), sep=","))
    return log.select("epsilon", "score_total", "score_wrangling")


@query("audit_json", f"""WITH {SECRETS_SQL}
SELECT (SELECT round(avg(risk), 6) + 0.0 FROM risks) AS inference_avg_risk, secret, risk, {BAND.replace('r <', 'risk <')} AS label
FROM risks""")
def audit_json(spark, sf_dir):
    """The nested audit summary through a JSON file, one line per secret."""
    details = risk.with_labels(_secrets(spark, sf_dir)).withColumnRenamed("band", "label")
    summary = sinks.audit_summary(details, timestamp="2026-02-01 17:14:36")
    path = sinks.write_json(summary, scratch_path(spark, "json"))
    back = spark.read.schema(summary.schema).json(path)
    lines = back.select("inference_avg_risk", F.explode("details").alias("secret", "entry"))
    return lines.select(r6("inference_avg_risk").alias("inference_avg_risk"), "secret", "entry.risk", "entry.label")


@query("committed_family", " UNION ALL ".join(
    f"SELECT CAST({e} AS DOUBLE) AS epsilon, o_orderstatus, count(*) AS n FROM orders WHERE {rule} GROUP BY 2"
    for e, rule in FAMILY.items()
))
def committed_family(spark, sf_dir):
    """Copies by ε, one of which was cut off before its commit and is made again."""
    store = EpsilonStore(spark, scratch_path(spark, "store"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    cut_off = next(iter(FAMILY))
    for epsilon, rule in FAMILY.items():
        if epsilon == cut_off:
            orders.filter(rule).limit(10).write.parquet(f"{store.folder}/data/step=cut-off")
        else:
            store.write(orders.filter(rule), epsilon)
    for epsilon in store.missing(list(FAMILY)):
        store.write(orders.filter(FAMILY[epsilon]), epsilon)
    return store.copies().groupBy("epsilon", "o_orderstatus").agg(F.count("*").alias("n"))


@query("append_once", "SELECT o_orderstatus AS run, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def append_once(spark, sf_dir):
    """Runs appended twice each under their names stand in the table once."""
    log = CommittedTable(spark, scratch_path(spark, "runs"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    names = [r["o_orderstatus"] for r in orders.select("o_orderstatus").distinct().collect()]  # three states
    for name in [*names, *names]:
        log.append(orders.filter(F.col("o_orderstatus") == name), name)
    return log.read(name="run").groupBy("run").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))
