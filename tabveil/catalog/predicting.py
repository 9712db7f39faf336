"""Queries of label encoding and prediction scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabveil.catalog.fixtures import CANDIDATES_SQL, HALVES_SQL, candidates, table, two_populations
from tabveil.catalog.registry import query, r6, rounded
from tabveil.functions import text
from tabveil.operators import encode, predictive
from tabveil.operators.sampling import split_stratified

ENCODED = ["SG_PARTIDO", "CD_GENERO", "SG_UF_NASCIMENTO"]


def code_sql(column: str, source: str) -> str:
    return f"(SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(CAST({column} AS VARCHAR), 'NULL') AS v FROM {source}))"


def encoded_sql(sources: dict[str, str], dictionary: str, unseen: str) -> str:
    parts = []
    for name, source in sources.items():
        joins = " ".join(
            f"LEFT JOIN {code_sql(c, dictionary)} d{i} ON d{i}.v = coalesce(CAST(s.{c} AS VARCHAR), 'NULL')" for i, c in enumerate(ENCODED)
        )
        codes = ", ".join(f"CAST({unseen.format(f'd{i}.code')} AS INTEGER) AS {c}" for i, c in enumerate(ENCODED))
        parts.append(f"SELECT '{name}' AS side, SQ_CANDIDATO, {codes} FROM {source} s {joins}")
    return " UNION ALL ".join(parts)


def _stacked(tables):
    out = None
    for name, df in tables.items():
        df = df.select(F.lit(name).alias("side"), "SQ_CANDIDATO", *ENCODED)
        out = df if out is None else out.unionByName(df)
    return out


@query("label_encode", f"WITH {CANDIDATES_SQL} {encoded_sql({'all': 'cand'}, 'cand', '{}')}")
def label_encode(spark, sf_dir):
    rows = candidates(spark, sf_dir, "SQ_CANDIDATO", *ENCODED)
    return _stacked({"all": encode.encode_union([rows], ENCODED)[0]})


@query("label_encode_union", f"WITH {HALVES_SQL} {encoded_sql({'train': 'ori', 'test': 'syn'}, 'cand', '{}')}")
def label_encode_union(spark, sf_dir):
    left, right = two_populations(spark, sf_dir, *ENCODED)
    train, test = encode.encode_union([left, right], ENCODED)
    return _stacked({"train": train, "test": test})


# The second table gets values of its own, so that some are unseen.
RENAMED_SQL = HALVES_SQL + """,
other AS (SELECT * REPLACE (CASE WHEN CD_GENERO = 'P' THEN 'X' ELSE CD_GENERO END AS CD_GENERO) FROM syn)"""


@query("label_encode_unseen_zero", f"WITH {RENAMED_SQL} {encoded_sql({'first': 'ori', 'second': 'other'}, 'ori', 'coalesce({}, 0)')}")
def label_encode_unseen_zero(spark, sf_dir):
    left, right = two_populations(spark, sf_dir, *ENCODED)
    right = right.withColumn("CD_GENERO", F.regexp_replace("CD_GENERO", "^P$", "X"))
    first, second = encode.encode_by_first(left, [right], ENCODED)
    return _stacked({"first": first, "second": second})


GUESS = """CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity < 20 THEN 'R' ELSE 'A' END"""
SCORED_SQL = f"""
pred AS (SELECT l_linestatus AS part, l_returnflag AS y, {GUESS} AS yhat FROM lineitem),
classes AS (SELECT part, y AS c FROM pred UNION SELECT part, yhat FROM pred),
per_class AS (SELECT part, c,
   (SELECT count(*) FROM pred p WHERE p.part = k.part AND y = c) AS support,
   (SELECT count(*) FROM pred p WHERE p.part = k.part AND yhat = c) AS predicted,
   (SELECT count(*) FROM pred p WHERE p.part = k.part AND y = c AND yhat = c) AS hits FROM classes k),
metrics AS (SELECT *, CASE WHEN predicted > 0 THEN hits / CAST(predicted AS DOUBLE) ELSE 0.0 END AS precision,
   CASE WHEN support > 0 THEN hits / CAST(support AS DOUBLE) ELSE 0.0 END AS recall FROM per_class),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM metrics),
scores AS (SELECT part, CAST(sum(support) AS BIGINT) AS n, sum(hits) / CAST(sum(support) AS DOUBLE) AS accuracy,
   sum(support * precision) / CAST(sum(support) AS DOUBLE) AS weighted_precision,
   sum(support * f1) / CAST(sum(support) AS DOUBLE) AS weighted_f1 FROM f GROUP BY part)
"""


def _guesses(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("part"), F.col("l_returnflag").alias("y"), F.expr(f"{GUESS} AS yhat")
    )


def _score(column):
    def build(spark, sf_dir):
        scores = predictive.prediction_scores(_guesses(spark, sf_dir), "y", "yhat", ["part"])
        return scores.select("part", "n", r6(column).alias(column))

    return build


for _column in ("weighted_f1", "accuracy", "weighted_precision"):
    query(_column, f"WITH {SCORED_SQL} SELECT part, n, round({_column}, 6) + 0.0 AS {_column} FROM scores")(_score(_column))


@query("confusion", "SELECT l_linestatus AS part, l_returnflag AS y, " + GUESS + " AS yhat, count(*) AS n FROM lineitem GROUP BY ALL")
def confusion(spark, sf_dir):
    return predictive.confusion(_guesses(spark, sf_dir), "y", "yhat", ["part"])


PAIR_SQL = f"""{SCORED_SQL},
wide AS (SELECT max(weighted_f1) FILTER (part = 'F') AS f1_syn, max(weighted_f1) FILTER (part = 'O') AS f1_real FROM scores)"""


def _pair(spark, sf_dir):
    scores = predictive.prediction_scores(_guesses(spark, sf_dir), "y", "yhat", ["part"])
    return scores.agg(
        F.max(F.when(F.col("part") == "F", F.col("weighted_f1"))).alias("f1_syn"),
        F.max(F.when(F.col("part") == "O", F.col("weighted_f1"))).alias("f1_real"),
    )


@query("retention", f"""WITH {PAIR_SQL}
SELECT round(f1_syn, 6) + 0.0 AS f1_syn, round(f1_real, 6) + 0.0 AS f1_real, round(f1_syn / f1_real * 100, 6) + 0.0 AS retention FROM wide""")
def retention(spark, sf_dir):
    return rounded(predictive.with_retention(_pair(spark, sf_dir), "f1_syn", "f1_real"), "f1_syn", "f1_real", "retention")


@query("f1_drop", f"""WITH {PAIR_SQL}
SELECT round(f1_syn, 6) + 0.0 AS f1_syn, round(f1_real, 6) + 0.0 AS f1_real, round(f1_real - f1_syn, 6) + 0.0 AS f1_drop FROM wide""")
def f1_drop(spark, sf_dir):
    return rounded(predictive.with_f1_drop(_pair(spark, sf_dir), "f1_real", "f1_syn"), "f1_syn", "f1_real", "f1_drop")


# --- fitted models (no SQL can state their result) --------------------------
FEATURES = ["CD_COR_RACA", "CD_CARGO", "SG_PARTIDO", "SG_UF", "DS_SITUACAO_CANDIDATURA"]


def _labelled(df):
    return df.withColumn("ALVO", text.contains_flag(F.col("DS_SIT_TOT_TURNO"), "ELEITO", excluding="NÃO"))


def _model_tables(spark, sf_dir):
    left, right = two_populations(spark, sf_dir, *FEATURES, "DS_SIT_TOT_TURNO")
    return _labelled(left), _labelled(right)


@query("tstr_forest")
def tstr_forest(spark, sf_dir):
    real, other = _model_tables(spark, sf_dir)
    models = {"RandomForest": predictive.forest(trees=20, depth=6)}
    return predictive.tstr(real, other, FEATURES, "ALVO", "SQ_CANDIDATO", models)


@query("tstr_boosted")
def tstr_boosted(spark, sf_dir):
    real, other = _model_tables(spark, sf_dir)
    models = {"GBT": predictive.boosted(rounds=10, depth=4)}
    return predictive.tstr_gap(predictive.tstr(real, other, FEATURES, "ALVO", "SQ_CANDIDATO", models))


@query("tstr_three_way")
def tstr_three_way(spark, sf_dir):
    from tabveil.operators.generalize import top_n_other

    real, other = _model_tables(spark, sf_dir)
    wrangled = top_n_other(real, {"SG_PARTIDO": 10})
    return predictive.tstr_three_way(real, wrangled, other, FEATURES, "ALVO", "SQ_CANDIDATO", trees=10, depth=5)


@query("tstr_grid")
def tstr_grid(spark, sf_dir):
    rows = _labelled(candidates(spark, sf_dir, "SQ_CANDIDATO", *FEATURES, "DS_SIT_TOT_TURNO"))
    marked = split_stratified(rows, "ALVO", 0.2, "SQ_CANDIDATO")
    train, test = marked.filter("NOT is_test"), marked.filter("is_test")
    scores, found = predictive.expert_scores(train, test, FEATURES, "ALVO", rounds=3, depths=(2, 4), rates=(0.05, 0.1))
    return scores.withColumns({"max_depth": F.lit(found["maxDepth"]), "step_size": F.lit(found["stepSize"])})


@query("train_wrangled")
def train_wrangled(spark, sf_dir):
    """Raw and top-15 training columns against the same raw test rows."""
    train, test = _model_tables(spark, sf_dir)
    out = None
    for name, columns in (("raw", []), ("wrangled", ["SG_PARTIDO"])):
        row = predictive.train_score(train, test, FEATURES, "ALVO", wrangle=columns, rounds=5)
        row = row.select(F.lit(name).alias("training"), *row.columns)
        out = row if out is None else out.unionByName(row)
    return out


@query("document_quality_forest")
def document_quality_forest(spark, sf_dir):
    """Forest on document features against the quality label, split 80/20."""
    from tabveil.operators.sampling import train_test

    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), "quality", "toxic")
    (coded,) = encode.encode_union([rows], ["lang", "source"])
    train, test = train_test(coded, 0.2, "doc_id")
    features = ["lang", "source", "n_chars", "toxic"]
    fitted = predictive.forest(trees=20, depth=5).fit(predictive.assemble(train, features, "quality"))
    return predictive.score_row(fitted, predictive.assemble(test, features, "quality"), model="RandomForest")
