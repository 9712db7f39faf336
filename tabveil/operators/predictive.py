"""Prediction scores from counts, and train-on-synthetic/test-on-real runs."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.functions import text
from tabveil.functions.scores import retention
from tabveil.operators.encode import encode_by_first, encode_union
from tabveil.operators.features import weighted_rows
from tabveil.operators.generalize import top_15_other
from tabveil.operators.sampling import train_test
from tabveil.session import materialize

MAX_BINS = 256
ROWS = "__rows"  # how many rows a counted row stands for
ROWS_PER_TASK = 500_000


# --- scores ----------------------------------------------------------------
def confusion(df: DataFrame, label: str, prediction: str, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Rows per (label, prediction); ``count`` names the column that says how many rows a counted row stands for."""
    rows = F.sum(count) if count else F.count("*")
    return df.groupBy(*by, F.col(label).alias("y"), F.col(prediction).alias("yhat")).agg(rows.alias("n"))


def class_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support, precision, recall and F1 per class from confusion counts."""
    roles = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).cast("long").alias("hits")),
        F.struct(F.col("yhat").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hits")),
    )
    sides = counts.select(*by, F.inline(roles))
    classes = sides.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    hits = F.col("hits")
    return classes.withColumns({
        "precision": F.when(F.col("predicted") > 0, hits / F.col("predicted")).otherwise(0.0),
        "recall": F.when(F.col("support") > 0, hits / F.col("support")).otherwise(0.0),
        "f1": F.when(hits > 0, 2 * hits / (F.col("support") + F.col("predicted"))).otherwise(0.0),
    })


def prediction_scores(df: DataFrame, label: str, prediction: str, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Accuracy and support-weighted precision and F1."""
    classes = class_scores(confusion(df, label, prediction, by, count), by)
    support = F.col("support")

    def weighted(c: str):
        return F.sum(support * F.col(c)) / F.sum(support)

    return classes.groupBy(*by).agg(
        F.sum("support").alias("n"), (F.sum("hits") / F.sum("support")).alias("accuracy"),
        weighted("precision").alias("weighted_precision"), weighted("f1").alias("weighted_f1"),
    )


def with_retention(df: DataFrame, score: str, reference: str) -> DataFrame:
    """Score as a percentage of the reference score."""
    return df.withColumn("retention", retention(F.col(score), F.col(reference)))


def with_f1_drop(df: DataFrame, generalised: str, synthetic: str) -> DataFrame:
    """F1 lost between the generalised and the synthetic training table."""
    return df.withColumn("f1_drop", F.col(generalised) - F.col(synthetic))


# --- models ----------------------------------------------------------------
def as_numbers(df: DataFrame, features: Sequence[str], label: str, extra: Sequence[str] = ()) -> DataFrame:
    """Features and label as numbers without nulls."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in features], *extra, F.col(label).cast("double").alias("label")).fillna(0.0)


def assemble(df: DataFrame, features: Sequence[str], label: str, extra: Sequence[str] = ()) -> DataFrame:
    """Feature vector and numeric label, written down once: tree fits pass over
    their input several times and would otherwise repeat the joins behind it.

    Files of codes are much smaller than the rows a fit holds, so many rows are dealt out anew.
    """
    vectors = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    written = materialize(vectors.transform(as_numbers(df, features, label, extra)).select("features", "label", *extra), "features")
    parts = math.ceil(written.count() / ROWS_PER_TASK)
    return written.repartition(parts) if parts > written.rdd.getNumPartitions() else written


def counted(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows that agree in the features, as text, and the label once, with their number in ROWS; written down.

    Boosted trees draw no rows, so they weigh a counted row like the rows it stands
    for. That is not so for forests, which draw every row for itself.
    """
    texts = [text.as_text(F.col(c)).alias(c) for c in features]
    return materialize(df.groupBy(*texts, F.col(label).alias(label)).agg(F.count("*").alias(ROWS)), "counted")


def forest(trees: int = 100, depth: int = 10, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=MAX_BINS)


def boosted(rounds: int = 100, depth: int = 6, rate: float = 0.3, seed: int = 42, classes: int = 2,
            weight: str | None = None):
    """Gradient-boosted trees; more than two classes go one against the rest."""
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, maxBins=MAX_BINS)
    if weight:
        model = model.setWeightCol(weight)
    if classes <= 2:
        return model
    return OneVsRest(classifier=model, weightCol=weight) if weight else OneVsRest(classifier=model)


def score_model(model, test: DataFrame, count: str | None = None) -> DataFrame:
    """One row of scores of a fitted model on a test table."""
    return prediction_scores(model.transform(test), "label", "prediction", count=count)


def score_row(fitted, test: DataFrame, /, **names) -> DataFrame:
    """The same with constant columns in front."""
    scores = score_model(fitted, test)
    return scores.select(*[F.lit(v).alias(k) for k, v in names.items()], *scores.columns)


def grid_search(train: DataFrame, rounds: int = 300, depths: Sequence[int] = (4, 6, 8),
                rates: Sequence[float] = (0.05, 0.1), folds: int = 3, seed: int = 42, parallelism: int = 4,
                weight: str | None = None, fold: str = "", count: str | None = None):
    """Cross-validated depth and rate of boosted trees; returns (model, parameters).

    Counted rows bring the ``fold`` of each and its ``count``.
    """
    model = boosted(rounds, seed=seed, weight=weight)
    grid = ParamGridBuilder().addGrid(model.maxDepth, list(depths)).addGrid(model.stepSize, list(rates)).build()
    search = CrossValidator(
        estimator=model, estimatorParamMaps=grid, numFolds=folds, seed=seed, parallelism=parallelism, foldCol=fold,
        evaluator=MulticlassClassificationEvaluator(metricName="f1", weightCol=count),
    ).fit(train)
    best = max(range(len(grid)), key=lambda i: search.avgMetrics[i])
    return search.bestModel, {p.name: v for p, v in grid[best].items()}


# --- train on synthetic, test on real --------------------------------------
def tstr(real: DataFrame, synthetic: DataFrame, features: Sequence[str], label: str, row_id: str,
         models: Mapping[str, object], test_fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """Each model fitted on real and on synthetic rows, scored on held-out real rows."""
    columns = [*features, label]
    keep = real.select(row_id, *columns)
    real_codes, syn_codes = encode_by_first(keep, [synthetic.select(*columns)], columns)
    train, test = train_test(real_codes, test_fraction, row_id, seed)
    test = assemble(test, features, label)
    sides = {"real": assemble(train, features, label), "synthetic": assemble(syn_codes, features, label)}
    rows = None
    for name, model in models.items():
        for side, table in sides.items():
            row = score_row(model.fit(table), test, model=name, trained_on=side)
            rows = row if rows is None else rows.unionByName(row)
    return rows


def tstr_gap(scores: DataFrame) -> DataFrame:
    """F1 of both sides and the accuracy lost, one row per model."""

    def of(side: str, c: str):
        return F.max(F.when(F.col("trained_on") == side, F.col(c)))

    return scores.groupBy("model").agg(
        of("real", "weighted_f1").alias("f1_real"), of("synthetic", "weighted_f1").alias("f1_syn"),
        (of("real", "accuracy") - of("synthetic", "accuracy")).alias("acc_delta"),
    )


def tstr_three_way(real: DataFrame, wrangled: DataFrame, synthetic: DataFrame, features: Sequence[str], label: str,
                   row_id: str, test_fraction: float = 0.2, seed: int = 42, trees: int = 100,
                   depth: int = 10) -> DataFrame:
    """Forest trained on real, generalised and synthetic rows, all scored on the
    same held-out real rows with one dictionary over all three."""
    columns = [*features, label]
    tables = [real.select(row_id, *columns), wrangled.select(*columns), synthetic.select(*columns)]
    real_codes, wrangled_codes, syn_codes = encode_union(tables, columns)
    train, test = train_test(real_codes, test_fraction, row_id, seed)
    test = assemble(test, features, label)
    rows = None
    for name, table in (("Real", train), ("Wrangled", wrangled_codes), ("Synthetic", syn_codes)):
        fitted = forest(trees, depth, seed).fit(assemble(table, features, label))
        row = score_row(fitted, test, trained_on=name)
        rows = row if rows is None else rows.unionByName(row)
    return rows


def forest_score(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 10,
                 seed: int = 42) -> DataFrame:
    """Scores of a forest on test rows, with one dictionary over both tables."""
    columns = [*features, label]
    codes, test_codes = encode_union([train.select(*columns), test.select(*columns)], columns)
    return score_model(forest(trees, depth, seed).fit(assemble(codes, features, label)), assemble(test_codes, features, label))


def train_score(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                wrangle: Sequence[str] = (), wrangle_test: bool = False, rounds: int = 100,
                seed: int = 42) -> DataFrame:
    """Boosted trees on one training table, optionally with top-15 grouping of
    some of its columns; the test table keeps its raw values unless asked."""
    if wrangle:
        train = top_15_other(train, list(wrangle))
        test = top_15_other(test, list(wrangle)) if wrangle_test else test
    train, test = encode_union([counted(t, features, label) for t in (train, test)], list(features))
    model = boosted(rounds, seed=seed, weight=ROWS).fit(assemble(train, features, label, [ROWS]))
    return score_model(model, assemble(test, features, label, [ROWS]), ROWS)


def expert_scores(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                  parameters: Mapping[str, float] | None = None, rounds: int = 300, seed: int = 42,
                  depths: Sequence[int] = (4, 6, 8), rates: Sequence[float] = (0.05, 0.1), folds: int = 3):
    """Class-weighted boosted trees: searched parameters at first, given ones later.

    Every row draws its own fold; then equal rows of a fold are counted, and weigh
    as much as all of them. Returns the score row and the parameters to use for the next training table.
    """
    train, test = encode_union([train.select(*features, label), counted(test, features, label)], list(features))
    # Written before the draw, so that a repeated task draws the same folds.
    rows = materialize(as_numbers(weighted_rows(train, label), features, label, ["weight"]), "rows")
    rows = rows.withColumn("fold", F.floor(F.rand(seed) * folds).cast("int"))
    rows = rows.groupBy(*features, "label", "weight", "fold").agg(F.count("*").alias(ROWS))
    train = assemble(rows.withColumn("weight", F.col("weight") * F.col(ROWS)), features, "label", ["weight", "fold", ROWS])
    test = assemble(test, features, label, [ROWS])
    if parameters is None:
        model, parameters = grid_search(train, rounds, depths, rates, folds, seed, weight="weight", fold="fold", count=ROWS)
    else:
        model = boosted(rounds, int(parameters["maxDepth"]), float(parameters["stepSize"]), seed,
                        weight="weight").fit(train)
    return score_model(model, test, ROWS), dict(parameters)
