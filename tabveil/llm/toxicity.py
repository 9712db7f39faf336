"""Toxic passages as maximal scoring segments over token log-odds.

Token scores are log-odds of toxic against clean labelled texts, with a
Dirichlet prior whose mean is the whole corpus' token distribution. A word
that the model does not know is scored by its first bytes, so inflected forms
share evidence. A token
scores its log-odds less a drift, so ordinary text runs downhill; every maximal
segment is found by one scan. Segment scores follow an extreme-value law
whose rate solves sum p e^(rate s) = 1, which turns the best score of a text of
any length into an evidence value; a logistic fit on held-back labelled rows
turns that into a probability.

Null and empty texts have no segment and get the probability of no evidence.
Labels that are null or without a document are left out; a document labelled
twice counts twice in the fit. Without labels of both kinds the score is the
share of label 1 (0.5 with no label at all). Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.llm import textbytes as tb
from tabveil.session import materialize

FIT_ROWS = 20_000   # labelled rows used, the smallest by a hash of their id
MODEL_TOKENS = 50_000  # strongest tokens kept
PRIOR = 1_000.0     # weight of the corpus distribution, in tokens
MIN_Z = 3.0
DRIFT = 0.7
MAX_SCORE = 6.0
NO_WEIGHT = (0.0,) * 5
NOTABLE = 4.0       # -ln of the chance of a segment at its place from which it adds to the sum
PREFIXES = (6, 5, 4)  # bytes of a longer word that stand in for it, longest first


@dataclass(frozen=True)
class Model:
    """Sorted token hashes with scores, the law of segment scores, and the logistic fit."""

    tokens: np.ndarray
    scores: np.ndarray
    rate: float
    weights: tuple[float, ...]

    def token_scores(self, levels: list[np.ndarray]) -> np.ndarray:
        """A score for each word: of itself, else of its longest known beginning, else the drift."""
        out = np.full(len(levels[0]), -DRIFT)
        if len(self.tokens):
            for hashes in reversed(levels):
                at = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
                out = np.where(self.tokens[at] == hashes, self.scores[at], out)
        return out


def word_levels(texts: tb.Texts) -> tuple[tb.Pieces, list[np.ndarray]]:
    """Words, and hashes of the whole words and of their beginnings; 0 where a word is too short."""
    words = tb.words(texts, tb.NO_WORD)
    sums = tb.prefix_hash(tb.LOWER[texts.data])
    levels = [words.hash]
    for k in PREFIXES:
        longer = words.end - words.start > k
        cut = tb.range_hash(sums, words.start, np.minimum(words.start + k, words.end))
        levels.append(np.where(longer, tb.mix(cut ^ np.uint64(k)), np.uint64(0)))
    return words, levels


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that never take part in the fit."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) in one left-to-right scan.

    Equal signs are merged before, so the scan works on runs. The list keeps
    candidates with the sums before their left and behind their right end, and
    the place of the nearest earlier one whose left sum is lower. A new one is
    merged with that one as long as its right sum is lower. What a link skips
    is never looked at again, so the scan is linear also where sums only fall.
    """
    if not len(scores) or scores.max() <= 0:
        return []
    positive = scores > 0
    edges = np.concatenate([[0], np.flatnonzero(positive[1:] != positive[:-1]) + 1, [len(scores)]])
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []
    for i in range(0 if positive[0] else 1, len(edges) - 1, 2):
        a, b = int(edges[i]), int(edges[i + 1])
        left, right = sums[a], sums[b]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            a, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((a, b, left, right, j))
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def evidence(model: Model, scores: np.ndarray) -> tuple[float, float, float, list[tuple[int, int, float]]]:
    """-ln of the chance of the best segment, the surplus of all significant ones, the sum of
    all segments that are unlikely at their place, and the significant segments."""
    found = maximal_segments(scores)
    if not found:
        return 0.0, 0.0, 0.0, []
    n = len(scores)
    surplus = [model.rate * s - math.log(n) for _, _, s in found]
    expected = math.exp(-max(surplus))
    best = -math.log(max(-math.expm1(-expected), 1e-300))
    strong = [(f, x) for f, x in zip(found, surplus) if x > 0]
    total = sum(model.rate * s for _, _, s in found if model.rate * s > NOTABLE)
    return best, float(sum(x for _, x in strong)), float(total), [f for f, _ in strong]


def _token_counts(df: DataFrame, with_label: bool) -> DataFrame:
    """Token counts of a table of texts, added up per slice before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column("label")).astype(np.int64) if with_label else None
            for texts in tb.slices(batch.column("body"), 2 * tb.SLICE_BYTES):
                words, levels = word_levels(texts)
                for level, hashes in enumerate(levels):
                    used = np.flatnonzero(hashes)
                    token, at, n = np.unique(hashes[used], return_inverse=True, return_counts=True)
                    columns = [pa.array(token.view(np.int64)), pa.array(np.full(len(token), level, np.int32)), pa.array(n.astype(np.int64))]
                    if with_label:
                        ones = np.bincount(at, weights=label[words.row[used] + texts.first_row], minlength=len(token))
                        columns.append(pa.array(ones.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays(columns, names=["token", "level", "n", "n_one"][:len(columns)])

    counted = df.mapInArrow(run, "token long, level int, n long" + ", n_one long" * with_label)
    return counted.groupBy("token", "level").agg(*[F.sum(c).alias(c) for c in ["n", "n_one"][:1 + with_label]])


def solve_rate(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p e^(rate s) = 1; 1 where no score is positive."""
    if not (s > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    value = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum()) - 1
    while value(high) < 0:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def regressors(best: np.ndarray, bits: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The columns of the logistic fit, the constant first."""
    return np.column_stack([np.ones(len(best)), np.log1p(best), np.log1p(bits), np.log1p(total), bits > 0, total > 0])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights of a logistic fit."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic",
        fit_rows: int = FIT_ROWS, model_tokens: int = MODEL_TOKENS) -> Model:
    """Fit on at most ``fit_rows`` labelled rows that are not held out; corpus counts cover all documents.

    Half of the rows give token scores, the other half the logistic fit.
    """
    picked = documents.select(F.col(id_column).alias("id"), F.col(text).alias("body"))
    rows = labels.select(F.col(id_column).alias("id"), F.col(label).alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id"))
    rows = rows.withColumn("place", F.xxhash64(F.col("id"), F.lit("fit"))).orderBy("place", "id", "label").limit(fit_rows)
    # At most fit_rows ids and labels: a fixed bound, so this side may be broadcast.
    local = documents.sparkSession.createDataFrame(rows.toArrow(), rows.schema)
    labelled = picked.join(F.broadcast(local), "id").withColumn("half", F.pmod("place", F.lit(2)))
    sums = {r["label"]: r["n"] for r in local.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sums) < 2:
        share = 0.5 if not sums else float(next(iter(sums)) == 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, (math.log(max(share, 1e-6) / max(1 - share, 1e-6)), *NO_WEIGHT))
    counts = _token_counts(labelled.where("half = 0").select("body", "label"), True)
    corpus = _token_counts(picked.select("body"), False).withColumnRenamed("n", "n_all")
    joined = corpus.join(counts, ["token", "level"], "left").select("n_all", "token", "level", F.coalesce("n", F.lit(0)).alias("n"),
                                                          F.coalesce("n_one", F.lit(0)).alias("n_one"))
    joined = materialize(joined, "tokens")
    t = joined.where("level = 0").agg(F.sum("n_all").alias("n_all"), F.sum("n").alias("n"), F.sum("n_one").alias("n_one")).first()
    n_one, n_zero, total = float(t["n_one"] or 0), float((t["n"] or 0) - (t["n_one"] or 0)), float(t["n_all"] or 1)
    a = F.lit(PRIOR) * F.col("n_all") / F.lit(total)
    one, zero = F.col("n_one") + a, F.col("n") - F.col("n_one") + a
    odds = F.log(one / (F.lit(n_one + PRIOR) - one)) - F.log(zero / (F.lit(n_zero + PRIOR) - zero))
    scored = joined.where("n > 0").select("token", "n_all", odds.alias("odds"), (odds / F.sqrt(1 / one + 1 / zero)).alias("z"))
    # The strongest tokens: a fixed bound, so the driver may hold them.
    top = scored.where(F.abs("z") >= MIN_Z).orderBy(F.desc(F.abs("z")), "token").limit(model_tokens).toArrow()
    tokens = np.asarray(top["token"]).astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    # Words and their beginnings both count in the law, which makes it a little more cautious.
    scores = np.clip(np.asarray(top["odds"]), -MAX_SCORE, MAX_SCORE)[order] - DRIFT
    p = np.asarray(top["n_all"]).astype(float)[order] / total
    rate = solve_rate(np.append(p, max(0.0, 1 - p.sum())), np.append(scores, -DRIFT))
    model = Model(tokens[order], scores, rate, (0.0, *NO_WEIGHT))
    features = score(labelled.where("half = 1").withColumnRenamed("body", "text"), model, "id", "text", keep=["label"])
    drawn = features.select("best", "bits", "total", "label").toArrow()  # bounded by fit_rows
    y = np.asarray(drawn["label"]).astype(float)
    if len(set(y)) < 2:
        return model
    x = regressors(*(np.asarray(drawn[c]) for c in ("best", "bits", "total")))
    return Model(model.tokens, model.scores, rate, logistic(x, y))


def score(documents: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Id, score, evidence, and the significant segments as word ranges ``start:end``."""
    keep = keep or []
    picked = documents.select(F.col(id_column).alias("id"), F.col(text).alias("body"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tb.slices(batch.column("body")):
                words, levels = word_levels(texts)
                values = model.token_scores(levels)
                edge = np.searchsorted(words.row, np.arange(len(texts) + 1))
                found = [evidence(model, values[edge[i]:edge[i + 1]]) for i in range(len(texts))]
                best, bits, total = (np.array([f[k] for f in found], float) for k in range(3))
                chance = 1 / (1 + np.exp(-np.clip(regressors(best, bits, total) @ np.array(model.weights), -30, 30)))
                spans = [",".join(f"{a}:{b}" for a, b, _ in f[3]) for f in found]
                kept = batch.slice(texts.first_row, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [kept.column("id"), *[kept.column(f"keep_{i}") for i in range(len(keep))], pa.array(chance), pa.array(best), pa.array(bits), pa.array(total),
                     pa.array(spans, pa.string())],
                    names=["id", *[f"keep_{i}" for i in range(len(keep))], "score", "best", "bits", "total", "segments"])

    kinds = ", ".join([f"id {picked.schema['id'].dataType.simpleString()}"]
                      + [f"keep_{i} {picked.schema[f'keep_{i}'].dataType.simpleString()}" for i in range(len(keep))])
    scored = picked.mapInArrow(run, f"{kinds}, score double, best double, bits double, total double, segments string")
    return scored.withColumnsRenamed({"id": id_column} | {f"keep_{i}": c for i, c in enumerate(keep)})
