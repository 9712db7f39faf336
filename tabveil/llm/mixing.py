"""Mixing sources to target weights: tempered token shares, realised as block permutations.

A source with token share p gets the weight p^a, normalised. The exponent a is
bisected so that the mixture has a wanted entropy. A limit on repetition leaves
an interval of exponents around 1, the sources' own shares; where the wanted
entropy lies beyond it, the nearer end is taken. No exponent goes below the
entropy of equal weights on the largest sources. What was reached and what
stood in the way is part of the result. The weights times the token budget say
how often a source is gone through: whole passes over all of its blocks, and a
last pass over the first blocks of a permutation, up to the budget.

Null sources are a source of their own. Documents without tokens, and sources
that have only such, get no place in the mixture; a single source is its own
mixture. Rows with equal ids lie in the same block, rows without an id in one
too; each row counts. Sources with equal shares get equal weights. Very long
texts count whole and are never split. Empty tables give an empty mixture.
Extra columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabveil.session import materialize

BLOCKS = 1024
POINTS = 15  # per pass over the sources: as good as four bisections
STEPS = 10
TOP = 2.0 ** 40  # of doublings; shares that differ by one token in 10^12 still part


def word_tokens(text: str = "text") -> Column:
    """Words between white space, null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: str = "source") -> Column:
    """A key that is never null and differs for null and any text."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def block_of(id_column: str, seed: int, blocks: int = BLOCKS) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_column)), F.lit(blocks)).cast("int")


@dataclass(frozen=True)
class Mixture:
    """The exponent found, and what it gives."""

    exponent: float
    entropy: float
    max_epochs: float
    total_tokens: int
    wanted: float | None  # the target, in nats
    outcome: str  # met, repetition or ties


def evaluate(sources: DataFrame, exponents: list[float], budget_ratio: float, top: float) -> list[tuple[float, float]]:
    """(entropy, largest number of epochs) for each exponent, in one pass over (source, share).

    Powers are taken relative to ``top``, the largest share, so that not all vanish.
    """
    p, rel = F.col("share"), F.log(F.col("share") / F.lit(top))
    sums = []
    for i, a in enumerate(exponents):
        power = F.exp(F.lit(a) * rel)
        sums += [F.sum(power).alias(f"z{i}"), F.sum(power * rel).alias(f"l{i}"), F.max(power / p).alias(f"m{i}")]
    row = sources.agg(*sums).first()
    return [(math.log(row[f"z{i}"]) - a * row[f"l{i}"] / row[f"z{i}"], budget_ratio * row[f"m{i}"] / row[f"z{i}"])
            for i, a in enumerate(exponents)]


def border(holds, low: float, high: float, steps: int = STEPS) -> float:
    """The least place up to ``high`` from which on a condition holds, where it holds at ``high``
    but not at ``low``; ``holds`` answers for several places at a time."""
    for _ in range(steps):
        inner = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
        good = holds(inner)
        at = good.index(True) if True in good else POINTS
        low, high = (inner[at - 1] if at else low), (inner[at] if at < POINTS else high)
    return high


def find_exponent(sources: DataFrame, budget_ratio: float, entropy: float | None, max_epochs: float | None) -> tuple[float, float | None, str]:
    """(exponent, target in nats, outcome) for an entropy of ``entropy`` x ln(sources).

    Entropy falls as the exponent grows, towards that of equal weights on the
    sources with the largest share, so the bracket is doubled until it holds the
    target. Repetition is least at exponent 1 and grows to both sides; a limit
    below the budget's own ratio cannot be met by any mixture and is refused.
    Without a target the mixture is as flat as the limit allows.
    """
    if max_epochs is not None and max_epochs < budget_ratio * (1 - 1e-9):
        raise ValueError(f"a budget of {budget_ratio:g} times all tokens repeats more than {max_epochs:g} times")
    facts = sources.agg(F.count(F.lit(1)).alias("n"), F.max("share").alias("top")).first()
    # Shares are quotients of whole numbers by one total, so ties are exact.
    tied = sources.where(F.col("share") == F.lit(facts["top"])).count()
    wanted = None if entropy is None else entropy * math.log(facts["n"])
    within = lambda epochs: max_epochs is None or epochs <= max_epochs * (1 + 1e-12)
    look = lambda places: evaluate(sources, places, budget_ratio, facts["top"])

    flat, most = look([0.0])[0]
    least = 0.0 if within(most) else border(lambda places: [within(e) for _, e in look(places)], 0.0, 1.0)
    if wanted is None or wanted >= flat - 1e-12:
        outcome = "met" if wanted is None or (not least and wanted <= flat + 1e-9) else "repetition" if least else "ties"
        return least, wanted, outcome
    if wanted <= math.log(tied) + 1e-12:
        # Nothing sharper is worth its repetitions: the sources' own shares stay.
        return max(least, 1.0), wanted, "ties"
    below = lambda h, _: h <= wanted + 1e-12
    top = 1.0
    while top < TOP and not below(*look([top])[0]):
        top *= 2
    place = border(lambda places: [below(*f) for f in look(places)], 0.0 if top == 1.0 else top / 2, top)
    if place < least:
        return least, wanted, "repetition"
    if place > 1.0 and not within(look([place])[0][1]):
        last = border(lambda places: [not within(e) for _, e in look(places)], 1.0, place)
        return max(1.0, last * (1 - 1e-9)), wanted, "repetition"
    return place, wanted, "met"


def mix(documents: DataFrame, budget_ratio: float = 1.0, entropy: float | None = 0.95, max_epochs: float | None = 4.0,
        id_column: str = "doc_id", source: str = "source", text: str = "text", seed: int = 1, blocks: int = BLOCKS) -> tuple[DataFrame, Mixture]:
    """The mixture as rows (id, source, n_tokens, epoch, block, slot), and its figures.

    ``slot`` orders the blocks of a source's epoch; reading by (epoch, slot) gives
    a block permutation for each pass. ``budget_ratio`` is the budget as a multiple
    of all tokens. A source is cut at a block border, so it is off its budget by at
    most half a block. Blocks per source are fixed in number, whatever its size:
    a source with a third of all rows is summed and joined in ``blocks`` parts.
    """
    slim = documents.select(F.col(id_column).alias("id"), F.col(source).alias("origin"), source_key(source).alias("key"),
                            word_tokens(text).alias("n_tokens"), block_of(id_column, seed, blocks).alias("block"))
    slim = slim.where("n_tokens > 0")
    totals = materialize(slim.groupBy("key", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    per_source = totals.groupBy("key").agg(F.sum("tokens").alias("tokens"))
    all_rows = per_source.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    total, n = all_rows["t"] or 0, all_rows["n"]
    shares = per_source.select("key", (F.col("tokens") / F.lit(float(total or 1))).alias("share"))
    if n:
        shares = materialize(shares, "shares")
        a, wanted, outcome = find_exponent(shares, budget_ratio, entropy, max_epochs)
        top = shares.agg(F.max("share")).first()[0]
        h, epochs = evaluate(shares, [a], budget_ratio, top)[0]
        power = F.exp(F.lit(a) * F.log(F.col("share") / F.lit(top)))
        z = shares.agg(F.sum(power)).first()[0]
    else:
        a, h, epochs, z, wanted, outcome, power = 1.0, 0.0, 0.0, 1.0, None, "met", F.col("share")
    weighted = per_source.withColumn("share", F.col("tokens") / F.lit(float(total or 1))).select(
        "key", F.col("tokens").alias("source_tokens"),
        (power / F.lit(z) * F.lit(budget_ratio * total)).alias("source_budget"))
    planned = totals.join(weighted, "key").withColumn("whole", F.floor(F.col("source_budget") / F.col("source_tokens")))
    last = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "block", "whole"), "block")
    planned = planned.withColumn("upto", F.sum("tokens").over(last.rowsBetween(Window.unboundedPreceding, 0)))
    rest = F.col("source_budget") - F.col("whole") * F.col("source_tokens")
    planned = planned.withColumn("copies", (F.col("whole") + F.when(F.col("upto") - F.col("tokens") / 2 <= rest, 1).otherwise(0)).cast("int"))
    planned = planned.where("copies > 0").select("key", "block", "copies")
    placed = slim.join(planned, ["key", "block"]).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    placed = placed.withColumn("slot", F.xxhash64(F.lit(seed), "key", "block", F.col("epoch").cast("long")))
    rows = placed.select(F.col("id").alias(id_column), F.col("origin").alias(source), "n_tokens", "epoch", "block", "slot")
    return rows, Mixture(a, h, epochs, total, wanted, outcome)
