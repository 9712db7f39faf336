"""Privacy-risk attacks: singling out, linkability, attribute inference.

Definitions follow Giomi et al. (PoPETs 2023); risks are Wilson score centres
with 95 % intervals. All values are compared as text, nulls as a category.
``n_attacks=None`` attacks with every row; a number draws that many, repeatably.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.functions.hashing import leading_int, row_digest
from tabveil.functions.scores import excess_risk, privacy_score, risk_band, traffic_light, wilson
from tabveil.operators.clean import all_text
from tabveil.operators.conjunctions import ColumnSet, count_conjunctions, once_satisfied, proposed
from tabveil.operators.expand import key_columns, per_set, set_counts
from tabveil.operators.neighbours import nearest, nearest_k
from tabveil.operators.ordering import order_statistics
from tabveil.operators.sampling import sample_exact
from tabveil.session import BROADCAST_ROWS, materialize, small_or_same
from tabveil.sources.commits import EpsilonStore

SINGLING_OUT, LINKABILITY, INFERENCE = "Singling Out", "Linkability", "Inference"
CANDIDATES_PER_ATTACK = 4


def with_risk(counts: DataFrame, successes: str = "successes", attacks: str = "n") -> DataFrame:
    """Add risk and interval to rows of success and attack counts; no attack, no risk."""
    centre, low, high = wilson(F.col(successes), F.col(attacks))
    known = F.col(attacks) > 0
    return counts.withColumns({
        "risk": F.when(known, centre), "ci_low": F.when(known, low), "ci_high": F.when(known, high),
    })


def with_labels(risks: DataFrame, risk: str = "risk") -> DataFrame:
    """Add the verbal band and the traffic light of a risk."""
    return risks.withColumns({"band": risk_band(F.col(risk)), "light": traffic_light(F.col(risk))})


def audit_sample(original: DataFrame, synthetic: DataFrame, row_id: str, syn_id: str, n: int | None,
                 seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Samples of the same size from both sides, as text."""
    sides = []
    for df, key in ((original, row_id), (synthetic, syn_id)):
        drawn = df if n is None else sample_exact(df, n, key, seed)
        sides.append(all_text(drawn, [c for c in df.columns if c != key]))
    return sides[0], sides[1]


def _attackers(df: DataFrame, row_id: str, n_attacks: int | None, seed: int) -> DataFrame:
    return df if n_attacks is None else sample_exact(df, n_attacks, row_id, seed)


def _attack_row(counts: DataFrame, attack: str) -> DataFrame:
    row = counts.select(F.lit(attack).alias("attack"), "n", F.coalesce("successes", F.lit(0)).alias("successes"))
    return with_risk(row)


# --- singling out ----------------------------------------------------------
def univariate_predicates(original: DataFrame, synthetic: DataFrame, columns: Sequence[str],
                          numeric: Sequence[str] = ()) -> DataFrame:
    """One row per guessed predicate: feature, operator, value, matches in the original.

    Text columns give "= v" for each value that is unique in the synthetic table;
    numeric ones give "<= min" and ">= max".
    """
    predicates = None
    if columns:
        sides = []
        for side, df in enumerate((original, synthetic)):
            long = all_text(df.select(*columns)).unpivot([], list(columns), "feature", "value")
            sides.append(long.withColumn("side", F.lit(side)))
        counts = sides[0].unionByName(sides[1]).groupBy("feature", "value").agg(
            F.count_if(F.col("side") == 0).alias("hits"), F.count_if(F.col("side") == 1).alias("n_syn")
        )
        predicates = counts.filter("n_syn = 1").select("feature", F.lit("=").alias("operator"), "value", "hits")
    if numeric:
        ends = synthetic.agg(F.struct(
            *[F.min(c).alias(f"min_{c}") for c in numeric], *[F.max(c).alias(f"max_{c}") for c in numeric]
        ).alias("ends"))
        hits = original.withColumn("ends", ends.scalar()).agg(
            F.first("ends").alias("ends"),
            *[F.count_if(F.col(c) <= F.col(f"ends.min_{c}")).alias(f"low_{c}") for c in numeric],
            *[F.count_if(F.col(c) >= F.col(f"ends.max_{c}")).alias(f"high_{c}") for c in numeric],
        )
        rows = F.array(*[
            F.struct(F.lit(c).alias("feature"), F.lit(op).alias("operator"),
                     F.col(f"ends.{end}_{c}").cast("string").alias("value"), F.col(f"{count}_{c}").alias("hits"))
            for c in numeric for op, end, count in (("<=", "min", "low"), (">=", "max", "high"))
        ])
        extremes = hits.select(F.inline(rows))
        predicates = extremes if predicates is None else predicates.unionByName(extremes)
    return predicates


def singling_out_univariate(original: DataFrame, synthetic: DataFrame, columns: Sequence[str],
                            numeric: Sequence[str] = (), n_attacks: int | None = None, seed: int = 42) -> DataFrame:
    """Share of one-column predicates that match exactly one original row."""
    predicates = univariate_predicates(original, synthetic, columns, numeric)
    if n_attacks is not None:
        predicates = sample_exact(predicates, n_attacks, ["feature", "operator", "value"], seed)
    counts = predicates.agg(F.count("*").alias("n"), F.count_if(F.col("hits") == 1).alias("successes"))
    return _attack_row(counts, SINGLING_OUT)


def column_sets(columns: Sequence[str], n_cols: int = 3) -> list[tuple[str, ...]]:
    return list(combinations(columns, min(n_cols, len(columns))))


def multivariate_predicates(original: DataFrame, synthetic: DataFrame, columns: Sequence[str],
                            sets: Sequence[Sequence[str]]) -> DataFrame:
    """Every value combination, over every column set, that is unique in the
    synthetic table: ``set_no``, its key columns, matches in the original."""
    keys = key_columns(sets)
    sides = [set_counts(all_text(df.select(*columns)), columns, sets).withColumn("side", F.lit(side))
             for side, df in enumerate((original, synthetic))]
    counts = sides[0].unionByName(sides[1]).groupBy(*keys).agg(
        F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("n_syn"),
    )
    return counts.filter("n_syn = 1").drop("n_syn")


def _matches(df: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]], wanted: DataFrame,
             name: str, small: bool = True) -> DataFrame:
    """Rows of ``df`` per wanted predicate. While ``wanted`` is small it is
    broadcast, the table is scanned in place and only counts travel."""
    keys = key_columns(sets)
    keyed = per_set(all_text(df.select(*columns)), columns, sets)
    wanted = wanted.select(*keys)
    return keyed.join(F.broadcast(wanted) if small else wanted, keys).groupBy(*keys).agg(F.count("*").alias(name))


def _drawn_predicates(original: DataFrame, synthetic: DataFrame, columns: Sequence[str],
                      sets: Sequence[Sequence[str]], syn_id: str, n_attacks: int, seed: int) -> DataFrame:
    """The first ``n_attacks`` unique predicates in digest order, where each
    synthetic row proposes one randomly drawn column set.

    A batch of candidates, small enough to broadcast, is tried first. Where it
    holds too few unique ones, unique combinations are rare, and all of them are
    counted instead: then most rows collapse before the shuffle.
    """
    keys = key_columns(sets)
    number = F.pmod(leading_int(row_digest([syn_id], f"{seed}-set")), F.lit(len(sets))).cast("int")
    drawn = row_digest([syn_id], f"{seed}-draw").alias("drawn")
    texts = all_text(synthetic, columns).select(syn_id, *[c for c in columns if c != syn_id])

    def proposals(df: DataFrame) -> DataFrame:
        return per_set(df.select("*", drawn), columns, sets, keep=["drawn"], number=number)

    batch = CANDIDATES_PER_ATTACK * n_attacks
    chosen, small = None, batch <= BROADCAST_ROWS
    if small:
        tried, _ = small_or_same(proposals(sample_exact(texts, batch, syn_id, f"{seed}-draw")))
        unique = _matches(synthetic, columns, sets, tried.select(*keys).distinct(), "n_syn").filter("n_syn = 1")
        # Unique in the table, so proposed by one row at most.
        chosen, _ = small_or_same(tried.join(F.broadcast(unique), keys).drop("n_syn").orderBy("drawn").limit(n_attacks))
        if chosen.count() < n_attacks:
            chosen = None
    if chosen is None:
        unique = set_counts(texts.select(*columns), columns, sets).filter("n = 1").drop("n")
        chosen, small = small_or_same(proposals(texts).join(unique, keys).orderBy("drawn").limit(n_attacks))
    hits = _matches(original, columns, sets, chosen, "hits", small)
    return chosen.drop("drawn").join(hits, keys, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def singling_out_multivariate(original: DataFrame, synthetic: DataFrame, columns: Sequence[str], n_cols: int = 3,
                              sets: Sequence[Sequence[str]] | None = None, n_attacks: int | None = None,
                              syn_id: str | None = None, seed: int = 42) -> DataFrame:
    """Share of several-column predicates that match exactly one original row."""
    sets = list(sets or column_sets(columns, n_cols))
    if n_attacks is None:
        predicates = multivariate_predicates(original, synthetic, columns, sets)
    else:
        if syn_id is None:
            raise ValueError("drawn attacks need the id of the synthetic rows")
        predicates = _drawn_predicates(original, synthetic, columns, sets, syn_id, n_attacks, seed)
    counts = predicates.agg(F.count("*").alias("n"), F.count_if(F.col("hits") == 1).alias("successes"))
    return _attack_row(counts, SINGLING_OUT)


def conjunction_predicates(original: DataFrame, synthetic: DataFrame, sets: Sequence[ColumnSet],
                           n_attacks: int | None = None, seed: int = 42) -> DataFrame:
    """Predicates of equalities and ranges that a single synthetic row satisfies:
    set_no, g (texts and directions), vs (signed bounds), hits in the original.

    Each synthetic row proposes one per column set; ``n_attacks`` takes that many
    of the unique ones, by digest.
    """
    numeric = list(dict.fromkeys(c for s in sets for c in s.numeric))
    used = list(dict.fromkeys(c for s in sets for c in (*s.text, *s.numeric)))
    original, synthetic = (materialize(df.select(*used), "sides") for df in (original, synthetic))
    medians = {c: synthetic.transform(lambda df, c=c: order_statistics(df, c, [0.5])).first()["cuts"][0] for c in numeric}
    medians = {c: float(m) if m is not None else 0.0 for c, m in medians.items()}
    distinct = proposed(synthetic, sets, medians).distinct()
    wanted = materialize(distinct.withColumn("pid", F.monotonically_increasing_id()), "predicates")
    unique = materialize(wanted.join(once_satisfied(synthetic, wanted, sets), "pid", "left_semi"), "unique")
    if n_attacks is not None:
        unique = unique.withColumn("name", F.to_json(F.struct("set_no", "g", "vs")))
        unique = materialize(sample_exact(unique, n_attacks, "name", seed).drop("name"), "drawn")
    return unique.join(count_conjunctions(original, unique, sets), "pid").drop("pid")


def singling_out_conjunctions(original: DataFrame, synthetic: DataFrame, sets: Sequence[ColumnSet],
                              n_attacks: int | None = None, seed: int = 42) -> DataFrame:
    """Share of conjunctions, unique in the synthetic table, that match exactly one original row."""
    predicates = conjunction_predicates(original, synthetic, sets, n_attacks, seed)
    counts = predicates.agg(F.count("*").alias("n"), F.count_if(F.col("hits") == 1).alias("successes"))
    return _attack_row(counts, SINGLING_OUT)


def attribute_ladder(original: DataFrame, population: DataFrame, rungs: Mapping[str, Sequence[str]],
                     n_cols: int = 3) -> DataFrame:
    """Singling-out risk and privacy score per set of quasi-identifiers, most
    vulnerable first. All rungs are counted in one pass over the data."""
    columns = list(dict.fromkeys(c for cs in rungs.values() for c in cs))
    per_rung = {name: column_sets(cs, n_cols) for name, cs in rungs.items()}
    sets = list(dict.fromkeys(s for ss in per_rung.values() for s in ss))
    predicates = multivariate_predicates(original, population, columns, sets)
    per_set = predicates.groupBy("set_no").agg(
        F.count("*").alias("n"), F.count_if(F.col("hits") == 1).alias("successes")
    )
    plan = [(name, len(rungs[name]), sets.index(s)) for name, ss in per_rung.items() for s in ss]
    table = original.sparkSession.createDataFrame(plan, "rung string, n_columns int, set_no int")
    counts = table.join(per_set, "set_no", "left").groupBy("rung", "n_columns").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("successes"), F.lit(0)).alias("successes")
    )
    scored = with_risk(counts).withColumn("privacy_score", privacy_score(F.col("risk")))
    return scored.orderBy("privacy_score", "rung")


# --- linkability -----------------------------------------------------------
def linkability(original: DataFrame, synthetic: DataFrame, aux_a: Sequence[str], aux_b: Sequence[str], row_id: str,
                syn_id: str, n_attacks: int | None = None, k: int = 1, seed: int = 42) -> DataFrame:
    """Share of original rows whose two attribute halves lead to the same synthetic row."""
    aux_a, aux_b = list(aux_a), list(aux_b)
    if not aux_a or not aux_b or set(aux_a) & set(aux_b):
        raise ValueError("linkability needs two disjoint column sets")
    both = [*aux_a, *aux_b]
    attackers = all_text(_attackers(original, row_id, n_attacks, seed).select(*both))
    combos = attackers.groupBy(*both).agg(F.count("*").alias("rows"))
    syn = all_text(synthetic.select(syn_id, *both), both)
    met = combos
    for side, columns in (("a", aux_a), ("b", aux_b)):
        if k == 1:
            found = nearest(attackers, syn, columns, syn_id).select(*columns, F.array("neighbour").alias(f"ids_{side}"))
        else:
            # k ids per combination.
            found = nearest_k(attackers, syn, columns, syn_id, k).groupBy(*columns).agg(
                F.collect_list("neighbour").alias(f"ids_{side}")
            )
        met = met.join(found, columns, "left")
    linked = F.coalesce(F.arrays_overlap("ids_a", "ids_b"), F.lit(False))
    counts = met.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.sum(F.when(linked, F.col("rows")).otherwise(0)).alias("successes")
    )
    return _attack_row(counts, LINKABILITY)


# --- attribute inference ---------------------------------------------------
def inference_by_secret(original: DataFrame, synthetic: DataFrame, aux: Sequence[str], secrets: Sequence[str],
                        row_id: str, syn_id: str, n_attacks: int | None = None, seed: int = 42) -> DataFrame:
    """Risk per secret of guessing it from the nearest synthetic row.

    The neighbour depends on the known attributes only, so one search serves all
    secrets. The rows are counted per combination before they meet their guess.
    """
    aux, secrets = list(aux), list(secrets)
    attackers = all_text(_attackers(original, row_id, n_attacks, seed).select(*aux, *secrets))
    combos = attackers.groupBy(*aux, *secrets).agg(F.count("*").alias("rows"))
    syn = all_text(synthetic.select(syn_id, *aux, *secrets), [*aux, *secrets])
    found = nearest(attackers.select(*aux), syn, aux, syn_id, secrets)
    guesses = found.select(*aux, *[F.col(c).alias(f"__g_{c}") for c in secrets])
    met = combos.join(guesses, aux, "left")
    totals = met.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n"),
        *[F.sum(F.when(F.col(c) == F.col(f"__g_{c}"), F.col("rows")).otherwise(0)).alias(c) for c in secrets],
    )
    long = totals.unpivot(["n"], secrets, "secret", "successes")
    return with_risk(long.select("secret", "n", F.coalesce("successes", F.lit(0)).alias("successes")))


def inference(original: DataFrame, synthetic: DataFrame, aux: Sequence[str], secret: str, row_id: str, syn_id: str,
              n_attacks: int | None = None, seed: int = 42) -> DataFrame:
    """Share of original rows whose secret equals that of the nearest synthetic row."""
    rows = inference_by_secret(original, synthetic, aux, [secret], row_id, syn_id, n_attacks, seed)
    return _attack_row(rows.drop("secret"), INFERENCE)


def multi_secret_summary(risks: DataFrame) -> DataFrame:
    """Mean and worst risk over the secrets with their bands."""
    total = risks.agg(F.count("*").alias("secrets"), F.avg("risk").alias("mean_risk"), F.max("risk").alias("worst_risk"))
    return total.withColumns({"mean_band": risk_band(F.col("mean_risk")), "worst_band": risk_band(F.col("worst_risk"))})


# --- combined --------------------------------------------------------------
def with_control(attack: DataFrame, control: DataFrame, on: Sequence[str] = ("attack",)) -> DataFrame:
    """Add the risk of the same attack on hold-out rows and the excess over it."""
    # One row per attack.
    base = F.broadcast(control.select(*on, F.col("risk").alias("control_risk")))
    return attack.join(base, list(on), "left").withColumn(
        "excess", excess_risk(F.col("risk"), F.coalesce("control_risk", F.lit(0.0)))
    )


def three_axis_audit(original: DataFrame, synthetic: DataFrame, columns: Sequence[str], aux: Sequence[str],
                     aux_a: Sequence[str], aux_b: Sequence[str], secret: str, row_id: str, syn_id: str,
                     n_attacks: int | None = None, seed: int = 42) -> DataFrame:
    """One row per attack: counts, risk, interval and labels."""
    attacks = [
        singling_out_multivariate(original, synthetic, columns, n_attacks=n_attacks, syn_id=syn_id, seed=seed),
        linkability(original, synthetic, aux_a, aux_b, row_id, syn_id, n_attacks, seed=seed),
        inference(original, synthetic, aux, secret, row_id, syn_id, n_attacks, seed),
    ]
    return with_labels(reduce(DataFrame.unionByName, attacks))


def audit_row(risks: DataFrame) -> DataFrame:
    """The three risks side by side and the privacy score."""

    def of(name: str):
        return F.max(F.when(F.col("attack") == name, F.col("risk")))

    wide = risks.agg(
        of(SINGLING_OUT).alias("singling_out_risk"), of(LINKABILITY).alias("linkability_risk"),
        of(INFERENCE).alias("inference_risk"),
    )
    score = privacy_score(F.col("singling_out_risk"), F.col("linkability_risk"), F.col("inference_risk"))
    return wide.withColumn("privacy_score", score)


# --- a family of copies ----------------------------------------------------
def _stacked(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def family_audit(original: DataFrame, copies: DataFrame, epsilons: Sequence[float], columns: Sequence[str], aux: Sequence[str],
                 aux_a: Sequence[str], aux_b: Sequence[str], secret: str, syn_id: str, n_cols: int = 3) -> DataFrame:
    """The three attacks on all copies of a table at once: epsilon, attack, n,
    successes, risk, interval, labels and ``status``.

    ``copies`` has the column ``epsilon``. The original is read and counted once;
    ε is part of every key, so all copies share each join. Every wanted ε has its
    rows: one without a copy has the status ``missing`` and no counts.
    """
    aux, aux_a, aux_b = list(aux), list(aux_a), list(aux_b)
    used = list(dict.fromkeys([*columns, *aux, *aux_a, *aux_b, secret]))
    spark = original.sparkSession
    wanted = spark.createDataFrame([(float(e),) for e in epsilons], "epsilon double")  # one row per copy
    people = materialize(all_text(original.select(*used)).groupBy(*used).agg(F.count("*").alias("rows")), "people")
    syn = all_text(copies.select("epsilon", syn_id, *used), used).join(F.broadcast(wanted), "epsilon", "left_semi")
    there = F.broadcast(materialize(syn.select("epsilon").distinct(), "copies"))  # one row per copy

    def each(combos: DataFrame) -> DataFrame:
        return combos.withColumn("epsilon", F.explode(_constant_doubles(epsilons))).join(there, "epsilon", "left_semi")

    # Singling out: unique combinations per ε, against counts of the original.
    sets = column_sets(columns, n_cols)
    keys = key_columns(sets)
    unique = per_set(syn, columns, sets, keep=["epsilon"]).groupBy("epsilon", *keys).agg(F.count("*").alias("n_syn")).filter("n_syn = 1")
    hits = per_set(people, columns, sets, keep=["rows"]).groupBy(*keys).agg(F.sum("rows").alias("hits"))
    singled = unique.join(hits, keys, "left").groupBy("epsilon").agg(F.count("*").alias("n"), F.count_if(F.col("hits") == 1).alias("successes"))
    # Linkability and inference: nearest rows within the same ε.
    total = F.sum("rows").alias("n")
    linked = each(people.groupBy(*aux_a, *aux_b).agg(F.sum("rows").alias("rows")))
    for side, part in (("a", aux_a), ("b", aux_b)):
        near = nearest(each(people.select(*part).distinct()), syn, part, syn_id, by=["epsilon"])
        linked = linked.join(near.select("epsilon", *part, F.col("neighbour").alias(f"id_{side}")), ["epsilon", *part], "left")
    same = F.coalesce(F.col("id_a") == F.col("id_b"), F.lit(False))
    linked = linked.groupBy("epsilon").agg(total, F.sum(F.when(same, F.col("rows")).otherwise(0)).alias("successes"))
    guess = nearest(each(people.select(*aux).distinct()), syn, aux, syn_id, [secret], by=["epsilon"])
    guessed = each(people.groupBy(*aux, secret).agg(F.sum("rows").alias("rows"))).join(
        guess.select("epsilon", *aux, F.col(secret).alias("__guess")), ["epsilon", *aux], "left")
    right = F.coalesce(F.col(secret) == F.col("__guess"), F.lit(False))
    guessed = guessed.groupBy("epsilon").agg(total, F.sum(F.when(right, F.col("rows")).otherwise(0)).alias("successes"))
    parts = [(SINGLING_OUT, singled), (LINKABILITY, linked), (INFERENCE, guessed)]
    counts = _stacked([part.select("epsilon", F.lit(name).alias("attack"), "n", "successes") for name, part in parts])
    rows = spark.createDataFrame([(float(e), name) for e in epsilons for name, _ in parts], "epsilon double, attack string")
    joined = rows.join(there.withColumn("there", F.lit(True)), "epsilon", "left").join(counts, ["epsilon", "attack"], "left")
    # A copy whose combinations are never unique proposes no attack.
    known = F.col("there").isNotNull()
    filled = joined.select("epsilon", "attack", F.when(known, F.coalesce("n", F.lit(0))).alias("n"),
                           F.when(known, F.coalesce("successes", F.lit(0))).alias("successes"),
                           F.when(known, "ok").otherwise("missing").alias("status"))
    return with_labels(with_risk(filled))


def _constant_doubles(values: Sequence[float]):
    return F.array(*[F.lit(float(v)) for v in values])


def audit_store(original: DataFrame, store: EpsilonStore, epsilons: Sequence[float], columns: Sequence[str], aux: Sequence[str],
                aux_a: Sequence[str], aux_b: Sequence[str], secret: str, syn_id: str = "row_id", n_cols: int = 3) -> DataFrame:
    """``family_audit`` of the stored copies. Damaged ones are not read; their rows say so."""
    damaged = [float(k) for k in store.damaged()]
    copies = store.copies()
    if copies is None:
        used = list(dict.fromkeys([*columns, *aux, *aux_a, *aux_b, secret]))
        copies = original.select(*used).limit(0).withColumns({syn_id: F.lit(0), "epsilon": F.lit(0.0)})
    audit = family_audit(original, copies, epsilons, columns, aux, aux_a, aux_b, secret, syn_id, n_cols)
    return audit.withColumn("status", F.when(F.col("epsilon").isin(damaged), "damaged").otherwise(F.col("status"))) if damaged else audit
