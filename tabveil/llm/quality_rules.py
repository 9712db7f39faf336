"""Quality rules: a ledger of failure bits and measurements, judged by versioned policies.

Every rule is evaluated once per document. The ledger keeps what was measured
and one bit per failed rule; a policy is a named set of rules. Applying another
policy, or asking what each rule changes, reads the ledger only.

Nulls and empty texts have no words and fail ``few_words``. A null id stays null.
Repeated rows give repeated ledger rows. Extra columns of the input are ignored,
so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.llm import textbytes as tb

# The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars"]


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` is true; it sees the measures only."""

    name: str
    bit: int
    fails: str


# Bits are never reused: a rule that is changed gets a new bit.
RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", 2, "10 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", 3, "2 * n_dup_lines > n_lines AND n_lines > 4"),
    Rule("long_words", 4, "word_chars > 40 * n_words"),
    Rule("short_words", 5, "2 * word_chars < 3 * n_words"),
)

# Each version lists the rules that reject.
POLICIES: Mapping[str, Sequence[str]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "long_words", "short_words"),
}


def mask_of(policy: str | Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """The bits that reject under a policy; unknown names are refused."""
    wanted = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {rule.name: rule.bit for rule in rules}
    if unknown := [name for name in wanted if name not in bits]:
        raise ValueError(f"no such rules: {unknown}")
    return sum(1 << bits[name] for name in set(wanted))


def measure_slice(texts: tb.Texts) -> dict[str, np.ndarray]:
    """The measures of every text of a slice."""
    rows, words, lines = len(texts), tb.words(texts, lower=False), tb.lines(texts)
    n_words = words.counts(rows)
    # A code point is counted at its first byte.
    lead = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.concatenate([[0], np.cumsum(symbol[texts.data])])
    word_chars = np.bincount(words.row, weights=lead[words.end] - lead[words.start], minlength=rows)
    words_before = np.searchsorted(words.start, lines.start)
    with_word = np.searchsorted(words.start, lines.end) > words_before
    _, later = tb.repeats(lines.row[with_word], lines.hash[with_word])
    hashes, at = tb.windows(words, WINDOW)
    twice, _ = tb.repeats(words.row[at], hashes)
    in_repeat = tb.covered(at[twice], WINDOW, len(words))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": np.diff(symbols[texts.offsets]),
        "n_dup_lines": np.bincount(lines.row[with_word][later], minlength=rows),
        "n_repeat_words": np.bincount(words.row[in_repeat], minlength=rows),
        "n_lines": np.bincount(lines.row[with_word], minlength=rows), "n_chars": np.diff(lead[texts.offsets]),
    }


def measure(documents: DataFrame, keep: Sequence[str] = (), text: str = "text") -> DataFrame:
    """The columns of ``keep``, as keep_0, keep_1 and so on, and the measures of each text."""
    picked = documents.select(*[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("measured_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tb.slices(batch.column("measured_text")):
                found = measure_slice(texts)
                kept = batch.slice(texts.first_row, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(i) for i in range(len(keep))] + [pa.array(found[m].astype(np.int64)) for m in MEASURES],
                    names=[f"keep_{i}" for i in range(len(keep))] + MEASURES)

    schema = ", ".join([f"keep_{i} {picked.schema[f'keep_{i}'].dataType.simpleString()}" for i in range(len(keep))]
                       + [f"{m} long" for m in MEASURES])
    return picked.mapInArrow(run, schema)


def fail_bits(rules: Sequence[Rule] = RULES) -> Column:
    """All failures of a row of measures as one number."""
    bits = [F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long") for rule in rules]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total


def ledger(documents: DataFrame, id_column: str = "doc_id", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: id, measures and ``fail_bits``."""
    return measure(documents, [id_column]).withColumn("fail_bits", fail_bits(rules)).withColumnRenamed("keep_0", id_column)


def rejected(policy: str | Sequence[str], rules: Sequence[Rule] = RULES) -> Column:
    """True where a ledger row fails a rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy, rules)).cast("long")) != 0


def ablation(book: DataFrame, policy: str | Sequence[str] = "v1", rules: Sequence[Rule] = RULES) -> DataFrame:
    """What each rule of a policy does: rows it fails, rows it alone rejects, rows kept without it.

    One aggregation over distinct bit patterns; at most 2^rules rows leave it.
    """
    mask = mask_of(policy, rules)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    active = [rule for rule in rules if mask >> rule.bit & 1]
    sums = []
    for rule in active:
        own, others = 1 << rule.bit, mask & ~(1 << rule.bit)
        fails = F.col("bits").bitwiseAND(F.lit(own).cast("long")) != 0
        alone = fails & (F.col("bits").bitwiseAND(F.lit(others).cast("long")) == 0)
        free = F.col("bits").bitwiseAND(F.lit(others).cast("long")) == 0
        total = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (fails, alone, free)]
        sums.append(F.struct(F.lit(rule.name).alias("rule"), total[0].alias("n_failed"), total[1].alias("n_only_this"),
                             total[2].alias("n_kept_without")))
    return patterns.agg(F.array(*sums).alias("rules")).select(F.inline("rules"))


def keep_passing(documents: DataFrame, policy: str | Sequence[str] = "v1", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that a policy keeps, with their own columns only."""
    names = documents.columns
    return measure(documents, names).withColumn("fail_bits", fail_bits(rules)).where(~rejected(policy, rules)).select(
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(names)])
