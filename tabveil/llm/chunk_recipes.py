"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text is normalised (every run of ASCII white space becomes one space) and cut
into chunks where its own content says so: a chunk is at least 256 characters
long and ends at the next word that ends in one of a few letters, at 2,048
characters at the latest. Equal stretches of different texts therefore fall into
equal chunks again soon after they start.

The distinct chunks of all texts are collected once, combined map-side, and give
every chunk its identifier. An identifier is used only after the dictionary has
shown that no two chunks share it; otherwise the next, wider one is taken, and
the last one is the chunk itself, so a result never rests on luck. After that no
text moves: texts are equal exactly where their ordered lists of identifiers are,
and lists are some eight bytes per 200 characters.

A group of copies of any size is grouped and found again in ``SLICES`` even
slices by a hash of the id, so that no task sees the whole of it.

Null texts count as empty; empty texts are equal to each other and have the empty
recipe. Null ids are larger than all others. Of rows with the same id and equal
texts one stays, the others are its copies. Very long texts are longer lists.
An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.session import materialize

LEAST, MOST = 256, 2048
# A chunk ends after a word that ends in one of these letters.
MARKS = "dgmyz"
CHUNK = rf"(?s).{{{LEAST},{MOST - 1}}}?(?:(?<=[{MARKS}]\x20)|\z)|.{{1,{MOST}}}"
SLICES = 1024

Identifier = Callable[[Column], Column]

# Each is wider than the one before; the last is the chunk itself and cannot fail.
IDENTIFIERS: tuple[Identifier, ...] = (
    F.xxhash64, lambda c: F.unhex(F.md5(c)), lambda c: F.unhex(F.sha2(c, 256)), lambda c: c.cast("binary"))


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks(norm: Column) -> Column:
    """The chunks of a normalised text in order; joined again they are the text."""
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def dictionary(documents: DataFrame, text: str = "text", identifier: Identifier = IDENTIFIERS[0]) -> DataFrame:
    """(id, chunk): every distinct chunk of all texts, under its identifier."""
    every = documents.select(F.explode(chunks(normalised(text))).alias("chunk"))
    return every.select(identifier(F.col("chunk")).alias("id"), "chunk").distinct()


def is_verified(filed: DataFrame) -> bool:
    """Whether no identifier of a dictionary stands for two chunks."""
    return not filed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()


def verified_identifier(documents: DataFrame, text: str = "text", identifiers: Sequence[Identifier] = IDENTIFIERS) -> Identifier:
    """The first identifier that tells all chunks of these texts apart."""
    for identifier in identifiers[:-1]:
        if is_verified(dictionary(documents, text, identifier)):
            return identifier
    return identifiers[-1]


def recipes(documents: DataFrame, id_column: str = "doc_id", text: str = "text", identifiers: Sequence[Identifier] = IDENTIFIERS) -> DataFrame:
    """One row per document: its id, ``recipe`` (the ordered identifiers of its
    chunks) and ``text_sha256`` of the normalised text."""
    identifier = verified_identifier(documents, text, identifiers)
    norm = documents.select(F.col(f"`{id_column}`").alias(id_column), normalised(text).alias("norm"))
    listed = F.transform(chunks(F.col("norm")), lambda c: identifier(c))
    return norm.select(id_column, listed.alias("recipe"), F.sha2("norm", 256).alias("text_sha256"))


def mark(documents: DataFrame, id_column: str = "doc_id", text: str = "text", identifiers: Sequence[Identifier] = IDENTIFIERS) -> DataFrame:
    """One row per document: id, keep_id (the smallest id among equal texts),
    group_size, kept and text_sha256."""
    slot = F.pmod(F.xxhash64("id"), F.lit(SLICES)).alias("slot")
    listed = recipes(documents, id_column, text, identifiers).withColumnRenamed(id_column, "id")
    rows = materialize(listed.groupBy("recipe", "text_sha256", "id").agg(F.count(F.lit(1)).alias("copies")).select("*", slot), "recipes")
    # Each slice of a group first, then the group; the slices that exist get its answer back.
    sliced = rows.groupBy("recipe", "slot").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("n"))
    groups = sliced.groupBy("recipe").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("slot").alias("slots"))
    answers = groups.select("recipe", "keep_id", "group_size", F.explode("slots").alias("slot"))
    found = rows.join(answers, ["recipe", "slot"])
    each = found.select("id", "keep_id", "group_size", "text_sha256", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select(F.col("id").alias(id_column), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def restore(listed: DataFrame, filed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, text_sha256, text): normalised texts put together again from recipes
    and the dictionary of the same identifier.

    Equal recipes are put together once per slice of their ids, not once per document.
    """
    slot = F.pmod(F.xxhash64(F.col(id_column)), F.lit(SLICES))
    rows = listed.select(id_column, "recipe", "text_sha256", slot.alias("slot"))
    distinct = rows.select("recipe", "slot").distinct()
    placed = distinct.select("recipe", "slot", F.posexplode_outer("recipe").alias("place", "chunk_id"))
    joined = placed.join(filed.select(F.col("id").alias("chunk_id"), "chunk"), "chunk_id", "left").groupBy("recipe", "slot").agg(
        F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "chunk")))).alias("parts"))
    texts = joined.select("recipe", "slot", F.array_join(F.transform("parts", lambda p: p["chunk"]), "").alias("text"))
    return rows.join(texts, ["recipe", "slot"]).select(id_column, "text_sha256", "text")
