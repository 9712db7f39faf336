"""Derived features over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.functions import text
from tabveil.operators.generalize import quantile_bins
from tabveil.session import lookup


def equal_flag(left: Column, right: Column) -> Column:
    """1 if both values are equal; a null is equal to nothing."""
    return F.coalesce(left == right, F.lit(False)).cast("int")


def group_size(df: DataFrame, keys: Sequence[str], counted: str, name: str) -> DataFrame:
    """Put the number of non-null ``counted`` values of a row's group on the row.

    Counts are aggregated before they travel, then looked up; no group is ever
    gathered, so a hot key costs one row. Rows with a null key get null.
    """
    keys = list(keys)
    complete = df.dropna(how="any", subset=keys)
    sizes = complete.groupBy(*keys).agg(F.count(counted).alias(name))
    return lookup(df, sizes, keys)


def add_competition(df: DataFrame, place: str = "SG_UE", office: str = "CD_CARGO", party: str = "SG_PARTIDO",
                    row_id: str = "SQ_CANDIDATO") -> DataFrame:
    """Rivals for the same office in the same place, and the size of the party."""
    df = group_size(df, [place, office], row_id, "COMPETICAO_CARGO")
    return group_size(df, [party], row_id, "TAMANHO_PARTIDO")


def competition_bin(df: DataFrame, k: int = 4, exact: bool = True) -> DataFrame:
    """The competition count in k bins of equal frequency."""
    return quantile_bins(df, "COMPETICAO_CARGO", k, "COMPETICAO_BIN", exact)


def engineer(df: DataFrame) -> DataFrame:
    """Title, name length, simplified education and marital status, home base."""
    return df.withColumns({
        "TEM_TITULO": text.title_flag(F.col("NM_URNA_CANDIDATO")),
        "LEN_NM_URNA": text.text_length(F.col("NM_URNA_CANDIDATO")),
        "DS_GRAU_INSTRUCAO": text.collapse_two_way(F.col("DS_GRAU_INSTRUCAO"), "SUPERIOR COMPLETO", "SUPERIOR"),
        "DS_ESTADO_CIVIL": text.collapse_two_way(F.col("DS_ESTADO_CIVIL"), "CASADO", "CASADO"),
        "BASE_NATAL": equal_flag(F.col("SG_UF"), F.col("SG_UF_NASCIMENTO")),
    })


def class_weight(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Negatives per positive; 1 where there is no positive."""
    negatives, positives = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    weight = F.when(positives > 0, negatives / positives).otherwise(1.0)
    return df.groupBy(*by).agg(negatives.alias("negatives"), positives.alias("positives"), weight.alias("weight"))


def weighted_rows(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Add the class weight to positive rows and 1 to the others."""
    weight = class_weight(df, label).select("weight").scalar()
    return df.withColumn(name, F.when(F.col(label) == 1, weight).otherwise(1.0))
