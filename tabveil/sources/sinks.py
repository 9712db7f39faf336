"""Table writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Parquet with compression and types as in the table."""
    df.write.mode(mode).parquet(path)
    return path


def write_epsilon_family(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """All ε copies as one table partitioned by ``epsilon``."""
    df.write.mode(mode).partitionBy("epsilon").parquet(path)
    return path


def write_epsilon_copy(df: DataFrame, folder: str, epsilon: float, prefix: str = "df_syn") -> str:
    """One copy under the name that carries its ε."""
    return write_parquet(df.drop("epsilon"), f"{folder.rstrip('/')}/{prefix}_eps_{epsilon}.parquet")


def write_csv(df: DataFrame, path: str, sep: str = ";", encoding: str = "UTF-8", mode: str = "overwrite") -> str:
    """Delimited text with a header."""
    df.write.mode(mode).option("sep", sep).option("encoding", encoding).option("header", True).csv(path)
    return path


def audit_summary(details: DataFrame, linkability: float | None = None, timestamp=None) -> DataFrame:
    """One nested row from per-secret rows (``secret``, ``risk``, ``label``).

    There is one row per audited column, so the collected map is short.
    """
    entry = F.struct("secret", F.struct("risk", "label"))
    return details.agg(
        F.lit(timestamp).cast("timestamp").alias("timestamp"),
        F.lit(linkability).cast("double").alias("linkability_risk"),
        F.avg("risk").alias("inference_avg_risk"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("details"),
    )


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines; structs and maps stay nested."""
    df.write.mode(mode).json(path)
    return path


def append_run(df: DataFrame, path: str) -> str:
    """Add run rows to a log table."""
    df.write.mode("append").parquet(path)
    return path
