"""Table readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabveil.session import spread

# Matches both single files and Spark's folders of part files.
EPSILON_IN_NAME = r"eps_([0-9.eE+-]+)\.parquet"

EXPERIMENT_LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("epsilon", T.StringType()),
        T.StructField("score_total", T.StringType()),
        T.StructField("score_wrangling", T.StringType()),
        T.StructField("dp_gain", T.StringType()),
        T.StructField("util_marginal", T.StringType()),
        T.StructField("util_joint", T.StringType()),
        T.StructField("train_sec", T.StringType()),
        T.StructField("gen_sec", T.StringType()),
        T.StructField("rows", T.StringType()),
    ]
)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                 balance: bool = False) -> DataFrame:
    """Parquet table; a column list prunes the scan. ``balance`` deals the rows of
    a few small files out over the cores, for work that multiplies rows."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return spread(df) if balance else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ";",
             encoding: str = "ISO-8859-1") -> DataFrame:
    """Delimited text with a header and a declared schema (no inference pass)."""
    return (
        spark.read.schema(schema).option("sep", sep).option("encoding", encoding)
        .option("header", True).option("enforceSchema", False).csv(path)
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet or delimited text, by the ending of the path."""
    if path.lower().rstrip("/").endswith(".parquet"):
        return read_parquet(spark, path, balance=True)
    if schema is None:
        raise ValueError("a delimited file needs a schema")
    return read_csv(spark, path, schema)


def read_epsilon_family(spark: SparkSession, folder: str, pattern: str = "*eps_*.parquet") -> DataFrame:
    """All copies ``…eps_{ε}.parquet`` below a folder, with ε as a column."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{pattern}")
    name = F.regexp_extract(F.col("_metadata.file_path"), EPSILON_IN_NAME, 1)
    return df.select("*", name.cast("double").alias("epsilon"))


def listed_epsilons(spark: SparkSession, folder: str) -> DataFrame:
    """The ε that have an output below a folder, largest first.

    Reads names only: the listing of the driver, no file content.
    """
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*eps_*.parquet")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in (fs.globStatus(pattern) or [])]
    listing = spark.createDataFrame([(n,) for n in names], "name string")
    return (
        listing.select(F.regexp_extract("name", EPSILON_IN_NAME, 1).cast("double").alias("epsilon"))
        .orderBy(F.desc("epsilon"))
    )


def missing_epsilons(spark: SparkSession, wanted: Sequence[float], folder: str) -> list[float]:
    """The wanted ε that have no output yet, in the wanted order."""
    want = spark.createDataFrame([(i, float(e)) for i, e in enumerate(wanted)], "pos int, epsilon double")
    left = want.join(listed_epsilons(spark, folder), "epsilon", "left_anti").orderBy("pos")
    return [r.epsilon for r in left.collect()]


def read_experiment_log(spark: SparkSession, path: str, numeric: Sequence[str] = ("epsilon", "score_total",
                        "score_wrangling"), strict: bool = True) -> DataFrame:
    """Comma-separated run log; short rows are padded with nulls.

    The numeric columns are cast: ``strict`` stops at a value that is no number,
    otherwise such a value becomes null.
    """
    log = (
        spark.read.schema(EXPERIMENT_LOG_SCHEMA).option("header", True)
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    )
    return log.select(
        *[
            (F.col(c).cast("double") if strict else F.col(c).try_cast("double")).alias(c) if c in numeric else F.col(c)
            for c in log.columns
        ]
    )
