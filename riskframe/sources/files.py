"""Scans and sinks for transaction, score and feature tables."""

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.columns import require_columns
from riskframe.operators.sampling import fixed_size_sample


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True, sep: str = ","
) -> DataFrame:
    """A delimited file; give a schema, inferring one costs a second scan."""
    reader = spark.read.option("header", header).option("sep", sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def scan_parquet(
    spark: SparkSession, *paths: str, glob: str | None = None, recursive: bool = False
) -> DataFrame:
    """One or several parquet files or folders, optionally filtered by name and read in depth."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(*paths)


def exists(spark: SparkSession, path: str) -> bool:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)


def has_parquet(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder holds parquet; an absent path is an error."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise FileNotFoundError(path)
    files = fs.listFiles(root, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def scan_any(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True, sep: str = ","
) -> DataFrame:
    """Parquet where the folder holds parquet files, else CSV; read errors are not hidden."""
    if has_parquet(spark, path):
        return scan_parquet(spark, path)
    return scan_csv(spark, path, schema, header, sep)


def bounded_scan(df: DataFrame, id_col: str, max_rows: int, label: str = "label") -> DataFrame:
    """At most ``max_rows`` rows drawn over all files of a table."""
    return fixed_size_sample(require_columns(df, [label]), id_col, max_rows, "subset")


def write_splits(df: DataFrame, path: str, columns: Sequence[str] = ("features", "label", "weight")) -> None:
    """One write for all splits: a folder per value of ``split``."""
    df.select(*columns, "split").write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; only its folder is read."""
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def export_scores(scored: DataFrame, path: str) -> None:
    """(label, score) as CSV with a header, one file per partition."""
    rows = require_columns(scored, ["label", "score"]).select(F.col("label").cast("int").alias("label"), "score")
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_scores(spark: SparkSession, *paths: str) -> DataFrame:
    """(label, score) of exported score files."""
    return spark.read.option("header", True).schema("label int, score double").csv(list(paths))


def export_feature_sample(df: DataFrame, id_col: str, n: int, path: str, features: str = "features") -> None:
    """n rows as a dense array x and label y, drawn over the whole table."""
    require_columns(df, [features, "label"])
    sample = fixed_size_sample(df, id_col, n)
    dense = sample.select(id_col, vector_to_array(features).alias("x"), F.col("label").cast("int").alias("y"))
    dense.write.mode("overwrite").parquet(path)


def write_documents(documents: DataFrame, path: str, segments: Sequence[str] = (), column: str = "document") -> None:
    """One JSON document per line, in a folder per segment where segments are named."""
    writer = documents.select(*segments, F.col(column).alias("value")).write.mode("overwrite")
    (writer.partitionBy(*segments) if segments else writer).text(path)


def read_documents(
    spark: SparkSession, *paths: str, segments: Sequence[str] = (), whole_files: bool = False
) -> DataFrame:
    """(segments, source_file, document); ``whole_files`` reads indented reports, one per file."""
    reader = spark.read.option("wholetext", whole_files)
    if segments:
        fields = [T.StructField("value", T.StringType()), *[T.StructField(s, T.StringType()) for s in segments]]
        reader = reader.schema(T.StructType(fields))
    lines = reader.format("text").load(list(paths))
    return lines.select(*segments, F.input_file_name().alias("source_file"), F.col("value").alias("document"))


def read_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """(name, document) of whole reports whose path matches ``pattern``, indented or on one line.

    A report is named by its file, or by its folder where Spark wrote it as one.
    """
    found = read_documents(spark, pattern, whole_files=True)
    name = F.regexp_extract("source_file", r"([^/]+?)(?:/part-[^/]*)?$", 1)
    return found.select(F.url_decode(name).alias("name"), "document")
