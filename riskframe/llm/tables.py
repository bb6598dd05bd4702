"""Reading the text tables and cutting lineage through the shared folder."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import shared_folder

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of texts that a Python worker is handed at a time, unless the session was started with a bound of its own.
BATCH_BYTES = "2m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts or vectors, whose rows are handed to Python workers in batches of bounded size."""
    if not spark.sparkContext.getConf().contains(_BATCH_SETTING):
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` computed once into a new table of the shared folder, read from there, and the table's path.

    Lineage ends at files that every executor reaches, so a lost executor costs
    only the tasks that were reading or writing.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once into a new table of the shared folder, as by :func:`stored`."""
    return stored(df)[0]


def drop_stored(spark: SparkSession, path: str) -> None:
    """Deletes a table that :func:`stored` wrote; nothing may read it any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def n_words(text: str) -> Column:
    """Words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
