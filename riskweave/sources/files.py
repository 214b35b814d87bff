"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    max_rows: int | None = None,
    date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """CSV with a header and a fixed schema, so no inference pass.

    ``max_rows`` caps what is read, for a quick look at a raw file.
    """
    df = spark.read.csv(path, header=True, schema=schema, dateFormat=date_format, enforceSchema=False)
    return df if max_rows is None else df.limit(max_rows)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def find(spark: SparkSession, root: str, name: str) -> str | None:
    """Path of the first table called ``name`` at any depth under ``root``.

    Folders are listed level by level; a parquet table may be a file or a folder.
    """
    level = [root] if exists(spark, root) else []
    while level:
        below = []
        for folder in level:
            target = spark._jvm.org.apache.hadoop.fs.Path(folder)
            for status in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target):
                path = status.getPath()
                if path.getName() == name:
                    return path.toString()
                if status.isDirectory():
                    below.append(path.toString())
        level = sorted(below)
    return None


def load_transactions(
    spark: SparkSession,
    interim: str,
    input_dir: str | None,
    csv: str | None,
    csv_schema: T.StructType,
    csv_rows: int | None = None,
) -> DataFrame:
    """First source that exists: interim parquet, any transactions.parquet
    under the input folder, the raw CSV; else an error.

    The raw CSV is read whole unless ``csv_rows`` caps it for a quick look.
    """
    if exists(spark, interim):
        return read_parquet(spark, interim)
    if input_dir is not None:
        found = find(spark, input_dir, "transactions.parquet")
        if found is not None:
            return read_parquet(spark, found)
    if csv is not None and exists(spark, csv):
        return read_csv(spark, csv, csv_schema, csv_rows)
    raise FileNotFoundError(f"no transactions found at {interim}, {input_dir} or {csv}")


def write_scores(alerts: DataFrame, path: str, partition_by: Sequence[str] = ("agent_name",)) -> None:
    """Alert rows as parquet, one folder per scorer."""
    alerts.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
