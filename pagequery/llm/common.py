"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: space and \t \n \v \f \r.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def spare(columns: list[str], name: str) -> str:
    """name, or name with underscores in front, such that none of the columns has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, whatever the optimiser inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset, as
    in local tests, is a temporary folder of this machine used.
    """
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pagequery-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def materialize(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there.

    Unlike checkpoint(), the rows are computed once. The rows go when the driver
    ends; keep collects the path, for a caller that drops it before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagequery/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop_quietly, spark, path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows
