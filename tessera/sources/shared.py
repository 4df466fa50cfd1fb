"""Tables of a folder, and cuts of lineage by tables written to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, one below the warehouse in local mode; elsewhere that may
    be a folder of one machine, which the executors of others can't see, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cuts").rstrip("/")


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and go on from the written table, so that a lost
    executor costs a re-read, not a recomputation of everything before.

    instead_of: an earlier cut that nothing reads any more once this one is written; its files go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead_of is not None:
        drop(instead_of)
    made = spark.read.schema(df.schema).parquet(path)
    made._cut_path = path
    return made


def drop(df: DataFrame) -> None:
    """Delete the files of a cut; of another table nothing."""
    path, spark = getattr(df, "_cut_path", None), df.sparkSession
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
