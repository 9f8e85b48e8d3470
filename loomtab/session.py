"""Sessions, tables and the shared folder for intermediate ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def session(name: str = "loomtab", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; master and sizes are the deployment's to choose."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_file_order(df: DataFrame) -> DataFrame:
    """df, a table as load gives it, with ``__file``, the place of a row's file among the table's in the order of their names, and ``__row``, its place in the file."""
    own = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    files = own.select("__path").distinct().select("__path", F.row_number().over(W.orderBy("__path")).alias("__file"))  # a row for each file
    return own.join(F.broadcast(files), "__path").drop("__path")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names, removed when the session's JVM ends.

    Only a local session may do without that setting; it gets a temporary folder.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_loomtab_scratch", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = sc._loomtab_scratch = "file://" + tempfile.mkdtemp(prefix="loomtab-scratch-")
    path = f"{base.rstrip('/')}/loomtab/{name}-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage is cut, and it is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
