"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates the words of every contract.
BLANKS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, wherever it was imported from."""
    sc = spark.sparkContext
    if getattr(sc, "_loomtab_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="loomtab-"), "loomtab_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._loomtab_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is set to a temporary folder only where it is unset and the session is
    local, as in tests; a cluster has to name one.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(sc, "_loomtab_shared", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomtab-shared-")
        sc._loomtab_shared = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/loomtab/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Remove a staged table before the session ends, once nothing reads it."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it, whatever its letters' case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def boxed(docs: DataFrame) -> Column:
    """All columns but text as one struct, so that none of their names meets another."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return F.struct(*rest) if rest else F.struct(F.lit(None).cast("boolean").alias("none"))


def unboxed(docs: DataFrame, row: str, text: Column) -> list[Column]:
    """The columns of docs, in their order, out of its box, with this text."""
    return [text.alias(c) if c == "text" else F.col(row)[c].alias(c) for c in docs.columns]


#: Keys of more rows than this, and more than one row in MOST_HOT, are joined by broadcast: there are MOST_HOT of them at most.
HOT_ROWS, MOST_HOT = 10_000, 4096


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """left (of so many rows, staged) joined with right (a row for each key, and n, the rows of left that have it).

    Hot keys have a bounded number, so their rows stay where they are; the
    others are shuffled.
    """
    limit = max(HOT_ROWS, rows // MOST_HOT)
    hot, rest = right.filter(F.col("n") > limit).drop("n"), right.filter(F.col("n") <= limit).drop("n")
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return left.join(F.broadcast(hot), keys).select(*cold.columns).union(cold)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value, body):
    """Bind value once and use it many times in body, inside one projection.

    A lambda's captured expression is evaluated again for each element; a
    one-element array makes it the lambda's variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
