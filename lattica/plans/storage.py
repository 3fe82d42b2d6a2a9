"""Where intermediate tables go: the folder all executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it back; such a table survives the loss of any executor.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_KEY = "spark.checkpoint.dir"
#: Rows of a stored table up to which Spark may broadcast it; packed files say too little about what it would take on the driver.
SENT = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Where none is named, a fresh temporary one in local mode (tests); elsewhere ValueError."""
    named = spark.sparkContext.getConf().get(_KEY, None) or spark.conf.get(_KEY, None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set(_KEY, named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_seeing(df: DataFrame, name: str, **facts: Column) -> tuple[DataFrame, dict]:
    """As :func:`stored`, with aggregates taken while writing: no job of their own.  A table whose rows, the fact ``n``, are more than SENT is not broadcast."""
    seen = Observation()
    out = stored(df.observe(seen, *[fact.alias(k) for k, fact in facts.items()]), name)
    if (seen.get.get("n") or 0) > SENT:
        path, out = out._stored_at, out.hint("merge")
        out._stored_at = path
    return out, seen.get


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`stored` that nothing reads any more."""
    for df in tables:
        path = df.__dict__.pop("_stored_at", None)
        if path:
            spark = df.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Stored tables that are deleted one by one or together, once nothing reads them any more."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(out := stored(df, name))
        return out

    def stored_seeing(self, df: DataFrame, name: str, **facts: Column) -> tuple[DataFrame, dict]:
        out, seen = stored_seeing(df, name, **facts)
        self.tables.append(out)
        return out, seen

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` stored, and everything else deleted."""
        out = stored(df, name)
        self.discard()
        return out

    def discard(self, *tables: DataFrame) -> None:
        """These tables, or all."""
        discard(*(tables or self.tables))
        self.tables = [t for t in self.tables if "_stored_at" in t.__dict__]
