"""Scratch tables in the cluster's shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset a temporary folder serves a session whose executors
    are threads of one machine; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "") or tempfile.mkdtemp(prefix="spark-")
        _own[app] = base
    return f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many tasks as the session has cores, and more, by ``keys`` that hardly repeat. A file of few row groups is read by as
    few tasks, and whatever follows in the same stage stays with them: for rows that are small and costly to work on."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables written by :func:`keep` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_quern_path", None):
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where only the driver's sys.path names it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
