"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_KEY = "spark.checkpoint.dir"


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the operators count on; sizes stay with the cluster."""
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: the session's checkpoint setting.

    Only where the setting is absent, as in local tests, a temporary folder is
    made and used as checkpoint folder too.
    """
    conf = spark.sparkContext.getConf().get(_KEY, None) or spark.conf.get(_KEY, None)
    if conf:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {_KEY} to a folder that all executors see")
    made = spark.conf.get("locusframe.local.dir", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("locusframe.local.dir", made)
        spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new sub-folder path of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
