"""Session settings and the shared scratch folder."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


#: The JVM never compiles a method of more bytecode than this; Spark's own limit lets such stages run interpreted.
CODEGEN = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def build_session(app="accesslens", master=None, cpus=8, **conf):
    """A session with the settings the operators expect (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **CODEGEN,
    }
    if master and master.startswith("local"):
        settings["spark.sql.shuffle.partitions"] = str(cpus)
        settings["spark.driver.memory"] = "8g"
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark, name):
    """A fresh path below the shared folder that ``spark.checkpoint.dir`` names.

    Only a local master may run without that setting; it then gets a temporary folder. Elsewhere a machine-local
    folder would be seen by one host only, so an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="accesslens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df, name):
    """Write a frame to the scratch folder and read it back: cuts lineage, survives executor loss."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def input_splits(spark, size):
    """Tables that jobs inside the block read are cut into splits of ``size`` bytes at most (in whole row groups)."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)
