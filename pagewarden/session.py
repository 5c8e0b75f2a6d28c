"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Run-time settings. Skewed joins are split by AQE even when that costs one
# more exchange downstream: a page or task may own a third of all rows.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Of repeated JSON keys the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}
# Page and log tables are expanded from rows of small files (thirteen elements to a
# customer), and Spark's estimate of a join side knows the file, not the expansion. Their
# joins are keyed and both sides grow, so none of them is sent whole through the driver.
KEYED_JOINS_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever they run; once for each application."""
    context = spark.sparkContext
    if getattr(context, "_pagewarden_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="pagewarden-ship-"), "pagewarden.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    context._pagewarden_shipped = True


def configure(spark: SparkSession, keyed_joins: bool = False) -> SparkSession:
    """Apply the run-time settings to a session that already exists.

    ``keyed_joins`` keeps sides of joins from being broadcast on an estimate; without
    it the session's own limits come back.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key, value in KEYED_JOINS_CONF.items():
        own = f"pagewarden.own.{key}"
        now = spark.conf.get(key, None)
        if keyed_joins and now != value:
            spark.conf.set(own, now or "")
            spark.conf.set(key, value)
        elif not keyed_joins and now == value and (before := spark.conf.get(own, None)) is not None:
            spark.conf.set(key, before) if before else spark.conf.unset(key)
            spark.conf.unset(own)
    ship_package(spark)
    return spark


def build_session(master: str | None = None, **extra: str) -> SparkSession:
    """Session for tests, the bench and scripts; a cluster brings its own."""
    builder = SparkSession.builder.appName("pagewarden")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark
