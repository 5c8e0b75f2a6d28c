"""Keep an expensive intermediate result that several joins read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """New folder for a job's own files, inside the session's shared folder.

    It goes when the driver ends. Local sessions without ``spark.checkpoint.dir``
    get a folder of their own; a cluster must name one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = f"file://{tempfile.mkdtemp(prefix='pagewarden-')}"
    folder = f"{shared.rstrip('/')}/pagewarden-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the session's shared folder and read it from there.

    The table outlives lost executors and cuts the lineage. It may hold raw
    values, so it goes with its folder when the driver ends.
    """
    folder = work_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
