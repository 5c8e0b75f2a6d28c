"""What the operators share: word pattern, work tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TASK_ROWS = 10_000  # rows of a task, where their number is known


def scratch(spark: SparkSession) -> str:
    """A new folder for work tables, in the folder of ``spark.checkpoint.dir``.

    Only a local session may leave that unset; it gets a temporary folder. The
    files go when the driver ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = f"file://{tempfile.mkdtemp(prefix='pagewarden-llm-')}"
    folder = f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` to ``folder`` and read it from there; its shuffle files go at once.

    The table outlives lost executors and cuts the lineage.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, in no more tasks than those need and the session has cores.

    Rounds over a small table otherwise cost what starting their tasks costs. More rows
    get more tasks, up to those that ``df`` has.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where a column of ``df`` is called so already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str | Column) -> Column:
    """Number of words of a whole text; null has none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | Column) -> Column:
    """Words of a whole text in order; null and empty texts have none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(column, F.lit("")), SPACE), lambda w: w != "")
