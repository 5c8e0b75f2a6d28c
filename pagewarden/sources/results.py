"""A keyed sink of results: each write replaces the values of its keys.

A write has a number. Its rows go to a folder of that number, cut into buckets of
the keys, and a marker is set when all of them are there. A write that is repeated
replaces its folder as a whole; one that stopped half-way has no marker and is not
read. Later numbers win key by key, column by column: a column that a write leaves
null keeps what was there. ``fold`` merges what was written so far into one folder,
bucket by bucket, so reading does not grow with the number of writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> set[str]:
    files, where = _folder(spark, path)
    return {s.getPath().getName() for s in files.listStatus(where)} if files.exists(where) else set()


def _mark(spark: SparkSession, path: str, name: str) -> None:
    files, where = _folder(spark, f"{path}/_done/{name}")
    files.create(where, True).close()


def _unmark(spark: SparkSession, path: str, name: str) -> None:
    files, where = _folder(spark, f"{path}/_done/{name}")
    files.delete(where, False)


def _latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: of every column the value of the last write that had one."""
    others = [c for c in rows.columns if c not in (*keys, order, "bucket")]
    # max_by leaves out rows whose order is null, so a null value never wins.
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others]
    return rows.groupBy("bucket", *keys).agg(*last)


def write(rows: DataFrame, path: str, number: int, keys: list[str], buckets: int = BUCKETS) -> None:
    """Write ``rows`` as write ``number``; repeating it changes nothing, also after it was folded.

    Of rows of one key within a write any may win; make them one before. Null keys
    are a key of their own. Columns ``bucket`` and ``write`` are the sink's own.
    """
    spark = rows.sparkSession
    name = f"write={number}"
    if name in _names(spark, f"{path}/_done"):
        _unmark(spark, path, name)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    _mark(spark, path, name)


def _written(spark: SparkSession, path: str) -> tuple[str | None, list[int]]:
    """Newest fold that is whole, and the whole writes after it."""
    done = _names(spark, f"{path}/_done")
    folds = sorted(int(n.split("=")[1]) for n in done if n.startswith("fold="))
    base = folds[-1] if folds else None
    writes = sorted(int(n.split("=")[1]) for n in done if n.startswith("write="))
    return base, [n for n in writes if base is None or n > base]


def _all(spark: SparkSession, path: str, schema: str) -> DataFrame:
    kind = f"{schema}, bucket int"
    base, writes = _written(spark, path)
    parts = [(f"{path}/fold={base}", base)] if base is not None else []
    parts += [(f"{path}/write={n}", n) for n in writes]
    out = spark.createDataFrame([], f"{kind}, write bigint")
    for folder, n in parts:
        out = out.unionByName(spark.read.schema(kind).parquet(folder).withColumn("write", F.lit(n).cast("bigint")))
    return out


def read(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """What stands for each key after all whole writes; no rows where nothing was written."""
    return _latest(_all(spark, path, schema), keys, "write").drop("bucket")


def fold(spark: SparkSession, path: str, schema: str, keys: list[str]) -> None:
    """Merge all whole writes so far into one folder, read from then on in their place.

    The writes stay on disk; a fold that stops half-way is not read either.
    """
    _, writes = _written(spark, path)
    if not writes:
        return
    merged = _latest(_all(spark, path, schema), keys, "write")
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/fold={writes[-1]}")
    _mark(spark, path, f"fold={writes[-1]}")
