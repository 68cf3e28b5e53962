"""Stored tables between stages: shared scratch tables, and named tables that are resumed, replaced by partition, or found stale."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, which ``spark.checkpoint.dir`` names.

    Where that is unset, a session of one process gets a folder of its own, which goes when the process ends; on a cluster this raises
    ValueError, as executors would not find each other's files.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="reclink-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor without computing this again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reclink-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """(file system, path) by Spark's own file systems, so that remote folders work."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was completed: the mark is written last."""
    files, _ = _files(spark, path)
    return files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))


def finished_file(spark: SparkSession, path: str) -> bool:
    """Whether a single file is there."""
    files, where = _files(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stored table; what its folders are named after stays text, whatever it looks like."""
    name = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(name, before)


def fresh(spark: SparkSession, path: str, columns: Iterable[str]) -> bool:
    """Whether a finished table has all of ``columns``; one written before a column was added is stale."""
    return finished(spark, path) and set(columns) <= set(read(spark, path).columns)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], columns: Iterable[str] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """The table at ``path``, built only if it is unfinished or lacks one of ``columns``.

    A build is written beside the old table, split by the columns ``by``, and takes its place by a rename, so a reader never sees half a table.
    """
    if not fresh(spark, path, columns):
        beside = f"{path}.tmp-{uuid.uuid4().hex}"
        build().write.partitionBy(*by).parquet(beside)
        remove(spark, path)
        files, old = _files(spark, path)
        files.mkdirs(old.getParent())
        if not files.rename(_files(spark, beside)[1], old):
            raise OSError(f"cannot put {beside} in the place of {path}")
    return read(spark, path)


def replace_partitions(df: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """Write ``df`` split by ``by``; partitions that it holds are replaced, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small report or map of the driver, as JSON text."""
    files, where = _files(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(json.dumps(value, indent=1, sort_keys=True, ensure_ascii=False).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def check_lists(lists: DataFrame, s1: DataFrame, others: DataFrame, column: str = "matched_entity_ids") -> dict[str, int]:
    """Faults of an output table of id lists, by kind; all are zero for a valid one.

    Every primary record has one row, ids in the lists are known, and no id is in two lists.
    """
    ids = lists.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split(column, ",")).alias("rid")).where("rid <> ''")
    each = ids.groupBy("rid").agg(F.count("*").alias("n"))
    known = others.select(F.col("entity_id").alias("rid")).distinct()
    primary = s1.select("s1_id").distinct()
    rows = lists.select(F.col("source1_entity_id").alias("s1_id"))
    return {
        "repeated_rows": rows.count() - rows.distinct().count(),
        "missing_rows": primary.join(rows, "s1_id", "left_anti").count(),
        "unknown_rows": rows.join(primary, "s1_id", "left_anti").count(),
        "unknown_ids": each.join(known, "rid", "left_anti").count(),
        "shared_ids": each.where("n > 1").count(),
    }
