"""Token dictionaries learned from matched records in another script, and their use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclink.functions.constants import NATIVE


def clean_native(x: Column) -> Column:
    return F.translate(x, "‌‍", "")


def latin(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")


def majority(seen: DataFrame, total: Column, least: int, purity: float) -> DataFrame:
    """``k, v``: each key's most frequent value (equal ones: the smaller), if it is frequent and pure enough."""
    counts = seen.groupBy("k", "v").agg(F.count("*").alias("n"))
    ranked = counts.withColumns({"total": total, "rn": F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "v"))})
    return ranked.where((F.col("rn") == 1) & (F.col("n") >= least) & (F.col("n") / F.col("total") >= purity)).select("k", "v")


def learn_names(matched: DataFrame, least: int = 2, purity: float = 0.5) -> DataFrame:
    """``k, v`` from matched names ``q_name, s_name`` with as many words each."""
    cut = matched.where(F.col("q_name").rlike(NATIVE)).select(F.split(F.trim("q_name"), r"\s+").alias("q"), F.split(F.trim("s_name"), r"\s+").alias("s")).where(F.size("q") == F.size("s"))
    zipped = cut.select(F.explode(F.arrays_zip("q", "s")).alias("z")).where(F.col("z.q").rlike(NATIVE))
    seen = zipped.select(clean_native(F.col("z.q")).alias("k"), latin(F.col("z.s")).alias("v")).where("k <> '' AND v <> ''")
    return majority(seen, F.sum("n").over(Window.partitionBy("k")), least, purity)


def learn_addresses(matched: DataFrame, least: int = 2, purity: float = 0.8) -> DataFrame:
    """``k, v`` from matched addresses ``q_address, s_address``: comma components that occur together."""
    parts = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    cut = matched.where(F.col("q_address").rlike(NATIVE)).select(parts("q_address").alias("q"), F.array_distinct(F.transform(parts("s_address"), F.lower)).alias("s"))
    cut = cut.select(F.explode("q").alias("k"), "s").where(F.col("k").rlike(NATIVE)).withColumn("k", clean_native(F.col("k")))
    occurs = cut.groupBy("k").agg(F.count("*").alias("total"))
    counts = cut.select("k", F.explode("s").alias("v")).groupBy("k", "v").agg(F.count("*").alias("n")).join(occurs, "k")
    ranked = counts.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "v")))
    return ranked.where((F.col("rn") == 1) & (F.col("n") >= least) & (F.col("n") / F.col("total") >= purity)).select("k", "v")


def _apply(records: DataFrame, column: str, learned: DataFrame, split: str, join: str) -> DataFrame:
    """Replace known parts of ``column``; unknown ones stay. Each distinct text in the other script is looked up once, all other rows are left alone."""
    native = F.coalesce(F.col(column).rlike(NATIVE), F.lit(False))
    texts = records.where(native).select(F.col(column).alias("_text")).distinct()
    parts = texts.select("_text", F.posexplode(F.split(F.trim("_text"), split)).alias("_at", "_x")).select("_text", "_at", F.trim("_x").alias("_x"), clean_native(F.trim("_x")).alias("k"))
    known = parts.join(learned.select("k", F.col("v").alias("_v")), "k", "left")
    done = known.groupBy("_text").agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("_v", "_x").alias("y")))).alias("_ys"))
    done = done.select("_text", F.array_join(F.transform("_ys", lambda y: y["y"]), join).alias("_new"))
    changed = records.where(native).join(done, F.col(column) == F.col("_text")).withColumn(column, F.col("_new")).drop("_text", "_new")
    return records.where(~native).unionByName(changed)


def apply_names(records: DataFrame, learned: DataFrame, column: str = "business_name") -> DataFrame:
    """Names with their known words replaced."""
    return _apply(records, column, learned, r"\s+", " ")


def apply_addresses(records: DataFrame, learned: DataFrame, column: str = "business_address") -> DataFrame:
    """Addresses with their known comma components replaced."""
    return _apply(records, column, learned, ",", ", ")
