"""Record sources and sinks: tab-separated files, ground truth, id lists, and the record view of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reclink.sources.stages import stage

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """One tab-separated source, without quoting; nulls are empty but for the id."""
    raw = spark.read.schema(SCHEMA).option("sep", "\t").option("quote", "").option("header", True).csv(path)
    return raw.na.fill("", subset=SCHEMA.names[1:])


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """All three sources of a split, with their number."""
    parts = [read_source(spark, f"{folder}/{split}/{split}_source{k}.tsv").withColumn("src", F.lit(k)) for k in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_cached(spark: SparkSession, folder: str, split: str, cache: str) -> DataFrame:
    """``read_split`` through a stored copy, which is made once."""
    return stage(spark, f"{cache}/{split}", lambda: read_split(spark, folder, split), [*SCHEMA.names, "src"])


def truth_long(wide: DataFrame) -> DataFrame:
    """``s1_id, match_id`` from ids and comma-joined lists."""
    return wide.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("match_id")).where("match_id <> ''")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    schema = "source1_entity_id string, matched_entity_ids string"
    return truth_long(spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", True).csv(path).na.fill(""))


def id_lists(s1: DataFrame, pairs: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row for each ``s1_id``: its distinct ``rid`` values of ``pairs``, sorted and joined by commas, empty for none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("rid")), ",").alias(column))
    return s1.select("s1_id").distinct().join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def write_id_lists(lists: DataFrame, path: str) -> None:
    lists.write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", "").option("header", True).csv(path)


def record_view(documents: DataFrame) -> DataFrame:
    """Documents as records: three sources by id, country by language, names and addresses from the first seven words.

    A stand-in for business records, which the test tables lack; ``ck`` digests the first 60 characters and serves as a stand-in for the truth.
    """
    # Eight pieces hold seven words even where the text begins with blanks; no more of it is split or lower-cased.
    w = F.filter(F.transform(F.slice(F.split("text", "[ \n\t\r]+", 9), 1, 8), F.lower), lambda x: x != "")
    cut = documents.select("doc_id", "lang", "source", "n_chars", F.slice(w, 1, 7).alias("w"), F.md5(F.substring("text", 1, 60)).alias("ck"))
    return cut.select(
        F.col("doc_id").cast("string").alias("entity_id"), (F.col("doc_id") % 3 + 1).cast("int").alias("src"), F.col("lang").alias("country"),
        F.array_join(F.slice("w", 1, 4), " ").alias("business_name"),
        F.concat(F.col("n_chars").cast("string"), F.lit(" "), F.array_join(F.slice("w", 5, 3), " "), F.lit(", "), "source", F.lit(", "), "lang").alias("business_address"),
        "ck",
    )
