"""Linking new query records as they arrive, against a frozen index of primary records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from reclink.operators import blocking, features
from reclink.operators.normalize import normalize


def build_index(records: DataFrame, path: str) -> None:
    """Store statistics and weights of the primary records among raw ``records``; the corpus that idf rests on is frozen with them."""
    recs = normalize(records)
    feats = features.features(recs)
    stats = features.statistics(feats, recs)
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    stored = records.sparkSession.read.parquet(f"{path}/stats")
    features.weights(feats.where("src = 1"), stored).write.mode("overwrite").parquet(f"{path}/weights")


def candidates(queries: DataFrame, path: str) -> DataFrame:
    """Pruned candidate lists of raw query records (``src`` over 1)."""
    spark = queries.sparkSession
    stats, index = spark.read.parquet(f"{path}/stats"), spark.read.parquet(f"{path}/weights")
    weighted = features.weights(features.features(normalize(queries)), stats)
    return blocking.prune(blocking.context(blocking.topk(index.unionByName(weighted))))


def link_stream(queries: DataFrame, index: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write the candidates of each micro-batch to a folder of its own; a batch that runs again replaces its folder."""

    def each(batch: DataFrame, number: int) -> None:
        candidates(batch, index).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
