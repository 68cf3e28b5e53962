"""Operator 2: removing sentences that repeated runs of sentences cover.

Every run of ``run`` consecutive sentences is hashed and dealt by its hash; a shorter text is one run. The first occurrence of a run
(smallest id, then place) stays; sentences that any other occurrence covers are removed. Occurrences are combined before they are
shuffled, so a run that a third of all documents share is one row a task. The most frequent runs, of a bounded number, are then
marked by a broadcast, so no task gets the occurrences of a hot run; all others by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclink.llm.common import join_hot, materialize

#: Consecutive sentences in a run.
RUN = 3
_END = r"([.!?])[ \t\r]+"


def sentences(text: Column) -> Column:
    """Sentences of a text, by end marks before blanks and by line ends; the blanks around them and empty ones are dropped."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, _END, "$1\n"), "\n"), lambda s: F.trim(s)), lambda s: s != "")


def remove_repeats(docs: DataFrame, run: int = RUN, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, n_sentences, n_removed, kept``: for every row the sentences left, joined by line ends.

    Runs compare by a 64-bit and a 32-bit hash of their sentences, whatever blanks stand between those. A text of fewer sentences than
    ``run`` is one run, which equals only texts of the same sentences. Null and empty texts have no sentences and keep an empty text. A null id
    counts as smaller than others and stays null. Rows that share an id but not the text (told apart by 64-bit hashes, by which they are
    ordered) are different documents; repeated rows (same id and text) are one, do not count against each other and all get the result of
    one. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    cut = docs.select(F.col(id_column).alias("key"), F.xxhash64(text).alias("mark"), sentences(text).alias("s"))
    places = F.when(F.size("s") >= run, F.sequence(F.lit(0), F.size("s") - run)).when(F.size("s") > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    whole = lambda i: F.slice(F.col("s"), i + 1, run)
    hashed = F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(whole(i)).alias("h"), F.hash(whole(i)).alias("g")))
    # An outer explode: for a plain one the optimiser adds a filter on the array's size, below, that would cut every text again for every run.
    runs = cut.select("key", "mark", "s", hashed.alias("r")).select("key", "mark", F.explode_outer("r").alias("r")).select("key", "mark", "r.at", "r.h", "r.g").where("at IS NOT NULL")
    first = materialize(runs.groupBy("h", "g").agg(F.min(F.struct("key", "mark", "at")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    again = join_hot(runs, first, ["h", "g"], "first", "n").where(~F.struct("key", "mark", "at").eqNullSafe(F.col("first")))
    gone = again.groupBy(F.col("key").alias("gone_key"), F.col("mark").alias("gone_mark")).agg(F.collect_set("at").alias("starts"))
    gone = gone.withColumn("gone", F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + run - 1))))).drop("starts")
    joined = cut.join(gone, F.col("key").eqNullSafe(F.col("gone_key")) & (F.col("mark") == F.col("gone_mark")), "left")
    every = F.when(F.size("s") > 0, F.sequence(F.lit(0), F.size("s") - 1)).otherwise(F.array().cast("array<int>"))
    left = joined.withColumn("left", F.array_except(every, F.coalesce("gone", F.array().cast("array<int>"))))
    kept = F.transform("left", lambda i: F.get(F.col("s"), i))
    return left.select(F.col("key").alias(id_column), F.size("s").cast("long").alias("n_sentences"), (F.size("s") - F.size("left")).cast("long").alias("n_removed"), F.array_join(kept, "\n").alias("kept"))
