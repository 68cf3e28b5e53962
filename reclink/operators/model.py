"""Gradient-boosted scoring of pairs: fitting with early stopping, refitting, out-of-fold scores, pseudo labels, stored models."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclink.functions import constants as K
from reclink.functions.text import bucket
from reclink.sources.stages import materialize

MISSING = -1.0e6


def held_out(s1_id: Column) -> Column:
    """Whether a primary record is kept from fitting, for evaluation."""
    return bucket(K.HELD, s1_id, 1000) < K.HELD_SHARE


def fitted_on(q_id: Column, share: int) -> Column:
    """Whether a query record is among the ``share`` per mille that models are fitted on."""
    return bucket(K.FITTED, q_id, 1000) < share


def stops_early(q_id: Column) -> Column:
    """Whether a held-out query record says when to stop."""
    return bucket(K.EARLY, q_id, 10) < 3


def filled(pairs: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Trees need numbers: nulls become a sentinel far below all values, which a split can part from them."""
    return pairs.withColumns({f"{c}__x": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in features}), [f"{c}__x" for c in features]


def fit(pairs: DataFrame, features: list[str], label: str = "y", rounds: int = 20, depth: int = 5, step: float = 0.08, bins: int = 64, seed: int = 7, validation: str | None = None) -> PipelineModel:
    """A boosted model; with a boolean ``validation`` column it stops once those rows no longer improve."""
    data, names = filled(pairs.withColumn(label, F.col(label).cast("double")), features)
    model = GBTClassifier(featuresCol="f", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, maxBins=bins, subsamplingRate=0.8, featureSubsetStrategy="0.7", seed=seed, predictionCol="_pred")
    model = model.setProbabilityCol("_prob").setRawPredictionCol("_raw")
    if validation:
        model = model.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="f"), model]).fit(data)


def refit(pairs: DataFrame, features: list[str], first: PipelineModel, factor: float = 1.05, **how) -> PipelineModel:
    """Fitted anew on ``pairs``, for ``factor`` times the rounds at which ``first`` stopped."""
    return fit(pairs, features, **{**how, "rounds": max(1, int(rounds_of(first) * factor))})


def rounds_of(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def importance(model: PipelineModel, features: list[str]) -> list[list]:
    """Features by their share of the gain of all splits, greatest first."""
    gains = model.stages[-1].featureImportances.toArray()
    return sorted(([f, float(g)] for f, g in zip(features, gains)), key=lambda x: (-x[1], x[0]))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, pairs: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    data, _ = filled(pairs, features)
    return model.transform(data).select(*pairs.columns, vector_to_array("_prob")[1].alias(name))


def fold(q_id: Column) -> Column:
    return bucket(K.FOLD, q_id, 2)


def fit_folds(pairs: DataFrame, features: list[str], **how) -> list[PipelineModel]:
    """One model for each half of the query records. ``pairs`` should be stored: each fit reads it several times."""
    return [fit(pairs.where(fold(F.col("q_id")) == k), features, **how) for k in (0, 1)]


def score_folds(models: list[PipelineModel], pairs: DataFrame, features: list[str], name: str = "p1") -> DataFrame:
    """Every pair by the model of the other half."""
    parts = [score(models[1 - k], pairs.where(fold(F.col("q_id")) == k), features, name) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def out_of_fold(pairs: DataFrame, features: list[str], label: str = "y", **how) -> DataFrame:
    """``p1`` of every pair from the model that was fitted on the other half of the query records."""
    stored = materialize(pairs)
    return score_folds(fit_folds(stored, features, label=label, **how), stored, features)


def pseudo_labels(scored: DataFrame, high: float = K.SURE, low: float = K.HOPELESS, share: int = K.NEGATIVE_SHARE, seed: int = K.NEGATIVE) -> DataFrame:
    """``q_id, s1_id, y``: each record's best pair, if its score is high enough, as a match (of equal ones the first by id); a hashed share of the pairs of low score as non-matches."""
    nth = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("p"), "s1_id"))
    y = F.when((nth == 1) & (F.col("p") >= high), 1).when((F.col("p") <= low) & (bucket(seed, F.col("q_id"), 1000) < share), 0)
    return scored.select("q_id", "s1_id", y.alias("y")).where("y IS NOT NULL")
