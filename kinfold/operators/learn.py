"""Pair classifiers, calibration and blending with pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import portable_bucket


def with_missing(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features that the table lacks become 0."""
    return df.withColumns({c: F.lit(0.0) for c in features if c not in df.columns}) if set(features) - set(df.columns) else df


def train_gbt(pairs: DataFrame, features: Sequence[str], rounds: int = 40, depth: int = 5, seed: int = 7, valid_col: str | None = None):
    """Gradient-boosted trees on ``label``; with ``valid_col`` rounds stop when its rows no longer gain."""
    gbt = GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed, subsamplingRate=0.8)
    if valid_col:
        gbt = gbt.setValidationIndicatorCol(valid_col)
    rows = with_missing(pairs, features).withColumn("y", F.col("label").cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="keep"), gbt]).fit(rows)


def score(model, pairs: DataFrame, features: Sequence[str], name: str = "prob") -> DataFrame:
    out = model.transform(with_missing(pairs, features))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def out_of_fold(pairs: DataFrame, features: Sequence[str], k: int = 3, early_stop: bool = False, models: list | None = None, **settings) -> DataFrame:
    """Every pair scored by a model that saw no pair of its entity: folds by the entity's bucket.

    ``early_stop`` keeps a tenth of the training entities aside, on which rounds must gain; ``models`` takes the
    fitted models, for ``feature_gains``. The pairs are read k times over: pass a written table.
    """
    folds = pairs.withColumn("fold", portable_bucket(F.col("s1_id"), k))
    if early_stop:
        folds = folds.withColumn("__aside", portable_bucket(F.concat(F.col("s1_id").cast("string"), F.lit("aside")), 10) == 0)
        settings["valid_col"] = "__aside"
    out = None
    for i in range(k):
        model = train_gbt(folds.where(F.col("fold") != i), features, **settings)
        part = score(model, folds.where(F.col("fold") == i), features).drop("__aside")
        out = part if out is None else out.unionByName(part)
        if models is not None:
            models.append(model)
    return out


def feature_gains(models: Sequence, features: Sequence[str], most: int | None = None) -> list[tuple[str, float]]:
    """Mean importance of each feature over the models, the largest first."""
    total = dict.fromkeys(features, 0.0)
    for m in models:
        for f, g in zip(features, m.stages[-1].featureImportances.toArray(), strict=True):
            total[f] += float(g) / len(models)
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most]


def logit(c):
    p = F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def fit_isotonic(df: DataFrame):
    return IsotonicRegression(featuresCol="prob", labelCol="y").fit(df.select(F.col("prob").cast("double"), F.col("label").cast("double").alias("y")))


def apply_isotonic(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("prob", F.least(F.greatest("prediction", F.lit(1e-4)), F.lit(1 - 1e-4))).drop("prediction")


def fit_platt(df: DataFrame):
    """Logistic regression on the logit."""
    rows = df.select(logit(F.col("prob")).alias("z"), F.col("label").cast("double").alias("y"))
    return Pipeline(stages=[VectorAssembler(inputCols=["z"], outputCol="x"), LogisticRegression(featuresCol="x", labelCol="y")]).fit(rows)


def apply_platt(model, df: DataFrame) -> DataFrame:
    out = model.transform(df.withColumn("z", logit(F.col("prob"))))
    return out.withColumn("prob", vector_to_array("probability")[1]).drop("z", "x", "rawPrediction", "probability", "prediction")


def calibrate_out_of_fold(df: DataFrame, k: int = 3, method: str = "isotonic") -> DataFrame:
    fit, use = (fit_isotonic, apply_isotonic) if method == "isotonic" else (fit_platt, apply_platt)
    folds = df.withColumn("fold", portable_bucket(F.col("s1_id"), k))
    out = None
    for i in range(k):
        part = use(fit(folds.where(F.col("fold") != i)), folds.where(F.col("fold") == i))
        out = part if out is None else out.unionByName(part)
    return out


BLEND = ("z1", "ce", "z1_ce")


def _blend_rows(df: DataFrame) -> DataFrame:
    return df.withColumns({"z1": logit(F.col("p1")), "z1_ce": logit(F.col("p1")) * F.col("ce")})


def fit_blend(df: DataFrame):
    """Logistic regression on the first score's logit, the re-ranker's score and their product (penalty 1 / n, not standardised)."""
    n = max(1, df.count())
    lr = LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / n, elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[VectorAssembler(inputCols=list(BLEND), outputCol="x"), lr]).fit(_blend_rows(df).withColumn("y", F.col("label").cast("double")))


def apply_blend(model, df: DataFrame) -> DataFrame:
    out = model.transform(_blend_rows(df))
    return out.withColumn("p2", vector_to_array("probability")[1]).drop(*BLEND[::2], "x", "rawPrediction", "probability", "prediction")


def band(df: DataFrame, lo: float = 0.01, hi: float = 0.99, col: str = "p1") -> DataFrame:
    """The uncertain pairs."""
    return df.where(F.col(col).between(lo, hi))


def area_under_curve(df: DataFrame, col: str) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y").evaluate(df.select(F.col(col).cast("double").alias("s"), F.col("label").cast("double").alias("y")))


def rerank(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], batch: int = 64) -> DataFrame:
    """Adds ``ce``: a scorer of text pairs (text_a, text_b) called on Arrow batches, pairs of like length together."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", ce double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            order = (frame["text_a"].str.len() + frame["text_b"].str.len()).sort_values(kind="stable").index
            frame = frame.loc[order]
            a, b = frame["text_a"].tolist(), frame["text_b"].tolist()
            yield frame.assign(ce=[s for i in range(0, len(a), batch) for s in scorer(a[i : i + batch], b[i : i + batch])])

    return pairs.mapInPandas(run, schema)


def overlap_scorer(a: list[str], b: list[str]) -> list[float]:
    """A stand-in for a cross-encoder: log-odds of shared character trigrams."""
    import math

    def grams(s):
        return {s[i : i + 3] for i in range(len(s) - 2)} or {s}

    out = []
    for x, y in zip(a, b, strict=True):
        g, h = grams(x.lower()), grams(y.lower())
        j = len(g & h) / len(g | h)
        out.append(math.log((j + 0.01) / (1.01 - j)))
    return out


def texts(records: DataFrame, ids: DataFrame) -> DataFrame:
    """entity_id, text (name, bar, address) of the wanted ids."""
    return records.join(ids, "entity_id", "left_semi").select("entity_id", F.concat_ws(" | ", "business_name", "business_address").alias("text"))
