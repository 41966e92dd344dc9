"""Learning heads on top of the panel: MLlib estimators and score blending."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crosssection import rank_normalize

c = F.col


def feature_stages(numeric: list[str], categorical: list[str] = ()) -> list:
    """Index the categories, assemble, keep missing numbers out by filling before."""
    index = [StringIndexer(inputCol=x, outputCol=f"{x}_ix", handleInvalid="keep") for x in categorical]
    return [*index, VectorAssembler(inputCols=[*numeric, *[f"{x}_ix" for x in categorical]], outputCol="features")]


def logistic(train: DataFrame, numeric: list[str], label: str = "win", reg: float = 0.1):
    """Scaled, class-balanced L2 logistic regression."""
    n = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = train.agg(F.count(F.lit(1)).alias("_t"), F.countDistinct(label).alias("_k"))
    weighted = train.join(F.broadcast(n), label).crossJoin(F.broadcast(total)).withColumn("_w", c("_t") / (c("_k") * c("_n")))
    stages = [*feature_stages(numeric), StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
              LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="_w", regParam=reg, maxIter=100)]
    return Pipeline(stages=stages).fit(weighted)


def margin() -> Column:
    """The signed distance of the fitted logistic model."""
    return vector_to_array("rawPrediction")[1]


def boosted(train: DataFrame, numeric: list[str], label: str, classify: bool = True, trees: int = 20, depth: int = 3):
    model = (GBTClassifier if classify else GBTRegressor)(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, seed=7)
    return Pipeline(stages=[*feature_stages(numeric), model]).fit(train)


def calibrate(scored: DataFrame, score: str, label: str):
    """Isotonic fit of the outcome on the score."""
    rows = scored.select(c(score).alias("features"), c(label).cast("double").alias("label"))
    return IsotonicRegression().fit(rows)


def brier(rows: DataFrame, p: Column, y: Column) -> DataFrame:
    """Squared error of the probabilities against that of the base rate."""
    base = rows.agg(F.avg(y).alias("_b"))
    return rows.crossJoin(F.broadcast(base)).agg(F.avg((p - y) ** 2).alias("brier"), F.avg((c("_b") - y) ** 2).alias("base_brier"), F.count(F.lit(1)).alias("n"))


def blend(rows: DataFrame, scores: list[str], mode: str = "mean", weights: dict[str, float] | None = None, tie: list[str] = (), out: str = "score",
          normalize: bool = True) -> DataFrame:
    """Mean, weighted mean or mean of ranks of component scores, rank-normalised first."""
    cols = list(scores)
    df = rows
    if normalize or mode == "rank_mean":
        for s in scores:
            df = rank_normalize(df, s, list(tie), f"{s}_01")
        cols = [f"{s}_01" for s in scores]
    w = {s: 1.0 for s in scores} if mode != "weighted" else dict(weights or {})
    total = sum(w[s] for s in scores)
    if total <= 0:
        raise ValueError("weights must sum to something positive")
    value = sum((c(k) * (w[s] / total) for s, k in zip(scores, cols)), F.lit(0.0))
    return df.withColumn(out, value)


def time_folds(rows: DataFrame, n_folds: int, ts: str = "ts") -> list[tuple[Column, Column]]:
    """(train, test) filters: test on each later time slice, train on everything before it."""
    if n_folds < 2:
        raise ValueError("stacking needs at least two folds")
    cut = rows.agg(F.percentile(ts, F.array(*[F.lit(i / n_folds) for i in range(1, n_folds)])).alias("q")).head()["q"]
    return [(c(ts) < a, (c(ts) >= a) & (c(ts) < z) if z is not None else (c(ts) >= a)) for a, z in zip(cut, [*cut[1:], None])]


def out_of_fold(rows: DataFrame, fit, n_folds: int, score: Column, out: str = "oof", ts: str = "ts") -> DataFrame:
    """Scores for every row after the first slice by a model that saw only earlier rows."""
    parts = []
    for train, test in time_folds(rows, n_folds, ts):
        parts.append(fit(rows.filter(train)).transform(rows.filter(test)).select(*rows.columns, score.alias(out)))
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    return done


def stack(oof: DataFrame, scores: list[str], label: str, kind: str = "logreg"):
    """Linear blend learnt on out-of-fold scores: logistic on the win, or ridge on the outcome."""
    va = VectorAssembler(inputCols=scores, outputCol="features")
    model = LogisticRegression(labelCol=label, regParam=1.0 / max(oof.count(), 1), maxIter=200) if kind == "logreg" else LinearRegression(labelCol=label, regParam=1.0 / max(oof.count(), 1))
    return Pipeline(stages=[va, model]).fit(oof)
