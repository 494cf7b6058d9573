"""Regression learners on series features: forest and elastic net by MLlib, boosting by ``boosting``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.config import DEFAULT
from loadloom.functions import aggregates as A
from loadloom.operators import boosting

# Candidate settings tried on the validation rows.
GRIDS = {
    "forest": {"featureSubsetStrategy": ("onethird", "sqrt")},
    "elastic": {"regParam": (0.001, 0.01, 0.1)},
}


def _estimator(kind: str, label: str, seed: int, **params):
    if kind == "forest":
        return RandomForestRegressor(featuresCol="_x", labelCol=label, predictionCol="_p", numTrees=params.pop("numTrees", 40), seed=seed, **params)
    if kind == "elastic":
        return LinearRegression(featuresCol="_x", labelCol=label, predictionCol="_p", elasticNetParam=0.5, **params)
    raise ValueError(f"unknown learner {kind!r}")


def complete_cases(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    return df.dropna(subset=[*features, y])


def design(train: DataFrame, features: Sequence[str]):
    """Median imputation fitted on the training rows only, then one vector column."""
    filled = [f"_f_{c}" for c in features]
    imputer = Imputer(strategy="median", inputCols=list(features), outputCols=filled)
    return Pipeline(stages=[imputer, VectorAssembler(inputCols=filled, outputCol="_x", handleInvalid="keep")]).fit(train)


def fit_regressor(kind: str, train: DataFrame, val: DataFrame, test: DataFrame, features: Sequence[str], y: str,
                  log=True, grid: dict | None = None, seed=DEFAULT.seed, **fixed):
    """Pick settings by validation MAE, refit on train and validation, predict the test rows.

    With boosting (``gbt``) the validation rows also stop the rounds, and the settings are chosen by the validation
    RMSE of the target that the trees fit. Returns (test with ``pred``, chosen settings, final model).
    """
    if kind == "gbt":
        settings = [boosting.Setting(**dict(zip(grid, v))) for v in product(*grid.values())] if grid else None
        model = boosting.fit(train, val, features, y, settings, log=log, seed=seed, **fixed)[0]
        return model.predict(test, log=log), dict(vars(model.setting), rounds=len(model.trees)), model
    prep = design(train, features)
    target = F.log1p(y) if log else F.col(y)

    def ready(df):
        return prep.transform(df.withColumns({c: F.col(c).cast("double") for c in features})).withColumn("_y", target)

    def predict(model, df):
        p = F.expm1("_p") if log else F.col("_p")
        return model.transform(df).withColumn("pred", F.greatest(F.lit(0.0), p))

    tr = ready(train.where(F.col(y).isNotNull())).withColumn("_val", F.lit(False))
    va = ready(val.where(F.col(y).isNotNull())).withColumn("_val", F.lit(True))
    both = tr.unionByName(va).persist()
    options = grid if grid is not None else GRIDS[kind]
    best = None
    try:
        for values in product(*options.values()):
            params = dict(zip(options, values))
            model = _estimator(kind, "_y", seed, **params, **fixed).fit(both.where(~F.col("_val")))
            score = predict(model, both.where("_val")).agg(A.mae(y, "pred").alias("s")).first()["s"]
            if score is not None and (best is None or score < best[0]):
                best = (score, params, model)
        if best is None:
            raise ValueError("no candidate has a validation score: the validation rows are empty")
        model = _estimator(kind, "_y", seed, **best[1], **fixed).fit(both)
    finally:
        both.unpersist()
    keep = test.columns
    return predict(model, ready(test)).select(*keep, "pred"), best[1], model


def importance(model, features: Sequence[str], spark) -> DataFrame:
    scores = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(s)) for f, s in zip(features, scores)], "feature string, importance double")


def rolling_origin(df: DataFrame, date: str, cutoffs: Sequence[str], fit: Callable[[DataFrame, DataFrame], DataFrame],
                   horizon=DEFAULT.cv_horizon, calibration_days=90) -> DataFrame:
    """Refit at every cutoff on the earlier rows and predict the next ``horizon`` days.

    ``fit(train, test) -> test with pred``. Each fold also carries the start of
    its calibration window.
    """
    out = None
    for i, cut in enumerate(cutoffs):
        c = F.lit(cut).cast("date")
        train = df.where(F.col(date) <= c)
        test = df.where((F.col(date) > c) & (F.col(date) <= F.date_add(c, horizon)))
        pred = fit(train, test).withColumn("fold", F.lit(i + 1)).withColumn("calibration_start", F.date_sub(c, calibration_days - 1))
        out = pred if out is None else out.unionByName(pred)
    return out


def group_mean_model(train: DataFrame, test: DataFrame, y: str, keys: Sequence[str], out="pred") -> DataFrame:
    """Mean of the training rows with the same keys (for example month and weekday)."""
    means = train.groupBy(*keys).agg(F.avg(y).alias(out))
    return test.join(means, list(keys), "left")


def enough_rows(df: DataFrame, group: str, split="split", need=(("train", 200), ("val", 30), ("test", 5))) -> DataFrame:
    """Groups that have the minimum number of rows in every split."""
    n = df.groupBy(group).agg(*[F.count_if(F.col(split) == s).alias(s) for s, _ in need])
    return n.withColumn("usable", F.expr(" AND ".join(f"{s} >= {k}" for s, k in need)))
