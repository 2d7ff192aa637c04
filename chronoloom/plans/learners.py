"""Learners behind one interface: closed-form ridge on aggregated Gram matrices, histogram trees, others from MLlib."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Cols = Sequence[str]


class Model(Protocol):
    def predict(self, df: DataFrame) -> DataFrame: ...

    def importance(self) -> dict[str, float]: ...


class Learner(Protocol):
    def fit(self, df: DataFrame, features: Cols, targets: Cols) -> Model: ...

    def params(self) -> dict: ...


def gram(df: DataFrame, features: Cols, targets: Cols) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'Y with an intercept column first, by one pass over complete rows; its size depends on columns only.

    Each partition sums its Arrow batches into one matrix, so the plan doesn't grow with the columns; the matrices are added up by cell.
    """
    names = list(dict.fromkeys([*features, *targets]))
    full = df.select(*[F.col(f"`{c}`").cast("double").alias(str(i)) for i, c in enumerate(names)]).na.drop()
    left, right = [names.index(c) for c in features], [names.index(c) for c in targets]
    p, width = len(left) + 1, len(left) + 1 + len(right)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, width))
        for b in batches:
            values = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            x = np.column_stack([np.ones(b.num_rows), *[values[i] for i in left]])
            total += x.T @ np.column_stack([x, *[values[i] for i in right]])
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(total.size), pa.int32()), "v": pa.array(total.ravel())})

    got = np.zeros(p * width)
    for r in full.mapInArrow(sums, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # one row for each cell
        got[r["cell"]] = r["v"]
    got = got.reshape(p, width)
    return got[:, :p], got[:, p:]


@dataclass
class LinearModel:
    features: list[str]
    targets: list[str]
    weights: np.ndarray  # (1 + features) x targets, intercept first

    def predict(self, df: DataFrame) -> DataFrame:
        """``{target}_hat`` columns: plain expressions, so scoring stays in generated code."""
        out = {}
        for j, t in enumerate(self.targets):
            e = F.lit(float(self.weights[0, j]))
            for i, c in enumerate(self.features):
                e = e + F.col(f"`{c}`") * float(self.weights[i + 1, j])
            out[f"{t}_hat"] = e
        return df.withColumns(out)

    def importance(self) -> dict[str, float]:
        return {c: float(np.abs(self.weights[i + 1]).mean()) for i, c in enumerate(self.features)}


@dataclass
class Ridge:
    """One solve for any number of targets; the intercept isn't penalised.

    The Gram matrix is solved with a unit diagonal: columns of large values would drown the intercept in their rounding.
    """

    penalty: float = 0.0

    def fit(self, df: DataFrame, features: Cols, targets: Cols) -> LinearModel:
        a, b = gram(df, features, targets)
        eye = np.eye(len(a)) * self.penalty
        eye[0, 0] = 0
        a = a + eye
        size = np.sqrt(np.diag(a))
        size = np.where(size > 0, size, 1.0)[:, None]
        return LinearModel(list(features), list(targets), np.linalg.lstsq(a / size / size.T, b / size, rcond=None)[0] / size)

    def params(self) -> dict:
        return {"penalty": self.penalty}


@dataclass
class MLlibModel:
    features: list[str]
    models: dict

    def predict(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        out = VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="keep").transform(df)
        for t, m in self.models.items():
            out = m.setPredictionCol(f"{t}_hat").transform(out)
        return out.drop("_features")

    def importance(self) -> dict[str, float]:
        total = sum(np.array(m.featureImportances.toArray()) for m in self.models.values()) / len(self.models)
        return dict(zip(self.features, map(float, total), strict=True))


@dataclass
class MLlibLearner:
    """One model for each target."""

    make: Callable
    defaults: dict
    given: dict = field(default_factory=dict)
    eval_col: str | None = None

    def fit(self, df: DataFrame, features: Cols, targets: Cols) -> MLlibModel:
        from pyspark.ml.feature import VectorAssembler

        full = df.na.drop(subset=[*features, *targets])
        wide = VectorAssembler(inputCols=list(features), outputCol="_features").transform(full)
        models = {}
        for t in targets:
            est = self.make(featuresCol="_features", labelCol=t, **(self.defaults | self.given))
            if self.eval_col:
                est = est.setValidationIndicatorCol(self.eval_col)
            models[t] = est.fit(wide)
        return MLlibModel(list(features), models)

    def params(self) -> dict:
        return self.defaults | self.given


def _gbt(**kw):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(**kw)


def _forest(**kw):
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(**kw)


def _boosting(**defaults):
    def make(**given):
        from chronoloom.plans.trees import Boosting

        return Boosting(**(defaults | given))

    return make


def _extra(**kw):
    from chronoloom.plans.trees import ExtraTrees

    return ExtraTrees(**kw)


#: Names, and the parameters that matter. Boosted trees are histogram trees of ``plans.trees``, forests MLlib's.
REGISTRY: dict[str, Callable[..., Learner]] = {
    "ridge": lambda **kw: Ridge(**kw),
    "ols": lambda **kw: Ridge(0.0),
    "lgb": _boosting(objective="mae", rounds=1000, rate=0.05, leaves=31, bins=31, l1=0.5, l2=0.5, row_share=0.8, feature_share=0.8, patience=100),
    "xgb": _boosting(objective="rmse", rounds=1000, rate=0.05, leaves=64, depth=6, bins=255, l2=1.0, rows=1, row_share=0.8, feature_share=0.8, patience=50),
    "cat": _boosting(objective="rmse", rounds=1000, rate=0.05, leaves=64, depth=6, bins=254, l2=3.0, rows=1, patience=50),
    "extra": _extra,
    "rf": lambda **kw: MLlibLearner(_forest, {"numTrees": 100, "maxDepth": 10, "seed": 42}, kw),
    "bagging": lambda **kw: MLlibLearner(_forest, {"numTrees": 30, "maxDepth": 12, "featureSubsetStrategy": "all", "seed": 42}, kw),
    "gbt": lambda **kw: MLlibLearner(_gbt, {"maxIter": 20, "seed": 42}, kw),
}
ALIASES = {"lightgbm": "lgb", "xgboost": "xgb", "catboost": "cat", "extratrees": "extra", "extra_trees": "extra", "randomforest": "rf", "random_forest": "rf", "linear": "ols"}


def list_models() -> list[str]:
    return sorted(REGISTRY)


def create(name: str, **params: object) -> Learner:
    key = ALIASES.get(name.lower(), name.lower())
    if key not in REGISTRY:
        raise ValueError(f"unsupported model {name}; there are {', '.join(list_models())}")
    return REGISTRY[key](**params)


def importance_table(spark, model: Model, top: int = 50) -> DataFrame:
    rows = sorted(model.importance().items(), key=lambda x: (-x[1], x[0]))[:top]
    return spark.createDataFrame(rows, "feature string, importance double")


def hybrid(df: DataFrame, trend: Cols, features: Cols, target: str, second: Learner) -> tuple[Model, Model, DataFrame]:
    """A linear model of the trend columns, and a second learner on its residuals; predictions add up in ``{target}_hybrid``."""
    first = Ridge().fit(df, trend, [target])
    rest = first.predict(df).withColumnRenamed(f"{target}_hat", "_trend").withColumn("_rest", F.col(target) - F.col("_trend"))
    model = second.fit(rest, features, ["_rest"])
    return first, model, model.predict(rest).withColumn(f"{target}_hybrid", F.col("_trend") + F.col("_rest_hat")).drop("_rest", "_rest_hat", "_trend")


def classifier(name: str, **kw):
    """Classifiers for stacking: logistic, rf, gbt from MLlib; adaboost, boosted stumps of ``plans.trees`` (``fit(df, features, label)``)."""
    from pyspark.ml import classification as c

    if name == "adaboost":
        from chronoloom.plans.trees import AdaBoost

        return AdaBoost(**kw)

    made = {"logistic": lambda: c.LogisticRegression(**kw), "rf": lambda: c.RandomForestClassifier(**({"numTrees": 100, "seed": 42} | kw)), "gbt": lambda: c.GBTClassifier(**({"maxIter": 20, "seed": 42} | kw))}
    if name not in made:
        raise ValueError(f"unsupported classifier {name}; there are adaboost, {', '.join(made)}")
    return made[name]()


def save(model: LinearModel, spark, path: str) -> None:
    rows = [("" if i == 0 else model.features[i - 1], t, float(model.weights[i, j])) for j, t in enumerate(model.targets) for i in range(len(model.features) + 1)]
    spark.createDataFrame(rows, "feature string, target string, weight double").write.mode("overwrite").parquet(path)


def load(spark, path: str) -> LinearModel:
    rows = spark.read.parquet(path).collect()  # one row for each weight
    targets = sorted({r.target for r in rows})
    features = sorted({r.feature for r in rows} - {""})
    by = {(r.feature, r.target): r.weight for r in rows}
    return LinearModel(features, targets, np.array([[by[f, t] for t in targets] for f in ["", *features]]))
