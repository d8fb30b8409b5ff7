"""Algorithms and metrics of the model layer, on Spark ML."""

from __future__ import annotations

import random
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkmill.errors import EngineError


#: Values of a target up to which rows are split value by value.
VALUES = 100


class ModelProblem(EngineError):
    """Training or prediction cannot be done."""


#: Algorithm names in lower case to an estimator and what it is for.
ALGORITHMS = {
    "randomforestclassifier": (C.RandomForestClassifier, "classification"), "decisiontreeclassifier": (C.DecisionTreeClassifier, "classification"), "logisticregression": (C.LogisticRegression, "classification"),
    "gradientboostingclassifier": (C.GBTClassifier, "classification"), "svc": (C.LinearSVC, "classification"), "randomforestregressor": (R.RandomForestRegressor, "regression"), "decisiontreeregressor": (R.DecisionTreeRegressor, "regression"),
    "linearregression": (R.LinearRegression, "regression"), "ridge": (R.LinearRegression, "regression"), "gradientboostingregressor": (R.GBTRegressor, "regression"), "kmeans": (K.KMeans, "clustering"),
}
MISSING = ("svr", "xgb", "lgbm", "lightgbm", "xgboost", "catboost")
#: Hyperparameters by the names that statements use.
PARAMETERS = {"n_estimators": ("numTrees", "maxIter"), "max_depth": ("maxDepth",), "learning_rate": ("stepSize",), "max_iter": ("maxIter",), "n_clusters": ("k",), "alpha": ("regParam",), "min_samples_leaf": ("minInstancesPerNode",), "random_state": ("seed",)}


def task_of(model_type: str) -> str:
    low = model_type.lower()
    return "regression" if low in ("regression", "forecasting", "time_series") else "clustering" if low in ("clustering", "anomaly_detection") else "classification"


def estimator(algorithm: str, task: str, parameters: dict):
    """An unknown algorithm is a random forest, or K-means for clustering."""
    low = algorithm.lower()
    if low.startswith(MISSING):
        raise ModelProblem(f"The backend of {algorithm} is not installed")
    default = {"classification": "randomforestclassifier", "regression": "randomforestregressor", "clustering": "kmeans"}[task]
    kind, for_task = ALGORITHMS.get(low, ALGORITHMS[default])
    if for_task != task:
        raise ModelProblem(f"{algorithm} does not do {task}")
    made = kind(featuresCol="_x", predictionCol="_p") if task == "clustering" else kind(featuresCol="_x", labelCol="_y", predictionCol="_p")
    known = {p.name for p in made.params}
    if "seed" in known:
        made._set(seed=42)
    for name, value in parameters.items():
        target = next((n for n in PARAMETERS.get(name, (name,)) if n in known), None)
        if target is None:
            raise ModelProblem(f"{algorithm} has no parameter {name}")
        param = made.getParam(target)
        made._set(**{target: param.typeConverter(float(value) if "." in str(value) else int(value)) if not isinstance(value, str) or value.replace(".", "", 1).isdigit() else value})
    return made


def prepared(df: DataFrame, features: list[str]) -> list:
    """Stages that make the vector _x: texts are indexed and one-hot encoded, numbers are taken as they are."""
    texts = [f for f in features if isinstance(df.schema[f].dataType, T.StringType)]
    stages: list = []
    if texts:
        stages.append(StringIndexer(inputCols=texts, outputCols=[f"_i_{f}" for f in texts], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"_i_{f}" for f in texts], outputCols=[f"_h_{f}" for f in texts]))
    stages.append(VectorAssembler(inputCols=[f"_h_{f}" if f in texts else f for f in features], outputCol="_x", handleInvalid="skip"))
    return stages


def split(df: DataFrame, key: str, target: str | None, share: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Rows to train on and rows to hold out, the same each time. Of each value of a target that has few values, the share with the
    smallest hashes of the key is trained on: their border is an approximate quantile of the hashes of that value, so that no group is
    held or sorted in one task. Without a target, or one of many values, the border is the share itself."""
    u = F.pmod(F.xxhash64(F.lit(42), key), F.lit(1_000_000)) / 1_000_000
    if target:
        borders = df.groupBy(F.col(target).alias("_value")).agg(F.percentile_approx(u, share, 10_000).alias("_border"), F.count(F.lit(1)).alias("_n")).limit(VALUES + 1).collect()
        if len(borders) <= VALUES:
            border = F.lit(share)
            for r in borders:
                border = F.when(F.col(target).eqNullSafe(F.lit(r._value)), F.lit(r._border)).otherwise(border)
            return df.where(u <= border), df.where(u > border)
    return df.where(u < share), df.where(u >= share)


def importances(model: PipelineModel, features: list[str]) -> dict[str, float]:
    """Share of each feature in what a fitted model goes by: a tree's importances, or the sizes of coefficients; parts of a text feature add up."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    fitted = next(s for s in model.stages if s.hasParam("predictionCol"))
    if hasattr(fitted, "featureImportances"):
        values = list(fitted.featureImportances.toArray())
    elif hasattr(fitted, "coefficientMatrix"):
        values = list(abs(fitted.coefficientMatrix.toArray()).sum(axis=0))
    elif hasattr(fitted, "coefficients"):
        values = list(abs(fitted.coefficients.toArray()))
    else:
        raise ModelProblem("This algorithm has no feature importances")
    sizes = {s.getOutputCols()[i]: n for s in model.stages if s.hasParam("inputCols") and hasattr(s, "categorySizes") for i, n in enumerate(s.categorySizes)}
    out, at = {}, 0
    for f, column in zip(features, assembler.getInputCols(), strict=True):
        n = sizes.get(column, 2) - 1 if column in sizes else 1
        out[f] = float(sum(values[at : at + n]))
        at += n
    total = sum(out.values()) or 1.0
    return {f: v / total for f, v in out.items()}


def fit(df: DataFrame, key: str, features: list[str], target: str | None, task: str, algorithm: str, parameters: dict) -> tuple[PipelineModel, dict]:
    """The fitted pipeline and its metrics on the part that was held out (on all rows if that part is empty)."""
    if task != "clustering":
        if target is None:
            raise ModelProblem("The feature set has no target")
        label = StringIndexer(inputCol=target, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip") if task == "classification" else None
        stages = ([label] if label else []) + prepared(df, features) + [estimator(algorithm, task, parameters)]
        df = df.where(F.col(target).isNotNull())
        df = df if label else df.withColumn("_y", F.col(target).cast("double"))
    else:
        stages = [*prepared(df, features), estimator(algorithm, task, parameters)]
    train, held = split(df, key, target)
    model = Pipeline(stages=stages).fit(train)
    return model, metrics(model, held if held.limit(1).count() else df, task)


def metrics(model: PipelineModel, df: DataFrame, task: str) -> dict:
    if task == "regression" and "_y" not in df.columns:
        raise ModelProblem("Rows to evaluate need _y")
    scored = model.transform(df).cache()
    out = {}
    if task == "classification":
        for name, metric in (("ACCURACY", "accuracy"), ("PRECISION", "weightedPrecision"), ("RECALL", "weightedRecall"), ("F1", "f1")):
            out[name] = MulticlassClassificationEvaluator(labelCol="_y", predictionCol="_p", metricName=metric).evaluate(scored)
        if scored.agg(F.max("_y")).first()[0] == 1.0:
            for name, metric in (("ROC_AUC", "areaUnderROC"), ("PR_AUC", "areaUnderPR")):
                out[name] = BinaryClassificationEvaluator(labelCol="_y", rawPredictionCol="rawPrediction", metricName=metric).evaluate(scored)
    elif task == "regression":
        for name, metric in (("MAE", "mae"), ("MSE", "mse"), ("RMSE", "rmse"), ("R2", "r2")):
            out[name] = RegressionEvaluator(labelCol="_y", predictionCol="_p", metricName=metric).evaluate(scored)
        out["MAPE"] = scored.where("_y <> 0").agg(F.avg(F.abs((F.col("_y") - F.col("_p")) / F.col("_y")))).first()[0] or 0.0
    else:
        try:
            out["SILHOUETTE"] = ClusteringEvaluator(featuresCol="_x", predictionCol="_p").evaluate(scored)
        except Exception as e:  # one cluster has no silhouette
            if "cluster" not in str(e):
                raise
            out["SILHOUETTE"] = 0.0
    scored.unpersist()
    return {k: float(v) for k, v in out.items()}


def predicted(model: PipelineModel, df: DataFrame, task: str) -> DataFrame:
    """df with prediction (label as it was, or number) and confidence."""
    if task == "regression" and "_y" not in df.columns:
        df = df.withColumn("_y", F.lit(0.0))
    scored = PipelineModel([s for s in model.stages if not (task == "classification" and getattr(s, "getOutputCol", lambda: "")() == "_y")]).transform(df)
    value, confidence = F.col("_p"), F.lit(1.0)
    if task == "classification":
        labels = next(s.labels for s in model.stages if s.hasParam("outputCol") and s.isSet("outputCol") and s.getOutputCol() == "_y")
        value = F.element_at(F.array(*(F.lit(x) for x in labels)), F.col("_p").cast("int") + 1)
        if "probability" in scored.columns:
            confidence = F.array_max(vector_to_array("probability"))
    return scored.withColumn("prediction", value.cast("string")).withColumn("confidence", confidence.cast("double"))


def trials(space: dict[str, str], strategy: str, n: int) -> list[dict]:
    """Settings to try: a..b gives numbers of a range, x,y,z a choice; GRID crosses them (5 steps of a range), others draw at random."""

    def steps(spec: str) -> list:
        if ".." in spec:
            a, b = spec.split("..")
            if "." in a.strip(".") or "." in b:
                return [float(a) + (float(b) - float(a)) * i / 4 for i in range(5)]
            return sorted({round(int(a) + (int(b) - int(a)) * i / 4) for i in range(5)})
        return [x.strip() for x in spec.split(",")]

    if strategy.upper() == "GRID":
        return [dict(zip(space, values, strict=True)) for values in product(*(steps(str(s)) for s in space.values()))][:n]
    r = random.Random(42)

    def draw(spec: str) -> object:
        if ".." in spec:
            a, b = spec.split("..")
            return r.uniform(float(a), float(b)) if "." in a or "." in b else r.randint(int(a), int(b))
        return r.choice(steps(spec))

    return [{k: draw(str(s)) for k, s in space.items()} for _ in range(n)]
