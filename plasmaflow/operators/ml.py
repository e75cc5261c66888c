"""Learned calling with MLlib: features, selection, models, ensembles, evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plasmaflow.operators import multiple, quantiles
from plasmaflow.operators.lineage import cut
from plasmaflow.operators.metrics import keyed_number

BASIC = ["family_size", "mean_quality", "consensus_agreement"]
DERIVED = ["size_per_quality", "agreement_af", "log_size", "root_quality", "size_z", "quality_per_size", "agreement_per_size", "size_quality", "large"]


def features(fams: DataFrame) -> DataFrame:
    """fams with the derived feature columns; missing agreement counts as 0."""
    stats = fams.agg(F.avg("family_size").alias("m__"), F.stddev_pop("family_size").alias("s__"))
    size, q, a = F.col("family_size").cast("double"), F.col("mean_quality"), F.coalesce("consensus_agreement", F.lit(0.0))
    out = fams.join(F.broadcast(stats)).withColumn("consensus_agreement", a)
    columns = [size / (q + 1), a * F.col("allele_fraction"), F.log1p(size), F.sqrt(q), (size - F.col("m__")) / (F.col("s__") + 1e-8), q / size, a / size, size * q, (size >= 3).cast("double")]
    return out.withColumns(dict(zip(DERIVED, columns, strict=True))).drop("m__", "s__")


def assembled(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return VectorAssembler(inputCols=columns or BASIC + DERIVED, outputCol="features", handleInvalid="skip").transform(df)


def select_anova(df: DataFrame, top: int, label: str = "label") -> list[int]:
    selector = UnivariateFeatureSelector(featuresCol="features", labelCol=label, outputCol="selected", selectionMode="numTopFeatures")
    return sorted(selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(top).fit(df).selectedFeatures)


def scaled(df: DataFrame) -> DataFrame:
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(df).transform(df)


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """weight 1 / share of positives for positives where that share is under 1 %, else 1."""
    share = df.agg(F.avg(F.col(label).cast("double")).alias("share__"))
    rare = (F.col("share__") < 0.01) & (F.col("share__") > 0) & (F.col(label) == 1)
    return df.join(F.broadcast(share)).withColumn("weight", F.when(rare, 1 / F.col("share__")).otherwise(1.0)).drop("share__")


def estimator(kind: str, seed: int = 0, trees: int = 100, depth: int = 10, rounds: int = 100, round_depth: int = 5):
    """rf (`trees` of `depth`), gbt (`rounds` of `round_depth`), lr or svm."""
    common = {"featuresCol": "features", "labelCol": "label"}
    return {
        "rf": lambda: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **common),
        "gbt": lambda: GBTClassifier(maxIter=rounds, maxDepth=round_depth, seed=seed, **common),
        "lr": lambda: LogisticRegression(regParam=0.01, **common),
        "svm": lambda: LinearSVC(regParam=0.01, maxIter=20, **common),
    }[kind]()


def train(df: DataFrame, kind: str, seed: int = 0, **sizes: int):
    return Pipeline(stages=[estimator(kind, seed, **sizes)]).fit(df)


def probability(model, df: DataFrame, name: str = "score") -> DataFrame:
    """df with the model's probability of label 1; a margin becomes one by the logistic function."""
    scored = model.transform(df)
    value = vector_to_array("probability")[1] if "probability" in scored.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return scored.withColumn(name, value).drop("probability", "rawPrediction", "prediction")


def ensemble(models: dict[str, tuple[object, float]], df: DataFrame) -> DataFrame:
    """df with the mean of the models' probabilities, weighted (by their validation AUC)."""
    out, total = df, sum(w for _, w in models.values())
    for name, (model, _) in models.items():
        out = probability(model, out, f"p_{name}")
    return out.withColumn("score", sum((F.col(f"p_{n}") * (w / total) for n, (_, w) in models.items()), F.lit(0.0)))


def call(scored: DataFrame, threshold: float | None = None) -> DataFrame:
    """is_call where score > threshold (the median score by default), p_value = 1 - score."""
    if threshold is not None:
        return scored.withColumns({"threshold": F.lit(float(threshold)), "is_call": F.col("score") > threshold, "p_value": 1 - F.col("score")})
    limit = quantiles.exact(scored, "score", {"threshold": 0.5})
    return scored.join(F.broadcast(limit)).withColumn("is_call", F.col("score") > F.col("threshold")).withColumn("p_value", 1 - F.col("score"))


def feature_sql(mean: float, sd: float) -> str:
    """The columns of `features` as one statement with the training rows' mean and deviation in it, so that a stream can be scored too."""
    size, quality, agreement = "cast(family_size as double)", "mean_quality", "coalesce(consensus_agreement, 0.0)"
    forms = [f"{size} / ({quality} + 1)", f"{agreement} * allele_fraction", f"log1p({size})", f"sqrt({quality})", f"({size} - {mean!r}D) / ({sd!r}D + 1e-8D)", f"{quality} / {size}", f"{agreement} / {size}", f"{size} * {quality}", f"cast({size} >= 3 as double)"]
    return f"SELECT *, {agreement} AS agreement, " + ", ".join(f"{f} AS {n}" for f, n in zip(forms, DERIVED, strict=True)) + " FROM __THIS__"


def fit_caller(fams: DataFrame, kind: str = "lr", seed: int = 0, **sizes: int) -> PipelineModel:
    """A caller from families (with label): features, vector and classifier in one model that can be saved."""
    mean, sd = fams.agg(F.avg("family_size"), F.stddev_pop("family_size")).first()
    columns = ["agreement" if c == "consensus_agreement" else c for c in BASIC + DERIVED]
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[SQLTransformer(statement=feature_sql(float(mean or 0.0), float(sd or 0.0))), assembler, estimator(kind, seed, **sizes)]).fit(fams)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def call_families(model: PipelineModel, fams: DataFrame, threshold: float) -> DataFrame:
    """fams, a table or a stream, with score, is_call and p_value of a saved model."""
    return call(probability(model, fams).drop("features", "agreement", *DERIVED), threshold)


def evaluate(scored: DataFrame, threshold: float = 0.5) -> dict[str, float]:
    """AUC, average precision, and weighted precision, recall and F1 at a threshold."""
    rows = cut(scored.select("label", "score"))
    df = rows.select(F.col("label").cast("double").alias("label"), (F.col("score") > threshold).cast("double").alias("prediction"))
    ranks = {"auc": multiple.roc_auc(rows).first()[0], "average_precision": multiple.average_precision(rows).first()[0]}
    return ranks | {m: MulticlassClassificationEvaluator(metricName=m).evaluate(df) for m in ("weightedPrecision", "weightedRecall", "f1")}


def importances(model) -> list[float]:
    """A model's feature importances; for linear models the absolute coefficients."""
    last = model.stages[-1]
    return [float(v) for v in (last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray()))]


def importance(spark, models: dict[str, tuple[object, float]], names: list[str]) -> DataFrame:
    """feature, the importance by each model (name to model and weight), and their weighted mean as importance."""
    total = sum(w for _, w in models.values())
    each = {n: importances(m) for n, (m, _) in models.items()}
    rows = [(f, *(each[n][i] for n in models), sum(each[n][i] * w for n, (_, w) in models.items()) / total) for i, f in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, " + "".join(f"{n} double, " for n in models) + "importance double")


def split(df: DataFrame, key: list[str], share: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows by a keyed hash, whatever the partitioning."""
    inside = keyed_number(*key, seed=seed) % 1000 < int(share * 1000)
    return df.where(inside), df.where(~inside)
