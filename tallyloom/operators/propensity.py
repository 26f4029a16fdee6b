"""Purchase propensity: user features, class weights, and pyspark.ml pipelines."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.schema import Config

FEATURES = ("pv_cnt", "cart_cnt", "fav_cnt", "category_diversity", "item_diversity")


def user_features(log: DataFrame, leak_free: bool = False) -> DataFrame:
    """Counts per behavior, distinct categories and items, and label 1.0 for users who bought.

    Diversity over all behaviors includes the purchases that make the label; leak_free counts it without them.
    """
    seen = F.col("behavior") != "buy" if leak_free else F.lit(True)
    count = lambda b: F.count_if(F.col("behavior") == b)
    per = log.groupBy("user_id").agg(
        count("pv").alias("pv_cnt"),
        count("cart").alias("cart_cnt"),
        count("fav").alias("fav_cnt"),
        count("buy").alias("buy_cnt"),
        F.countDistinct(F.when(seen, F.col("category"))).alias("category_diversity"),
        F.countDistinct(F.when(seen, F.col("item_id"))).alias("item_diversity"),
    )
    return per.withColumn("label", F.when(F.col("buy_cnt") > 0, 1.0).otherwise(0.0))


def with_class_weight(features: DataFrame) -> DataFrame:
    """features with class_weight total / (2 n) of the row's class, from one aggregate row; an empty class counts as 1."""
    totals = features.agg(F.count(F.lit(1)).alias("_all"), F.greatest(F.count_if(F.col("label") == 0), F.lit(1)).alias("_neg"), F.greatest(F.count_if(F.col("label") == 1), F.lit(1)).alias("_pos"))
    weight = F.col("_all").cast("double") / (2 * F.when(F.col("label") == 1, F.col("_pos")).otherwise(F.col("_neg")))
    return features.join(F.broadcast(totals), F.lit(True)).withColumn("class_weight", weight).drop("_all", "_neg", "_pos")


def split(features: DataFrame, train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the user: the same whatever the partitioning."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("user_id")), F.lit(1_000_000)) / 1_000_000
    marked = features.withColumn("_place", place)
    return marked.filter(F.col("_place") < train).drop("_place"), marked.filter(F.col("_place") >= train).drop("_place")


def _pipeline(classifier) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(FEATURES), outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features", withStd=True, withMean=True),
            classifier,
        ]
    )


def logistic_regression(config: Config | None = None) -> Pipeline:
    c = config or Config()
    return _pipeline(LogisticRegression(featuresCol="features", labelCol="label", weightCol="class_weight", maxIter=c.ml_max_iter, regParam=c.ml_reg_param))


def random_forest(trees: int = 100, depth: int = 5, seed: int = 42) -> Pipeline:
    return _pipeline(RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="class_weight", numTrees=trees, maxDepth=depth, seed=seed))


def metrics(predictions: DataFrame) -> dict[str, float]:
    """Accuracy and area under ROC."""
    return {
        "accuracy": MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="accuracy").evaluate(predictions),
        "auc": BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", metricName="areaUnderROC").evaluate(predictions),
    }


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("cnt")).orderBy("label", "prediction")


def save_best(models: dict[str, PipelineModel], test: DataFrame, path: str) -> str:
    """Saves the model with the greatest area under ROC and returns its name."""
    name = max(models, key=lambda k: metrics(models[k].transform(test))["auc"])
    models[name].write().overwrite().save(path)
    return name
