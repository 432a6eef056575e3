"""Scores of predictions, computed where the predictions are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``label, prediction, n`` for the pairs that occur."""
    return scored.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 if there is no whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.when(whole == 0, F.lit(1)).otherwise(whole))


def classification_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``class, precision, recall, f1, support``: a row per class, then ``accuracy`` (in
    ``f1``), ``macro avg`` and ``weighted avg``. No rows for no predictions.

    The rows are scanned once; everything after the confusion counts is a handful of rows.
    """
    pairs = confusion_matrix(scored, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("class"), hit.alias("hits"), none.alias("predicted"), F.col("n").alias("support")),
        F.struct(F.col("prediction").alias("class"), none.alias("hits"), F.col("n").alias("predicted"), none.alias("support")),
    )
    sums = [F.sum(c).alias(c) for c in ("hits", "predicted", "support")]
    per_class = pairs.select(F.inline(sides)).groupBy("class").agg(*sums)
    per_class = per_class.select(
        F.col("class").cast("string").alias("class"),
        "hits",
        "support",
        _share(F.col("hits"), F.col("predicted")).alias("precision"),
        _share(F.col("hits"), F.col("support")).alias("recall"),
        _share(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
    )
    # Each class row feeds its own line and the three summary lines.
    line = F.explode(F.array(F.col("class"), F.lit("accuracy"), F.lit("macro avg"), F.lit("weighted avg")))
    lines = per_class.withColumn("line", line)
    summary = F.col("line")

    def average(c: str) -> Column:
        return (
            F.when(summary == "weighted avg", _share(F.sum(F.col(c) * F.col("support")), F.sum("support")))
            .when(summary == "accuracy", F.lit(None).cast("double"))
            .otherwise(F.avg(c))
        )

    accuracy = _share(F.sum("hits"), F.sum("support"))
    return lines.groupBy("line").agg(
        average("precision").alias("precision"),
        average("recall").alias("recall"),
        F.when(summary == "accuracy", accuracy).otherwise(average("f1")).alias("f1"),
        F.sum("support").alias("support"),
    ).withColumnRenamed("line", "class").orderBy(
        F.when(F.col("class") == "accuracy", 1).when(F.col("class") == "macro avg", 2).when(F.col("class") == "weighted avg", 3).otherwise(0),
        "class",
    )


def regression_metrics(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``rmse, mae, r2, n`` in one pass, over the rows that have both values."""
    scored = scored.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    error = a - p
    n = F.count(error)
    spread = F.var_pop(a) * n
    return scored.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.sum(error * error) / F.nullif(spread, F.lit(0.0))).alias("r2"),
        n.alias("n"),
    )


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> float:
    """Area under the ROC curve, exact (ties count half).

    Rows are reduced to one per distinct score before Spark's evaluator sorts them.
    """
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    groups = scored.groupBy(F.col(label).cast("double").alias("label"), F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="label", weightCol="weight", metricName="areaUnderROC", numBins=0
    )
    return evaluator.evaluate(groups)


def roc_auc_frame(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """:func:`roc_auc` with the class sizes, as one row."""
    auc = roc_auc(scored, label, score)
    positive = F.col(label) == 1
    return scored.agg(
        F.lit(auc).alias("auc"),
        F.count_if(positive).alias("n_positive"),
        F.count_if(~positive).alias("n_negative"),
    )
