"""Model quality from a table of predictions, as Spark aggregates."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.functions.values import quote
from gritstone.runtime import small_frame

# Score and overfit limits of the model review, per task.
REVIEW_LIMITS = {"classification": (0.92, 0.12), "regression": (0.85, 0.15)}
OVERFIT_ALLOWANCE = 0.12
MAX_CLASSES = 1_000


def label_pairs(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) as text: at most classes x classes rows."""
    pairs = df.selectExpr(
        f"cast({quote(actual)} as string) as actual", f"cast({quote(predicted)} as string) as predicted"
    )
    return pairs.where("actual is not null").groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def classification_metrics(
    df: DataFrame, actual: str, predicted: str, score: str | None = None
) -> DataFrame:
    """(metric, value): accuracy, support-weighted F1 and, with a score of class 1, AUC."""
    pairs = label_pairs(df, actual, predicted)
    # One row per label: correct predictions, support and number of predictions.
    by_label = (
        pairs.selectExpr("actual as label", "if(actual = predicted, n, 0) as hit", "n as support", "0 as named")
        .unionByName(pairs.selectExpr("predicted as label", "0 as hit", "0 as support", "n as named"))
        .groupBy("label")
        .agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("named").alias("named"))
    )
    f1 = "if(hit = 0, 0D, 2D * hit / (support + named))"
    wide = by_label.selectExpr(
        "sum(hit) / sum(support) as accuracy", f"sum({f1} * support) / sum(support) as f1"
    )
    found = wide.selectExpr("stack(2, 'accuracy', accuracy, 'f1', f1) as (metric, value)")
    if score is None:
        return found
    auc = area_under_curve(df, actual, score)
    extra = small_frame(df.sparkSession, [("auc", auc)], "metric string, value double")
    return found.unionByName(extra)


def area_under_curve(df: DataFrame, actual: str, score: str) -> float:
    """Area under the ROC curve; ``actual`` holds 0 and 1."""
    pairs = df.selectExpr(f"cast({quote(actual)} as double) as label", f"cast({quote(score)} as double) as score")
    # Rows with equal score and label are combined, so a common score is one record per task.
    combined = pairs.groupBy("label", "score").agg(F.count("*").cast("double").alias("weight"))
    evaluator = BinaryClassificationEvaluator(
        labelCol="label", rawPredictionCol="score", weightCol="weight", numBins=0
    )
    return evaluator.evaluate(combined)


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(metric, value): RMSE, MAE and R2."""
    pairs = df.selectExpr(f"cast({quote(actual)} as double) as a", f"cast({quote(predicted)} as double) as p")
    wide = pairs.where("a is not null").selectExpr(
        "sqrt(avg((a - p) * (a - p))) as rmse",
        "avg(abs(a - p)) as mae",
        "1 - sum((a - p) * (a - p)) / nullif(var_pop(a) * count(a), 0) as r2",
    )
    return wide.selectExpr("stack(3, 'rmse', rmse, 'mae', mae, 'r2', r2) as (metric, value)")


def metrics_from_predictions(
    df: DataFrame, actual: str, predicted: str, task: str, score: str | None = None
) -> DataFrame:
    if task == "classification":
        return classification_metrics(df, actual, predicted, score)
    return regression_metrics(df, actual, predicted)


def confusion_matrix(df: DataFrame, actual: str, predicted: str, max_classes: int = MAX_CLASSES) -> DataFrame:
    """Rows ``actual``, one ``pred_<label>`` column per actual label, sorted, zero filled.

    More than ``max_classes`` labels are refused, as each is a column; ``label_pairs`` holds the counts in long form.
    """
    pairs = label_pairs(df, actual, predicted)
    labels = [r["actual"] for r in pairs.select("actual").distinct().orderBy("actual").limit(max_classes + 1).collect()]
    if len(labels) > max_classes:
        raise ValueError(f"There are more than max_classes = {max_classes} labels.")
    wide = pairs.groupBy("actual").pivot("predicted", labels).sum("n")
    cells = [f"coalesce({quote(v)}, 0) as {quote(f'pred_{v}')}" for v in labels]
    return wide.selectExpr("actual", *cells).orderBy("actual")


def penalized_score(train: float, test: float) -> float:
    """Test score less the part of the overfit gap beyond the allowance."""
    return test - max(0.0, (train - test) - OVERFIT_ALLOWANCE)


def review_gate(comparisons: DataFrame) -> DataFrame:
    """Add ``needs_improvement`` and ``reason`` to (task_type, test_score, overfit_gap) rows."""
    good = " or ".join(
        f"(task_type = '{task}' and test_score >= {score}D and overfit_gap <= {gap}D)"
        for task, (score, gap) in REVIEW_LIMITS.items()
    )
    return comparisons.selectExpr(
        "*",
        f"not ({good}) as needs_improvement",
        f"concat(task_type, if({good}, ' score is strong and overfit gap is controlled',"
        " ' score or overfit gap needs improvement')) as reason",
    )


def leaderboard(runs: DataFrame) -> DataFrame:
    """Rank runs by key metric: auc, accuracy, f1 or r2, rmse, mae; errors count negated."""
    choice = {
        "classification": ("auc", "accuracy", "f1"),
        "regression": ("r2", "rmse", "mae"),
    }
    label = "case " + " ".join(
        f"when (task_type = 'classification') = {str(task == 'classification').lower()}"
        f" and {m} is not null then '{m}'"
        for task, names in choice.items()
        for m in names
    )
    fallback = " else if(task_type = 'classification', 'f1', 'mae') end"
    value = (
        "case key_metric "
        + " ".join(f"when '{m}' then {'-' if m in {'rmse', 'mae'} else ''}{m}" for names in choice.values() for m in names)
        + " end"
    )
    ranked = runs.selectExpr("*", f"{label}{fallback} as key_metric")
    scored = ranked.selectExpr("*", f"coalesce({value}, double('-inf')) as key_value")
    return scored.orderBy(F.col("key_value").desc(), "id")
