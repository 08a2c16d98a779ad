"""Train, tune, evaluate, store and apply models with Spark ML.

Missing values and scaling are folded into one SQL transformer whose literals
come from the training rows, so a stored pipeline carries them with it.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions.values import as_text, is_number, quote, stable_hash, text_literal
from gritstone.operators import binned_trees, frequency
from gritstone.operators import features as feature_ops
from gritstone.operators.filters import filter_expression
from gritstone.operators.metrics import (
    MAX_CLASSES,
    REVIEW_LIMITS,
    area_under_curve,
    metrics_from_predictions,
    penalized_score,
    review_gate,
)
from gritstone.operators.normalize import normalize, require_columns, types_of
from gritstone.operators.preparation import FOLD, Preparation, prepare_views
from gritstone.operators.split import Split, train_test_split
from gritstone.operators.tuning import MAX_FOLDS, STORAGE, GridSearch, grid_points, grid_search, score
from gritstone.runtime import small_frame, spread

MIN_ROWS = 5
# Depth that stands for "unlimited"; trees double in size with every level.
DEFAULT_DEPTH = 12
# One-vs-rest fits that run side by side.
CLASSES_AT_ONCE = 16

# Default and allowed parameters, tuning grids.
ALLOWED = {
    "logistic_regression": {"C", "max_iter", "class_weight"},
    "linear_regression": {"fit_intercept"},
    "random_forest": {"n_estimators", "max_depth", "min_samples_leaf", "class_weight"},
    "gradient_boosting": {"n_estimators", "learning_rate", "max_depth"},
}
GRIDS = {
    "random_forest": {"n_estimators": [80, 140], "max_depth": [None, 6, 12]},
    "gradient_boosting": {"n_estimators": [80, 140], "learning_rate": [0.05, 0.1], "max_depth": [2, 3]},
    "logistic_regression": {"C": [0.3, 1.0, 3.0]},
}
STAGED_GRIDS = {**GRIDS, "random_forest": {**GRIDS["random_forest"], "min_samples_leaf": [1, 3]}}
RUN_SCHEMA = (
    "id string, target string, features string, task_type string, model_type string, hyperparameters string,"
    " filter_expression string, use_pca boolean, accuracy double, f1 double, auc double, rmse double, mae double,"
    " r2 double, feature_importances string, training_time_seconds double, created_at timestamp_ntz"
)


@dataclass
class ModelRun:
    """One trained model with its evaluation."""

    target: str
    features: list[str]
    task: str
    model_type: str
    model: PipelineModel
    params: dict
    metrics: dict[str, float | None]
    importances: list[tuple[str, float]]
    predictions: DataFrame | None
    split: Split | None
    train_score: float | None = None
    filter_expression: str = ""
    use_pca: bool = False
    search: GridSearch | None = None
    seconds: float = 0.0
    id: str = field(default_factory=lambda: f"model_{uuid.uuid4().hex[:10]}")
    created_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc).replace(tzinfo=None))

    def importance_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, n, v) for i, (n, v) in enumerate(self.importances, start=1)]
        return small_frame(spark, rows, "rank int, feature string, importance double")

    def metric_table(self, spark: SparkSession) -> DataFrame:
        return small_frame(spark, list(self.metrics.items()), "metric string, value double")

    def record(self) -> tuple:
        m = self.metrics
        return (
            self.id, self.target, json.dumps(self.features), self.task, self.model_type, json.dumps(self.params),
            self.filter_expression, self.use_pca, m.get("accuracy"), m.get("f1"), m.get("auc"), m.get("rmse"),
            m.get("mae"), m.get("r2"), json.dumps(self.importances), self.seconds, self.created_at,
        )


def validate_request(df: DataFrame, target: str, features: list[str]) -> None:
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' was not found.")
    if target in features:
        raise ValueError("The target cannot be one of the features.")
    if not features:
        raise ValueError("At least one feature is required.")
    require_columns(df, features)


def _estimator(model_type: str, task: str, params: dict, classes: int, rows: int):
    """The Spark estimator of a model family with public parameter names applied."""
    depth = int(params.get("max_depth") or DEFAULT_DEPTH)
    trees = int(params.get("n_estimators", 100))
    common = {"featuresCol": "features", "labelCol": "label", "predictionCol": "prediction"}
    if model_type == "logistic_regression":
        return LogisticRegression(
            maxIter=int(params.get("max_iter", 300)), regParam=_penalty(params.get("C", 1.0), rows),
            standardization=False, **common,
        )
    if model_type == "linear_regression":
        return LinearRegression(fitIntercept=bool(params.get("fit_intercept", True)), **common)
    if model_type == "gradient_boosting":
        boosted = {
            "maxIter": trees, "maxDepth": int(params.get("max_depth") or 3), "seed": 42,
            "stepSize": float(params.get("learning_rate", 0.1)), **common,
        }
        if task == "regression":
            return GBTRegressor(**boosted)
        classifier = GBTClassifier(**boosted)
        # Classes are fitted side by side on one persisted table.
        return classifier if classes <= 2 else OneVsRest(classifier=classifier, parallelism=min(classes, CLASSES_AT_ONCE), **common)
    forest = {
        "numTrees": trees, "maxDepth": depth, "seed": 42,
        "minInstancesPerNode": int(params.get("min_samples_leaf", 1)), **common,
    }
    if task == "regression":
        return RandomForestRegressor(featureSubsetStrategy="all", **forest)
    return RandomForestClassifier(featureSubsetStrategy="sqrt", **forest)


def _penalty(strength: float, rows: int) -> float:
    """Ridge penalty per row of an inverse regularisation strength."""
    return 1.0 / (float(strength) * max(rows, 1))


def feature_names(vectors: DataFrame, plan: Preparation | None) -> list[str]:
    """Names of the entries of ``features``, from the metadata that the stages attached to the column."""
    attached = vectors.schema["features"].metadata["ml_attr"]
    names = [str(i) for i in range(attached["num_attrs"])]
    for group in attached.get("attrs", {}).values():
        for a in group:
            names[a["idx"]] = a.get("name", names[a["idx"]])
    return names if plan is None else [plan.shown(n) for n in names]


def _importances(model, names: list[str], top: int) -> list[tuple[str, float]]:
    if hasattr(model, "featureImportances"):
        raw = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        raw = abs(model.coefficientMatrix.toArray()[0])
    elif hasattr(model, "coefficients"):
        raw = abs(model.coefficients.toArray())
    elif hasattr(model, "models"):
        raw = sum(m.featureImportances.toArray() for m in model.models) / len(model.models)
    else:
        raw = [0.0] * len(names)
    scored = sorted(zip(names, map(float, raw)), key=lambda item: -item[1])
    return scored[:top]


def train(
    df: DataFrame,
    target: str,
    features: list[str] | None = None,
    task: str = "auto",
    model: str = "random_forest",
    params: dict | None = None,
    filter_expr: str = "",
    pca: int | None = None,
    tune: bool | dict = False,
    key: list[str] | str | None = None,
    top: int = 30,
    prepared: bool = False,
    split: Split | None = None,
    hash_above: int | None = None,
    max_classes: int = MAX_CLASSES,
) -> ModelRun:
    """Train one model on 80 % of the rows and evaluate it on the rest.

    ``tune`` searches the default grid, or the grid passed in its place.
    ``prepared`` marks features that are already numeric and scaled. Categories become one column each (in sparse
    vectors); ``hash_above`` instead hashes features with more distinct values to a fixed width.
    """
    started = time.perf_counter()
    chosen = [c for c in df.columns if c != target] if features is None else list(features)
    validate_request(df, target, chosen)
    data = filter_expression(df, filter_expr)
    keys = [key] if isinstance(key, str) else list(key or [])
    data = normalize(data).select(*[quote(c) for c in dict.fromkeys([*chosen, target, *keys])])
    data = data.where(f"{quote(target)} is not null")
    if split is None and not prepared:
        data = spread(data)
    kind = feature_ops.infer_task(data, target) if task == "auto" else task
    if kind == "regression" and not is_number(types_of(data)[target]):
        raise ValueError("Regression needs a numeric target.")
    family = model if model in ALLOWED else "random_forest"
    if (family, kind) in {("logistic_regression", "regression"), ("linear_regression", "classification")}:
        family = "random_forest"
    used = {k: v for k, v in (params or {}).items() if k in ALLOWED[family]}
    split = split or train_test_split(data, keys or None, target if kind == "classification" else None)
    if split.rows_total < MIN_ROWS:
        raise ValueError(f"Training needs at least {MIN_ROWS} rows.")
    train_rows = split.rows_total - split.rows_test
    labels: list[str] = []
    smallest = train_rows
    if kind == "classification":
        found = frequency.values_up_to(split.train, [target], max_classes)
        if target not in found:
            raise ValueError(f"The target has more than max_classes = {max_classes} classes.")
        labels = sorted(found[target])
        smallest = min(found[target].values(), default=0)
        label = f"{_label_sql(target, data, labels)} AS label"
    else:
        label = f"CAST({quote(target)} AS DOUBLE) AS label"
    grid = tune if isinstance(tune, dict) else GRIDS.get(family, {}) if tune else {}
    folds = min(MAX_FOLDS, train_rows, smallest) if grid else 1
    folds = folds if folds >= 2 else 0
    place = stable_hash("'fold'", *[quote(k) for k in (keys or data.columns)])
    rows = split.train.selectExpr("*", f"cast(pmod({place}, {max(folds, 1)}) as int) as {FOLD}")
    views = [None] * (folds + 1) if prepared else prepare_views(rows, chosen, folds, pca, hash_above)
    pipelines = []
    for v, view in enumerate(views):
        stages = view.stages() if view else [VectorAssembler(inputCols=chosen, outputCol="features")]
        stages.append(SQLTransformer(statement=f"SELECT *, {label} FROM __THIS__"))
        pipelines.append(Pipeline(stages=stages).fit(rows.where(f"{FOLD} <> {v - 1}") if v else rows))
    prepare = pipelines[0]
    balanced = used.get("class_weight") == "balanced"

    def weigh(vectors: DataFrame) -> DataFrame:
        if not balanced:
            return vectors
        counts = {r.label: r["count"] for r in vectors.groupBy("label").count().collect()}
        total = sum(counts.values())
        weights = " ".join(f"when {l}D then {total / (len(counts) * n)}D" for l, n in counts.items())
        return vectors.withColumn("__weight", F.expr(f"case label {weights} end"))

    def build(point: dict, n: int):
        estimator = _estimator(family, kind, {**used, **point}, len(labels), n)
        return estimator.setWeightCol("__weight") if balanced else estimator

    search = fitted = train_score = None
    vectors = prepare.transform(rows).select("features", "label")
    if folds:
        # Points that mean the same are tried once.
        points = {json.dumps({**p, **({"max_depth": p["max_depth"] or DEFAULT_DEPTH} if "max_depth" in p else {})}): p for p in grid_points(grid)}
        tried = list(points.values())
        layouts = [binned_trees.blocks_of(view, chosen) for view in views]
        estimators = [build(p, train_rows) for p in tried]
        scored = None
        if kind == "regression" and not balanced and all(layouts) and all(binned_trees.fits(e, train_rows, len(layouts[0])) for e in estimators):
            prepared_rows = [(p.transform(rows), blocks) for p, blocks in zip(pipelines, layouts, strict=True)]
            scored = binned_trees.search_folds(estimators, prepared_rows[1:], train_rows)
        search = GridSearch(tried, scored) if scored else grid_search(rows, pipelines[1:], weigh, build, kind, tried)
        used = {**used, **search.points[search.best]}
        if scored:
            fitted, train_score = binned_trees.fit_trees(build({}, train_rows), *prepared_rows[0], train_rows)
    if fitted and train_score is None:
        train_score = score(fitted.transform(vectors), kind)
    elif not fitted:
        # Iterative learners read the vectors many times; lost blocks are rebuilt from the source.
        ready = weigh(vectors).persist(STORAGE)
        try:
            fitted = build({}, train_rows).fit(ready)
            train_score = score(fitted.transform(ready), kind)
        finally:
            ready.unpersist()
    tail: list = [fitted]
    if kind == "classification":
        tail.append(IndexToString(inputCol="prediction", outputCol="predicted", labels=labels))
    else:
        tail.append(SQLTransformer(statement="SELECT *, prediction AS predicted FROM __THIS__"))
    pipeline = PipelineModel([*prepare.stages, *tail])
    run = ModelRun(
        target, chosen, kind, family, pipeline, used, {}, [], None, split, train_score, filter_expr, pca is not None
    )
    run.predictions = predict(run, split.test)
    two = len(labels) == 2 and "score" in run.predictions.columns
    binary = run.predictions
    if two:
        binary = run.predictions.withColumn("is_second", F.expr(f"int(actual = {text_literal(labels[1])})"))
    run.metrics = {r.metric: r.value for r in metrics_from_predictions(binary, "actual", "prediction", kind).collect()}
    if two:
        run.metrics["auc"] = area_under_curve(binary, "is_second", "score")
    if search:
        run.metrics["tuning_score"] = search.scores[search.best]
        run.search = search
    run.importances = _importances(fitted, feature_names(vectors, views[0]), top)
    run.seconds = round(time.perf_counter() - started, 4)
    return run


def _label_sql(target: str, data: DataFrame, labels: list[str]) -> str:
    """Index of the target's label; labels unseen in training get the next index."""
    text = as_text(quote(target), types_of(data)[target])
    listed = ", ".join(text_literal(v) for v in labels)
    return f"CAST(COALESCE(NULLIF(array_position(array({listed}), {text}), 0) - 1, {len(labels)}) AS DOUBLE)"


def predict(run: ModelRun, df: DataFrame) -> DataFrame:
    """Every row with ``prediction``, plus ``actual`` and a binary ``score`` where known.

    Columns of the input with one of these names go on as ``<name>_input``.
    """
    source = normalize(df)
    types = types_of(source)
    if run.target not in source.columns:
        source = source.withColumn(run.target, F.lit(None).cast("string" if run.task == "classification" else "double"))
        types = types_of(source)
    out = run.model.transform(source)
    actual = quote(run.target)
    if run.task == "classification":
        actual = as_text(actual, types[run.target])
    columns = [F.expr(quote(c)).alias(f"{c}_input" if c in {"actual", "prediction", "score"} else c) for c in source.columns]
    columns += [F.expr(actual).alias("actual"), F.col("predicted").alias("prediction")]
    if "probability" in out.columns:
        columns.append(vector_to_array("probability")[1].alias("score"))
    return out.select(*columns)


def auto_train(
    df: DataFrame, target: str | None = None, key: list[str] | str | None = None,
    params: dict[str, dict] | None = None, tune: bool | dict[str, dict] = False,
) -> tuple[ModelRun, DataFrame]:
    """Feature-model loop: up to three feature sets, three models each.

    ``tune`` searches the staged grids, or the given ones by model family. Stops when the review passes and returns the best run by penalised score
    with the comparison of all candidates.
    """
    goal = target if target in df.columns else feature_ops.choose_target(df)
    keys = [key] if isinstance(key, str) else list(key or [])
    flat = normalize(df).where(f"{quote(goal)} is not null")
    task = feature_ops.infer_task(flat, goal, "staged")
    prepared, names = feature_ops.prepare_features(flat, goal, keys)
    prepared = spread(prepared)
    names = [n for n in names if n not in keys]
    linear = "logistic_regression" if task == "classification" else "linear_regression"
    defaults = {linear: {"max_iter": 500}, "random_forest": {"n_estimators": 120}, "gradient_boosting": {}}
    grids = STAGED_GRIDS if tune is True else tune or {}
    rows, best, best_score = [], None, None
    for loop, (label, table, columns, _) in enumerate(feature_ops.feature_variants(prepared, names), start=1):
        champion = None

        def trained(family: str, table=table, columns=columns) -> ModelRun:
            return train(
                table, goal, columns, task, family, {**defaults[family], **(params or {}).get(family, {})},
                tune=grids.get(family, False), key=keys or None, top=12, prepared=True,
            )

        # The families share nothing, so their jobs run side by side.
        with ThreadPool(len(defaults)) as pool:
            runs = pool.map(trained, defaults, chunksize=1)
        for run in runs:
            test = run.metrics["accuracy" if task == "classification" else "r2"]
            gap = run.train_score - test
            value = penalized_score(run.train_score, test)
            rows.append((run.model_type, label, loop, len(columns), task, run.train_score, test, gap, value))
            if champion is None or value > champion[0]:
                champion = (value, run, test, gap)
        if best_score is None or champion[0] > best_score:
            best_score, best = champion[0], champion[1]
        if _review_passes(task, champion[2], champion[3]):
            break
    comparison = small_frame(
        df.sparkSession,
        rows,
        "name string, feature_set string, loop_iteration int, feature_count int, task_type string,"
        " train_score double, test_score double, overfit_gap double, penalized_score double",
    )
    return best, review_gate(comparison)


def accuracy_report(run: ModelRun, comparison: DataFrame) -> DataFrame:
    """One row that sums up a feature-model loop: the chosen model, its rows, metrics and review."""
    metrics = json.dumps(run.metrics)
    split = run.split
    best = comparison.where(F.col("name") == run.model_type).orderBy(F.col("penalized_score").desc()).limit(1)
    return best.selectExpr(
        "'success' as status",
        f"{text_literal(run.target)} as target",
        "name as model",
        "feature_set",
        "loop_iteration",
        f"cast({split.rows_total - split.rows_test} as bigint) as rows_train",
        f"cast({split.rows_test} as bigint) as rows_test",
        f"{text_literal(metrics)} as metrics",
        "overfit_gap",
        "needs_improvement",
        "reason",
    )


def _review_passes(task: str, score: float, gap: float) -> bool:
    least, most = REVIEW_LIMITS[task]
    return score >= least and gap <= most


def save_run(run: ModelRun, root: str, spark: SparkSession) -> str:
    """Store the pipeline and append the run to the registry below ``root``."""
    base = root.rstrip("/")
    run.model.write().save(f"{base}/{run.id}/model")
    record = small_frame(spark, [run.record()], RUN_SCHEMA).coalesce(1)
    record.write.mode("append").parquet(f"{base}/_runs")
    return run.id


def list_runs(root: str, spark: SparkSession) -> DataFrame:
    """The run registry, newest first."""
    return spark.read.schema(RUN_SCHEMA).parquet(f"{root.rstrip('/')}/_runs").orderBy(F.col("created_at").desc(), "id")


def load_run(root: str, run_id: str, spark: SparkSession) -> ModelRun:
    """A stored run, ready for prediction."""
    row = list_runs(root, spark).where(F.col("id") == run_id).first()
    if row is None:
        raise KeyError(f"Unknown model run '{run_id}'.")
    names = ("accuracy", "f1", "auc", "rmse", "mae", "r2")
    metrics = {m: row[m] for m in names if row[m] is not None}
    importances = [tuple(item) for item in json.loads(row["feature_importances"])]
    return ModelRun(
        row["target"], json.loads(row["features"]), row["task_type"], row["model_type"],
        PipelineModel.load(f"{root.rstrip('/')}/{run_id}/model"), json.loads(row["hyperparameters"]), metrics,
        importances, None, None, None, row["filter_expression"], row["use_pca"], row["training_time_seconds"],
        row["id"], row["created_at"],
    )
