"""The staged workflow: ten ordered stages over versioned tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from gritstone.functions.values import quote
from gritstone.operators import charts, features, models
from gritstone.operators.cleaning import clean_staged
from gritstone.operators.filters import Filter, apply_filters
from gritstone.operators.profile import profile, profile_summary
from gritstone.operators.split import split_summary, train_test_split
from gritstone.sources.reader import export
from gritstone.sources.versions import VersionStore


@dataclass(frozen=True)
class Stage:
    """What a stage runs and whether its table becomes the next version."""

    steps: tuple[str, ...]
    pca: bool = False
    plots: bool = False
    outliers: bool = False
    split: bool = False
    model: bool = False
    tune: bool = False
    promotes: bool = False


LOAD, CHECK = "load_local_dataset", "validate_outputs"
PREPARED = (LOAD, "feature_engineering", "prepare_data")
MODELLED = (*PREPARED, "split_data", "train_model", "evaluate_model")

# Stages in running order.
STAGES = {
    "load_data": Stage((LOAD, "inspect_data", CHECK)),
    "explore_data": Stage((LOAD, "explore_data", CHECK)),
    "visualize_data": Stage((LOAD, "visualize_data", CHECK), plots=True),
    "clean_data": Stage((LOAD, "clean_and_preprocess", CHECK), outliers=True, promotes=True),
    "feature_engineering": Stage((LOAD, "feature_engineering", CHECK), promotes=True),
    "prepare_data": Stage((*PREPARED, "pca_variance", CHECK), pca=True, promotes=True),
    "split_data": Stage((*PREPARED, "split_data", CHECK), split=True),
    "train_model": Stage((*MODELLED, CHECK), split=True, model=True, tune=True),
    "tune_evaluate": Stage((*MODELLED, CHECK), plots=True, split=True, model=True, tune=True),
    "save_predict": Stage((*MODELLED, "generate_predictions", CHECK), plots=True, split=True, model=True, tune=True),
}
# Outputs without which a stage counts as failed.
REQUIRED = {
    "load_data": ("summary",),
    "explore_data": ("summary", "columns", "dataset"),
    "visualize_data": ("hist", "share", "box", "missing"),
    "clean_data": ("table", "manifest", "validation"),
    "feature_engineering": ("table",),
    "prepare_data": ("table",),
    "split_data": ("split_summary",),
    "train_model": ("metrics", "model_comparison", "accuracy_report"),
    "tune_evaluate": ("metrics", "model_comparison", "accuracy_report"),
    "save_predict": ("metrics", "predictions", "accuracy_report"),
}
# The short flow: clean, filter, reduce, train, tune.
SHORT_FLOW = ("clean_data", "filter_rows", "prepare_data", "train_model", "tune_evaluate")


@dataclass
class StageResult:
    """Outcome of one stage with its output tables."""

    stage: str
    status: str
    steps: tuple[str, ...] = ()
    outputs: dict[str, DataFrame] = field(default_factory=dict)
    version: int | None = None
    error: Exception | None = None
    run: models.ModelRun | None = None

    def write(self, path: str) -> None:
        """Write every output table below ``path`` as Parquet, and the predictions as CSV too."""
        for name, df in self.outputs.items():
            export(df, f"{path.rstrip('/')}/{name}.parquet", "parquet")
            if name == "predictions":
                export(df, f"{path.rstrip('/')}/{name}.csv", "csv")


@dataclass
class Workflow:
    """Runs stages on the current version of one dataset."""

    store: VersionStore
    dataset_id: str
    target: str | None = None
    key: list[str] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    row_filter: Filter | None = None
    models_root: str | None = None
    grids: dict[str, dict] | None = None

    def run(self, name: str) -> StageResult:
        current = self.store.read(self.dataset_id)
        if name == "filter_rows":
            stage, outputs, run = Stage((LOAD, "filter_rows", CHECK), promotes=True), self._filter(current), None
        else:
            stage = STAGES[name]
            outputs, run = self._outputs(name, stage, current)
        missing = [o for o in REQUIRED.get(name, ()) if o not in outputs]
        if missing:
            raise ValueError(f"Missing output(s): {', '.join(missing)}")
        result = StageResult(name, "passed", stage.steps, outputs, run=run)
        if stage.promotes:
            result.version = self.store.promote(outputs["table"], self.dataset_id, f"Stage {name}")
        return result

    def _filter(self, current: DataFrame) -> dict[str, DataFrame]:
        if self.row_filter is None:
            return {"table": current}
        return {"table": apply_filters(current, [self.row_filter])}

    def _outputs(self, name: str, stage: Stage, current: DataFrame):
        outputs: dict[str, DataFrame] = {}
        run = None
        if name in {"load_data", "explore_data", "visualize_data"}:
            outputs["summary"] = profile_summary(current)
        if name == "explore_data":
            found = profile(current)
            outputs.update(columns=found.column_table, dataset=found.dataset, correlation=found.pearson)
        if stage.outliers:
            cleaned = clean_staged(current)
            if cleaned.status == "failed":
                raise ValueError("Cleaning did not pass its checks.")
            outputs.update(table=cleaned.df, manifest=cleaned.manifest, validation=cleaned.validation)
        if stage.plots:
            outputs.update(
                hist=charts.eda_hist(current), share=charts.eda_share(current), box=charts.eda_box(current),
                missing=charts.eda_missing(current),
            )
        goal = self.target if self.target in current.columns else None
        if stage.split and goal is None:
            goal = features.choose_target(current)
        aside = [c for c in [*self.key, *([goal] if goal else [])] if c in current.columns]
        if name == "feature_engineering":
            texts = [c for c in features.text_columns(current) if c not in aside]
            outputs["table"] = features.one_hot(current, columns=texts)
        if name in {"prepare_data", "split_data"}:
            table, names = features.prepare_features(current, goal, self.key)
            names = [n for n in names if n not in aside]
            outputs["table"] = table
            if stage.pca and len(names) >= 2:
                reduced = features.pca_90(table.select(*[quote(n) for n in names]))
                if reduced is not None:
                    outputs.update(pca=reduced.df, pca_variance=reduced.variance)
            if name == "split_data":
                task = features.infer_task(current, goal, "staged")
                split = train_test_split(table, self.key or None, goal if task == "classification" else None)
                outputs["split_summary"] = split_summary(split, task, len(names))
        if stage.model:
            run, comparison = models.auto_train(current, goal, self.key or None, self.params, tune=stage.tune and (self.grids or True))
            outputs.update(
                model_comparison=comparison,
                metrics=run.metric_table(current.sparkSession),
                feature_importance=run.importance_table(current.sparkSession),
                accuracy_report=models.accuracy_report(run, comparison),
            )
            if name == "save_predict":
                outputs["predictions"] = run.predictions.select("actual", "prediction")
                if self.models_root:
                    models.save_run(run, self.models_root, current.sparkSession)
        return outputs, run


def run_stages(
    df: DataFrame,
    store: VersionStore,
    stages: list[str] | None = None,
    target: str | None = None,
    key: list[str] | str | None = None,
    params: dict | None = None,
    row_filter: Filter | None = None,
    dataset_id: str | None = None,
    models_root: str | None = None,
    grids: dict[str, dict] | None = None,
) -> list[StageResult]:
    """Store a table and run the stages on it in order, stopping at the first failure.

    A failed stage carries its exception. ``grids`` replaces the staged tuning grids of the model families.
    """
    names = list(STAGES) if stages is None else list(stages)
    unknown = [n for n in names if n not in STAGES and n != "filter_rows"]
    if unknown:
        raise ValueError(f"Unknown stage(s): {', '.join(unknown)}")
    dataset = store.create(df, "workflow.parquet", dataset_id)
    keys = [key] if isinstance(key, str) else list(key or [])
    flow = Workflow(store, dataset, target, keys, params or {}, row_filter, models_root, grids)
    results: list[StageResult] = []
    for name in names:
        try:
            results.append(flow.run(name))
        except Exception as exc:
            results.append(StageResult(name, "failed", error=exc))
            break
    return results
