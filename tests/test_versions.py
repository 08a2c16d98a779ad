"""The version log, stored profiles, and user functions on batches."""

from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest

from gritstone.operators.cleaning import apply_batches
from gritstone.runtime import put_if_absent
from gritstone.sources.versions import VersionStore


@pytest.fixture
def store(spark, tmp_path):
    return VersionStore(spark, str(tmp_path / "store"))


def test_one_writer_wins(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: put_if_absent(spark, f"{tmp_path}/log/1.json", str(i)), range(16)))
    assert sum(won) == 1 and (tmp_path / "log/1.json").read_text() == str(won.index(True))
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["1.json"]


def test_of_two_promotions_one_wins(spark, store, monkeypatch):
    dataset = store.create(spark.range(3), "a.csv")
    latest = store._latest(dataset)
    monkeypatch.setattr(VersionStore, "_latest", lambda self, d: latest)  # both saw version 1 as the last
    outcomes = []

    def promote(n):
        try:
            outcomes.append(("won", n, store.promote(spark.range(n), dataset, f"try {n}")))
        except RuntimeError as error:
            outcomes.append(("lost", n, str(error)))

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(promote, [5, 7]))
    monkeypatch.undo()
    assert sorted(o[0] for o in outcomes) == ["lost", "won"]
    winner = next(o[1] for o in outcomes if o[0] == "won")
    assert [(r.version, r.row_count) for r in store.list().orderBy("version").collect()] == [(1, 3), (2, winner)]
    assert store.read(dataset).count() == winner and store.promote(spark.range(1), dataset, "next") == 3


def test_interrupted_versions_are_not_listed(spark, store, monkeypatch):
    import gritstone.sources.versions as versions

    dataset = store.create(spark.range(3), "a.csv")
    monkeypatch.setattr(versions, "put_if_absent", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.promote(spark.range(9), dataset, "never")
    monkeypatch.undo()
    assert store.list().count() == 1
    assert store.promote(spark.range(4), dataset, "again") == 2 and store.read(dataset).count() == 4


def test_profiles_stay_with_their_versions(spark, store):
    dataset = store.create(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), "a.csv", profiled=True)
    store.promote(spark.createDataFrame([(1, "y")], "a int, b string"), dataset, "filled", profiled=True)
    nulls = lambda v: {r.column: r.null_count for r in store.profile(dataset, v).collect()}
    assert nulls(1) == {"a": 0, "b": 1} and nulls(None) == nulls(2) == {"a": 0, "b": 0}
    assert store.profile(dataset, 1, "dataset").first().row_count == 2


def test_functions_on_batches(spark, store):
    df = spark.range(20).selectExpr("id", "cast(id as double) as x").repartition(3)
    dataset = store.create(df, "a.csv")
    good = apply_batches(df, lambda b: b.select(["id"]), "id long")
    assert good.df.count() == 20 and good.run_id and good.error is None
    assert good.approve(store, dataset) == 2

    def failing(batch):
        if 13 in batch["id"].to_pylist():
            raise KeyError("thirteen")
        return batch

    bad = apply_batches(df, failing, "id long, x double")
    assert bad.status == "failed" and bad.run_id in bad.error and "thirteen" in bad.error
    with pytest.raises(ValueError, match=bad.run_id):
        bad.approve(store, dataset)
    missing = apply_batches(df, lambda b: b.select(["id"]), "id long, x double")
    lossy = apply_batches(df, lambda b: pa.table({"id": pa.array([0.5] * b.num_rows)}), "id long")
    assert missing.status == lossy.status == "failed" and "id" in lossy.error
    assert store.list().count() == 2
