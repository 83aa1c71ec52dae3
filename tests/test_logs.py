import pytest
from pyspark.sql import functions as F

from plumbline.errors import ValidationError
from plumbline.sources import logs
from plumbline.sources.files import create_new
from plumbline.sources.versions import VersionStore

SCHEMA = "id bigint, status string"


def rows(spark, first, last, files=1):
    return spark.range(first, last, 1, files).select("id", F.lit("success").alias("status"))


def ids(frame):
    return sorted(r.id for r in frame.collect())


def files_read(frame):
    return len(frame.inputFiles())


@pytest.fixture
def store(spark, tmp_path):
    return VersionStore(spark, str(tmp_path / "store"))


def test_many_small_files_become_few_while_they_are_read(spark, store):
    store.append("runs", rows(spark, 0, 1000, 1000))
    before = store.log("runs", SCHEMA)
    assert files_read(before) == 1000
    assert store.fold_log("runs") == 1000
    after = store.log("runs", SCHEMA)
    assert files_read(after) == 1
    # Found before the fold and read after it; and once more after files went that nobody needs.
    assert ids(before) == ids(after) == list(range(1000))
    store.append("runs", rows(spark, 1000, 1003))
    assert ids(store.log("runs", SCHEMA)) == list(range(1003))
    assert store.fold_log("runs") == 0 and store.expire_log("runs") == 0
    assert store.expire_log("runs", 0) == 1000
    assert ids(store.log("runs", SCHEMA)) == list(range(1003)) and files_read(store.log("runs", SCHEMA)) == 2


def test_folds_are_folded_too(spark, store, monkeypatch):
    monkeypatch.setattr(logs, "MOST_FOLDS", 3)
    for i in range(7):
        store.append("runs", rows(spark, i, i + 1))
        assert store.fold_log("runs", 1) == 1
        assert ids(store.log("runs", SCHEMA)) == list(range(i + 1))
        assert files_read(store.log("runs", SCHEMA)) <= 3
        if i % 2:
            store.expire_log("runs", 0)
    assert ids(store.log("runs", SCHEMA)) == list(range(7))


def test_two_that_fold_at_once_and_one_that_is_lost(spark, store, monkeypatch):
    log = logs.Log(spark, store.root, "runs")
    log.append(rows(spark, 0, 5, 5))
    write, others = logs.Log._measured, []

    def meanwhile(self, names):
        if not others:
            others.append(None)
            others.append(logs.Log(spark, store.root, "runs").fold(1))
        return write(self, names)

    monkeypatch.setattr(logs.Log, "_measured", meanwhile)
    assert log.fold(1) == 0 and others[1] == 5
    assert ids(log.read(SCHEMA)) == list(range(5))
    # The file of a lost writer is not whole.
    log.append(rows(spark, 5, 6))
    assert create_new(spark, f"{store.root}/log-folds/runs/v=2", '{"folds": ["x')
    assert ids(log.read(SCHEMA)) == list(range(6))
    assert log.fold(1) == 1 and ids(log.read(SCHEMA)) == list(range(6))
    assert log.expire(0) == 6 and ids(log.read(SCHEMA)) == list(range(6))


def test_an_unfinished_state_between_two_loses_nothing(spark, store):
    log = logs.Log(spark, store.root, "runs")
    log.append(rows(spark, 0, 2, 2))
    assert log.fold(1) == 2
    # A later state that holds fewer files keeps them where they are.
    create_new(spark, f"{store.root}/log-folds/runs/v=2", '{"folds": [], "files": []}')
    assert log.expire(0) == 0 and ids(log.read(SCHEMA)) == [0, 1]


def test_columns_of_a_log_are_settled_by_its_first_rows(spark, store):
    assert store.log("runs", SCHEMA).count() == 0 and store.fold_log("runs", 1) == 0 and store.expire_log("runs", 0) == 0
    store.append("runs", rows(spark, 0, 1))
    with pytest.raises(ValidationError):
        store.append("runs", spark.range(1))
    with pytest.raises(ValidationError):
        store.log("runs", "id bigint, state string")
    assert ids(store.log("runs", SCHEMA)) == [0]
