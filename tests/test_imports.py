from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fixtures import customers, events, transactions, write_csv
from plumbline.errors import LimitExceededError, NotFoundError, ValidationError
from plumbline.functions.casting import CellType
from plumbline.model import columns_of
from plumbline.operators.load import issue_counts, typed_load
from plumbline.plans.importing import load_import, profile_import
from plumbline.plans.spec import Dimension, Filter, Measure, QuerySpec
from plumbline.plans.structured import execute
from plumbline.sources import versions
from plumbline.sources.csv import Ceilings
from plumbline.sources.versions import Claim, VersionStore

ZONE = "America/New_York"


@pytest.fixture
def store(spark, tmp_path):
    return VersionStore(spark, str(tmp_path / "store"))


def types(proposed):
    return {r.name: r.type for r in proposed.columns.collect()}


def test_transactions_end_to_end(spark, store, tmp_path):
    proposed = profile_import(spark, write_csv(tmp_path / "t.csv", transactions()))
    described = {r.name: r for r in proposed.columns.collect()}
    assert {n: r.type for n, r in described.items()} == {
        "id": "string",
        "customer_id": "string",
        "customer_name": "string",
        "amount": "decimal",
        "currency": "string",
        "status": "string",
        "created_at": "timestamptz",
        "plan_name": "string",
        "country": "string",
    }
    assert described["amount"].unparseable_count == 2 and described["amount"].nullable
    assert described["created_at"].datetime_offset == "explicit"
    assert described["plan_name"].nullable and not described["status"].nullable

    assert load_import(store, proposed, "transactions", ZONE) == 1
    version = store.versions().first()
    assert (version.row_count, version.rows_rejected, version.status) == (1000, 2, "COMPLETED")
    errors = store.import_errors("transactions").orderBy("row_number").collect()
    assert [(e.row_number, e.column_name, e.error_code) for e in errors] == [
        (4, "amount", "UNPARSEABLE_VALUE"),
        (8, "amount", "UNPARSEABLE_VALUE"),
    ]
    frame = store.read_version("transactions")
    assert frame.filter(F.col("customer_name").contains("\n")).count() == 1

    by_id = {c.name: c for c in columns_of(frame.schema)}
    assert by_id["amount"].nullable and not by_id["status"].nullable
    question = QuerySpec(
        "transactions",
        [Dimension(by_id["status"].id)],
        [Measure("sum", "value", by_id["amount"].id), Measure("count", "rows")],
        [Filter(by_id["currency"].id, "eq", "USD")],
    )
    result = execute(frame, question, ZONE)
    assert sum(int(r["rows"]) for r in result.rows) == 334
    with pytest.raises(ValidationError, match="pinning"):
        execute(frame, QuerySpec("transactions", [], [question.measures[0]]), ZONE)


def test_naive_times_are_read_in_the_chosen_zone(spark, store, tmp_path):
    proposed = profile_import(spark, write_csv(tmp_path / "c.csv", customers()))
    assert types(proposed)["created_at"] == "timestamptz"
    load_import(store, proposed, "customers", ZONE)
    errors = store.import_errors("customers").orderBy("row_number").collect()
    assert [(e.row_number, e.column_name, e.error_code) for e in errors] == [
        (5, "mrr", "UNPARSEABLE_VALUE"),
        (9, "mrr", "UNPARSEABLE_VALUE"),
        (21, "created_at", "NONEXISTENT_LOCAL_TIME"),
        (25, "canceled_at", "AMBIGUOUS_LOCAL_TIME"),
    ]
    kept = store.read_version("customers").filter("id = 'c000020'").first()
    assert str(kept.created_at) == "2026-03-08 07:30:00"


def test_mixed_offsets(spark, store, tmp_path):
    proposed = profile_import(spark, write_csv(tmp_path / "e.csv", events()))
    assert {r.name: r.datetime_offset for r in proposed.columns.collect()}["timestamp"] == "mixed"
    load_import(store, proposed, "events", ZONE)
    counts = {r.error_code: r.issue_count for r in issue_counts(store.import_errors("events")).collect()}
    assert counts == {"NONEXISTENT_LOCAL_TIME": 1, "AMBIGUOUS_LOCAL_TIME": 1}


def test_a_repeated_load_converges_and_ids_continue(spark, store, tmp_path):
    path = write_csv(tmp_path / "t.csv", transactions(50))
    proposed = profile_import(spark, path)
    for _ in range(2):
        assert load_import(store, proposed, "t", ZONE, version=1) == 1
    assert store.versions().count() == 1 and store.read_version("t").count() == 50
    first = {c.name: c.id for c in store.version_columns("t", 1)}
    assert len(set(first.values())) == 9

    assert load_import(store, proposed, "t", ZONE, overrides={4: "string"}) == 2
    second = {c.name: c.id for c in store.version_columns("t", 2)}
    changed = {n for n in first if first[n] != second[n]}
    assert changed == {"amount"}
    assert store.current_versions().first().version_number == 2
    # The older version is still there, with its own ids.
    assert store.read_version("t", 1).schema["amount"].metadata["column_id"] == first["amount"]
    assert store.read_version("t").filter("amount = 'N/A'").count() == 1


def test_ragged_rows_load_and_are_reported(spark, store, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("id,amount\n1,10.00\n2\n3,1,extra\n")
    load_import(store, profile_import(spark, str(path)), "ragged", "UTC")
    rows = store.read_version("ragged").orderBy("id").collect()
    assert [(r.id, None if r.amount is None else str(r.amount)) for r in rows] == [
        (1, "10.0000000000"),
        (2, None),
        (3, "1.0000000000"),
    ]
    messages = [e.message for e in store.import_errors("ragged").orderBy("row_number").collect()]
    assert messages == ["Row has 1 fields, expected 2.", "Row has 3 fields, expected 2."]


def test_only_the_sample_decides_types(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("n\n" + "1\n" * 30 + "x\n" * 30)
    assert types(profile_import(spark, str(path), sample_rows=30)) == {"n": "integer"}
    assert types(profile_import(spark, str(path))) == {"n": "string"}


def test_refusals(spark, store, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(LimitExceededError):
        profile_import(spark, str(path), Ceilings(max_columns=1))
    proposed = profile_import(spark, str(path))
    with pytest.raises(ValidationError):
        load_import(store, proposed, "x", "EST")
    with pytest.raises(ValidationError):
        load_import(store, proposed, "../x", "UTC")
    with pytest.raises(NotFoundError):
        store.read_version("x")
    assert store.versions().count() == 0


def test_late_and_long_decimals_of_all_files_are_kept(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("id,v\n" + "1,1.5\n" * 300)
    (folder / "b.csv").write_text("id,v\n" + "x2,0.111111111111\n" * 300)
    store = VersionStore(spark, str(tmp_path / "store"))
    proposed = profile_import(spark, str(folder))
    assert load_import(store, proposed, "d", ZONE) == 1
    rows = store.read_version("d", with_source=True)
    assert {r.v for r in rows.select("v").distinct().collect()} == {Decimal("1.5"), Decimal("0.111111111111")}
    assert dict(rows.dtypes)["id"] == "string"
    assert rows.select("_file", "_row_number").distinct().count() == 600
    assert store.import_errors("d").count() == 0
    # The first rows may decide the types, but no decimal place is lost by it.
    sampled = profile_import(spark, str(folder), sample_rows=5)
    assert sampled.columns.where("name = 'v'").first().decimal_scale >= 12


def test_a_complete_version_stays_until_its_successor_is_whole(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("v\n1\nx\n")
    store = VersionStore(spark, str(tmp_path / "store"))
    proposed = profile_import(spark, str(path))
    load_import(store, proposed, "d", ZONE, overrides={1: "integer"})
    with pytest.raises(ValidationError, match="complete"):
        store.write_version("d", 1, store.read_version("d"), [], ZONE)
    # Data and columns of an attempt that never got its catalog row are not seen.
    orphan = store._dir("data", "d", 1) + "/attempt=lost"
    spark.range(3).selectExpr("id AS v").write.parquet(orphan)
    assert [r.v for r in store.read_version("d").orderBy("v").collect()] == [None, 1]
    assert store.next_version_number("d") == 2
    errors = store.import_errors("d").collect()
    assert [(e.row_number, e.file.endswith("a.csv")) for e in errors] == [(2, True)]


def test_other_failures_to_read_the_catalog_are_not_an_empty_catalog(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    assert store.next_version_number("d") == 1
    bad = tmp_path / "store" / "catalog" / "versions" / "dataset_id=d" / "version_number=1"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        store.next_version_number("d")


def test_the_import_query_writes_its_files_in_parts(spark, tmp_path, monkeypatch):
    from plumbline.catalogue import files

    source = spark.range(400).selectExpr("id AS event_id", "id % 7 AS user_id", "'k' || id % 3 AS event_type", "CAST(id AS DOUBLE) AS value")
    source.repartition(4).write.parquet(f"{tmp_path}/sf/events.parquet")
    monkeypatch.setattr(files, "scratch_path", lambda _, purpose: f"{tmp_path}/{purpose}")
    monkeypatch.setattr(files, "table", lambda *_: spark.read.parquet(f"{tmp_path}/sf/events.parquet").repartition(4))
    answer = {r.kind: r.rows for r in files.QUERIES["import_end_to_end"](spark, str(tmp_path)).collect()}
    assert [answer[f"k{i}"] for i in range(3)] == [134, 133, 133]
    assert len(list((tmp_path / "events-csv").glob("*.csv"))) == 8


def _written(store, dataset_id, claim, value):
    rows = typed_load(store.spark.createDataFrame([(value,)], "n string"), CELLS, "UTC")
    return store.write_version(dataset_id, claim.version, rows, CELLS, "UTC", claim=claim)


CELLS = [CellType("n", "integer")]


def test_every_writer_gets_a_number_of_its_own(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        claims = list(pool.map(lambda _: store.claim_version("d"), range(8)))
    assert sorted(c.version for c in claims) == list(range(1, 9))
    first, second = sorted(claims, key=lambda c: c.version)[:2]
    # The later number is written first; the earlier one does not take its place.
    _written(store, "d", second, "2")
    _written(store, "d", first, "1")
    assert store.current_version_number("d") == 2
    assert [store.read_version("d", v).first()[0] for v in (1, 2)] == [1, 2]


def test_a_number_belongs_to_its_claim(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path))
    claim = store.claim_version("d")
    with pytest.raises(ValidationError, match="belongs to another writer"):
        _written(store, "d", Claim("d", claim.version, "somebody else"), "1")
    with pytest.raises(ValidationError, match="is being written"):
        store.write_version("d", 1, typed_load(spark.createDataFrame([("1",)], "n string"), CELLS, "UTC"), CELLS, "UTC")
    assert store.versions("d").isEmpty()
    assert store.claim("e", 5).version == 5 and store.claim("e", 5) is None and store.claim_version("e").version == 6


def test_a_writer_lost_before_the_catalog_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = VersionStore(spark, str(tmp_path))
    _written(store, "d", store.claim_version("d"), "1")
    lost = store.claim_version("d")
    with monkeypatch.context() as patch:
        patch.setattr(versions, "column_continuity", lambda *_: 1 / 0)  # after the data, before the catalog
        with pytest.raises(ZeroDivisionError):
            _written(store, "d", lost, "2")
    assert store.current_version_number("d") == 1 and store.read_version("d").first()[0] == 1
    later = store.claim_version("d")
    assert later.version == 3
    _written(store, "d", later, "3")
    assert store.read_version("d").first()[0] == 3
