import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from plumbline.sources import csv as source
from plumbline.errors import LimitExceededError, NotFoundError, ValidationError
from plumbline.sources.csv import (
    FIELD_COUNT,
    FILE,
    ROW_NUMBER,
    Ceilings,
    preview_rows,
    resolve_headers,
    scan_csv,
)


@pytest.fixture
def small_splits(spark):
    """Read blocks of a few dozen bytes, so that records, quotes and breaks straddle them."""
    saved = {
        key: spark.conf.get(key)
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    }
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key, value in saved.items():
        spark.conf.set(key, value)


def write(tmp_path, data, name="data.csv"):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def read(spark, path):
    rows = scan_csv(spark, path).records().orderBy(ROW_NUMBER).collect()
    return [tuple("" if v is None else v for v in row[1:]) for row in rows]


def names(cells):
    return [c.name for c in resolve_headers(cells)]


def test_headers():
    bom = "﻿"
    marked = resolve_headers([bom + "id", bom + "name"])
    assert [(h.name, h.issues) for h in marked] == [("id", ("bom_stripped",)), ("name", ())]
    assert names(["id", "", "name"]) == ["id", "column_2", "name"]
    assert resolve_headers([bom, "n"])[0].issues == ("bom_stripped", "blank_header")
    assert names(["amount", "id", "amount", "amount"]) == ["amount", "id", "amount_3", "amount_4"]
    assert names(["amount", "amount", "amount_2"]) == ["amount", "amount_2", "amount_2_3"]
    assert names(["a_3", "a", "a", "a"]) == ["a_3", "a", "a_3_2", "a_4"]
    trimmed = resolve_headers(["amount", "amount "])
    assert (trimmed[1].name, trimmed[1].issues) == ("amount_2", ("duplicate_header",))


def test_framing(spark, tmp_path, small_splits):
    path = write(
        tmp_path,
        b"\xef\xbb\xbfid,name\r\n1,\"a, \"\"b\"\"\r\nc\"\r\n\r\n2,\"x\ny\"\r\n3,\\z\r\n4,\"\"\r\n5,\r\n"
        b"6\r\n7,a,b\r\n8,  sp  \r\n9,\"q\r\n\r\n\r\nr\"\r\n10,z",
    )
    assert scan_csv(spark, path).header[0].issues == ("bom_stripped",)
    assert read(spark, path) == [
        (1, 2, "1", 'a, "b"\r\nc'),
        (2, 2, "2", "x\ny"),
        (3, 2, "3", "\\z"),
        (4, 2, "4", ""),
        (5, 2, "5", ""),
        (6, 1, "6", ""),
        (7, 3, "7", "a"),
        (8, 2, "8", "  sp  "),
        (9, 2, "9", "q\r\n\r\n\r\nr"),
        (10, 2, "10", "z"),
    ]


@pytest.mark.parametrize("separator", ["\n", "\r\n", "\r"])
def test_against_the_standard_reader(spark, tmp_path, small_splits, separator):
    rng = random.Random(7)
    alphabet = ["a", "é", "1", " ", ",", '"', "\n", "\r\n", "x y", "z" * 50]
    rows = [
        [str(i)] + ["".join(rng.choices(alphabet, k=rng.randrange(6))) for _ in range(rng.choice([2, 2, 2, 1, 3]))]
        for i in range(1, 120)
    ]
    text = io.StringIO(newline="")
    writer = csv.writer(text, lineterminator=separator, quoting=csv.QUOTE_ALL)
    writer.writerow(["id", "left", "right"])
    for i, row in enumerate(rows):
        if i % 17 == 3:
            text.write(separator)
        writer.writerow(row)
    path = write(tmp_path, text.getvalue())
    expected = [
        (i, len(row), *(row + ["", ""])[:3]) for i, row in enumerate(rows, start=1)
    ]
    assert read(spark, path) == expected


def test_plain_files_are_read_without_a_shuffle_of_lines(spark, tmp_path, small_splits):
    path = write(tmp_path, "id,name\n" + "".join(f'{i},"n,{i}"\n' for i in range(1, 60)))
    scan = scan_csv(spark, path)
    assert [(r[1], r.id, r.name) for r in scan.records().orderBy(ROW_NUMBER).collect()] == [
        (i, str(i), f"n,{i}") for i in range(1, 60)
    ]
    plan = scan.records()._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    sampled = scan.records(sample_rows=10)
    assert sampled.count() == 10


def test_many_files_share_a_header(spark, tmp_path):
    for part in range(3):
        write(tmp_path, f'id,name\n{part}1,a\n{part}2,"b\nb"\n' if part else "id,name\n01,a\n02,b\n", f"{part}.csv")
    scan = scan_csv(spark, str(tmp_path))
    rows = scan.records().collect()
    assert sorted((r[1], r.id) for r in rows) == [(1, "01"), (1, "11"), (1, "21"), (2, "02"), (2, "12"), (2, "22")]
    assert len({r[FILE] for r in rows}) == 3
    write(tmp_path, "other,header\n1,2\n", "3.csv")
    with pytest.raises(ValidationError, match="same header"):
        scan_csv(spark, str(tmp_path)).records().collect()


def test_headers_are_compared_as_whole_records(spark, tmp_path):
    write(tmp_path, b'\xef\xbb\xbf\r\nid,"name\r\nx"\r\n1,a\r\n', "0.csv")
    write(tmp_path, b'"id","name\r\nx"\r\n2,"b\r\nb"\r\n', "1.csv")
    scan = scan_csv(spark, str(tmp_path))
    assert sorted((r.id, r["name\r\nx"]) for r in scan.records().collect()) == [("1", "a"), ("2", "b\r\nb")]
    assert sorted(r.cells for r in scan.header_records().collect()) == [["id", "name\r\nx"]] * 2
    write(tmp_path, b'id,"name\r\ny",extra\r\n3,c,d\r\n', "2.csv")
    with pytest.raises(ValidationError, match="same header .*2.csv"):
        scan_csv(spark, str(tmp_path)).records().collect()


def test_a_header_longer_than_a_read_block(spark, tmp_path, small_splits):
    header = 'id,"' + "long name\n" * 12 + 'end"'
    for i in range(2):
        write(tmp_path, f"{header}\n{i},x\n", f"{i}.csv")
    scan = scan_csv(spark, str(tmp_path))
    assert sorted((r[1], r.id) for r in scan.records().collect()) == [(1, "0"), (1, "1")]
    assert [len(r.cells) for r in scan.header_records().collect()] == [2, 2]


def test_text_is_read_twice(spark, tmp_path):
    """Once to count splits, once to put records together; nothing reads it again."""
    path = write(tmp_path, "a,b\n" + "".join(f'{i},"x\ny"\n' for i in range(500)))
    scan = scan_csv(spark, path)
    first = scan.records()
    assert first.count() == 500 and scan.row_count == 500
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (first, scan.file_profile(), scan.field_count_mismatches())]
    assert all("data.csv" not in p and "text" not in p.replace("_text", "") for p in plans)


def test_a_stray_quote_names_file_and_block(spark, tmp_path, small_splits):
    rows = "".join(f"{i},x\n" for i in range(40))
    with pytest.raises(Exception, match=r"does not enclose a whole field \(.*data.csv, block at \d+\)"):
        scan_csv(spark, write(tmp_path, f'a,b\n{rows}9,a"b\n{rows}8,c"d\n{rows}')).records().collect()
    with pytest.raises(ValidationError, match="never closed .*open.csv"):
        scan_csv(spark, write(tmp_path, f'a,b\n{rows}9,"b\n{rows}', "open.csv")).records().collect()


def test_a_quote_left_open_ends_before_its_text_is_gathered(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(source, "MAX_RECORD_BYTES", 300)
    rows = "".join(f"{i},x\n" for i in range(200))
    path = write(tmp_path, f'a,b\n1,"open\n{rows}2,close"\n3,z\n')
    with pytest.raises(ValidationError, match=r"longer than 300 bytes \(.*data.csv, block at \d+\)"):
        scan_csv(spark, path).records()


def test_a_sample_reads_the_head_of_the_file_only(spark, tmp_path):
    path = write(tmp_path, 'a,b\n\n' + "".join(f'{i},"x\n{i}"\n' for i in range(400_000)))
    scan = scan_csv(spark, path)
    sampled = scan.records(sample_rows=1000).orderBy(ROW_NUMBER).collect()
    assert [(r[1], r.a, r.b) for r in sampled] == [(i + 1, str(i), f"x\n{i}") for i in range(1000)]
    assert "_counted" not in scan.__dict__ and "_shape" not in scan.__dict__
    tiny = scan_csv(spark, write(tmp_path, "a,b\n1,2", "tiny.csv"))
    assert [(r.a, r.b) for r in tiny.records(sample_rows=50).collect()] == [("1", "2")]


def test_field_counts(spark, tmp_path):
    path = write(tmp_path, 'a,b,c\n1,2,3\n1,2\n"1,1",2,3\n1,2,3,4,5\n')
    scan = scan_csv(spark, path)
    wrong = scan.field_count_mismatches().orderBy("row_number").collect()
    assert [(r.row_number, r.expected, r.actual) for r in wrong] == [(2, 3, 2), (4, 3, 5)]
    profile = scan.file_profile().first()
    assert (profile.column_count, profile.rows_read, profile.rows_with_bad_field_count) == (3, 4, 2)
    assert scan.records().filter(F.col(FIELD_COUNT) == 2).first().c is None


@pytest.mark.parametrize("body", ['1,"open\n2,x\n', '1,a"b"\n', '1,"a"b\n'])
def test_broken_quotes_are_refused(spark, tmp_path, body):
    with pytest.raises(Exception, match="not valid CSV"):
        scan_csv(spark, write(tmp_path, "a,b\n" + body)).records().collect()


def test_a_long_cell_of_quotes(spark, tmp_path):
    cell = '""' * 50_000
    assert read(spark, write(tmp_path, f'a,b\n1,"{cell}"\n')) == [(1, 2, "1", '"' * 50_000)]


def test_empty_and_missing_files(spark, tmp_path):
    with pytest.raises(ValidationError, match="no columns"):
        scan_csv(spark, write(tmp_path, ""))
    assert read(spark, write(tmp_path, "a,b\n", "header.csv")) == []
    with pytest.raises(NotFoundError):
        scan_csv(spark, str(tmp_path / "nothing.csv"))


def test_ceilings(spark, tmp_path):
    path = write(tmp_path, "a,b\n1,2\n3,4\n")
    scan_csv(spark, path, Ceilings(12, 2, 2)).enforce_ceilings()
    with pytest.raises(LimitExceededError, match=r"11-byte limit \(measured 12 bytes\)"):
        scan_csv(spark, path, Ceilings(max_bytes=11))
    with pytest.raises(LimitExceededError, match=r"1-column limit \(measured 2 columns\)"):
        scan_csv(spark, path, Ceilings(max_columns=1))
    with pytest.raises(LimitExceededError, match=r"1-row limit \(measured 2 rows\)"):
        scan_csv(spark, path, Ceilings(max_rows=1)).enforce_ceilings()


def test_preview_is_refused_out_of_range(spark):
    assert preview_rows(spark.range(500), 200).count() == 200
    for rows in (0, 201, -1, True, 1.5):
        with pytest.raises(ValidationError):
            preview_rows(spark.range(5), rows)


def test_a_header_of_any_length_is_read_to_its_end(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text(",".join(f"column_number_{i}" for i in range(80_000)) + "\n")
    header = scan_csv(spark, str(path)).header
    assert (len(header), header[-1].name) == (80_000, "column_number_79999")


@pytest.mark.parametrize("first", ["1", '"a ""quoted"", cell"'])
def test_rows_with_very_many_surplus_fields_are_kept(spark, tmp_path, first):
    path = tmp_path / "surplus.csv"
    path.write_text("a,b\n" + first + ",2" + ",x" * 30_000 + "\n3,4\n")
    rows = scan_csv(spark, str(path)).records().orderBy("_row_number").collect()
    cell = first.strip('"').replace('""', '"')
    assert [(r.a, r.b, r["_field_count"]) for r in rows] == [(cell, "2", 30_002), ("3", "4", 2)]
