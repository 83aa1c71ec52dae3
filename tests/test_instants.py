from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import random

import pytest
from pyspark.sql import functions as F

from plumbline.errors import ValidationError
from plumbline.functions import instants
from plumbline.functions.instants import date_grain, explicit_instant, naive_wall, resolve_wall_clocks
from plumbline.model import canonical_timezones


def resolve(spark, texts, zone):
    frame = spark.createDataFrame([(t,) for t in texts], "cell string")
    walls = frame.withColumn("wall", naive_wall(F.col("cell")))
    rows = resolve_wall_clocks(walls, {"local": "wall"}, zone).select(
        "cell", F.unix_seconds("local.instant").alias("s"), "local.kind"
    )
    return {r.cell: (r.s, r.kind) for r in rows.collect()}


def seconds(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp())


def test_gap_and_overlap(spark):
    answers = resolve(
        spark,
        ["2026-03-08 02:30:00", "2026-11-01 01:30:00", "2026-09-01 09:15:00", "2026-09-01T09:15:00Z"],
        "America/New_York",
    )
    assert answers["2026-03-08 02:30:00"] == (seconds("2026-03-08T07:30:00"), "nonexistent")
    assert answers["2026-11-01 01:30:00"] == (seconds("2026-11-01T05:30:00"), "ambiguous")
    assert answers["2026-09-01 09:15:00"] == (seconds("2026-09-01T13:15:00"), "ok")
    assert answers["2026-09-01T09:15:00Z"] == (None, None)


def modelled(wall, zone):
    """The rule on one wall clock, with the standard library's zone data."""

    def offset(instant):
        return int(datetime.fromtimestamp(instant, ZoneInfo(zone)).utcoffset().total_seconds())

    before, after = offset(wall - 86400), offset(wall + 86400)
    if before == after:
        return wall - before, "ok"
    stands = [c for c in (before, after) if offset(wall - c) == c]
    if len(stands) == 2:
        return min(wall - before, wall - after), "ambiguous"
    if len(stands) == 1:
        return wall - stands[0], "ok"
    return max(wall - before, wall - after), "nonexistent"


@pytest.mark.parametrize(
    "zone",
    ["America/New_York", "Europe/London", "Australia/Lord_Howe", "Africa/Casablanca", "Asia/Kolkata", "Pacific/Apia"],
)
def test_every_half_hour_agrees_with_the_model(spark, zone):
    texts = []
    for year in (2011, 2018):
        moment = datetime(year, 1, 1)
        while moment.year == year:
            texts.append(moment.strftime("%Y-%m-%d %H:%M:%S"))
            moment += timedelta(minutes=30)
    answers = resolve(spark, texts, zone)
    wrong = [t for t in texts if answers[t] != modelled(seconds(t), zone)]
    assert wrong == []


def test_explicit_instants(spark):
    frame = spark.createDataFrame(
        [("2026-09-01T09:15:00.999Z",), ("2026-09-01 09:15:00-04:00",), ("2026-09-01 09:15:00+05:30",), ("x",)],
        "cell string",
    )
    rows = frame.select(F.unix_seconds(explicit_instant(F.col("cell"))).alias("s")).collect()
    assert [r.s for r in rows] == [
        seconds("2026-09-01T09:15:00"),
        seconds("2026-09-01T13:15:00"),
        seconds("2026-09-01T03:45:00"),
        None,
    ]


def test_instants_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        answers = resolve(spark, ["2026-03-08 02:30:00"], "America/New_York")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert answers["2026-03-08 02:30:00"] == (seconds("2026-03-08T07:30:00"), "nonexistent")


def test_grain_is_local(spark):
    frame = spark.sql("SELECT TIMESTAMP '2024-01-01 02:00:00' AS ts")
    month = frame.select(date_grain(F.col("ts"), "month", "America/New_York")).first()[0]
    week = frame.select(date_grain(F.col("ts"), "week", "America/New_York")).first()[0]
    assert (str(month), str(week)) == ("2023-12-01", "2023-12-25")


def test_only_canonical_zones():
    zones = canonical_timezones()
    assert {"UTC", "Asia/Kolkata", "Europe/Kyiv"} <= zones
    assert not {"EST", "Asia/Calcutta", "Europe/Kiev", "GMT+1"} & zones
    assert len(zones) == 313
    with pytest.raises(ValidationError):
        date_grain(None, "month", "EST")
    with pytest.raises(ValidationError):
        date_grain(None, "hour", "UTC")


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Australia/Lord_Howe", "Asia/Kolkata", "UTC", "Africa/Casablanca"])
def test_the_table_of_a_zone_says_what_the_zone_says(spark, zone, monkeypatch):
    monkeypatch.setattr(instants, "require_timezone", lambda _: None)
    pick = random.Random(zone)
    walls = [pick.randint(-5_000_000_000, 6_000_000_000) for _ in range(300)] + [None, -1, 0, instants._TABLE_END - 1, instants._TABLE_END]
    for instant, before, after in instants._transitions(zone):
        walls += [instant + o + d for o in (before, after) for d in (-3600, -1, 0, 1, 1800)]
    frame = spark.createDataFrame([(w,) for w in walls], "wall long")
    both = instants._resolved_by_zone(instants.resolve_wall_clocks(frame, {"fast": "wall"}, zone), {"slow": "wall"}, zone)
    rows = both.select("wall", "fast", "slow").collect()
    assert len(rows) == len(walls)
    assert [r for r in rows if r.fast != r.slow] == []
