"""Wall-clock time to instants, with daylight-saving gaps and overlaps reported.

Everything is whole seconds since the epoch until the last step, which keeps the
expressions independent of the session time zone. Resolving a local time needs
each intermediate value several times, so that part works on a frame in a few
stages: nested in one expression it would outgrow what Spark can compile. From 1970 to 2037
the zone's transitions are looked up in a table of time slots; other years ask the zone.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import UTC, datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..model import GRANULARITIES, require_timezone
from .fence import fence
from .grammar import datetime_text, has_offset, trimmed

OK = "ok"
AMBIGUOUS = "ambiguous"
NONEXISTENT = "nonexistent"

_DAY_SECONDS = 86_400


def _number(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start, length).try_cast("bigint")


def wall_seconds(text: Column) -> Column:
    """The written wall clock, read as if it were UTC. A fraction is discarded."""
    day = F.unix_date(F.substring(text, 1, 10).try_cast("date")).cast("bigint")
    return (
        day * _DAY_SECONDS
        + _number(text, 12, 2) * 3600
        + _number(text, 15, 2) * 60
        + _number(text, 18, 2)
    )


def offset_seconds(text: Column) -> Column:
    """The written offset (``Z`` is zero) of a date-time that has one."""
    size = _number(text, -5, 2) * 3600 + _number(text, -2, 2) * 60
    return F.when(text.endswith("Z"), F.lit(0).cast("bigint")).otherwise(
        F.when(F.substring(text, -6, 1) == "-", -size).otherwise(size)
    )


def explicit_instant(cell: Column) -> Column:
    """Instant of a date-time that carries an offset; null for anything else."""
    text = trimmed(cell)
    return F.when(
        datetime_text(text) & has_offset(text),
        F.timestamp_seconds(wall_seconds(text) - offset_seconds(text)),
    )


def naive_wall(cell: Column) -> Column:
    """Wall clock of a date-time without offset; null for anything else."""
    text = trimmed(cell)
    return F.when(datetime_text(text) & ~has_offset(text), wall_seconds(text))


def zone_offset(seconds: Column, timezone: str) -> Column:
    """Seconds that local time in ``timezone`` is ahead of UTC at an instant."""
    local = F.from_utc_timestamp(F.timestamp_seconds(seconds), timezone)
    return F.unix_seconds(local) - seconds


# A slot is some 24 days; no zone moves twice in one, or the slot is left out.
_SLOT = 1 << 21
_TABLE_END = int(datetime(2038, 1, 1, tzinfo=UTC).timestamp())
_NEVER = 1 << 62


def _transitions(timezone: str) -> list[tuple[int, int, int]]:
    """(instant, offset before, offset after) of every change of offset while the table lasts."""
    zone = ZoneInfo(timezone)

    def offset(instant: int) -> int:
        return int(datetime.fromtimestamp(instant, zone).utcoffset().total_seconds())

    found = []
    known = offset(-_DAY_SECONDS)
    for day in range(0, _TABLE_END + 2 * _DAY_SECONDS, _DAY_SECONDS):
        if (after := offset(day)) != known:
            low, high = day - _DAY_SECONDS, day
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == known else (low, middle)
            found.append((high, known, after))
            known = after
    return found


@lru_cache(maxsize=64)
def _slots(timezone: str) -> dict[str, tuple[int, ...]]:
    """For each slot of wall clock: the offset at its begin, and the stretch of wall clock that a
    transition skips or repeats in it, with the offset from its end on. ``usable`` is 0 where a
    slot holds more than one transition, or part of one.
    """
    size = _TABLE_END // _SLOT
    first = int(datetime.fromtimestamp(-_DAY_SECONDS, ZoneInfo(timezone)).utcoffset().total_seconds())
    table = {"offset": [first] * size, "low": [_NEVER] * size, "high": [_NEVER] * size, "later": [0] * size, "usable": [1] * size}
    for instant, before, after in _transitions(timezone):
        low, high = instant + min(before, after), instant + max(before, after)
        for slot in {low // _SLOT, (high - 1) // _SLOT}:
            if 0 <= slot < size:
                alone = low // _SLOT == (high - 1) // _SLOT and table["low"][slot] == _NEVER
                table["usable"][slot] &= alone
                table["low"][slot], table["high"][slot], table["later"][slot] = low, high, after
        following = max(0, -(-high // _SLOT))
        table["offset"][following:] = [after] * len(table["offset"][following:])
    return {name: tuple(values) for name, values in table.items()}


def resolve_wall_clocks(df: DataFrame, walls: Mapping[str, str], timezone: str) -> DataFrame:
    """Add ``struct(instant, kind)`` columns for wall clocks read in a zone.

    ``walls`` maps each new column to the column of wall seconds it resolves. A wall clock
    that occurs twice is an overlap (earlier instant taken), one that is skipped is a gap
    (later one taken): both mean the offset from before the transition.
    """
    require_timezone(timezone)
    table = _slots(timezone)

    def slot(wall: str) -> Column:
        place = F.floor(F.col(wall) / _SLOT).cast("int")
        inside = (F.col(wall) >= 0) & (F.col(wall) < len(table["usable"]) * _SLOT)
        return F.when(inside & (_looked_up(table["usable"], place) == 1), place)

    staged = df.withColumns({f"_slot_{out}": slot(wall) for out, wall in walls.items()})
    fields = ("offset", "low", "high", "later")
    staged = staged.withColumns(
        {f"_{name}_{out}": _looked_up(table[name], F.col(f"_slot_{out}")) for out in walls for name in fields}
    )

    def from_table(out: str, wall: str) -> Column:
        clock, low, high = F.col(wall), F.col(f"_low_{out}"), F.col(f"_high_{out}")
        offset = F.when(clock < high, F.col(f"_offset_{out}")).otherwise(F.col(f"_later_{out}"))
        moved = F.when(F.col(f"_later_{out}") > F.col(f"_offset_{out}"), F.lit(NONEXISTENT)).otherwise(F.lit(AMBIGUOUS))
        kind = F.when((clock >= low) & (clock < high), moved).otherwise(F.lit(OK))
        return F.struct(F.timestamp_seconds(clock - offset).alias("instant"), kind.alias("kind"))

    rest = {f"_rest_{out}": f"_other_{out}" for out in walls}
    staged = staged.withColumns({f"_other_{out}": F.when(F.col(f"_slot_{out}").isNull(), F.col(wall)) for out, wall in walls.items()})
    asked = _resolved_by_zone(staged, rest, timezone)
    resolved = asked.withColumns(
        {
            out: fence(
                F.when(F.col(f"_slot_{out}").isNotNull(), from_table(out, wall)).otherwise(F.col(f"_rest_{out}"))
            )
            for out, wall in walls.items()
        }
    )
    return resolved.drop(*[f"_{name}_{out}" for out in walls for name in (*fields, "slot", "other", "rest")])


def _looked_up(values: tuple[int, ...], place: Column) -> Column:
    # One text, turned into an array once while the query is planned.
    array = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    return F.get(array, place)


def _resolved_by_zone(df: DataFrame, walls: Mapping[str, str], timezone: str) -> DataFrame:
    """The same for any year, by what the zone says of it.

    The zone's offset a day earlier and a day later bracket any transition. Where they
    differ, each gives a candidate instant, and a candidate stands only if the zone
    really has that offset then: two that stand are an overlap, none is a gap.
    """
    bracketed = df.withColumns(
        {
            f"_{side}_{out}": zone_offset(F.col(wall) + shift, timezone)
            for out, wall in walls.items()
            for side, shift in (("before", -_DAY_SECONDS), ("after", _DAY_SECONDS))
        }
    )

    def stands(out: str, wall: str, side: str) -> Column:
        moved = F.col(f"_before_{out}") != F.col(f"_after_{out}")
        offset = F.col(f"_{side}_{out}")
        return F.when(moved, zone_offset(F.col(wall) - offset, timezone) == offset)

    checked = bracketed.withColumns(
        {
            f"_{side}_stands_{out}": stands(out, wall, side)
            for out, wall in walls.items()
            for side in ("before", "after")
        }
    )

    def resolution(out: str, wall: str) -> Column:
        with_before = F.col(wall) - F.col(f"_before_{out}")
        with_after = F.col(wall) - F.col(f"_after_{out}")
        before_stands, after_stands = F.col(f"_before_stands_{out}"), F.col(f"_after_stands_{out}")
        neither = ~before_stands & ~after_stands
        seconds = (
            F.when(before_stands & after_stands, F.least(with_before, with_after))
            .when(neither, F.greatest(with_before, with_after))
            .when(before_stands.isNull() | before_stands, with_before)
            .otherwise(with_after)
        )
        kind = (
            F.when(before_stands & after_stands, F.lit(AMBIGUOUS))
            .when(neither, F.lit(NONEXISTENT))
            .otherwise(F.lit(OK))
        )
        return F.when(
            F.col(wall).isNotNull(),
            F.struct(F.timestamp_seconds(seconds).alias("instant"), kind.alias("kind")),
        )

    resolved = checked.withColumns({out: resolution(out, wall) for out, wall in walls.items()})
    return resolved.drop(
        *[
            f"_{part}_{out}"
            for out in walls
            for part in ("before", "after", "before_stands", "after_stands")
        ]
    )


def date_grain(instant: Column, granularity: str, timezone: str) -> Column:
    """First local day of the day, week (Monday), month, quarter or year an instant is in."""
    if granularity not in GRANULARITIES:
        raise ValidationError(f'"{granularity}" is not a granularity.')
    require_timezone(timezone)
    return F.to_date(F.date_trunc(granularity, F.from_utc_timestamp(instant, timezone)))
