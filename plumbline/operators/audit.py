"""The execution audit: what ran, how often it failed, how long it took.

``executions`` rows carry ``execution_id, saved_query_id, dataset_version, timezone,
status, started_at, completed_at, duration_ms, row_count, error_code``; ``row_count``
is null and ``error_code`` set exactly when the run failed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fence import fence

SUCCESS = "success"
FAILED = "failed"

EXECUTION_SCHEMA = (
    "execution_id string, saved_query_id string, dataset_version bigint, timezone string, "
    "status string, started_at timestamp, completed_at timestamp, duration_ms bigint, "
    "row_count bigint, error_code string"
)

_CELLS_PER_BLOCK = 10_000


def failed_count(executions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    failed = F.count_if(F.col("status") == FAILED).alias("failed_count")
    return executions.groupBy(*by).agg(failed) if by else executions.agg(failed)


def latency_summary(
    runs: DataFrame,
    duration: str = "duration_ms",
    started: Sequence[str] = ("started_at",),
    by: Sequence[str] = (),
) -> DataFrame:
    """Runs, cold (earliest by ``started``), p50, p95, min and max, to two decimals.

    A percentile is the value at index ``min(n - 1, floor(p / 100 * n))`` of the sorted
    durations. Results are rounded to hundredths, and rounding keeps the order, so the
    runs are first folded into a histogram of hundredths. Ranks are then running totals:
    over blocks of 10,000 hundredths, and inside each block. However many runs there
    are, neither step sees more rows than there are distinct hundredths.
    """
    by, wanted = list(by) or ["_all"], list(by)
    if not wanted:
        # Fenced, as Catalyst would fold a constant key and join without one.
        runs = runs.withColumn("_all", fence(F.lit(0)))
    hundredths = F.floor(F.col(duration).cast("double") * 100 + 0.5).cast("bigint")
    measured = runs.filter(F.col(duration).isNotNull()).select(
        *by, hundredths.alias("cell"), *[F.col(c) for c in started if c not in by]
    )
    block = F.floor(F.col("cell") / _CELLS_PER_BLOCK)
    # Everything else is derived from the histogram, so the runs are read once.
    first = F.min(F.struct(*started)).alias("first")
    histogram = measured.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"), first)
    histogram = histogram.withColumn("block", block)
    totals = histogram.groupBy(*by).agg(
        F.sum("n").alias("runs"),
        F.min_by("cell", "first").alias("cold"),
        F.min("cell").alias("lowest"),
        F.max("cell").alias("highest"),
    )
    blocks = histogram.groupBy(*by, "block").agg(F.sum("n").alias("in_block"))
    earlier = F.sum("in_block").over(Window.partitionBy(*by).orderBy("block")) - F.col("in_block")
    blocks = blocks.select(*by, "block", earlier.alias("before_block"))
    inside = F.sum("n").over(Window.partitionBy(*by, "block").orderBy("cell"))
    ranked = _same(histogram, blocks, [*by, "block"]).withColumn(
        "through", F.col("before_block") + inside
    )

    def placed(p: int):
        # In doubles, as the definition has it: 0.95 * n may fall just below a whole number.
        index = F.least(F.col("runs") - 1, F.floor(F.lit(p / 100) * F.col("runs")))
        return F.min(F.when(F.col("through") > index, F.col("cell")))

    ends = ["runs", "cold", "lowest", "highest"]
    summary = (
        _same(ranked, totals, by)
        .groupBy(*by, *ends)
        .agg(placed(50).alias("p50"), placed(95).alias("p95"))
    )
    named = {
        "cold": "cold_ms",
        "p50": "p50_ms",
        "p95": "p95_ms",
        "lowest": "min_ms",
        "highest": "max_ms",
    }
    return summary.select(
        *wanted, "runs", *[(F.col(old) / 100.0).alias(new) for old, new in named.items()]
    )


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, a null being equal to a null: grouping has made it a key."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])


def modal_value(table: DataFrame, column: str) -> DataFrame:
    """The most frequent value and its count; of equally frequent ones the smallest."""
    return (
        table.groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
        .limit(1)
    )
