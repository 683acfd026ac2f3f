"""Progress percentages and elapsed times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sightledger.schema import STAGE_BOUNDS, TERMINAL_STAGE_STATUS


def stage_percent(stage: Column, status: Column, current: Column, total: Column) -> Column:
    """Linear share of the stage interval; unknown stages are 0."""
    start = F.coalesce(*[F.when(stage == s, F.lit(b[0])) for s, b in STAGE_BOUNDS.items()])
    end = F.coalesce(*[F.when(stage == s, F.lit(b[1])) for s, b in STAGE_BOUNDS.items()])
    fraction = F.least(F.greatest(current / F.nullif(total, F.lit(0)), F.lit(0.0)), F.lit(1.0))
    return (
        F.when(start.isNull(), F.lit(0.0))
        .when(total == 0, F.when(status.isin(*TERMINAL_STAGE_STATUS), end).otherwise(start))
        .otherwise(start + (end - start) * fraction)
    )


def elapsed_seconds(started: Column, completed: Column) -> Column:
    """max(0, completed - started) to 3 decimals; bad or missing text gives null."""
    a = F.unix_micros(F.try_to_timestamp(started))
    b = F.unix_micros(F.try_to_timestamp(completed))
    gap = F.greatest(b - a, F.lit(0).cast("long"))
    return F.when(a.isNotNull() & b.isNotNull(), F.round(gap / F.lit(1e6), 3))
