"""Structured Streaming: levels arrive as (gauge, t, level), days leave when the watermark has passed them.

State is a row for each gauge, open day and distinct level (a histogram), so it does not grow with the
grid; cells join when a day is complete, in foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.operators import duration


def held(levels: DataFrame) -> DataFrame:
    """Gaps take the last level of their gauge, kept as state; a leading gap stays, as the future is not known."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values("t")
        filled = rows["level"].ffill()
        if last is not None:
            filled = filled.fillna(last)
        known = filled.dropna()
        if len(known):
            state.update((float(known.iloc[-1]),))
        yield rows.assign(level=filled)[["gauge", "t", "level"]]

    rows = levels.select("gauge", "t", "level")
    return rows.groupBy("gauge").applyInPandasWithState(run, rows.schema, "last double", "append", GroupStateTimeout.NoTimeout)


def day_histograms(levels: DataFrame, late: str = "1 hour") -> DataFrame:
    """(gauge, day_start, ws, n) of complete days. Times must be timestamps with a zone to carry a watermark."""
    rows = levels.select("gauge", F.col("t").cast("timestamp").alias("t"), F.col("level").alias("ws")).filter("ws is not null and not isnan(ws)")
    days = rows.withWatermark("t", late).groupBy("gauge", F.window("t", "1 day").alias("w"), "ws")
    return days.agg(F.count("*").alias("n")).select("gauge", F.col("w.start").alias("day_start"), "ws", "n")


def run_daily(levels: DataFrame, cells: DataFrame, windows: duration.Windows, thresholds: list[float], timestep: int, sink: Callable[[DataFrame, int], None], checkpoint: str, late: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that gives sink the minutes (cell_id, day_start, by test) of each batch's complete days."""
    tests = duration.metric_columns(windows, thresholds)

    def batch(hist: DataFrame, number: int) -> None:
        joined = duration.usable(cells).select("cell_id", "gauge", "dem").join(hist, "gauge")
        sink(duration._sums(joined, ["cell_id", "day_start"], tests, timestep), number)

    writer = day_histograms(levels, late).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def to_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A sink by batch number: a batch that is repeated after a failure replaces itself."""

    def sink(minutes: DataFrame, number: int) -> None:
        minutes.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink
