"""Event counts per sliding window, the same for a table and for a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Fixed values. The configured report window. Its start offset of 10 minutes is one whole
# slide, which aligns the windows exactly as no offset does.
WINDOW = "1 hour"
SLIDE = "10 minutes"
START = "0 minutes"


def sliding_report(
    events: DataFrame,
    ts_col: str,
    attributes: Sequence[str],
    window: str = WINDOW,
    slide: str = SLIDE,
    start: str = START,
    watermark: str | None = None,
) -> DataFrame:
    """``(window_start, window_end, *attributes, n)``.

    On a stream ``watermark`` bounds the state: a row later than that against the newest
    event time seen is dropped, and a window is emitted once it can no longer change.
    """
    if watermark and events.isStreaming:
        events = events.withWatermark(ts_col, watermark)
    spans = F.window(ts_col, window, slide, start).alias("span")
    counted = events.groupBy(spans, *attributes).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        F.col("span.start").alias("window_start"),
        F.col("span.end").alias("window_end"),
        *attributes,
        "n",
    )


def sliding_report_panes(
    events: DataFrame,
    ts_col: str,
    attributes: Sequence[str],
    window: str = WINDOW,
    slide: str = SLIDE,
    watermark: str | None = None,
) -> DataFrame:
    """``(window_start, window_end, attribute, value, n)``: a report by every listed attribute on its own.

    Each event is counted once per attribute in the pane of one slide where it lies; windows add up their
    panes, so work per event does not grow with the number of windows that overlap. The attributes are
    grouping sets of one attribute each; values are strings, a NULL is a value. An event without a time is in no window.

    On a stream both sums keep state until ``watermark`` has passed: a row later than that against the
    newest event time seen is dropped, and a window is emitted once it can no longer change (append mode).
    """
    if watermark and events.isStreaming:
        events = events.withWatermark(ts_col, watermark)
    sets = F.array(
        *[
            F.struct(F.lit(name).alias("attribute"), F.col(name).cast("string").alias("value"))
            for name in attributes
        ]
    )
    each = events.where(F.col(ts_col).isNotNull()).select(F.col(ts_col).alias("_ts"), F.inline(sets))
    panes = each.groupBy(F.window("_ts", slide).alias("pane"), "attribute", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    spans = F.window(F.window_time("pane"), window, slide).alias("span")
    counted = panes.groupBy(spans, "attribute", "value").agg(F.sum("n").alias("n"))
    return counted.select(
        F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "attribute", "value", "n"
    )


def write_report(report: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the closed windows of a streamed report to a table, until all available events are read."""
    return (
        report.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
