"""Barcode counters over a stream of records: stateful per class and barcode, fed by micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A barcode is held back while it has this many reads given to it and fewer than two of its own.
FREE = 10


def running_counts(barcodes: DataFrame) -> DataFrame:
    """Counts per barcode so far, in update mode: Spark's own stateful aggregation."""
    return barcodes.groupBy("barcode").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(barcodes: DataFrame, at: str = "seen_at", width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Counts per barcode and window of event time; rows later than ``late`` are no longer taken in."""
    return barcodes.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "barcode").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "barcode", "n"
    )


def gated_counters(barcodes: DataFrame) -> DataFrame:
    """raw, corrected and whether the barcode stands, per class and barcode. Columns in: class_id, barcode, corrected.

    The verdict follows from the sums alone, so the order of the reads doesn't matter: with two raw reads the corrected
    ones may be 0.8 of all (from ten reads on); with fewer, less than FREE corrected ones are let through.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        raw, fixed = state.get if state.exists else (0, 0)
        for pdf in parts:
            n = int(pdf["corrected"].sum())
            raw, fixed = raw + len(pdf) - n, fixed + n
        state.update((raw, fixed))
        total = raw + fixed
        stands = (total < 10 or (fixed + 1) / (total + 1) <= 0.8) if raw >= 2 else total < FREE
        yield pd.DataFrame({"class_id": [key[0]], "barcode": [key[1]], "raw_count": [raw], "corrected_count": [fixed], "stands": [stands]})

    return barcodes.groupBy("class_id", "barcode").applyInPandasWithState(
        step, "class_id string, barcode string, raw_count bigint, corrected_count bigint, stands boolean", "raw bigint, fixed bigint", "update", GroupStateTimeout.NoTimeout
    )
