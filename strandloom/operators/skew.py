"""Per-key totals under heavy key skew, by eager aggregation through a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eager_join_totals(
    left: DataFrame,
    right: DataFrame,
    left_keys: list[str],
    right_keys: list[str] | None = None,
    sums: dict[str, Column] | None = None,
    how: str = "left",
) -> DataFrame:
    """Aggregate ``left JOIN right`` per key without ever joining raw rows.

    Both inputs are first reduced to one compact state per join key (row count, and for the left input the sums in
    ``sums``). The reduction runs map-side before the shuffle, so a key owning a third of all rows reaches its reducer
    as one partial state per input partition. States are then joined, one row against one row, and combined
    algebraically: ``n_joined = n_rows * matches`` and ``<sum>_joined = <sum> * matches``, where matches is the number of
    right rows of the key (a left join keeps unmatched keys once).

    Output: the left keys, ``n_rows``, every name in ``sums``, ``n_right``, ``n_joined`` and ``<name>_joined``.

    Null keys form a group of their own and match nothing on the right (SQL equality). Null addends are skipped; a key
    with only null addends has a null sum. Ties and repeated rows count as rows. Empty inputs give an empty result (an
    empty right side leaves ``n_right`` at 0). Other columns of either input, clashing names included, are ignored.
    """
    right_keys = right_keys or left_keys
    sums = sums or {}
    states = left.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(left_keys))).agg(
        F.count(F.lit(1)).alias("n_rows"), *(F.sum(c).alias(n) for n, c in sums.items())
    )
    matches = right.groupBy(*(F.col(k).alias(f"__r{i}") for i, k in enumerate(right_keys))).agg(F.count(F.lit(1)).alias("__n"))
    on = reduce(lambda a, b: a & b, (F.col(f"__k{i}") == F.col(f"__r{i}") for i in range(len(left_keys))))
    n = F.coalesce(F.col("__n"), F.lit(0))
    times = F.greatest(n, F.lit(1)) if how == "left" else n
    return states.join(matches, on, how).select(
        *(F.col(f"__k{i}").alias(k) for i, k in enumerate(left_keys)),
        "n_rows",
        *sums,
        n.alias("n_right"),
        (F.col("n_rows") * times).alias("n_joined"),
        *((F.col(s) * times).alias(f"{s}_joined") for s in sums),
    )


def roll_up(totals: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Combine the compact states of finer keys into those of ``keys``; sums of sums, counts of counts."""
    return totals.groupBy(*keys).agg(*(F.sum(m).alias(m) for m in measures))


def dominant_keys(totals: DataFrame, rows: int, share_percent: int, not_null: str) -> DataFrame:
    """Keys holding at least ``share_percent`` of ``rows``, compared in whole numbers.

    A key's rows are read from the joined state: its joined rows are its own times its matches.
    """
    matches = F.greatest(F.col("n_right"), F.lit(1))
    return totals.where(F.col(not_null).isNotNull() & (F.col("n_joined") * 100 >= F.lit(share_percent * rows) * matches))
