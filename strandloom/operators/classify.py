"""Filters on located elements, read types and counters, as expressions on the array of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases by which variable elements may overlap.
OVERLAP = 3


def _of(elements: Column, direction: str) -> Column:
    return F.filter(elements, lambda e: e["direction"] == direction)


def has_static(elements: Column, direction: str) -> Column:
    edges = ("start", "stop", "poly_tail")
    return F.exists(elements, lambda e: (e["direction"] == direction) & (e["type"] == "static") & ~e["global_class"].isin(*edges))


def read_length(elements: Column, direction: str) -> Column:
    """Bases of the window of the strand's read, before anything is cut out of it; 0 without one."""
    found = F.filter(elements, lambda e: (e["direction"] == direction) & (e["global_class"] == "read") & e["seq"].isNotNull())
    first = F.get(found, F.lit(0))
    return F.coalesce(first["stop"] - first["start"] + 1, F.lit(0))


def long_enough(length: Column, least: int) -> Column:
    """Whether a strand's read has bases, and as many as the layout's own structure."""
    return (length > 0) & (length >= least)


def invalid_element(elements: Column, direction: str) -> Column:
    """First element in order without a proper position; null if all have one."""
    bad = F.filter(
        F.sort_array(F.transform(_of(elements, direction), lambda e: F.struct(e["ord"], e["class_id"], e["global_class"], e["start"], e["stop"]))),
        lambda e: ~e["global_class"].isin("start", "stop", "poly_tail") & ~((e["start"] > 0) & (e["start"] < e["stop"])),
    )
    return F.get(bad, F.lit(0))["class_id"]


def overlapping_element(elements: Column, direction: str) -> Column:
    """First variable element in order that reaches more than OVERLAP bases into a later one."""
    vars_ = F.sort_array(
        F.transform(F.filter(_of(elements, direction), lambda e: e["type"] == "variable"), lambda e: F.struct(e["ord"], e["class_id"], e["start"], e["stop"]))
    )
    bad = F.filter(vars_, lambda a: F.exists(vars_, lambda b: (b["ord"] > a["ord"]) & (a["stop"] >= b["start"] + OVERLAP)))
    return F.get(bad, F.lit(0))["class_id"]


def direction_reason(elements: Column, direction: str, least: int) -> Column:
    """Why a direction is dropped, the first reason that applies; null if it stands."""
    invalid, over = invalid_element(elements, direction), overlapping_element(elements, direction)
    return (
        F.when(~has_static(elements, direction), f"{direction}_FILTERED_NO_STATIC_ELEMENTS")
        .when(~long_enough(read_length(elements, direction), least), f"{direction}_FILTERED_READ_LENGTH")
        .when(invalid.isNotNull(), F.concat(F.lit(":FILTERED_ELEMENT_"), invalid, F.lit("_INVALID_POSITIONS")))
        .when(over.isNotNull(), F.concat(F.lit(":FILTERED_VARIABLE_"), over, F.lit("_OVERLAPPING_POSITIONS")))
    )


def valid_count(elements: Column, direction: str, barcodes: bool) -> Column:
    """Variable elements that have been judged at all: reads, and barcodes if asked for."""
    groups = ("read", "barcode") if barcodes else ("read",)
    return F.size(F.filter(_of(elements, direction), lambda e: (e["type"] == "variable") & e["element_pass"].isNotNull() & e["global_class"].isin(*groups)))


def read_type(forward: Column, reverse: Column) -> Column:
    """By the counts of the directions that stand (0 for one that doesn't): equal and not 0 is a concatenate."""
    return (
        F.when((forward > 0) & (forward == reverse), "concatenate").when((forward > 0) & (forward > reverse), "forward").when(reverse > 0, "reverse").otherwise("filtered")
    )


def classify(located: DataFrame, least: int, bulk: bool = False) -> DataFrame:
    """Add forward_reason, reverse_reason and read_type."""
    e = F.col("elements")
    out = located.withColumn("forward_reason", direction_reason(e, "forward", least)).withColumn("reverse_reason", direction_reason(e, "reverse", least))
    n = lambda d: F.when(F.col(f"{d}_reason").isNull(), valid_count(e, d, not bulk)).otherwise(0)
    return out.withColumn("read_type", read_type(n("forward"), n("reverse")))


def masked_read(seq: Column, spans: Column, start: Column, stop: Column) -> Column:
    """The window start to stop of a read, without the bases that other elements cover and without any N.

    ``spans`` holds structs of start and stop. The pieces between the sorted spans are joined: linear in the window.
    """
    begin = F.struct(start.cast("int").alias("at"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        inside = (s["stop"] >= acc["at"]) & (s["start"] <= stop)
        piece = F.when(inside & (s["start"] > acc["at"]), F.substring(seq, acc["at"], s["start"] - acc["at"])).otherwise("")
        at = F.when(inside, F.greatest(acc["at"], s["stop"] + 1)).otherwise(acc["at"])
        return F.struct(at.cast("int").alias("at"), F.concat(acc["text"], piece).alias("text"))

    def last(acc: Column) -> Column:
        rest = F.when(acc["at"] <= stop, F.substring(seq, acc["at"], stop - acc["at"] + 1)).otherwise("")
        return F.replace(F.concat(acc["text"], rest), F.lit("N"), F.lit(""))

    return F.aggregate(F.sort_array(spans), begin, step, last)


def counters(elements: DataFrame) -> DataFrame:
    """Counters per class and barcode. Columns in: class_id, barcode, direction, read_type, corrected."""
    kind = F.col("read_type")
    passing = (kind != "filtered") & ((kind == F.col("direction")) | (kind == "concatenate"))
    n = lambda c, name: F.count_if(c).alias(name)
    concat = passing & (kind == "concatenate")
    return elements.groupBy("class_id", "barcode").agg(
        n(passing & ~F.col("corrected"), "raw_count"), n(passing, "total_count"), n(passing & F.col("corrected"), "corrected_count"),
        n(passing & (kind == "forward"), "forw_count"), n(passing & (kind == "reverse"), "rev_count"),
        n(concat & (F.col("direction") == "forward"), "forw_concat_count"), n(concat & (F.col("direction") == "reverse"), "rev_concat_count"),
        n(~passing, "filtered_count"),
    )


def summary(counted: DataFrame) -> DataFrame:
    return counted.where("total_count > 0")
