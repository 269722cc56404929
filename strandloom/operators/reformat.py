"""Rewriting of record headers: collapsed names, spatial coordinates, one output per barcode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import tags
from strandloom.session import small_side


def with_tags(records: DataFrame, sep: str = "_") -> DataFrame:
    """Add qname, cb and ub: from a collapsed name if it is one, else from the tags."""
    parsed = records.withColumn("__p", tags.parse_collapsed(F.col("read_id"), sep))
    return parsed.select(
        "*", F.coalesce("__p.qname", "read_id").alias("qname"),
        F.coalesce("__p.cb", tags.cell_tag(F.col("read_id"), F.col("comment"))).alias("cb"), F.coalesce("__p.ub", tags.molecule_tag(F.col("comment"))).alias("ub"),
    ).drop("__p")


def collapse_headers(records: DataFrame, sep: str = "_") -> DataFrame:
    """The name takes CB and UB in; the comment is dropped."""
    t = with_tags(records, sep)
    return t.withColumn("read_id", tags.collapse(F.col("qname"), F.col("cb"), F.col("ub"), sep)).withColumn("comment", F.lit("")).drop("qname")


def resolve_axes(cells: DataFrame, x_axis: DataFrame, y_axis: DataFrame, cb: str = "cb") -> DataFrame:
    """Add x_idx and y_idx of a CB: two barcodes joined by '-' in either order, else the only split of it into an x and a y
    barcode. Axis tables hold barcode and ordinal. Unresolved ones have nulls.
    """
    distinct = cells.select(cb).where(F.col(cb).isNotNull()).distinct()
    x = small_side(x_axis.select(F.col("barcode").alias("xb"), F.col("ordinal").alias("x_idx")).dropDuplicates(["xb"]))
    y = small_side(y_axis.select(F.col("barcode").alias("yb"), F.col("ordinal").alias("y_idx")).dropDuplicates(["yb"]))
    sizes = lambda df: sorted(r[0] for r in df.select(F.length("barcode")).distinct().collect())
    part = F.split(F.col(cb), "-")
    cut = F.size(part) >= 2
    ways = [(cut, part[0], F.get(part, F.lit(1)), 0), (cut, F.get(part, F.lit(1)), part[0], 1)]
    for a in sizes(x_axis):
        for b in sizes(y_axis):
            fits = F.length(cb) == a + b
            ways.append((fits, F.substring(cb, 1, a), F.substring(cb, a + 1, b), 2))
            ways.append((fits, F.substring(cb, b + 1, a), F.substring(cb, 1, b), 2))
    tried = F.array(*(F.struct(ok.alias("ok"), p.alias("xb"), q.alias("yb"), F.lit(k).alias("way")) for ok, p, q, k in ways))
    open_ = distinct.withColumn("t", F.explode(tried)).where("t.ok").select(cb, "t.xb", "t.yb", "t.way").distinct()
    hits = open_.join(x, "xb").join(y, "yb")
    best = hits.groupBy(cb).agg(F.min_by(F.struct("x_idx", "y_idx"), "way").alias("xy"), F.min("way").alias("way"), F.count_if(F.col("way") == 2).alias("n"))
    found = best.where((F.col("way") < 2) | (F.col("n") == 1)).select(cb, "xy.*")
    return cells.join(found, cb, "left")


def coordinate_headers(records: DataFrame, x_axis: DataFrame, y_axis: DataFrame, bin_um: int = 2, sep: str = "_") -> DataFrame:
    """Names and comments with spatial bins for records whose CB resolves and that have a UB; others stay as they are."""
    t = resolve_axes(with_tags(records, sep), x_axis, y_axis)
    x, y = tags.bin_of(F.col("x_idx"), bin_um), tags.bin_of(F.col("y_idx"), bin_um)
    ok = F.col("x_idx").isNotNull() & (F.length(F.coalesce("ub", F.lit(""))) > 0)
    note = F.concat(F.lit("BC:Z:"), tags.spatial_id(bin_um, x, y), F.lit("\tCB:Z:"), F.col("cb"), F.lit("\tUB:Z:"), F.col("ub"), F.lit(f"\tRG:Z:{tags.bin_tag(bin_um)}"))
    named = t.withColumn("read_id", F.when(ok, tags.coordinate_name(F.col("qname"), x, y)).otherwise(F.col("qname")))
    return named.withColumn("comment", F.when(ok, note).otherwise(F.col("comment"))).drop("qname")
