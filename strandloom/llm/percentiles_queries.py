"""Queries of problem 1: percentiles of the aligned elements of each class."""

from pyspark.sql import functions as F

from strandloom.llm import percentiles
from strandloom.session import table

SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]
COLUMNS = ["edit_distance", "start", "stop"]
#: Kept apart: nothing, days, runs, and the runs of a day.
SETS = [(), ("day",), ("run_id",), ("day", "run_id")]
#: Tasks that the rows of one class, run and day are spread over.
SALTS = 4


def aligned(spark, d):
    """Elements that were aligned, redelivered ones once (all their columns but loaded_at are equal; null ids stand for
    themselves). Rows of a day's run meet in a few tasks, so that their sketches need no second gathering of raw values."""
    rows = table(spark, d, "elements", "elem_id", "class_id", "run_id", "seen_at", *COLUMNS)
    rows = rows.where("not (coalesce(edit_distance, 0) = -1 and coalesce(start, 0) = 0 and coalesce(stop, 0) = 0)")
    rows = rows.withColumn("day", F.to_date("seen_at")).drop("seen_at")
    salt = F.pmod(F.xxhash64(F.coalesce("elem_id", F.monotonically_increasing_id())), F.lit(SALTS)).cast("tinyint")
    rows = rows.withColumn("salt", salt).withColumn("lone", F.when(F.col("elem_id").isNull(), F.monotonically_increasing_id()))
    met = rows.repartition("class_id", "run_id", "day", "salt")
    return met.dropDuplicates(["class_id", "run_id", "day", "salt", "elem_id", "lone"]).drop("salt", "lone")


def p1_percentiles(spark, d):
    """Percentiles with mergeable sketches of the whole, of days, of runs and of the runs of a day."""
    return percentiles.part_percentiles(aligned(spark, d), ["class_id"], ["day", "run_id"], COLUMNS, SHARES, SETS)


def p1_run_percentiles(spark, d):
    """Those of each run, put together from the kept sketches of its days."""
    days = percentiles.part_percentiles(aligned(spark, d), ["class_id"], ["day", "run_id"], COLUMNS, SHARES, [("day", "run_id")])
    return percentiles.percentiles(percentiles.merge_sketches(days, ["class_id", "run_id"]), SHARES)


def p1_rank_check(spark, d):
    """Exact ranks of the percentiles of the whole against the stated bound."""
    rows = aligned(spark, d)
    daily = percentiles.group_percentiles(rows, ["class_id"], COLUMNS, SHARES, by="day")
    names = ["p" + f"{s * 100:g}".replace(".", "_") for s in SHARES]
    given = daily.select("class_id", "column", F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.col(n).alias("value")) for s, n in zip(SHARES, names)))).alias("v"))
    given = given.groupBy("class_id", "column").agg(F.collect_list("v").alias("v"))
    long = rows.select("class_id", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in COLUMNS))).alias("e"))
    counted = long.select("class_id", "e.*").where("x is not null").groupBy("class_id", "column", "x").agg(F.count(F.lit(1)).alias("c"))
    # both sides are grouped: a row per class, column and distinct value against one per class and column
    met = counted.join(given, (counted["class_id"].eqNullSafe(given["class_id"])) & (counted["column"] == given["column"])).select(counted["class_id"], counted["column"], "x", "c", F.explode("v").alias("v"))
    ranks = met.groupBy("class_id", "column", F.col("v.share").alias("share")).agg(
        F.sum("c").alias("n"),
        F.sum(F.when(F.col("x") < F.col("v.value"), F.col("c")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("x") <= F.col("v.value"), F.col("c")).otherwise(0)).alias("upto"),
    )
    target = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n") - 1e-9))
    allowed = percentiles.ERROR * F.least(F.col("share"), 1 - F.col("share")) * F.col("n") + 1
    within = (target >= F.col("below") + 1 - allowed) & (target <= F.col("upto") + allowed)
    return ranks.select("class_id", "column", "share", "n", within.alias("within"))


QUERIES = {"p1_percentiles": p1_percentiles, "p1_run_percentiles": p1_run_percentiles, "p1_rank_check": p1_rank_check}

_SHARES = ", ".join(f"({s})" for s in SHARES)
_LONG = " UNION ALL ".join(f"SELECT class_id, '{c}' AS \"column\", {c} AS x FROM one" for c in COLUMNS)
#: The percentiles are within a rank error, not equal to exact ones: p1_rank_check gives exact ranks the word.
SQL = {
    "p1_rank_check": f"""
WITH one AS (SELECT DISTINCT elem_id, class_id, edit_distance, start, stop FROM elements
             WHERE NOT (coalesce(edit_distance, 0) = -1 AND coalesce(start, 0) = 0 AND coalesce(stop, 0) = 0)),
long AS ({_LONG})
SELECT class_id, "column", share::DOUBLE AS share, n, true AS within
FROM (SELECT class_id, "column", count(*) AS n FROM long WHERE x IS NOT NULL GROUP BY 1, 2), (VALUES {_SHARES}) v(share)
""",
}
