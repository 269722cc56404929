"""Queries of problem 7: documents packed into containers of each capacity."""

from pyspark.sql import functions as F

from strandloom.llm import packing
from strandloom.session import stored, table


def p7_containers(spark, d):
    """Every document, or part of one longer than the capacity, with its container."""
    packed = packing.pack_texts(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "pack_kind"), "doc_id", "text")
    return packed.withColumnRenamed("key", "doc_id")


def p7_fill(spark, d):
    """Containers used, against the fewest that any packing needs; the part of the tokens in containers of the program (the
    rest is best fit's) and the largest content."""
    kinds = table(spark, d, "pack_kind").select("kind", "capacity").distinct()
    packed = stored(p7_containers(spark, d))
    lengths = packed.where("n_tokens > 0").groupBy("kind", "n_tokens").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(kinds), "kind")
    histograms: dict = {}
    for r in lengths.collect():  # at most as many rows as all capacities together
        histograms.setdefault((r["kind"], r["capacity"]), {})[r["n_tokens"]] = r["n"]
    bounds = spark.createDataFrame([(k, c, packing.dual_bound(h, c)) for (k, c), h in histograms.items()], "kind string, capacity int, least bigint")
    by = packed.groupBy("kind", "container").agg(F.sum("n_tokens").alias("n"), F.sum(F.when(F.col("by_program"), F.col("n_tokens"))).alias("p"))
    by = by.groupBy("kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), (F.sum("p") / F.sum("n")).alias("by_program"))
    return by.join(F.broadcast(bounds), "kind").withColumn("over_least", F.col("containers") / F.col("least") - 1)


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
#: No SQL: a packing has many right answers; tests/llm checks capacity, completeness and fill.
SQL: dict[str, str] = {}
