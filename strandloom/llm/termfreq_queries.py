"""Queries of problem 2: frequency of every barcode, with those too rare or too common marked."""

from pyspark.sql import functions as F

from strandloom.llm import termfreq
from strandloom.session import table

RARE = 2
#: Share of all records, in thousandths, from which a barcode is common.
COMMON = {"counts": 600, "barcode_1": 35}


def p2_frequencies(spark, d):
    counts = table(spark, d, "barcode_counts")
    scans = table(spark, d, "extracted_bc")
    rows = {
        "counts": (counts, "barcode", "chunk_id", F.col("n")),
        "barcode_1": (scans, "barcode_1", "read_id", F.lit(1)),
    }
    sides = [
        df.select(F.lit(f).alias("field"), F.col(t).alias("term"), F.col(r).cast("string").alias("record"), w.cast("bigint").alias("w"),
                  F.xxhash64(*(c for c in df.columns if c != "loaded_at")).alias("delivery"))
        for f, (df, t, r, w) in rows.items()
    ]
    counted = termfreq.count_terms(sides[0].unionByName(sides[1]), "term", "record", F.col("field"), F.col("w"), ["delivery"])
    totals = {f: df.select(r).distinct().where(F.col(r).isNotNull()).count() for f, (df, _, r, _) in rows.items()}
    of = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("field")]
    return termfreq.mark_terms(counted, of(totals), RARE, of(COMMON)).withColumnRenamed("term", "barcode")


def p2_found(spark, d):
    return p2_frequencies(spark, d).where(F.col("mark").isNotNull()).select("field", "barcode", "mark")


QUERIES = {"p2_found": p2_found, "p2_frequencies": p2_frequencies}

_ALL = """
WITH c AS (SELECT DISTINCT run_id, chunk_id, barcode, n, seen_at FROM barcode_counts),
e AS (SELECT DISTINCT read_id, run_id, sequence, pos, is_rc, barcode_1, barcode_2, seen_at FROM extracted_bc),
t AS (SELECT 'counts' AS field, barcode, coalesce(sum(n), 0)::BIGINT occurrences, count(DISTINCT chunk_id) records,
  (SELECT count(DISTINCT chunk_id) FROM barcode_counts) total, 600 permille FROM c WHERE barcode IS NOT NULL GROUP BY 2
UNION ALL SELECT 'barcode_1', barcode_1, count(*), count(DISTINCT read_id),
  (SELECT count(DISTINCT read_id) FROM extracted_bc), 35 FROM e WHERE barcode_1 IS NOT NULL GROUP BY 2),
m AS (SELECT field, barcode, occurrences, records,
  CASE WHEN records <= 2 THEN 'rare' WHEN records * 1000 >= permille * total THEN 'common' END mark FROM t)
"""
SQL = {
    "p2_found": _ALL + "SELECT field, barcode, mark FROM m WHERE mark IS NOT NULL",
    "p2_frequencies": _ALL + "SELECT * FROM m",
}
