"""Queries of problem 5: the most frequent barcodes and sequences of extracted_bc."""

from pyspark.sql import functions as F

from strandloom.llm import heavy
from strandloom.session import table

SHARE, LEAST = 0.004, 10


def p5_counts(spark, d):
    rows = table(spark, d, "extracted_bc", "barcode_1", "sequence")
    found = [
        heavy.most_frequent(rows, c, SHARE, LEAST).select(F.lit(c).alias("field"), "item", "n", "total") for c in ("barcode_1", "sequence")
    ]
    return found[0].unionByName(found[1])


def p5_found(spark, d):
    return p5_counts(spark, d).select("field", "item")


QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}

_COUNTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS field, item, n, total FROM (SELECT {c} item, count(*) n, sum(count(*)) OVER ()::BIGINT total
    FROM extracted_bc WHERE {c} IS NOT NULL GROUP BY 1) WHERE n * 250 >= total AND n >= 10"""
    for c in ("barcode_1", "sequence")
)
SQL = {"p5_found": f"SELECT field, item FROM ({_COUNTS})", "p5_counts": _COUNTS}
