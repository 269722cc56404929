"""Queries of problem 8: passages of eval_items in the dialogue of documents."""

from pyspark.sql import functions as F

from strandloom.llm import leak
from strandloom.session import table


def _leaks(spark, d):
    return leak.find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p8_found(spark, d):
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_matches(spark, d):
    return _leaks(spark, d)


def p8_clean(spark, d):
    """Documents that hold no passage, by language."""
    left = leak.without_leaks(table(spark, d, "documents", "doc_id", "lang"), _leaks(spark, d))
    return left.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {f.__name__: f for f in (p8_found, p8_matches, p8_clean)}
#: No SQL: dialogue extraction and tolerant word comparison are tested against a brute-force version in tests/llm.
SQL: dict[str, str] = {}
