"""The sequence functions as temporary SQL functions of a session; native, so the planner sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name(parameters) and body in SQL
SCALAR = {
    "revcomp(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGT', 'TGCA'))",
    "encode_bases(s STRING) RETURNS BIGINT": "IF(s RLIKE '^[ACGT]{1,31}$', aggregate(split(s, ''), 0L, (a, x) -> a * 4 + locate(x, 'ACTG') - 1), NULL)",
    "decode_bases(v BIGINT, n INT) RETURNS STRING": "array_join(transform(sequence(n - 1, 0, -1), i -> substring('ACTG', int(shiftright(v, 2 * i) & 3) + 1, 1)), '')",
    "distinct_kmers(s STRING, k INT) RETURNS INT": "IF(length(s) >= k, size(array_distinct(transform(sequence(1, length(s) - k + 1), i -> substring(s, i, k)))), 0)",
    "homopolymer_end(s STRING, n INT) RETURNS BOOLEAN": "length(s) >= n AND (left(upper(s), n) = repeat(left(upper(s), 1), n) OR right(upper(s), n) = repeat(right(upper(s), 1), n))",
}
TABLE = {
    "substitutions(s STRING) RETURNS TABLE (neighbour STRING)": """SELECT DISTINCT x FROM (SELECT concat(left(substitutions.s, i - 1), b, substring(substitutions.s, i + 1)) AS x
        FROM (SELECT explode(sequence(1, length(substitutions.s))) AS i), (SELECT explode(array('A', 'C', 'G', 'T')) AS b)) WHERE x <> substitutions.s""",
}


def register(spark: SparkSession) -> None:
    for head, body in (SCALAR | TABLE).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
