"""Queries of the core problems: skewed keys and lines that cannot be loaded."""

from pyspark.sql import functions as F

from strandloom.operators import rejects, skew
from strandloom.session import table


def _totals(spark, d):
    entries = table(spark, d, "barcode_entry", "class_id", "barcode", "count")
    listed = table(spark, d, "whitelist", "class_id", "barcode")
    return skew.eager_join_totals(entries, listed, ["class_id", "barcode"], sums={"sum_count": F.col("count")})


def p3_found(spark, d):
    rows = table(spark, d, "barcode_entry").count()
    return skew.dominant_keys(_totals(spark, d), rows, 2, "barcode").select("class_id", "barcode")


def p3_key_totals(spark, d):
    return _totals(spark, d)


def p3_class_totals(spark, d):
    return skew.roll_up(_totals(spark, d), ["class_id"], ["n_rows", "sum_count", "n_joined"])


def _loaded(spark, d):
    return rejects.load_records(table(spark, d, "raw_lines", "line_id", "kind", "line"))


def p4_found(spark, d):
    return rejects.rejected(_loaded(spark, d)).select("line_id", "reason")


def p4_reads(spark, d):
    return rejects.typed_reads(_loaded(spark, d))


def p4_layout(spark, d):
    return rejects.typed_layout(_loaded(spark, d))


def p4_judges(spark, d):
    """How many lines of a reason were told by the reader, by a rule beyond its types, and by the grammar alone."""
    return rejects.rejected(_loaded(spark, d)).groupBy("kind", "reason", "judge").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p3_found, p3_key_totals, p3_class_totals, p4_found, p4_reads, p4_layout, p4_judges)}

_TOTALS = """
WITH e AS (SELECT class_id, barcode, count(*) n_rows, sum("count")::BIGINT sum_count FROM barcode_entry GROUP BY ALL),
w AS (SELECT class_id, barcode, count(*) n FROM whitelist GROUP BY ALL),
t AS (SELECT e.class_id, e.barcode, n_rows, sum_count, coalesce(n, 0) n_right,
  n_rows * greatest(coalesce(n, 0), 1) n_joined, sum_count * greatest(coalesce(n, 0), 1) sum_count_joined
  FROM e LEFT JOIN w ON e.class_id = w.class_id AND e.barcode = w.barcode)
"""

#: Grammar and rules of the raw lines, stated once more in SQL.
_LINES = r"""
WITH b AS (SELECT line_id, kind, regexp_replace(regexp_replace(line, '^\x{FEFF}', ''), '\r$', '') s FROM raw_lines),
q AS (SELECT *, regexp_full_match(s, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') ok,
  list_transform(regexp_extract_all(',' || s, ',("(?:[^"]|"")*"|[^",]*)', 1),
    lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) f FROM b),
j AS (SELECT line_id, kind, f, CASE WHEN NOT ok THEN 'quoting'
  WHEN len(f) <> CASE kind WHEN 'read' THEN 5 ELSE 7 END THEN 'columns'
  WHEN kind = 'read' AND NOT (regexp_full_match(f[3], '[ACGTNacgtn]+') AND ((f[5] = 'false' AND f[4] = '')
    OR (f[5] = 'true' AND length(f[4]) = length(f[3]) AND regexp_full_match(f[4], '[!-~]+')))) THEN 'value'
  WHEN kind = 'layout' AND NOT ((f[3] = '' OR regexp_full_match(f[3], '0*[1-9][0-9]*(-0*[1-9][0-9]*)?'))
    AND f[4] IN ('static', 'variable') AND regexp_full_match(f[2], '[ACGTN]*')) THEN 'value' END reason FROM q)
"""

SQL = {
    "p3_found": _TOTALS
    + "SELECT class_id, barcode FROM t WHERE barcode IS NOT NULL AND n_rows * 50 >= (SELECT count(*) FROM barcode_entry)",
    "p3_key_totals": _TOTALS + "SELECT * FROM t",
    "p3_class_totals": _TOTALS
    + "SELECT class_id, sum(n_rows)::BIGINT n_rows, sum(sum_count)::BIGINT sum_count, sum(n_joined)::BIGINT n_joined FROM t GROUP BY 1",
    "p4_found": _LINES + "SELECT line_id, reason FROM j WHERE reason IS NOT NULL",
    "p4_reads": _LINES
    + "SELECT line_id, f[1] read_id, f[2] \"comment\", f[3] seq, f[4] qual, f[5] = 'true' is_fastq FROM j WHERE reason IS NULL AND kind = 'read'",
    "p4_layout": _LINES
    + """SELECT line_id, f[1] element, f[2] seq, f[3] expected_length,
    CASE WHEN f[3] = '' THEN NULL ELSE list_min(list_transform(string_split(f[3], '-'), lambda x: x::BIGINT)) END min_length,
    CASE WHEN f[3] = '' THEN NULL ELSE list_max(list_transform(string_split(f[3], '-'), lambda x: x::BIGINT)) END max_length,
    f[4] "type", f[5] "class", f[6] whitelist, f[7] flags FROM j WHERE reason IS NULL AND kind = 'layout'""",
}
