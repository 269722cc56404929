"""Queries of problem 6: written and observed barcodes mapped to the whitelist."""

from pyspark.sql import functions as F

from strandloom.llm import canonical
from strandloom.session import small_side, table

CLASSES = ["barcode", "barcode_1", "barcode_2"]


def cases(spark, d):
    """Non-null values that are no barcode of their class as they stand, each record once."""
    entries = table(spark, d, "barcode_entry", "entry_id", "class_id", "barcode").select(
        F.lit("barcode_entry").alias("src"), F.col("entry_id").alias("rec_id"), "class_id", F.col("barcode").alias("value")
    )
    seen = table(spark, d, "elements", "elem_id", "class_id", "global_class", "original_seq", "seq")
    seen = seen.where(F.col("global_class").isin(CLASSES)).select(
        F.lit("elements").alias("src"),
        F.col("elem_id").alias("rec_id"),
        F.regexp_replace("class_id", "^rc_", "").alias("class_id"),
        F.coalesce("original_seq", "seq").alias("value"),
    )
    both = entries.unionByName(seen).where(F.col("value").isNotNull() & F.col("class_id").isin(CLASSES))
    listed = table(spark, d, "whitelist", "class_id", F.col("barcode").alias("value")).distinct()
    return both.join(small_side(listed), ["class_id", "value"], "left_anti").dropDuplicates(["src", "rec_id", "class_id", "value"])


def p6_found(spark, d):
    mapped = canonical.map_to_list(cases(spark, d), table(spark, d, "whitelist"), keep=("src", "rec_id"))
    return mapped.select("src", "rec_id", "canonical")


def p6_unmatched(spark, d):
    """Values without an entry, by class and value, with how many records carry them."""
    mapped = canonical.map_to_list(cases(spark, d), table(spark, d, "whitelist"), keep=("src",))
    return mapped.where(F.col("canonical") == canonical.UNMATCHED).groupBy("src", "class_id", "value").agg(F.count(F.lit(1)).alias("n_records"))


QUERIES = {"p6_found": p6_found, "p6_unmatched": p6_unmatched}

_MAPPED = r"""
WITH w AS (SELECT DISTINCT class_id, barcode FROM whitelist),
raw AS (SELECT 'barcode_entry' AS src, entry_id AS rec_id, class_id, barcode AS v FROM barcode_entry
  UNION ALL SELECT 'elements', elem_id, regexp_replace(class_id, '^rc_', ''), coalesce(original_seq, seq) FROM elements WHERE global_class IN ('barcode', 'barcode_1', 'barcode_2')),
c AS (SELECT DISTINCT * FROM raw WHERE v IS NOT NULL AND class_id IN ('barcode', 'barcode_1', 'barcode_2') AND (class_id, v) NOT IN (SELECT (class_id, barcode) FROM w)),
u AS (SELECT DISTINCT class_id, v, trim(regexp_replace(v, '^\s*[A-Za-z]{2,8}\s*(:[A-Za-z]:|[:=])\s*', ''), E' \t\r\n"\'`()[]{}<>#*?!;,.:|') AS t FROM c),
k AS (SELECT DISTINCT class_id, length(barcode) AS k FROM w),
z AS (SELECT class_id, v, t, upper(regexp_replace(trim(regexp_replace(t, '[-_.][0-9]{1,3}\s*$', ''), E' \t\r\n"\'`()[]{}<>#*?!;,.:|'), '[\s._\-]+', '', 'g')) AS s FROM u),
b AS (SELECT class_id, v, replace(s, 'U', 'T') AS s FROM z WHERE NOT regexp_full_match(t, '[0-9]+') AND regexp_full_match(s, '[ACGTUNRYKMSWBDHV]+')
  UNION ALL SELECT class_id, v, array_to_string(list_transform(range(k - 1, -1, -1), lambda i: substr('ACTG', ((n >> (2 * i)::INT) & 3)::INT + 1, 1)), '')
  FROM (SELECT z.class_id, v, k, t::BIGINT AS n FROM z JOIN k USING (class_id) WHERE regexp_full_match(t, '[0-9]{1,18}')) WHERE n < (1::BIGINT << (2 * k)::INT)),
f AS (SELECT class_id, barcode, barcode AS form FROM w UNION ALL SELECT class_id, barcode, reverse(translate(barcode, 'ACGT', 'TGCA')) FROM w),
m AS (SELECT b.class_id, v, arg_min(barcode, (levenshtein(s, form), barcode)) AS canonical FROM b JOIN f ON b.class_id = f.class_id AND length(form) BETWEEN length(s) - 2 AND length(s) + 2
  WHERE levenshtein(s, form) <= 2 GROUP BY 1, 2),
r AS (SELECT src, rec_id, class_id, c.v, coalesce(canonical, 'UNMATCHED') AS canonical FROM c LEFT JOIN m USING (class_id, v))
"""
#: Every value against every entry; for small tables.
SQL = {
    "p6_found": _MAPPED + "SELECT src, rec_id, canonical FROM r",
    "p6_unmatched": _MAPPED + "SELECT src, class_id, v AS value, count(*) AS n_records FROM r WHERE canonical = 'UNMATCHED' GROUP BY 1, 2, 3",
}
