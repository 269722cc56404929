"""Queries of scans, joins and aggregations on barcodes, each over whole tables."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import correct, emit, reformat, rejects, scan
from strandloom.plans.layout import length_range
from strandloom.session import shared_dir, small_side, table
from strandloom.sources import whitelists

QUERIES, SQL = {}, {}
#: Fixed value: the adapter before the barcodes in the test reads.
ADAPTER = "ATTATCTGCATACGCATCGATA"
_RC = ADAPTER.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _reads(spark, d):
    return table(spark, d, "reads", "read_ord", "read_id", "comment", "seq", "qual", "is_fastq").distinct()


def _listed(spark, d, class_id=None, role=None):
    w = table(spark, d, "whitelist", "class_id", "role", "barcode").distinct()
    w = w.where(F.col("class_id") == class_id) if class_id else w
    return w.where(F.col("role") == role) if role else w


def _extracted(spark, d, ratio=0.3):
    return scan.extract(_reads(spark, d), ADAPTER, 16, ratio=ratio)


_READS = "r AS (SELECT DISTINCT read_ord, read_id, comment, seq, qual, is_fastq FROM reads)"
_HITS = f"""{_READS}, h AS (SELECT *, CASE WHEN instr(seq, '{ADAPTER}') > 0 THEN instr(seq, '{ADAPTER}') - 1 ELSE instr(seq, '{_RC}') - 1 END AS "position",
instr(seq, '{ADAPTER}') = 0 AS is_rc FROM r WHERE instr(seq, '{ADAPTER}') > 0 OR instr(seq, '{_RC}') > 0),
x AS (SELECT *, CASE WHEN is_rc THEN reverse(translate(substr(seq, greatest(0, "position" - 16) + 1, "position" - greatest(0, "position" - 16)), 'ACGT', 'TGCA'))
ELSE substr(seq, "position" + 23, 16) END AS barcode FROM h),
b AS (SELECT * FROM x WHERE length(barcode) > 0)"""


@query(f"WITH {_HITS} SELECT read_ord, \"position\", is_rc FROM h")
def scan_adapter(spark, d):
    hit = scan.with_adapter(_reads(spark, d), ADAPTER, 0).where("hit is not null")
    return hit.select("read_ord", "hit.position", "hit.is_rc")


@query()
def scan_fuzzy(spark, d):
    """Barcodes behind the adapter with up to 30 % of it differing."""
    return scan.extract(_reads(spark, d), ADAPTER, 16, ratio=0.3).select("read_ord", "position", "is_rc", "barcode")


@query()
def scan_extract(spark, d):
    return _extracted(spark, d).select("read_ord", "barcode", "is_rc")


@query()
def scan_chunk(spark, d):
    return _extracted(spark, d).groupBy("is_rc").agg(F.count(F.lit(1)).alias("extracted"), F.count_if(dna.is_plain("barcode")).alias("joinable"))


@query()
def scan_count(spark, d):
    return scan.count(_extracted(spark, d), _listed(spark, d, "barcode"))


@query()
def agg_scan(spark, d):
    return scan.count(_extracted(spark, d))


_SPLIT = f"""WITH {_READS}, h AS (SELECT read_ord, instr(seq, '{ADAPTER}') = 0 AS is_rc,
CASE WHEN instr(seq, '{ADAPTER}') > 0 THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END s,
CASE WHEN instr(seq, '{ADAPTER}') > 0 THEN instr(seq, '{ADAPTER}') + 21 ELSE length(seq) - instr(seq, '{_RC}') + 1 END AS adapter_end
FROM r WHERE instr(seq, '{ADAPTER}') > 0 OR instr(seq, '{_RC}') > 0),
t AS (SELECT *, substr(s, (adapter_end + 9 + o)::INT + 1, a) bc1, substr(s, (adapter_end + 9 + o)::INT + a + 1, b) bc2
FROM h, (VALUES (0), (1), (2), (3)) v(o), (VALUES (15), (16)) w(a), (VALUES (14), (15)) u(b) WHERE adapter_end + 9 + o + a + b <= length(s)),
p AS (SELECT * FROM t WHERE bc1 IN (SELECT barcode FROM whitelist WHERE class_id = 'barcode_1') AND bc2 IN (SELECT barcode FROM whitelist WHERE class_id = 'barcode_2')
QUALIFY row_number() OVER (PARTITION BY read_ord ORDER BY o, a, b) = 1)"""


def _pairs(spark, d, ratio=0.3):
    return scan.split_pairs(_reads(spark, d), ADAPTER, _listed(spark, d, "barcode_1"), _listed(spark, d, "barcode_2"), ratio=ratio)


@query()
def scan_split(spark, d):
    return _pairs(spark, d)


@query()
def agg_pair(spark, d):
    return scan.pair_counts(_pairs(spark, d))


@query()
def agg_collapse(spark, d):
    return scan.count(_pairs(spark, d).select(F.concat("bc1", "bc2").alias("barcode")))


def _ordinals(spark, d, class_id):
    w = table(spark, d, "whitelist").where((F.col("class_id") == class_id) & (F.col("role") == "true"))
    return w.groupBy("barcode").agg(F.min("ordinal").alias("ordinal"))


_AXES = """o1 AS (SELECT barcode, min(ordinal) ordinal FROM whitelist WHERE class_id = 'barcode_1' AND role = 'true' GROUP BY 1),
o2 AS (SELECT barcode, min(ordinal) ordinal FROM whitelist WHERE class_id = 'barcode_2' AND role = 'true' GROUP BY 1)"""


@query()
def snk_mask(spark, d):
    """Dense 0/1 matrix of the pairs seen, a line per first barcode."""
    return scan.pair_matrix(scan.pair_counts(_pairs(spark, d)), _ordinals(spark, d, "barcode_1"), _ordinals(spark, d, "barcode_2"))


@query()
def src_mask(spark, d):
    """Pairs read back from the matrix."""
    one, two = _ordinals(spark, d, "barcode_1"), _ordinals(spark, d, "barcode_2")
    return scan.matrix_pairs(scan.pair_matrix(scan.pair_counts(_pairs(spark, d)), one, two).select("ordinal", "line"), one, two)


_SEEN = """e0 AS (SELECT 'barcode' class_id, barcode_1 raw, sequence, instr(sequence, barcode_1) AS i FROM extracted_bc UNION ALL SELECT 'barcode_1', barcode_1, sequence, instr(sequence, barcode_1) FROM extracted_bc
UNION ALL SELECT 'barcode_2', barcode_2, sequence, CASE WHEN instr(substr(sequence, coalesce(length(barcode_1), 0) + 1), barcode_2) > 0 THEN instr(substr(sequence, coalesce(length(barcode_1), 0) + 1), barcode_2) + coalesce(length(barcode_1), 0) ELSE 0 END FROM extracted_bc),
o AS (SELECT class_id, raw, CASE WHEN i > 0 THEN substr(sequence, greatest(1, i - 4), least(length(sequence), i + length(raw) + 3) - greatest(1, i - 4) + 1) ELSE raw END AS expanded, count(*) n FROM e0 WHERE raw IS NOT NULL GROUP BY ALL),
w AS (SELECT DISTINCT class_id, role, barcode FROM whitelist),
t AS (SELECT DISTINCT class_id, barcode FROM w WHERE role = 'true'), g AS (SELECT DISTINCT class_id, barcode FROM w WHERE role = 'global' AND (class_id, barcode) NOT IN (SELECT (class_id, barcode) FROM t))"""


def _observed(spark, d):
    """All barcodes, those with N too, and their windows, 4 bases more on either side. The table doesn't say by which
    layout a row was read, and either list has some of either kind of row, so barcode_1 stands under both classes."""
    e = table(spark, d, "extracted_bc", "sequence", "barcode_1", "barcode_2")
    one = e.select(F.explode(F.array(F.lit("barcode"), F.lit("barcode_1"))).alias("class_id"), F.col("barcode_1").alias("raw"), "sequence", F.expr("locate(barcode_1, sequence)").alias("at"))
    two = e.select(F.lit("barcode_2").alias("class_id"), F.col("barcode_2").alias("raw"), "sequence", F.expr("locate(barcode_2, sequence, coalesce(length(barcode_1), 0) + 1)").alias("at"))
    o = one.unionByName(two).where("raw is not null")
    window = F.when(F.col("at") > 0, dna.padded("sequence", F.col("at"), F.col("at") + F.length("raw") - 1, 4)).otherwise(F.col("raw"))
    return o.select("class_id", "raw", window.alias("expanded")).groupBy("class_id", "raw", "expanded").agg(F.count(F.lit(1)).alias("n"))


def _sides(spark, d):
    return correct.split_lists(_listed(spark, d))


@query(f"WITH {_SEEN} SELECT o.class_id, raw, expanded, coalesce(a.barcode, b.barcode) AS candidate FROM o LEFT JOIN t a ON a.class_id = o.class_id AND a.barcode = raw LEFT JOIN t b ON b.class_id = o.class_id AND b.barcode = reverse(translate(raw, 'ACGT', 'TGCA')) WHERE coalesce(a.barcode, b.barcode) IS NOT NULL")
def jn_eq(spark, d):
    true, _ = _sides(spark, d)
    return correct.exact(_observed(spark, d), true.withColumn("is_true", F.lit(True))).where("candidate is not null").select("class_id", "raw", "expanded", "candidate")


@query(f"WITH {_SEEN} SELECT class_id, raw, sum(n)::BIGINT AS n FROM o WHERE (class_id, raw) IN (SELECT (class_id, barcode) FROM t) GROUP BY 1, 2")
def jn_ident(spark, d):
    true, _ = _sides(spark, d)
    seen = _observed(spark, d).join(small_side(true.withColumnRenamed("barcode", "raw")), ["class_id", "raw"], "left_semi")
    return seen.groupBy("class_id", "raw").agg(F.sum("n").alias("n"))


@query(f"WITH {_SEEN} SELECT DISTINCT class_id, raw FROM o WHERE (class_id, raw) IN (SELECT (class_id, barcode) FROM w)")
def jn_exact2(spark, d):
    return _observed(spark, d).join(small_side(_listed(spark, d).select("class_id", F.col("barcode").alias("raw")).distinct()), ["class_id", "raw"], "left_semi").select("class_id", "raw").distinct()


@query(f"WITH {_SEEN} SELECT * FROM g")
def jn_dedup(spark, d):
    return _sides(spark, d)[1]


_INFIX = "least({most} + 1, (SELECT min(levenshtein({s}, substr({l}, i::INT, k::INT))) FROM range(1, length({l}) + 1) a(i), range(length({s}) - {most}, length({s}) + {most} + 1) b(k)))"


@query(f"""WITH {_SEEN}, c AS (SELECT class_id, raw, expanded, unnest(list_distinct(list_transform(range(1, greatest(length(expanded) - length(raw) + 2, 2)), lambda i: substr(expanded, i::INT, length(raw))))) k FROM o),
m AS (SELECT c.class_id, raw, expanded, barcode AS candidate FROM c JOIN t ON t.class_id = c.class_id AND barcode = k)
SELECT * FROM m WHERE EXISTS (SELECT 1 FROM range(1, length(candidate) + 1) a(i), range(length(raw) - 2, length(raw) + 3) b(k) WHERE levenshtein(raw, substr(candidate, i::INT, k::INT)) <= 2)""")
def jn_kmer(spark, d):
    """True entries among the k-mers of the window, within two edits of the barcode."""
    true, _ = _sides(spark, d)
    return correct.kmer_candidates(_observed(spark, d), true, 2).select("class_id", "raw", "expanded", "candidate")


@query(f"""WITH {_SEEN}, s AS (SELECT DISTINCT class_id, raw, expanded FROM o), u AS (SELECT class_id, barcode, substr(barcode, length(barcode) * k // 3 + 1, length(barcode) * (k + 1) // 3 - length(barcode) * k // 3) AS part FROM t, (VALUES (0), (1), (2)) v(k)),
c AS (SELECT DISTINCT s.*, barcode AS candidate, CASE WHEN length(barcode) <= length(expanded) THEN barcode ELSE expanded END AS a, CASE WHEN length(barcode) <= length(expanded) THEN expanded ELSE barcode END AS b FROM s JOIN u ON u.class_id = s.class_id AND contains(expanded, part)),
m AS (SELECT class_id, raw, expanded, candidate, min(levenshtein(a, substr(b, i::INT, (length(a) + k)::INT))) AS dist FROM c, range(1, 60) x(i), range(-2, 3) y(k) WHERE i <= length(b) GROUP BY ALL)
SELECT * FROM m WHERE dist <= 2""")
def jn_seed(spark, d):
    """True entries within two edits inside the window, found by their parts."""
    true, _ = _sides(spark, d)
    return correct.seed_candidates(_observed(spark, d), true).select("class_id", "raw", "expanded", "candidate", "dist")


@query(f"""WITH {_SEEN}, s AS (SELECT DISTINCT class_id, raw FROM o), p AS (SELECT class_id, raw, barcode, levenshtein(raw, barcode) dist FROM s JOIN t USING (class_id) WHERE abs(length(raw) - length(barcode)) <= 2),
b AS (SELECT class_id, raw, min(barcode) AS candidate, dist, count(*) c, rank() OVER (PARTITION BY class_id, raw ORDER BY dist) k FROM p WHERE dist <= 2 GROUP BY class_id, raw, dist)
SELECT class_id, raw, candidate, dist FROM b WHERE k = 1 AND c = 1""")
def jn_theta(spark, d):
    """The only nearest true entry within two edits of the whole barcode, by parts instead of a nested loop."""
    true, _ = _sides(spark, d)
    seen = _observed(spark, d).select("class_id", "raw", F.col("raw").alias("expanded")).distinct()
    near = correct.seed_candidates(seen, true, small=False, most=2).withColumn("dist", F.levenshtein("raw", "candidate", 2)).where("dist >= 0")
    rungs = near.select("*", F.lit(0).alias("rung"), F.lit(0).alias("raw_n"), F.lit(True).alias("nearest"))
    return correct.settle(rungs).select("class_id", "raw", "candidate", "dist")


@query(f"""WITH {_SEEN}, s AS (SELECT DISTINCT class_id, raw FROM o) SELECT class_id, raw, barcode AS candidate FROM s JOIN t USING (class_id) WHERE length(raw) = length(barcode) AND raw <> barcode AND hamming(raw, barcode) <= 2""")
def jn_mut(spark, d):
    true, _ = _sides(spark, d)
    seen = _observed(spark, d).select("class_id", "raw", F.col("raw").alias("expanded")).distinct()
    return correct.mutation_candidates(seen, true, 2, 4).select("class_id", "raw", "candidate").distinct()


_CAND = f"""WITH {_SEEN}, s AS (SELECT DISTINCT class_id, raw FROM o), x AS (SELECT class_id, raw c, sum(n) raw_n FROM o GROUP BY 1, 2),
p AS (SELECT s.class_id, s.raw, barcode AS candidate, hamming(raw, barcode) dist, coalesce(raw_n, 0) raw_n FROM s JOIN t USING (class_id) LEFT JOIN x ON x.c = barcode AND x.class_id = s.class_id
WHERE length(raw) = length(barcode) AND raw <> barcode AND hamming(raw, barcode) <= 2),
a AS (SELECT *, count(*) OVER (PARTITION BY class_id, raw) = 1 alone FROM p),
k AS (SELECT *, min(dist) OVER (PARTITION BY class_id, raw) least, count(*) OVER (PARTITION BY class_id, raw, dist) tied FROM a WHERE alone OR raw_n > 0)"""


@query(_CAND + " SELECT class_id, raw, candidate, dist::INT AS dist FROM k WHERE dist = least AND tied = 1")
def jn_tie(spark, d):
    """One candidate wins; of several, the only one at the least distance at which any was seen exactly."""
    true, _ = _sides(spark, d)
    seen = _observed(spark, d)
    plain = seen.select("class_id", "raw", F.col("raw").alias("expanded")).distinct()
    cands = correct.mutation_candidates(plain, true, 2, 4).withColumn("dist", dna.hamming("raw", "candidate"))
    raw_n = seen.groupBy("class_id", F.col("raw").alias("candidate")).agg(F.sum("n").alias("raw_n"))
    rungs = cands.join(raw_n, ["class_id", "candidate"], "left").withColumn("raw_n", F.coalesce("raw_n", F.lit(0)))
    return correct.settle(rungs.select("*", F.lit(0).alias("rung"), F.lit(False).alias("nearest"))).select("class_id", "raw", "candidate", "dist")


@query()
def jn_correct(spark, d):
    """The whole ladder."""
    return correct.correct(_observed(spark, d), _listed(spark, d), filters=correct.adapter_kmers([ADAPTER], 16))


_EL = """e AS (SELECT DISTINCT elem_id, read_ord, run_id, class_id, global_class, type, ord, direction, edit_distance, "start", stop, element_pass, write, seq, qual, original_seq FROM elements)"""


def _elements(spark, d):
    return table(spark, d, "elements").drop("seen_at", "loaded_at").distinct()


@query(f"""WITH {_EL}, t AS (SELECT DISTINCT class_id, barcode FROM whitelist WHERE role = 'true'), w AS (SELECT DISTINCT class_id, barcode FROM whitelist)
SELECT elem_id, (k, seq) IN (SELECT (class_id, barcode) FROM t) AS write_flag, original_seq IS NOT NULL AND seq <> original_seq AND seq <> reverse(translate(original_seq, 'ACGT', 'TGCA')) AS corrected
FROM (SELECT *, regexp_replace(class_id, '^rc_', '') k FROM e WHERE global_class = 'barcode' AND seq IS NOT NULL) WHERE (k, seq) IN (SELECT (class_id, barcode) FROM w)""")
def jn_apply(spark, d):
    """Barcodes on a list: whether they go on (true list), and whether they were changed beyond their strand."""
    e = _elements(spark, d).where("global_class = 'barcode' and seq is not null")
    out = correct.apply_lists(e.select("elem_id", dna.strip_rc("class_id").alias("class_id"), "seq", "original_seq"), _listed(spark, d))
    return out.select("elem_id", F.col("write").alias("write_flag"), "corrected")


@query()
def jn_joint(spark, d):
    """Two adjoining barcodes near the place where the layout expects them, the start in the direction of the adapter; on
    the reverse strand where there are none on the forward one."""
    at = scan.oriented_hits(_reads(spark, d), ADAPTER).select(F.struct("read_ord", "is_rc").alias("k"), F.col("s").alias("seq"), (F.col("adapter_end") + 10).alias("anchor"))
    lists = {c: _listed(spark, d, c) for c in ("barcode_1", "barcode_2")}
    found = correct.joint_chain(at, lists, {"barcode_1": [15, 16], "barcode_2": [14, 15]}, "anchor", key="k")
    best = found.groupBy("k.read_ord").agg(F.min_by(F.struct("start", "barcode_1", "barcode_2"), "k.is_rc").alias("b"))
    return best.select("read_ord", "b.*")


_PAIRS = "p AS (SELECT DISTINCT read_id, barcode_1 AS bc1, barcode_2 AS bc2 FROM extracted_bc WHERE barcode_1 IS NOT NULL AND barcode_2 IS NOT NULL)"


@query(f"WITH {_PAIRS}, ok AS (SELECT bc1, bc2 FROM p GROUP BY 1, 2 HAVING count(*) >= 2) SELECT read_id, bc1, bc2 FROM p WHERE (bc1, bc2) IN (SELECT (bc1, bc2) FROM ok)")
def jn_mask(spark, d):
    """Pairs among the allowed ones, here those seen in two reads and more."""
    p = table(spark, d, "extracted_bc").select("read_id", F.col("barcode_1").alias("bc1"), F.col("barcode_2").alias("bc2")).dropna().distinct()
    return correct.allowed_pairs(p, scan.pair_counts(p).where("n >= 2")).select("read_id", "bc1", "bc2")


_ADAPTERS = [ADAPTER, "GCCTCTCCCGGAGTACGCTGCCT", "GCGGTAGTAATAG"]


@query("WITH a AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in _ADAPTERS) + """) v(s)), k AS (SELECT DISTINCT CASE WHEN length(s) >= 16 THEN substr(s, i::INT, 16) ELSE substr(repeat(s, 3), i::INT, 16) END k FROM a, range(1, 40) t(i)
WHERE i <= CASE WHEN length(s) >= 16 THEN length(s) - 15 ELSE length(s) END) SELECT barcode_1, count(*) AS n FROM extracted_bc WHERE barcode_1 IS NOT NULL AND barcode_1 NOT IN (SELECT k FROM k) GROUP BY 1""")
def jn_filterset(spark, d):
    """Barcodes that are no k-mer of an adapter."""
    kmers = correct.adapter_kmers(_ADAPTERS, 16)
    return table(spark, d, "extracted_bc").where(F.col("barcode_1").isNotNull() & ~F.col("barcode_1").isin(kmers)).groupBy("barcode_1").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT class_id, role AS spec, count(DISTINCT barcode) n FROM whitelist GROUP BY 1, 2), r AS (SELECT class_id, spec, CASE WHEN count(*) OVER (PARTITION BY class_id) = 1 THEN CASE WHEN n >= 100000 THEN 'global' ELSE 'true' END
WHEN n = min(n) OVER (PARTITION BY class_id) THEN 'true' ELSE 'global' END AS role FROM s) SELECT class_id, r.role, count(DISTINCT barcode) AS n FROM whitelist w JOIN r USING (class_id) WHERE w.role = r.spec GROUP BY 1, 2""")
def jn_role(spark, d):
    """Roles by the size of the lists of a class."""
    lists = table(spark, d, "whitelist").select("class_id", F.col("role").alias("spec"), "barcode")
    return correct.assign_roles(lists).groupBy("class_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_EL} SELECT read_ord, direction, CASE WHEN count(*) > 1 THEN bool_or(coalesce(write, false)) ELSE bool_and(coalesce(write, false)) END AS passed FROM e WHERE global_class = 'barcode' GROUP BY 1, 2""")
def jn_dir(spark, d):
    b = _elements(spark, d).where("global_class = 'barcode'").withColumn("passed", F.coalesce("write", F.lit(False)))
    return correct.direction_passes(b)


@query(f"""WITH {_PAIRS}, {_AXES}, c AS (SELECT DISTINCT CASE WHEN length(read_id) % 2 = 0 THEN bc1 || '-' || bc2 ELSE bc2 || '-' || bc1 END cb, bc1, bc2 FROM p)
SELECT DISTINCT cb, o1.ordinal AS x_idx, o2.ordinal AS y_idx FROM c LEFT JOIN o1 ON bc1 = o1.barcode AND bc2 IN (SELECT barcode FROM o2) LEFT JOIN o2 ON bc2 = o2.barcode AND bc1 IN (SELECT barcode FROM o1)""")
def jn_axis(spark, d):
    """Coordinates of joined barcodes in either order."""
    p = table(spark, d, "extracted_bc").select("read_id", F.col("barcode_1").alias("bc1"), F.col("barcode_2").alias("bc2")).dropna()
    cb = F.when(F.length("read_id") % 2 == 0, F.concat_ws("-", "bc1", "bc2")).otherwise(F.concat_ws("-", "bc2", "bc1"))
    cells = p.select(cb.alias("cb")).distinct()
    return reformat.resolve_axes(cells, _ordinals(spark, d, "barcode_1"), _ordinals(spark, d, "barcode_2"))


_COUNTED = "c AS (SELECT barcode, sum(n)::BIGINT n FROM barcode_counts WHERE barcode IS NOT NULL AND n IS NOT NULL GROUP BY 1)"


def _counts(spark, d):
    return table(spark, d, "barcode_counts").where("barcode is not null and n is not null").groupBy("barcode").agg(F.sum("n").alias("n"))


@query(f"WITH {_COUNTED} SELECT barcode, n FROM c WHERE barcode IN (SELECT barcode FROM whitelist)")
def jn_semi_scan(spark, d):
    return _counts(spark, d).join(small_side(_listed(spark, d).select("barcode").distinct()), "barcode", "left_semi")


@query(f"WITH {_COUNTED} SELECT n, count(*) AS multiplicity FROM c GROUP BY 1")
def agg_mult(spark, d):
    return _counts(spark, d).groupBy("n").agg(F.count(F.lit(1)).alias("multiplicity"))


@query(f"WITH {_COUNTED} SELECT count(*) AS n_barcodes, round(avg(n), 6) AS rate FROM c")
def agg_lambda(spark, d):
    return _counts(spark, d).agg(F.count(F.lit(1)).alias("n_barcodes"), F.round(F.avg("n"), 6).alias("rate"))


@query(f"""WITH {_COUNTED}, r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 k, count(*) OVER () m FROM c) SELECT max(n) FILTER (k = m // 4) AS q1, max(n) FILTER (k = 3 * m // 4) AS q3 FROM r""")
def agg_quart(spark, d):
    """Order statistics at n/4 and 3n/4, from the histogram of counts, so that no row is sorted alone."""
    h = _counts(spark, d).groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # over distinct counts only
    h = h.withColumn("upto", F.sum("m").over(w)).withColumn("all", F.sum("m").over(Window.partitionBy(F.lit(1))))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("n")))
    return h.agg(at(F.floor(F.col("all") / 4)).alias("q1"), at(F.floor(3 * F.col("all") / 4)).alias("q3"))


@query(f"WITH {_EL} SELECT is_fastq, count(*) AS total, count(*) FILTER (read_ord IN (SELECT read_ord FROM e WHERE write)) AS passing FROM (SELECT DISTINCT read_ord, is_fastq FROM reads) GROUP BY 1")
def agg_run(spark, d):
    ok = _elements(spark, d).where("write").select("read_ord").distinct().withColumn("ok", F.lit(1))
    r = table(spark, d, "reads").select("read_ord", "is_fastq").distinct().join(ok, "read_ord", "left")
    return r.groupBy("is_fastq").agg(F.count(F.lit(1)).alias("total"), F.count("ok").alias("passing"))


@query(r"""WITH b AS (SELECT line_id, regexp_replace(regexp_replace(line, '^\x{FEFF}', ''), '\r$', '') s FROM raw_lines WHERE kind = 'layout'),
q AS (SELECT line_id, CASE WHEN regexp_full_match(s, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') THEN regexp_extract_all(',' || s, ',("(?:[^"]|"")*"|[^",]*)', 1)[3] END x FROM b),
f AS (SELECT line_id, CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END x FROM q),
n AS (SELECT line_id, greatest(least(a, coalesce(z, a)), 1) lo, greatest(a, coalesce(z, a)) hi FROM (SELECT line_id, try_cast(regexp_extract(x, '^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$', 1) AS HUGEINT) a, try_cast(nullif(regexp_extract(x, '^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$', 2), '') AS HUGEINT) z FROM f))
SELECT line_id, (CASE WHEN hi IS NULL OR hi < lo THEN 0 ELSE hi - lo + 1 END)::BIGINT AS n, (CASE WHEN hi >= lo THEN lo END)::BIGINT AS "least", (CASE WHEN hi >= lo THEN hi END)::BIGINT AS "most" FROM n""")
def lay_len(spark, d):
    """Lengths that a layout's length field allows; none for a bad one or a record that can't be read."""
    rows = table(spark, d, "raw_lines").where("kind = 'layout'")
    return rows.select("line_id", length_range(rejects.field_of(F.col("line"), 2)).alias("l")).select("line_id", "l.*")


_TOKENS = "k AS (SELECT DISTINCT upper(trim(split_part(barcode, ',', 1))) t FROM barcode_entry WHERE barcode IS NOT NULL)"


@query(f"""WITH {_TOKENS}, c AS (SELECT t, CASE WHEN regexp_full_match(t, '[0-9]{{1,18}}') THEN t::BIGINT END v FROM k) SELECT DISTINCT barcode FROM (SELECT t AS barcode FROM c WHERE regexp_full_match(t, '[ACGT]{{1,31}}') UNION ALL
SELECT array_to_string(list_transform(range(15, -1, -1), lambda i: substr('ACTG', ((v >> (2 * i)::INT) & 3)::INT + 1, 1)), '') FROM c WHERE v < 4294967296)""")
def src_wl(spark, d):
    """Barcodes of a list in bases or codes of 16 bases."""
    lines = table(spark, d, "barcode_entry").select(F.col("barcode").alias("value")).where("value is not null")
    return whitelists.parse_barcodes(lines.select(F.trim(F.split("value", ",")[0]).alias("token")), 16)


@query(f"WITH {_TOKENS}, c AS (SELECT t, CASE WHEN regexp_full_match(t, '[0-9]{{1,18}}') THEN t::BIGINT END v FROM k) SELECT t AS token FROM c WHERE NOT (regexp_full_match(t, '[ACGT]{{1,31}}') AND length(t) = 16 OR coalesce(v < 4294967296, false))")
def src_wl_scan(spark, d):
    """Entries that are neither 16 bases nor a code of as many."""
    lines = table(spark, d, "barcode_entry").where("barcode is not null")
    return whitelists.malformed(lines.select(F.upper(F.trim(F.split("barcode", ",")[0])).alias("token")).distinct(), 16)


@query("SELECT barcode, sum(n)::BIGINT AS n FROM barcode_counts WHERE n > 0 AND regexp_full_match(barcode, '[ACGTN]+') GROUP BY 1")
def src_rescan(spark, d):
    """A count table written as text and read back by its reader."""
    rows = table(spark, d, "barcode_counts").where("n > 0 and barcode is not null").select(F.concat_ws(",", "barcode", "n").alias("value"))
    at = f"{shared_dir(spark)}/counts_{uuid.uuid4().hex}"
    rows.write.text(at)
    return whitelists.read_counts(spark, at)


@query(f"WITH {_READS} SELECT read_ord, CASE WHEN coalesce(qual, '') <> '' THEN '@' || read_id || CASE WHEN coalesce(comment, '') <> '' THEN chr(9) || comment ELSE '' END || chr(10) || seq || chr(10) || '+' || chr(10) || qual ELSE '>' || read_id || CASE WHEN coalesce(comment, '') <> '' THEN chr(9) || comment ELSE '' END || chr(10) || seq END AS record FROM r")
def snk_rec(spark, d):
    from strandloom.functions import tags

    return _reads(spark, d).select("read_ord", tags.record(F.col("read_id"), F.col("comment"), F.col("seq"), F.col("qual")).alias("record"))


@query("SELECT read_id, CASE WHEN barcode_1 IS NOT NULL AND barcode_1 <> '' THEN read_id || '_' || barcode_1 ELSE read_id END AS new_name, barcode_1 AS cb FROM (SELECT DISTINCT read_id, barcode_1 FROM extracted_bc)")
def reformat_collapse(spark, d):
    """Headers with the barcode taken into the name."""
    b = table(spark, d, "extracted_bc").select("read_id", "barcode_1").distinct()
    rec = b.select("read_id", F.col("read_id").alias("old"), F.when(F.col("barcode_1").isNotNull(), F.concat(F.lit("CB:Z:"), F.col("barcode_1"))).alias("comment"))
    out = reformat.collapse_headers(rec, sep="_")
    return out.select(F.col("old").alias("read_id"), F.col("read_id").alias("new_name"), "cb")


@query("SELECT cb, count(*) AS n FROM (SELECT DISTINCT read_id, barcode_1 AS cb FROM extracted_bc WHERE barcode_1 IS NOT NULL) GROUP BY 1")
def snk_split(spark, d):
    """Records as they fall into a folder per barcode (tests write and read such folders)."""
    rows = table(spark, d, "extracted_bc").where("barcode_1 is not null").select("read_id", F.col("barcode_1").alias("cb"), F.lit("F").alias("strand"), F.lit(False).alias("concat"), F.lit("").alias("cr"), F.lit("").alias("ub"), F.lit("+").alias("ts"), F.lit("A").alias("seq"), F.lit(None).cast("string").alias("qual"))
    return emit.by_barcode(rows.distinct()).where("value like '>%'").groupBy("cb").agg(F.count(F.lit(1)).alias("n"))



#: The same operators where no edit of the adapter is allowed, which SQL can state.


@query(f"WITH {_HITS} SELECT read_ord, barcode, is_rc FROM b")
def scan_extract_exact(spark, d):
    return _extracted(spark, d, 0).select("read_ord", "barcode", "is_rc")


@query(f"WITH {_HITS} SELECT is_rc, count(*) AS extracted, count(*) FILTER (regexp_full_match(barcode, '[ACGT]{{1,31}}')) AS joinable FROM b GROUP BY 1")
def scan_chunk_exact(spark, d):
    return _extracted(spark, d, 0).groupBy("is_rc").agg(F.count(F.lit(1)).alias("extracted"), F.count_if(dna.is_plain("barcode")).alias("joinable"))


@query(f"WITH {_HITS} SELECT barcode, count(*) AS n FROM b WHERE barcode IN (SELECT barcode FROM whitelist WHERE class_id = 'barcode') GROUP BY 1")
def scan_count_exact(spark, d):
    return scan.count(_extracted(spark, d, 0), _listed(spark, d, "barcode"))


@query(f"WITH {_HITS} SELECT barcode, count(*) AS n FROM b GROUP BY 1")
def agg_scan_exact(spark, d):
    return scan.count(_extracted(spark, d, 0))


@query(_SPLIT + " SELECT read_ord, is_rc, adapter_end, bc1, bc2 FROM p")
def scan_split_exact(spark, d):
    return _pairs(spark, d, 0)


@query(_SPLIT + " SELECT bc1, bc2, bc1 || bc2 AS pair, count(*) AS n FROM p GROUP BY 1, 2")
def agg_pair_exact(spark, d):
    return scan.pair_counts(_pairs(spark, d, 0))


@query(_SPLIT + f""", {_AXES} SELECT o1.ordinal, o1.barcode AS bc1, (SELECT string_agg(CASE WHEN (o1.barcode, z.barcode) IN (SELECT (bc1, bc2) FROM p) THEN '1' ELSE '0' END, ',' ORDER BY z.ordinal) FROM o2 z) AS line FROM o1""")
def snk_mask_exact(spark, d):
    return scan.pair_matrix(scan.pair_counts(_pairs(spark, d, 0)), _ordinals(spark, d, "barcode_1"), _ordinals(spark, d, "barcode_2"))


@query(_SPLIT + f", {_AXES} SELECT DISTINCT bc1, bc2 FROM p JOIN o1 ON bc1 = o1.barcode JOIN o2 ON bc2 = o2.barcode")
def src_mask_exact(spark, d):
    one, two = _ordinals(spark, d, "barcode_1"), _ordinals(spark, d, "barcode_2")
    return scan.matrix_pairs(scan.pair_matrix(scan.pair_counts(_pairs(spark, d, 0)), one, two).select("ordinal", "line"), one, two)
