"""Queries of the scalar functions, each over a whole table."""

from pyspark.sql import functions as F

from strandloom.functions import dna, stats, tags
from strandloom.operators import correct
from strandloom.session import table

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _joined(c):
    return F.array_join(c, ",")


def _listed(spark, d):
    return table(spark, d, "whitelist", "class_id", "role", "barcode")


def _scans(spark, d):
    return table(spark, d, "extracted_bc", "read_id", "sequence", "pos", "is_rc", "barcode_1", "barcode_2")


_REV = "reverse(translate({}, 'ACGT', 'TGCA'))"
_CODE = "list_sum(list_transform(range(1, length({0}) + 1), lambda i: (instr('ACTG', substr({0}, i::INT, 1)) - 1)::BIGINT << (2 * (length({0}) - i))::INT))::BIGINT"
_PLAIN = "regexp_full_match({}, '[ACGT]{{1,31}}')"
_KMERS = "CASE WHEN length({0}) >= {1} THEN list_transform(range(1, length({0}) - {1} + 2), lambda i: substr({0}, i::INT, {1})) ELSE [] END"


@query(f"SELECT read_id, loaded_at, {_REV.format('seq')} AS rc FROM reads")
def fn_revcomp(spark, d):
    return table(spark, d, "reads").select("read_id", "loaded_at", dna.revcomp("seq").alias("rc"))


@query(f"SELECT class_id, role, barcode, {_CODE.format('barcode')} AS code FROM whitelist")
def fn_enc(spark, d):
    return _listed(spark, d).withColumn("code", dna.encode("barcode"))


@query("SELECT class_id, role, barcode, barcode AS decoded FROM whitelist")
def fn_dec(spark, d):
    return _listed(spark, d).select("class_id", "role", "barcode", dna.decode(dna.encode("barcode"), F.length("barcode")).alias("decoded"))


@query(f"""SELECT read_id, barcode_1, CASE WHEN {_PLAIN.format('barcode_1')} THEN {_CODE.format('barcode_1')} + (1::BIGINT << (2 * length(barcode_1))::INT) END AS packed,
CASE WHEN {_PLAIN.format('barcode_1')} THEN barcode_1 END AS unpacked FROM extracted_bc""")
def fn_pack(spark, d):
    packed = _scans(spark, d).select("read_id", "barcode_1", dna.pack("barcode_1").alias("packed"))
    return packed.withColumn("unpacked", dna.unpack("packed"))


@query(f"SELECT class_id, role, barcode, array_to_string({_KMERS.format('barcode', 5)}, ',') AS kmers, len(list_distinct({_KMERS.format('barcode', 2)})) AS n_distinct FROM whitelist")
def fn_kmer(spark, d):
    return _listed(spark, d).withColumn("kmers", _joined(dna.kmers("barcode", 5))).withColumn("n_distinct", dna.distinct_kmers("barcode", 2))


@query("""SELECT class_id, role, barcode, array_to_string(list_transform(range(1, length(barcode) + 1), lambda i: substr(repeat(barcode, 3), i::INT, 20)), ',') AS kmers FROM whitelist""")
def fn_kmer_circ(spark, d):
    return _listed(spark, d).withColumn("kmers", _joined(dna.circular_kmers("barcode", 20)))


@query("""SELECT elem_id, e.loaded_at, substr(r.seq, greatest(1, least(a, b) - 4), least(length(r.seq), greatest(a, b) + 4) - greatest(1, least(a, b) - 4) + 1) AS window_seq
FROM (SELECT elem_id, e.loaded_at, seq1 AS seq, greatest(1, least("start", length(seq1))) a, greatest(1, least(stop, length(seq1))) b
  FROM elements e JOIN (SELECT DISTINCT read_ord, seq AS seq1 FROM reads) USING (read_ord)) r JOIN elements e USING (elem_id, loaded_at)""")
def fn_pad(spark, d):
    reads = table(spark, d, "reads", "read_ord", "seq").distinct()
    found = table(spark, d, "elements", "elem_id", "loaded_at", "read_ord", "start", "stop")
    return found.join(reads, "read_ord").select("elem_id", "loaded_at", dna.padded("seq", F.col("start"), F.col("stop"), 4).alias("window_seq"))


@query("""SELECT read_id, loaded_at, array_to_string(list_transform(list_filter(range(0, greatest(length(seq) - 5, 1)),
lambda p: substr(seq, (p + 1)::INT, 6) = 'GATCTA' AND p + 18 <= length(seq)), lambda p: p || ':' || substr(seq, (p + 7)::INT, 12)), ',') AS found FROM reads""")
def fn_extract(spark, d):
    found = F.transform(dna.hits("seq", "GATCTA", 12, 0), lambda h: F.concat_ws(":", h["pos"].cast("string"), h["window"]))
    return table(spark, d, "reads").select("read_id", "loaded_at", _joined(found).alias("found"))


@query("SELECT elem_id, loaded_at, class_id LIKE 'rc\\_%' ESCAPE '\\' AS is_rc, regexp_replace(class_id, '^rc_', '') AS plain_id FROM elements")
def fn_rc_id(spark, d):
    return table(spark, d, "elements").select("elem_id", "loaded_at", dna.is_rc("class_id").alias("is_rc"), dna.strip_rc("class_id").alias("plain_id"))


@query("""SELECT read_id, barcode_1, length(barcode_1) >= 4 AND (left(upper(barcode_1), 4) = repeat(left(upper(barcode_1), 1), 4)
OR right(upper(barcode_1), 4) = repeat(right(upper(barcode_1), 1), 4)) AS homopolymer FROM extracted_bc WHERE barcode_1 IS NOT NULL""")
def fn_hp(spark, d):
    found = _scans(spark, d).where("barcode_1 is not null")
    return found.select("read_id", "barcode_1", dna.homopolymer_end("barcode_1", 4).alias("homopolymer"))


@query("""SELECT read_id, barcode_1, sequence, CASE WHEN levenshtein(barcode_1, substr(sequence, 3, 16)) <= 4 THEN levenshtein(barcode_1, substr(sequence, 3, 16)) ELSE -1 END AS dist
FROM extracted_bc WHERE barcode_1 IS NOT NULL AND sequence IS NOT NULL""")
def fn_ld(spark, d):
    found = _scans(spark, d).where("barcode_1 is not null and sequence is not null")
    return found.select("read_id", "barcode_1", "sequence", F.levenshtein("barcode_1", F.substring("sequence", 3, 16), 4).alias("dist"))


@query("""WITH p AS (SELECT DISTINCT barcode_1 a, sequence b FROM extracted_bc WHERE barcode_1 IS NOT NULL AND sequence IS NOT NULL),
w AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END s, CASE WHEN length(a) <= length(b) THEN b ELSE a END l FROM p),
m AS (SELECT a, b, min(levenshtein(s, substr(l, i::INT, n::INT))) dist FROM w, range(1, 100) t(i), range(-2, 3) u(k), LATERAL (SELECT length(s) + k n) WHERE i <= length(l) GROUP BY a, b)
SELECT a, b, CASE WHEN dist <= 2 THEN dist ELSE -1 END AS dist FROM m""")
def fn_ld_part(spark, d):
    found = _scans(spark, d).where("barcode_1 is not null and sequence is not null")
    pairs = found.select(F.col("barcode_1").alias("a"), F.col("sequence").alias("b")).distinct()
    return pairs.withColumn("dist", dna.infix_distance("a", "b", 2))


@query("""WITH o AS (SELECT DISTINCT barcode_1 bc FROM extracted_bc WHERE barcode_1 IS NOT NULL), w AS (SELECT DISTINCT barcode ref FROM whitelist WHERE class_id = 'barcode'),
p AS (SELECT bc, ref, levenshtein(bc, ref) dist FROM o, w WHERE abs(length(bc) - length(ref)) <= 4)
SELECT bc, dist, count(*) AS n, string_agg(ref, ',' ORDER BY ref) AS refs FROM p WHERE dist <= 4 GROUP BY 1, 2""")
def fn_ld_set(spark, d):
    seen = _scans(spark, d).where("barcode_1 is not null").select(F.col("barcode_1").alias("bc")).distinct()
    refs = _listed(spark, d).where("class_id = 'barcode'").select(F.col("barcode").alias("ref")).distinct()
    near = correct.whole_candidates(seen, refs, 4)
    return near.groupBy("bc", "dist").agg(F.count(F.lit(1)).alias("n"), _joined(F.sort_array(F.collect_list("ref"))).alias("refs"))


_SUBS = """SELECT DISTINCT barcode, left(barcode, (i - 1)::INT) || b || substr(barcode, (i + 1)::INT) AS neighbour
FROM (SELECT DISTINCT barcode FROM whitelist WHERE role = 'true'), range(1, 33) t(i), (VALUES ('A'), ('C'), ('G'), ('T')) v(b) WHERE i <= length(barcode)"""


def _true(spark, d):
    return _listed(spark, d).where("role = 'true'").select("barcode").distinct()


@query(f"WITH s AS ({_SUBS}) SELECT * FROM s WHERE neighbour <> barcode")
def fn_mut_pt(spark, d):
    return _true(spark, d).select("barcode", F.explode(dna.substitutions("barcode")).alias("neighbour"))


@query("SELECT DISTINCT barcode, (3 * length(barcode) + 9 * length(barcode) * (length(barcode) - 1) // 2)::INT AS n FROM whitelist WHERE role = 'true'")
def fn_mut_ham(spark, d):
    return _true(spark, d).select("barcode", F.size(dna.hamming_ball("barcode", 2)).alias("n"))


@query("""WITH w AS (SELECT DISTINCT barcode FROM whitelist WHERE role = 'true'), m AS (SELECT DISTINCT barcode, x FROM (
SELECT barcode, b || left(barcode, -1) x FROM w, (VALUES ('A'), ('C'), ('G'), ('T')) v(b) UNION ALL SELECT barcode, left(barcode, -1) || b FROM w, (VALUES ('A'), ('C'), ('G'), ('T')) v(b)))
SELECT barcode, x AS neighbour FROM m WHERE x <> barcode""")
def fn_mut_shift(spark, d):
    return _true(spark, d).select("barcode", F.explode(dna.shifted("barcode")).alias("neighbour"))


@query(f"""WITH w AS (SELECT DISTINCT barcode FROM whitelist WHERE role = 'true'), s AS ({_SUBS}
UNION SELECT barcode, left(barcode, (i - 1)::INT) || substr(barcode, (i + 1)::INT) FROM w, range(1, 33) t(i) WHERE i <= length(barcode)
UNION SELECT barcode, left(barcode, (i - 1)::INT) || b || substr(barcode, i::INT) FROM w, range(1, 34) t(i), (VALUES ('A'), ('C'), ('G'), ('T')) v(b) WHERE i <= length(barcode) + 1)
SELECT barcode, neighbour FROM s WHERE neighbour <> barcode""")
def fn_mut_lv(spark, d):
    return _true(spark, d).select("barcode", F.explode(dna.edit_ball("barcode")).alias("neighbour"))


_COUNTS = "WITH c AS (SELECT barcode, sum(n)::BIGINT n FROM barcode_counts WHERE barcode IS NOT NULL AND n IS NOT NULL GROUP BY 1)"


def _counts(spark, d):
    return table(spark, d, "barcode_counts").where("barcode is not null and n is not null").groupBy("barcode").agg(F.sum("n").alias("n"))


@query(_COUNTS + " SELECT barcode, n, round(n * 1e6 / sum(n) OVER (), 6) AS ncpm, round(ln(1 + n * 1e6 / sum(n) OVER ()), 6) AS log1p_ncpm FROM c")
def fn_ncpm(spark, d):
    return stats.with_ncpm(_counts(spark, d)).select("barcode", "n", F.round("ncpm", 6).alias("ncpm"), F.round("log1p_ncpm", 6).alias("log1p_ncpm"))


@query(_COUNTS + """, l AS (SELECT avg(n) lam FROM c), g AS (SELECT i AS k, sum(exp(i * ln(lam) - lam - lgamma(i + 1))) OVER (ORDER BY i) p FROM (SELECT unnest(range(1, (SELECT max(n) FROM c) + 1)) i), l)
SELECT barcode, n AS k, round(100 * p / (1 - exp(-lam)), 4) AS pct FROM c JOIN g ON g.k = c.n, l""")
def fn_ztp(spark, d):
    k = _counts(spark, d).select("barcode", F.col("n").alias("k"))
    rate = k.agg(F.avg("k").alias("lam"))
    return k.join(F.broadcast(rate)).select("barcode", "k", F.round(stats.zero_truncated_percentile("k", "lam"), 4).alias("pct"))


_HEAD = """WITH h AS (SELECT read_id, barcode_1 cb, substr(sequence, 17) ub,
CASE WHEN is_rc THEN 'CB:Z:' || coalesce(barcode_1, '') || chr(9) || 'UB:Z:' || coalesce(substr(sequence, 17), '') ELSE 'ch=1' END AS note,
read_id || coalesce('_' || nullif(barcode_1, ''), '') || coalesce('_' || nullif(substr(sequence, 17), ''), '') AS name FROM extracted_bc)"""


def _heads(spark, d):
    s = _scans(spark, d).select("read_id", "is_rc", F.col("barcode_1").alias("cb"), F.substring(F.col("sequence"), F.lit(17), F.length("sequence")).alias("ub"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    note = F.when(F.col("is_rc"), F.concat(F.lit("CB:Z:"), blank("cb"), F.lit("\tUB:Z:"), blank("ub"))).otherwise("ch=1")
    return s.withColumn("note", note).withColumn("name", tags.collapse(F.col("read_id"), F.col("cb"), F.col("ub")))


@query(_HEAD + r" SELECT read_id, note, CASE WHEN contains(note, 'CB:Z:') THEN regexp_extract(note, 'CB:Z:([^ \t]*)', 1) END AS cb_tag, CASE WHEN contains(note, 'UB:Z:') THEN regexp_extract(note, 'UB:Z:([^ \t]*)', 1) END AS ub_tag FROM h")
def fn_cb_ub(spark, d):
    h = _heads(spark, d)
    return h.select("read_id", "note", tags.cell_tag(F.col("read_id"), F.col("note")).alias("cb_tag"), tags.molecule_tag(F.col("note")).alias("ub_tag"))


@query(_HEAD + """ SELECT read_id, name AS collapsed, CASE WHEN regexp_full_match(name, '.+_[^_]+_[^_]+') THEN regexp_extract(name, '^(.+)_([^_]+)_([^_]+)$', 1) END AS qname,
CASE WHEN regexp_full_match(name, '.+_[^_]+_[^_]+') THEN regexp_extract(name, '^(.+)_([^_]+)_([^_]+)$', 2) END AS cb_tag FROM h""")
def fn_collapse(spark, d):
    parsed = _heads(spark, d).withColumn("p", tags.parse_collapsed(F.col("name")))
    return parsed.select("read_id", F.col("name").alias("collapsed"), F.col("p.qname").alias("qname"), F.col("p.cb").alias("cb_tag"))


@query("""SELECT class_id, role, barcode, ordinal, (ordinal * 2 // 8)::INT AS bin, 's_008um_' || lpad((ordinal * 2 // 8)::VARCHAR, 5, '0') || '_' || lpad(ordinal::VARCHAR, 5, '0') || '-1' AS spatial_id,
'r_' || lpad((ordinal * 2 // 8)::VARCHAR, 5, '0') || '_' || lpad(ordinal::VARCHAR, 5, '0') AS read_name, 's008um' AS rg FROM whitelist""")
def fn_bin(spark, d):
    w = table(spark, d, "whitelist").withColumn("bin", tags.bin_of(F.col("ordinal"), 8))
    return w.select("class_id", "role", "barcode", "ordinal", "bin", tags.spatial_id(8, F.col("bin"), F.col("ordinal")).alias("spatial_id"),
                    tags.coordinate_name(F.lit("r"), F.col("bin"), F.col("ordinal")).alias("read_name"), F.lit(tags.bin_tag(8)).alias("rg"))


@query("""SELECT class_id, count(*) AS n, round(avg(stop - "start" + 1), 6) AS mean_len, round(coalesce(stddev_samp(stop - "start" + 1), 0), 6) AS sd_len FROM elements GROUP BY 1""")
def fn_misc(spark, d):
    mean, sd = stats.mean_deviation(F.col("stop") - F.col("start") + 1)
    return table(spark, d, "elements").groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.round(mean, 6).alias("mean_len"), F.round(sd, 6).alias("sd_len"))


@query("""SELECT class_id, array_to_string(list_sort(list_distinct(list(length(barcode)))), ',') AS lengths FROM whitelist GROUP BY 1""")
def fn_bclen(spark, d):
    lengths = F.array_sort(F.collect_set(F.length("barcode")))
    return _listed(spark, d).groupBy("class_id").agg(_joined(lengths.cast("array<string>")).alias("lengths"))
