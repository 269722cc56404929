import math
import random

from pyspark.sql import functions as F

from strandloom.operators import locate
from strandloom.plans import calibrate
from strandloom.plans.layout import revcomp
from strandloom.queries import reads as read_queries
from strandloom.queries import relational, scalar


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        s[i : i + 1] = rng.choice(["", "A", "N", "CG", "T"])
    return "".join(s)


def test_candidate_sets_hold_all_entries_within_four_edits(spark, tmp_path):
    rng = random.Random(5)
    refs = sorted({"".join(rng.choice("ACGT") for _ in range(rng.choice([3, 8, 15, 16, 17]))) for _ in range(60)})
    seen = sorted({edited(rng, rng.choice(refs), rng.randint(0, 5)) for _ in range(400)} | {"", "A", "N" + refs[-1]})
    rows = [("r", s, 0, False, s, None) for s in seen] + [("r", None, 0, False, None, None)]
    spark.createDataFrame(rows, "read_id string, sequence string, pos int, is_rc boolean, barcode_1 string, barcode_2 string").write.parquet(f"{tmp_path}/extracted_bc.parquet")
    spark.createDataFrame([("barcode", "true", r) for r in refs], "class_id string, role string, barcode string").write.parquet(f"{tmp_path}/whitelist.parquet")
    want = {}
    for s in seen:
        for r in refs:
            if (dist := brute_edits(s, r)) <= 4:
                want.setdefault((s, dist), []).append(r)
    got = {(r.bc, r.dist): (r.n, r.refs) for r in scalar.fn_ld_set(spark, str(tmp_path)).collect()}
    assert got == {k: (len(v), ",".join(v)) for k, v in want.items()}
    assert any(s[:4] != r[:4] and len(r) > 8 for (s, _), v in want.items() for r in v)


def test_percentiles_of_counts_far_above_the_rest(spark, tmp_path):
    counts = {"A": 1, "C": 3, "G": 700, "T": 520, "AC": 640, "AG": 401, "AT": 2500}
    rows = [(b, n - n // 3) for b, n in counts.items()] + [(b, n // 3) for b, n in counts.items()] + [(None, 9), ("CC", None)]
    spark.createDataFrame(rows, "barcode string, n bigint").write.parquet(f"{tmp_path}/barcode_counts.parquet")
    rate = sum(counts.values()) / len(counts)
    got = {r.barcode: (r.k, r.pct) for r in scalar.fn_ztp(spark, str(tmp_path)).collect()}
    assert {b: k for b, (k, _) in got.items()} == counts
    for b, n in counts.items():
        want = 100 * math.fsum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(1, n + 1)) / -math.expm1(-rate)
        assert abs(got[b][1] - want) < 1e-4, b
    assert 10 < got["G"][1] < 90


def test_calibration_and_discovery_look_at_all_reads_or_the_first(spark, tmp_path, monkeypatch):
    looked = []
    best_hits = calibrate.best_hits
    monkeypatch.setattr(calibrate, "best_hits", lambda r, *a: looked.append(r) or best_hits(r, *a))
    lay, n = read_queries.layout(), 50_100
    front, back = (lay.get(c).seq for c in ("forw_primer", "rev_primer"))
    made = spark.range(n).select((F.lit(n) - F.col("id")).alias("read_ord"), F.col("id").cast("string").alias("read_id"), F.lit(None).cast("string").alias("comment"),
                                 F.lit(front + "ACGTTGCA" * 5 + back).alias("seq"), F.lit(None).cast("string").alias("qual"), F.lit(False).alias("is_fastq"))
    made.write.parquet(f"{tmp_path}/reads.parquet")
    assert {"forw_primer", "rev_primer"} <= {r.class_id for r in read_queries.lay_discover(spark, str(tmp_path)).collect()}
    assert {"forw_primer", "rev_primer"} <= {r.class_id for r in read_queries.lay_cal_apply(spark, str(tmp_path)).collect()}
    assert [r.count() for r in looked] == [n, n]
    looked.clear()
    calibrate.calibrate(made, lay, sample=7)
    calibrate.discover(made, [("forw_primer", front)], sample=7)
    assert [sorted(x.read_ord for x in r.collect()) for r in looked] == [list(range(1, 8))] * 2


def test_pairs_and_scans_behind_an_adapter_with_errors(spark, tmp_path):
    a = relational.ADAPTER
    one, two, umi, tail = "ACGGTTCAGTCATGAC", "TTGCAGGACTAACCG", "ACACACACA", "GGTCA" * 6
    damaged = a[:5] + "G" + a[6:11] + a[12:]
    part = umi + one + two + tail
    lone = a[:16] + "GG" + a[18:]
    made = {1: "CC" + a + part, 2: "CC" + damaged + part, 3: revcomp("CC" + damaged + part), 4: "TT" + lone + "C" * 40 + revcomp(damaged + part), 5: "GGTCA" * 20, 6: None}
    rows = [(i, f"r{i}", None, s, None, False) for i, s in made.items()]
    spark.createDataFrame(rows, "read_ord bigint, read_id string, comment string, seq string, qual string, is_fastq boolean").write.parquet(f"{tmp_path}/reads.parquet")
    lists = [("barcode_1", "true", one, 0), ("barcode_2", "true", two, 0), ("barcode", "true", "ACACACACAACGGTTC", 0)]
    spark.createDataFrame(lists, "class_id string, role string, barcode string, ordinal int").write.parquet(f"{tmp_path}/whitelist.parquet")
    d = str(tmp_path)
    got = {r.read_ord: (r.is_rc, r.adapter_end, r.bc1, r.bc2) for r in relational.scan_split(spark, d).collect()}
    assert got == {1: (False, 24, one, two), 2: (False, 23, one, two), 3: (True, 23, one, two), 4: (True, 21, one, two)}
    assert [tuple(r) for r in relational.agg_pair(spark, d).select("bc1", "bc2", "n").collect()] == [(one, two, 4)]
    assert {r.read_ord: (r.start, r.barcode_1, r.barcode_2) for r in relational.jn_joint(spark, d).collect()} == {1: (34, one, two), 2: (33, one, two), 3: (33, one, two), 4: (31, one, two)}
    assert {r.read_ord for r in relational.scan_extract(spark, d).collect()} == {1, 2, 3, 4}
    assert relational.scan_count(spark, d).first().n == 2


def test_correction_takes_all_barcodes_of_all_classes(spark, tmp_path):
    b, one, two = "ACGGTTCAGTCATGAC", "GATCCATGCAATTCGA", "TTGCAGGACTAACCG"
    damaged, longer = one[:7] + "N" + one[8:], b[:9] + "G" + b[9:]
    rows = [(b + "ACGTACGTACGT", b, None), (b[:5] + "N" + b[6:] + "ACGTACGTACGT", b[:5] + "N" + b[6:], None), (longer + "ACGTACGTACGT", longer, None),
            (one + two, one, two), (damaged + two[:4] + "C" + two[5:], damaged, two[:4] + "C" + two[5:]), (b + two, b, two), (None, "NNNNNNNNNNNNNNNN", None), ("ACGT", None, None)]
    spark.createDataFrame([("r", s, 0, False, x, y) for s, x, y in rows], "read_id string, sequence string, pos int, is_rc boolean, barcode_1 string, barcode_2 string").write.parquet(f"{tmp_path}/extracted_bc.parquet")
    spark.createDataFrame([(c, "true", x, 0) for c, x in (("barcode", b), ("barcode_1", one), ("barcode_2", two))], "class_id string, role string, barcode string, ordinal int").write.parquet(f"{tmp_path}/whitelist.parquet")
    out = relational.jn_correct(spark, str(tmp_path)).collect()
    got = {(r.class_id, r.raw): r.corrected for r in out if r.corrected}
    assert got == {("barcode", b): b, ("barcode", rows[1][1]): b, ("barcode", longer): b, ("barcode_1", one): one, ("barcode_1", damaged): one, ("barcode_2", two): two, ("barcode_2", rows[4][2]): two}
    for c, i in (("barcode", 1), ("barcode_1", 1), ("barcode_2", 2)):
        assert {r.raw for r in out if r.class_id == c} == {r[i] for r in rows if r[i]} and sum(r.n for r in out if r.class_id == c) == sum(bool(r[i]) for r in rows)
    assert {r.expanded for r in out if r.raw == longer} == {longer + "ACGT"} and {r.expanded for r in out if r.raw == two} == {one[-4:] + two, b[-4:] + two}
    assert {(r.class_id, r.raw, r.candidate) for r in relational.jn_theta(spark, str(tmp_path)).collect()} >= {("barcode", rows[1][1], b), ("barcode_1", damaged, one)}


def test_adapters_in_lower_case_are_aligned_as_those_in_upper_case():
    lay = read_queries.layout()
    cut_off = lay.get("rev_primer").seq[:11]
    body = lay.get("forw_primer").seq + "ACGTTGCA" * 8
    spans = [[(x["class_id"], x["start"], x["stop"]) for x in locate.locate_reads(lay, [body + end])[0] if x["class_id"] == "rev_primer"] for end in (cut_off, cut_off.lower())]
    assert spans[0] == spans[1] == [("rev_primer", len(body) + 1, len(body) + 11)]


def test_lengths_of_all_layout_rows(spark, tmp_path):
    lines = {1: "a,,16,variable,barcode,,", 2: 'b,"",\"15-16\",variable,barcode,,', 3: '"x,y",,100-200,variable,umi,,', 4: "c,,sixteen,variable,umi,,", 5: "d,,9-1000000000000,variable,umi,,", 6: 'e,"open,16', 7: "f", 8: "\ufeffg,,12", 9: None}
    spark.createDataFrame([(i, "layout", x) for i, x in lines.items()] + [(99, "read", "a,,16")], "line_id bigint, kind string, line string").write.parquet(f"{tmp_path}/raw_lines.parquet")
    got = {r.line_id: (r.n, r.least, r.most) for r in relational.lay_len(spark, str(tmp_path)).collect()}
    none = (0, None, None)
    assert got == {1: (1, 16, 16), 2: (2, 15, 16), 3: (101, 100, 200), 4: none, 5: (999999999992, 9, 1000000000000), 6: none, 7: none, 8: (1, 12, 12), 9: none}


def test_barcodes_are_searched_in_whole_sequences(spark, tmp_path):
    b = "ACGGTTCAGTCATGAC"
    pairs = [(b, b + "TTTTTTTTTTTT"), (b, "TTTTTTTTTTTTTTTT" + b), (b, "GG" + b[:7] + "T" + b[8:]), ("ACG", "TTACGTT"), (b, b[2:12]), (b, "TTTTTTTTTTTTTTTTTTTTTTTT")]
    spark.createDataFrame([("r", s, 0, False, x, None) for x, s in [*pairs, (None, b), (b, None)]], "read_id string, sequence string, pos int, is_rc boolean, barcode_1 string, barcode_2 string").write.parquet(f"{tmp_path}/extracted_bc.parquet")
    assert {(r.a, r.b): r.dist for r in scalar.fn_ld_part(spark, str(tmp_path)).collect()} == dict(zip(pairs, (0, 0, 1, 0, 0, -1)))
