import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import dna, stats, tags
from strandloom.plans import layout as L


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(column).first()[0]


def test_codes(spark):
    assert one(spark, "AAACCTGAGAAACCAT", dna.encode("s")) == 23904338
    seqs = ["A", "ACGT", "TTTTTTTTTTTTTTTTTTTTTTTTTTTTTTT", "GATTACA"]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    got = df.select("s", dna.decode(dna.encode("s"), F.length("s")).alias("d"), dna.revcomp(dna.revcomp("s")).alias("r"), dna.unpack(dna.pack("s")).alias("u")).collect()
    for r in got:
        assert r.r == r.s and (len(r.s) > 26 or (r.d == r.s and r.u == r.s))
    for bad in ("ACGN", "", None, "A" * 32):
        assert one(spark, bad, dna.encode("s")) is None


def test_windows(spark):
    assert one(spark, "ACGTA", dna.kmers("s", 4)) == ["ACGT", "CGTA"] and one(spark, "AC", dna.kmers("s", 4)) == []
    assert one(spark, "ACG", dna.circular_kmers("s", 5)) == ["ACGAC", "CGACG", "GACGA"]
    assert one(spark, "ABCDEFGH", dna.padded("s", F.lit(6), F.lit(4), 1)) == "CDEFG"
    assert one(spark, "", dna.padded("s", F.lit(1), F.lit(2), 1)) == ""
    assert [tuple(h) for h in one(spark, "AAAA", dna.hits("s", "AA", 1, 0))] == [(0, "A"), (1, "A")]
    assert one(spark, "aaaaCGT", dna.homopolymer_end("s", 4)) and not one(spark, "AAACGT", dna.homopolymer_end("s", 4))


def brute_infix(a, b):
    if len(a) > len(b):
        a, b = b, a
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.text("ACGT", min_size=3, max_size=9), st.text("ACGT", min_size=3, max_size=12)), min_size=1, max_size=20))
def test_infix_distance(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", dna.infix_distance("a", "b", 2).alias("d")).collect():
        d = brute_infix(r.a, r.b)
        assert r.d == (d if d <= 2 else -1)


def test_neighbours(spark):
    def ball(s):
        subs = {s[:i] + b + s[i + 1 :] for i in range(len(s)) for b in "ACGT"}
        dels = {s[:i] + s[i + 1 :] for i in range(len(s))}
        ins = {s[:i] + b + s[i:] for i in range(len(s) + 1) for b in "ACGT"}
        return (subs | dels | ins) - {s}

    assert set(one(spark, "ACCA", dna.edit_ball("s"))) == ball("ACCA")
    assert len(one(spark, "ACGTA", dna.hamming_ball("s", 2))) == 15 + 90
    assert set(one(spark, "ACG", dna.shifted("s"))) == {"AAC", "CAC", "GAC", "TAC", "ACA", "ACC", "ACT"}


def test_headers(spark):
    assert one(spark, "x_A_B", tags.parse_collapsed(F.col("s"))).asDict() == {"qname": "x", "cb": "A", "ub": "B"}
    assert one(spark, "x_A", tags.parse_collapsed(F.col("s"))) is None
    assert one(spark, 5, tags.bin_of(F.col("s"), 8), "int") == 1
    assert one(spark, 12, tags.spatial_id(8, F.col("s"), F.lit(34)), "int") == "s_008um_00012_00034-1"
    assert tags.parse_bin("s008um") == 8 and tags.parse_bin("16") == 16 and tags.parse_bin("0") is None and tags.parse_bin("x") is None
    assert tags.record_suffix("a.fasta.gz") == ".fa" and tags.record_suffix("x.fq") == ".fq"
    assert tags.flag_tokens("a, b;c|d") == ["a", "b", "c", "d"]
    assert L.joint_flag("keep|joint_barcode") == (0, -3, 3) and L.joint_flag("joint_barcode:2_1") == (2, 0, 1) and L.joint_flag("x") is None


def test_statistics():
    assert [dna.max_edits(22, 0.3), dna.max_edits(3, 0.3), dna.max_edits(22, 0), dna.max_edits(22, math.nan)] == [6, 1, 0, 0]
    for lam in (0.3, 2.5, 40.0):
        for k in (1, 2, 7, 60):
            p = sum(math.exp(i * math.log(lam) - lam - math.lgamma(i + 1)) for i in range(1, k + 1)) / (1 - math.exp(-lam))
            assert abs(stats.ztp_percentile(k, lam) - 100 * p) < 1e-6
    assert stats.ztp_percentile(0, 2) == 0 and stats.least_match_length(0, 5, 0.1) == -1
    assert stats.kmer_match_probability(10, 10, 11) == 0


def test_sql_functions(spark):
    from strandloom.functions.register import register

    register(spark)
    assert spark.sql("SELECT revcomp('ACGN'), encode_bases('AAACCTGAGAAACCAT'), decode_bases(23904338L, 16), distinct_kmers('AAAA', 2), homopolymer_end('ACGGGG', 4)").first() == (
        "NCGT", 23904338, "AAACCTGAGAAACCAT", 1, True,
    )
    assert {r[0] for r in spark.sql("SELECT * FROM substitutions('AC')").collect()} == {"CC", "GC", "TC", "AA", "AG", "AT"}
