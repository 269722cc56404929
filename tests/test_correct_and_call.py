import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import calling, classify, correct, scan
from tests.test_functions import brute_infix


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_seeded_search_finds_what_a_full_comparison_finds(spark):
    rng = random.Random(2)
    refs = [dna(rng, 10) for _ in range(40)]
    seen = []
    for _ in range(150):
        s = list(rng.choice(refs))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice(["", "A", "CG", "T"])
        seen.append("".join(s))
    obs = spark.createDataFrame([("b", s, dna(rng, 2) + s + dna(rng, 2)) for s in set(seen)], "class_id string, raw string, expanded string")
    lists = spark.createDataFrame([("b", r) for r in set(refs)], "class_id string, barcode string")
    got = {(r.expanded, r.candidate): r.dist for r in correct.seed_candidates(obs, lists, 2).collect()}
    want = {(o.expanded, b): brute_infix(b, o.expanded) for o in obs.collect() for b in set(refs) if brute_infix(b, o.expanded) <= 2}
    assert got == want
    muts = {(r.raw, r.candidate) for r in correct.mutation_candidates(obs, lists, 2, 4).collect()}
    ham = lambda a, b: sum(x != y for x, y in zip(a, b))
    assert muts == {(o.raw, b) for o in obs.collect() for b in set(refs) if len(b) == len(o.raw) and 0 < ham(b, o.raw) <= 2}


def test_ladder(spark):
    lists = spark.createDataFrame([("b", "true", "AACCGGTTACGTACTG"), ("b", "global", "GGATCCATTGCAAGTC"), ("b", "global", "AACCGGTTACGTACTG")], "class_id string, role string, barcode string")
    rows = [
        ("AACCGGTTACGTACTG", 5), ("CAGTACGTAACCGGTT", 1), ("GGATCCATTGCAAGTC", 3), ("AACCGGTTACGTACTA", 1), ("GGATCCATTGCAAGTT", 1), ("TTTTTTTTTTTTTTTT", 1), ("CATGCATGCATGCATG", 1), (None, 2),
    ]
    obs = spark.createDataFrame([("b", r, f"AC{r}GA" if r else None, n) for r, n in rows], "class_id string, raw string, expanded string, n int")
    out = {r.raw: r for r in correct.correct(obs, lists, filters=["ACGTACGTACGTACGT"]).collect()}
    assert len(out) == len(rows)
    assert out["AACCGGTTACGTACTG"].stage == "true_exact" and out["CAGTACGTAACCGGTT"].corrected == "AACCGGTTACGTACTG"
    assert out["GGATCCATTGCAAGTC"].stage == "global_exact" and not out["GGATCCATTGCAAGTC"].write
    assert out["AACCGGTTACGTACTA"].corrected == "AACCGGTTACGTACTG" and out["AACCGGTTACGTACTA"].changed
    assert out["GGATCCATTGCAAGTT"].corrected == "GGATCCATTGCAAGTC" and out["TTTTTTTTTTTTTTTT"].stage == "screened"
    assert out["CATGCATGCATGCATG"].stage == "unmatched" and out[None].corrected is None
    with pytest.raises(ValueError):
        correct.correct(obs, lists, mode="other")


def test_gate_does_not_depend_on_order(spark):
    prop = spark.createDataFrame([("b", f"r{i}", "e", "X", 0, "s", 1) for i in range(9)] + [("b", "q", "e", "Y", 0, "s", 10)], "class_id string, raw string, expanded string, candidate string, dist int, stage string, n int")
    raw = spark.createDataFrame([("b", "Z", 3)], "class_id string, candidate string, raw_n int")
    assert {r.candidate for r in correct.gate(prop, raw, "offensive").collect()} == {"X"}
    assert correct.gate(prop, raw, "defensive").count() == 0


def test_roles(spark):
    rows = [("a", 0, "AA"), ("b", 0, "AA"), ("b", 1, "AA"), ("b", 1, "CC"), ("c", 0, "GG"), ("c", 1, "TT")]
    got = {(r.class_id, r.role, r.barcode) for r in correct.assign_roles(spark.createDataFrame(rows, "class_id string, spec int, barcode string")).collect()}
    assert got == {("a", "true", "AA"), ("b", "true", "AA"), ("b", "global", "AA"), ("b", "global", "CC"), ("c", "true", "GG"), ("c", "true", "TT")}


def test_call_of_a_clear_case(spark):
    rng = random.Random(1)
    rows = [(dna(rng, 16), 200 + i % 40) for i in range(60)] + [(dna(rng, 16), 1 + i % 3) for i in range(900)] + [(None, 5), (dna(rng, 16), None)]
    calls, call = calling.call_barcodes(spark.createDataFrame(rows, "barcode string, n int"))
    final = {r.barcode for r in calls.where("final_barcode").collect()}
    assert final == {b for b, n in rows if b and n and n >= 200}, call
    assert calls.count() == 960
    empty, _ = calling.call_barcodes(spark.createDataFrame([], "barcode string, n int"))
    assert empty.count() == 0


def test_calling_parts():
    assert calling.finite_guard(100, 60, 10, 40) == "accepted" and calling.finite_guard(0, 0, 0, 0) == "invalid_universe" and calling.finite_guard(60, 60, 10, 40) == "rejected"
    x = np.sort(np.random.default_rng(0).normal(size=500))
    sd, (q1, q3) = x.std(ddof=1), (x[125], x[375])
    assert abs(calling.bandwidth(x, np.ones(500, int)) - 0.9 * min(sd, (q3 - q1) / 1.34) * 500**-0.2) < 1e-12
    two = np.sort(np.r_[x, x + 8])
    s = calling.saddle_cut(two, np.ones(1000, int))
    assert s.ok and 1 < s.final_cut <= s.cut < 7
    assert calling.bandwidth(x[:1], np.ones(1, int)) == 0.1


def test_scan_windows(spark):
    a = "ATTATCTGCATACGCATCGATA"
    rc = a.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    rows = [(1, "GG" + a + "ACGTACGTACGTACGTCC"), (2, "CC" + "TTGGTTGGTTGGTTGG" + rc + "AA"), (3, "ACGT"), (4, None), (5, a), (6, "G" + a[:10] + "C" + a[11:] + "TTTTCCCCTTTTCCCCA")]
    df = spark.createDataFrame(rows, "read_ord int, seq string")
    exact = {r.read_ord: (r.position, r.is_rc, r.barcode) for r in scan.extract(df, a, 16, ratio=0).collect()}
    assert exact == {1: (2, False, "ACGTACGTACGTACGT"), 2: (18, True, "CCAACCAACCAACCAA")}
    fuzzy = {r.read_ord: r.barcode for r in scan.extract(df, a, 16).collect()}
    assert fuzzy == {1: "ACGTACGTACGTACGT", 2: "CCAACCAACCAACCAA", 6: "TTTTCCCCTTTTCCCC"}


def test_pair_matrix_round_trip(spark):
    one = spark.createDataFrame([(0, "AA"), (1, "CC"), (2, "GG")], "ordinal int, barcode string")
    two = spark.createDataFrame([(0, "TT"), (1, "AC")], "ordinal int, barcode string")
    pairs = spark.createDataFrame([("AA", "AC"), ("GG", "TT"), ("AA", "AC")], "bc1 string, bc2 string")
    lines = scan.pair_matrix(scan.pair_counts(pairs), one, two)
    assert {r.ordinal: r.line for r in lines.collect()} == {0: "0,1", 1: "0,0", 2: "1,0"}
    assert {tuple(r) for r in scan.matrix_pairs(lines, one, two).collect()} == {("AA", "AC"), ("GG", "TT")}


def test_read_types(spark):
    df = spark.createDataFrame([(0, 0), (2, 2), (3, 1), (1, 3), (0, 1)], "f int, r int")
    assert [r[0] for r in df.select(classify.read_type(F.col("f"), F.col("r"))).collect()] == ["filtered", "concatenate", "forward", "reverse", "reverse"]
