import random

import pytest

from strandloom.operators import align as A
from strandloom.operators import locate
from strandloom.plans import layout as L
from strandloom.queries.reads import LAYOUT


def test_lengths():
    assert L.length_candidates("16-15") == [15, 16] and L.length_candidates("0") == [] and L.length_candidates("x") == [] and L.length_candidates("0-2") == [1, 2]


def compiled():
    mode, rows = L.read_rows("﻿" + LAYOUT)
    return L.compile_layout(rows, mode)


def test_compiled_layout():
    y = compiled()
    assert [e.class_id for e in y.elements] == [
        "seq_start", "forw_primer", "barcode", "umi", "poly_t", "read", "rev_primer", "seq_stop",
        "rc_seq_start", "rc_rev_primer", "rc_read", "poly_a", "rc_umi", "rc_barcode", "rc_forw_primer", "rc_seq_stop",
    ]
    assert y.structural_length == 22 + 16 + 12 + 12 + 23
    assert str(y.places["umi"].start) == "barcode|stop+1|var_chained" and str(y.places["umi"].start2) == "forw_primer|stop+17"
    assert str(y.places["rc_umi"].stop2) == "rc_forw_primer|start-17"
    assert L.read_compiled(*L.write_compiled(y)) == y
    with pytest.raises(ValueError):
        L.read_rows(L.write_compiled(y)[0])
    one = L.compile_layout(L.read_rows(LAYOUT)[1], "R1")
    assert {e.direction for e in one.elements} == {"forward"}


def test_duplicate_classes_get_numbers():
    rows = [dict(id=f"b{i}", seq="", expected_length="8", type="variable", whitelist="", **{"class": "barcode"}) for i in (1, 2)]
    assert [e.class_id for e in L.compile_layout(rows).of("forward")][1:3] == ["barcode_1", "barcode_2"]


def test_infix_scores_against_the_full_matrix():
    rng = random.Random(4)
    for _ in range(60):
        p = "".join(rng.choice("ACGT") for _ in range(rng.choice([4, 22, 40, 70])))
        t = "".join(rng.choice("ACGT") for _ in range(50))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert A.infix_scores(p, A.as_matrix([t])[0])[0].tolist() == row[1:]


def test_alignment_details():
    assert A.infix_locations("ACGT", "TTACGTTTACTT", 1) == (0, [(2, 5)])
    score, a, b, cigar = A.local_alignment("CTACACGACGCTC", "GGGCTACACGTACGCTCTT")
    assert (a, b, cigar) == (3, 16, "7=1D6=") and score == 23
    assert A.longest_match("5=2X9=1I3=") == 9 and A.longest_match_with_slip("5=2X9=1I3=") == 14 and A.cigar_edits("5=2X9=1I3=3S") == 3
    assert A.poly_tails("T", "T" * 14) == [(1, 14, 0)] and A.poly_tails("T", "ACGT" * 9) == []
    assert A.masked_regions("ACNNGTNN", "ACTTGTCC") == "TT-CC"
    assert A.merge_overlaps([(5, 9), (1, 3), (3, 4)]) == [(1, 4), (5, 9)]


def test_reads_of_known_structure_are_located():
    y, rng = compiled(), random.Random(9)
    dna = lambda n: "".join(rng.choice("ACG") for _ in range(n))
    for turn in (False, True):
        bc, umi, cdna = dna(16), dna(12), dna(120)
        forw, rev = y.get("forw_primer").seq, y.get("rev_primer").seq
        s = "GG" + forw + bc + umi + "T" * 20 + cdna + rev
        items = {x["class_id"]: x for x in locate.locate_reads(y, [L.revcomp(s) if turn else s])[0] if x["element_pass"]}
        pre = "rc_" if turn else ""
        fix = L.revcomp if turn else str
        assert fix(items[pre + "barcode"]["seq"]) == bc and fix(items[pre + "umi"]["seq"]) == umi and cdna[3:] in fix(items[pre + "read"]["seq"])


def test_locate_keeps_rows_and_takes_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ACGT" * 30), (4, "A" * 5000)], "read_ord int, seq string")
    got = {r.read_ord: len(r.elements) for r in locate.locate(df, compiled()).collect()}
    assert got[1] == got[2] == 0 and got[3] > 0 and got[4] > 0
