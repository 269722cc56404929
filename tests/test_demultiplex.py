import random
import time

from pyspark.sql import functions as F

from strandloom import pipeline
from strandloom.operators import classify, locate
from strandloom.plans.layout import compile_layout, joint_groups, read_rows, revcomp
from strandloom.queries import reads as read_queries

FRONT, BACK = "ATTATCTGCATACGCATCGATA", "GCCTCTCCCGGAGTACGCTGCCT"
JOINT = f"""Read Layout,,,,,,
id,seq,expected_length,type,class,whitelist,flags
forw_primer,{FRONT},,static,,,
umi,,9,variable,umi,,
barcode_1,,15-16,variable,barcode,one,joint_barcode
barcode_2,,14-15,variable,barcode,two,joint_barcode
poly_t,,,static,poly_t,,
read,,,variable,read,,
rev_primer,{BACK},,static,,,
"""
READS = "read_ord bigint, read_id string, seq string, qual string"


def dna(rng, n):
    return "".join(rng.choice("ACG") for _ in range(n - 1)) + "C"


def test_joint_barcodes_stand_where_their_chain_is_found(spark):
    rng = random.Random(3)
    one, two = [dna(rng, 15), dna(rng, 16)], [dna(rng, 14), dna(rng, 15)]
    tail = "T" * 25 + dna(rng, 120) + BACK
    made = {
        1: FRONT + dna(rng, 9) + one[1] + two[1] + tail,  # as expected
        2: FRONT + dna(rng, 10) + one[0] + two[0] + tail,  # a base further on, both shorter
        3: revcomp(FRONT + dna(rng, 8) + one[1] + two[0] + tail),  # the other strand, a base earlier
        4: FRONT + dna(rng, 9) + one[1][:6] + "T" + one[1][7:] + two[1] + tail,  # no chain: corrected alone
        5: FRONT + dna(rng, 9) + one[0] + dna(rng, 15) + tail,
    }
    df = spark.createDataFrame([(i, f"r{i}", s, "I" * len(s)) for i, s in made.items()], READS)
    lists = spark.createDataFrame([("barcode_1", "true", b) for b in one] + [("barcode_2", "true", b) for b in two], "class_id string, role string, barcode string")
    lay = compile_layout(*reversed(read_rows(JOINT)))
    assert [(g.direction, [e.class_id for e in g.members]) for g in joint_groups(lay)] == [("forward", ["barcode_1", "barcode_2"]), ("reverse", ["rc_barcode_1", "rc_barcode_2"])]
    out = pipeline.demultiplex(df, lay, lists)
    bcs = {(r.read_ord, r.class_id.removeprefix("rc_")): r for r in out.where("global_class = 'barcode' and stage is not null").collect()}
    want = {1: (one[1], two[1]), 2: (one[0], two[0]), 3: (one[1], two[0])}
    for i, pair in want.items():
        for name, b in zip(("barcode_1", "barcode_2"), pair):
            r = bcs[i, name]
            whole = made[i][r.start - 1 : r.stop]
            assert (r.seq, r.stage, revcomp(whole) if r.class_id.startswith("rc_") else whole) == (b, "joint", b)
    assert bcs[4, "barcode_1"].stage != "joint" and bcs[4, "barcode_1"].seq == one[1]
    only = spark.createDataFrame([(one[1], two[1])], "bc1 string, bc2 string")
    held = pipeline.demultiplex(df, lay, lists, pairs=only)
    assert {r.read_ord for r in held.where("stage = 'joint'").collect()} == {1}
    assert pipeline.records(pipeline.demultiplex_reads(df.limit(0), lay, lists), lay).count() == 0


def test_nested_records_are_those_of_the_long_table(spark):
    rng = random.Random(4)
    lay = read_queries.layout()
    bcs = [dna(rng, 16) for _ in range(6)]
    part = lambda: FRONT + rng.choice(bcs) + dna(rng, 12) + "T" * 20 + dna(rng, 110) + BACK
    seqs = [part() for _ in range(20)] + [revcomp(part()) for _ in range(20)] + [part() + revcomp(part()) for _ in range(5)] + [dna(rng, 80), "", None, "N" * 300]
    df = spark.createDataFrame([(i, f"r{i}", s, "I" * len(s) if s and i % 3 else None) for i, s in enumerate(seqs)], READS)
    lists = spark.createDataFrame([("barcode", "true", b) for b in bcs] + [("barcode", "true", None)], "class_id string, role string, barcode string")
    flat = pipeline.records(pipeline.demultiplex(df, lay, lists), lay)
    nested = pipeline.records(pipeline.demultiplex_reads(df, lay, lists), lay)
    cols = flat.columns
    a, b = (sorted(map(tuple, x.select(*cols).collect()), key=repr) for x in (flat, nested))
    assert a == b and len(a) >= 35


def test_reads_are_cut_as_base_by_base(spark):
    rng = random.Random(5)
    rows, want = [], []
    for k in range(60):
        seq, qual = ("".join(rng.choice("ACGTNn") for _ in range(80)) for _ in range(2))
        spans = [sorted((rng.randint(1, 80), rng.randint(1, 80))) for _ in range(rng.randint(0, 4))]
        start, stop = sorted((rng.randint(1, 80), rng.randint(1, 80)))
        kept = [i for i in range(start, stop + 1) if seq[i - 1] != "N" and not any(a <= i <= b for a, b in spans)]
        rows.append((k, seq, spans, start, stop))
        want.append("".join(seq[i - 1] for i in kept))
        items = [{"direction": "forward", "global_class": "umi", "start": a, "stop": b} for a, b in spans if a < b]
        x = {"direction": "forward", "global_class": "read", "start": start, "stop": stop}
        lone = [i for i in kept] if all(a < b for a, b in spans) else None
        if lone is not None:
            assert locate.clean_read(seq, qual, x, items) == (want[-1], "".join(qual[i - 1] for i in kept))
    df = spark.createDataFrame(rows, "k int, seq string, spans array<array<int>>, start int, stop int")
    spans = F.transform("spans", lambda s: F.struct(s[0].alias("start"), s[1].alias("stop")))
    got = df.select("k", classify.masked_read(F.col("seq"), spans, F.col("start"), F.col("stop")).alias("t")).orderBy("k").collect()
    assert [r.t for r in got] == want


def test_time_grows_with_the_length_of_reads_not_faster():
    rng = random.Random(6)
    lay = read_queries.layout()

    def took(n, k):
        seqs = [FRONT + dna(rng, 28) + "T" * 20 + dna(rng, n) + BACK for _ in range(k)]
        began = time.perf_counter()
        found = locate.locate_reads(lay, seqs)
        for items, s in zip(found, seqs):
            locate._carry(items, s, "I" * len(s), 4, [])
        assert all(x["element_pass"] for items in found for x in items if x["class_id"] == "read")
        return time.perf_counter() - began

    took(1000, 4)
    short, long = took(4000, 16), took(64000, 1)  # as many bases
    assert long < 4 * short + 1
