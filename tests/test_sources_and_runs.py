import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandloom import pipeline
from strandloom.functions import tags
from strandloom.operators import emit, reformat
from strandloom.plans import calibrate
from strandloom.plans.catalog import Catalog
from strandloom.plans.layout import compile_layout, revcomp
from strandloom.queries.reads import layout
from strandloom.sources import fastx, seqspec, whitelists
from strandloom.streaming import counts


def test_record_parser():
    text = "@a x y\nAC\nGT\n+\nII\nII\n>b\nACGT\n@c\n\n+\n\n>d\tz\nAA\n@e\nACGT\n+\nIII\n"
    assert list(fastx.parse_records(iter(text.splitlines(True)))) == [("a", "x y", "ACGT", "IIII"), ("b", "", "ACGT", ""), ("d", "z", "AA", "")]


def test_fastx_source(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 c\nACGT\n+\n@@@@\n@r2\nAC\n+\nII\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">r3\nAC\nGT\n")
    (tmp_path / "c.txt").write_text("no records")
    df = fastx.read_fastx(spark, str(tmp_path))
    assert {(r.read_id, r.comment, r.seq, r.qual, r.is_fastq) for r in df.collect()} == {("r1", "c", "ACGT", "@@@@", True), ("r2", "", "AC", "II", True), ("r3", "", "ACGT", None, False)}
    assert fastx.read_fastx(spark, str(tmp_path / "a.fq"), columns="seq", max_reads=1).collect() == [("ACGT",)]
    (tmp_path / "batch.csv").write_text(f"{tmp_path}/a.fq,one\n{tmp_path}/b.fa.gz,two\n")
    assert fastx.read_manifest(spark, str(tmp_path / "batch.csv")).groupBy("output_prefix").count().count() == 2
    q = fastx.stream_fastx(spark, str(tmp_path)).writeStream.format("memory").queryName("fx").trigger(once=True).start()
    q.awaitTermination()
    assert spark.table("fx").count() == 3


def test_whitelists(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("header\n23904338,x\n99999999999\n")
    assert [r[0] for r in whitelists.read_whitelist(spark, str(tmp_path / "codes.csv"), 16).collect()] == ["AAACCTGAGAAACCAT"]
    assert whitelists.is_code_list(["h", "1", "2"]) and not whitelists.is_code_list(["ACGT"]) and not whitelists.is_code_list([])
    (tmp_path / "l.csv").write_text("whitelist_bcs\nCC\nAA\nCC\n")
    assert [(r.ordinal, r.barcode) for r in whitelists.read_ordered(spark, str(tmp_path / "l.csv")).orderBy("ordinal").collect()] == [(0, "CC"), (1, "AA")]
    (tmp_path / "n.csv").write_text("# note\ncount,barcode\n2,ACGT\n3,ACGT\n0,AC\nx,GG\n")
    assert [tuple(r) for r in whitelists.read_counts(spark, str(tmp_path / "n.csv")).collect()] == [("ACGT", 5)]


def test_seqspec(tmp_path):
    (tmp_path / "wl.txt").write_text("ACGT\n")
    (tmp_path / "s.yaml").write_text("""
!Assay
seqspec_version: 0.3.0
library_spec:
- !Region
  region_id: rna
  region_type: rna
  regions:
  - {region_id: p5, region_type: illumina_p5, sequence_type: fixed, sequence: AATG}
  - {region_id: primer, region_type: custom_primer, sequence_type: fixed, sequence: CTACACGACGCTCTTCC}
  - {region_id: bc, region_type: barcode, sequence_type: onlist, min_len: 15, max_len: 16, onlist: {filename: wl.txt}}
  - {region_id: umi, region_type: umi, sequence_type: random, sequence: NNNNNNNNNN}
  - {region_id: pt, region_type: poly_T, sequence_type: random}
  - {region_id: cdna, region_type: cdna, sequence_type: random}
""")
    mode, rows = seqspec.read_seqspec(str(tmp_path / "s.yaml"))
    assert mode == "" and [(r["id"], r["expected_length"]) for r in rows] == [("primer", ""), ("bc", "15-16"), ("umi", "10"), ("poly_t", ""), ("cdna", "")]
    assert rows[1]["whitelist"].endswith("wl.txt") and seqspec.onlist({"filename": "737K-august-2016.txt"}, ".") == "10x_3v2"
    assert compile_layout(rows, mode).get("rc_barcode").length == 16
    with pytest.raises(ValueError):
        seqspec.onlist({"filename": "x", "url": "https://nowhere.example/x"}, ".")


def test_catalog(spark, tmp_path):
    c = Catalog(str(tmp_path / "c.json"), {"layout": {"a": "/a", "b": "/b"}})
    c.add("layout", "x", "/x")
    c.remove("layout", "a")
    again = Catalog(str(tmp_path / "c.json"), {"layout": {"a": "/a", "b": "/b"}})
    assert again.entries("layout") == {"b": "/b", "x": "/x"} and again.resolve("layout", "x") == "/x"
    again.reset("layout", "a")
    assert again.entries("layout")["a"] == "/a" and again.table(spark).count() == 3
    with pytest.raises(KeyError):
        again.resolve("whitelist", "nothing")


def test_reformat(spark):
    x = spark.createDataFrame([(0, "AAC"), (1, "GGTT")], "ordinal int, barcode string")
    y = spark.createDataFrame([(0, "CCA"), (7, "TTG")], "ordinal int, barcode string")
    rows = [("q1", "CB:Z:AAC-TTG\tUB:Z:ACG"), ("q2", "CB:Z:CCA-AAC\tUB:Z:A"), ("q3", "CB:Z:GGTTCCA\tUB:Z:A"), ("q4", "CB:Z:XX\tUB:Z:A"), ("n_AAC-CCA_T", None)]
    df = spark.createDataFrame(rows, "read_id string, comment string")
    got = sorted(r.read_id for r in reformat.coordinate_headers(df, x, y, 8).collect())
    assert got == sorted(["q1_00000_00001", "q2_00000_00000", "q3_00000_00000", "q4", "n_00000_00000"])
    assert sorted(r.read_id for r in reformat.collapse_headers(df).collect())[0] == "n_AAC-CCA_T"


def synthetic(n, cells, rng):
    y = layout()
    dna = lambda k: "".join(rng.choice("ACG") for _ in range(k))
    rows = []
    for i in range(n):
        bc = rng.choice(cells)
        s = y.get("forw_primer").seq + bc + dna(12) + "T" * 18 + dna(130) + y.get("rev_primer").seq
        s = revcomp(s) if i % 2 else s
        rows.append((i, f"{bc}-{i}", s, "I" * len(s)))
    return rows


def test_run_from_reads_to_records(spark, tmp_path):
    rng = random.Random(3)
    cells = ["".join(rng.choice("ACGT") for _ in range(16)) for _ in range(12)]
    rows = synthetic(240, cells, rng)
    reads = spark.createDataFrame(rows, "read_ord int, read_id string, seq string, qual string")
    lists = spark.createDataFrame([("barcode", "true", c) for c in cells], "class_id string, role string, barcode string")
    out = pipeline.demultiplex(reads, layout(), lists)
    rec = pipeline.records(out, layout())
    got = rec.collect()
    assert len(got) >= 235 and all(r.cb == r.read_id.split("-")[0] for r in got) and {r.strand for r in got} == {"F", "R"}
    assert all(len(r.seq) == len(r.qual) for r in got)
    # tail and adapters are cut away, whatever the window took in of them; a tail's window takes up to two bases along
    whole = {r[1]: r[2] for r in rows}
    for r in got:
        turn = (lambda x: x) if r.strand == "F" else revcomp
        assert turn(r.seq) in turn(whole[r.read_id])[68:198] and len(r.seq) >= 120
    assert pipeline.barcode_summary(out).agg(F.sum("total_count")).first()[0] == len(got)
    emit.write_records(rec, str(tmp_path / "out"), split_by_barcode=True)
    assert spark.read.text(str(tmp_path / "out")).select("cb").distinct().count() == len({r.cb for r in got})
    text = rec.select(emit.record_text(rec).alias("t")).first().t
    assert text.startswith("@") and "\tCB:Z:" in text and "TS:A:" in text
    done = calibrate.calibrate(reads, layout())
    assert done.get("forw_primer").threshold and done.get("forw_primer").aligned[0] < 50
    found = calibrate.discover(reads, [("forw_primer", layout().get("forw_primer").seq), ("rev_primer", layout().get("rev_primer").seq), ("x", "GATTACAGATTACAGATTACA")])
    assert [e.class_id for e in found.of("forward")] == ["seq_start", "forw_primer", "read", "rev_primer", "seq_stop"]
    calls, _ = pipeline.auto_whitelist(reads, layout(), lists.select("barcode"))
    assert {r.barcode for r in calls.collect()} <= set(cells)


def test_gated_state(spark, tmp_path):
    rows = [("b", "X", False)] * 3 + [("b", "X", True)] * 2 + [("b", "Y", True)] * 12
    spark.createDataFrame(rows, "class_id string, barcode string, corrected boolean").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("class_id string, barcode string, corrected boolean").parquet(str(tmp_path / "in"))
    q = counts.gated_counters(s).writeStream.outputMode("update").format("memory").queryName("gated").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.barcode: (r.raw_count, r.corrected_count, r.stands) for r in spark.table("gated").collect()}
    assert got == {"X": (3, 2, True), "Y": (0, 12, False)}


def test_record_text_without_quality(spark):
    df = spark.createDataFrame([("a", None, "AC", None)], "i string, c string, s string, q string")
    assert df.select(tags.record(F.col("i"), F.col("c"), F.col("s"), F.col("q"))).first()[0] == ">a\nAC"
