import pytest
from collections import Counter

from pyspark.sql import functions as F

from strandloom.operators import rejects, skew


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_totals_match_a_plain_join(spark):
    left = [("a", i % 3 if i > 20 else 0, i if i % 5 else None, "x") for i in range(60)] + [(None, 1, 7, "y"), ("a", None, 8, "y")]
    right = [("a", 0), ("a", 0), ("a", 2), (None, 1), ("b", 9)]
    l = spark.createDataFrame(left, "class_id string, barcode int, count int, n_rows string")  # an extra column with a clashing name
    r = spark.createDataFrame(right, "class_id string, barcode int").withColumn("count", F.lit(1))
    got = {(x.class_id, x.barcode): (x.n_rows, x.s, x.n_right, x.n_joined, x.s_joined) for x in skew.eager_join_totals(l, r, ["class_id", "barcode"], sums={"s": F.col("count")}).collect()}
    n = Counter((a, b) for a, b, _, _ in left)
    m = Counter(k for k in right if None not in k)
    for k, v in n.items():
        values = [c for a, b, c, _ in left if (a, b) == k and c is not None]
        s = sum(values) if values else None
        times = max(1, m.get(k, 0))
        assert got[k] == (v, s, m.get(k, 0), v * times, None if s is None else s * times)
    assert len(got) == len(n)


def test_dominant_keys_and_roll_up(spark):
    df = spark.createDataFrame([("c", "hot")] * 98 + [("c", "rare"), ("c", None)], "class_id string, barcode string")
    totals = skew.eager_join_totals(df, df.limit(0), ["class_id", "barcode"])
    assert rows(skew.dominant_keys(totals, 100, 2, "barcode").select("barcode")) == [("hot",)]
    assert rows(skew.roll_up(totals, ["class_id"], ["n_rows"])) == [("c", 100)]


def test_empty_sides(spark):
    df = spark.createDataFrame([], "class_id string, barcode string")
    assert skew.eager_join_totals(df, df, ["class_id", "barcode"]).count() == 0


LINES = [
    ("read", "r1,ch=1,ACGTN,IIIII,true", None), ("read", 'r2,"a ""b"", c",acgt,IIII,true\r', None), ("read", "﻿r3,,ACGT,,false", None),
    ("read", 'r4,"two\nlines",ACGT,"I,II",true', None), ("read", 'r5,"open,ACGT,IIII,true', "quoting"), ("read", 'r6,"x"y,ACGT,IIII,true', "quoting"),
    ("read", 'r7,a"b,ACGT,IIII,true', "quoting"), ("read", "r8,,ACGT,IIII", "columns"), ("read", "r9,,ACGT,IIII,true,", "columns"), ("read", "", "columns"),
    ("read", None, "columns"), ("read", "ra,,ACGT,III,true", "value"), ("read", "rb,,ACXT,IIII,true", "value"), ("read", "rc,,ACGT,IIII,false", "value"),
    ("read", "rd,,,,false", "value"), ("read", "re,,ACGT,IIII,True", "value"), ("read", "rf,,ACGT,II I,true", "value"), ("layout", "a,ACGT,16-15,static,,,", None),
    ("layout", "a,,,variable,b,w,f", None), ("layout", "a,,0-0,static,,,", "value"), ("layout", "a,,x,static,,,", "value"), ("layout", "a,acgt,4,static,,,", "value"),
    ("layout", "a,,4,fixed,,,", "value"), ("layout", "a,,4,static,,", "columns"), ("other", "a,b", "kind"), (None, "a,b", "kind"),
    ("read", "rz," + "c" * 3_000_000 + ",ACGT,IIII,true", None), ("layout", f"a,,{10**30},static,,,", None),
]


def test_reasons_of_bad_lines(spark):
    df = spark.createDataFrame([(i, k, x, "clash") for i, (k, x, _) in enumerate(LINES)], "line_id bigint, kind string, line string, reason string").repartition(2)
    loaded = rejects.load_records(df)
    assert {r.line_id: r.reason for r in loaded.collect()} == {i: r for i, (_, _, r) in enumerate(LINES)}
    reads = {r.line_id: r for r in rejects.typed_reads(loaded).collect()}
    assert reads[1].comment == 'a "b", c' and reads[3].comment == "two\nlines" and reads[3].qual == "I,II" and reads[2].is_fastq is False
    layout = {r.line_id: r for r in rejects.typed_layout(loaded).collect()}
    assert (layout[17].min_length, layout[17].max_length) == (15, 16) and layout[27].min_length is None and layout[18].min_length is None


def test_an_open_quote_takes_no_neighbours(spark):
    bad = [(i, "read", 'x,"open,ACGT,IIII,true' if i % 7 == 0 else f"x{i},,ACGT,IIII,true") for i in range(500)]
    got = rejects.load_records(spark.createDataFrame(bad, "line_id bigint, kind string, line string"))
    assert {r.line_id for r in got.where("reason is not null").collect()} == {i for i in range(500) if i % 7 == 0}
    assert rejects.load_records(spark.createDataFrame([], "line_id bigint, kind string, line string")).count() == 0


def test_the_reader_decides(spark, monkeypatch):
    import duckdb
    import pandas as pd

    con = duckdb.connect(":memory:")
    pdf = pd.DataFrame([(i, k, x) for i, (k, x, _) in enumerate(LINES)], columns=["line_id", "kind", "line"])
    got = {r.line_id: r.judge for r in rejects._load_batch(con, pdf).itertuples()}
    assert {i: got[i] for i in (4, 5, 6, 7, 8, 9, 11, 15, 16, 22, 23)} == {4: "reader", 5: "reader", 6: "grammar", 7: "reader", 8: "reader", 9: "reader", 11: "rule", 15: "reader", 16: "rule", 22: "reader", 23: "reader"}
    assert {got[i] for i in (10, 24, 25)} == {"grammar"} and all(pd.isna(got[i]) for i in (0, 1, 3, 17))
    monkeypatch.setattr(rejects, "_read_files", lambda *a: ({}, {}, set()))
    with pytest.raises(RuntimeError):
        rejects._load_batch(con, pdf)


def test_any_line_is_judged_as_the_grammar_judges_it():
    import random

    import duckdb
    import pandas as pd

    rng = random.Random(8)
    parts = ["a", "ACGT", '"', '""', ",", ",", ",", " ", "true", "false", "\n", "\r", "\ufeff", "\0", "é", "\ue00a", "static", "1-2", "'", "\\"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    con = duckdb.connect(":memory:")
    for kind in ("read", "layout"):
        out = rejects._load_batch(con, pd.DataFrame({"line_id": range(len(lines)), "kind": kind, "line": lines})).sort_values("line_id")
        for x, reason in zip(lines, out["reason"]):
            fields = rejects.split_record(rejects._bare(x))
            want = "quoting" if fields is None else "columns" if len(fields) != len(rejects.FIELDS[kind]) else None
            assert reason == want if want else reason in (None, "value"), x
