import random

from strandloom import session
from strandloom.operators import correct


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def asked(monkeypatch, heap):
    """Rows of every build side that is hinted for broadcasting, on a driver with that heap."""
    rows, hint = [], correct.F.broadcast
    monkeypatch.setattr(session, "driver_heap", lambda spark: heap, raising=False)
    monkeypatch.setattr(correct.F, "broadcast", lambda df: rows.append(df.count()) or hint(df))
    return rows


def test_long_lists_of_joint_barcodes_stay_off_a_small_driver(spark, monkeypatch):
    rng = random.Random(7)
    one, two = sorted({dna(rng, 16) for _ in range(3000)}), [dna(rng, 15) for _ in range(20)]
    reads = spark.createDataFrame([(i, dna(rng, 9 + i % 3) + b + two[i % 20] + "TTTTT", 10) for i, b in enumerate(one[:60])], "read_ord long, seq string, anchor int")
    lists = {n: spark.createDataFrame([(b,) for b in of], "barcode string") for n, of in (("one", one), ("two", two))}
    run = lambda: sorted(map(tuple, correct.joint_chain(reads, lists, {"one": [15, 16], "two": [15]}, "anchor").collect()))
    want = run()
    assert [(r[0], *r[2:]) for r in want] == [(i, b, two[i % 20]) for i, b in enumerate(one[:60])]
    rows = asked(monkeypatch, 16_000_000)
    assert run() == want and rows and max(rows) * 500 <= 1_000_000


def test_long_lists_stay_off_a_small_driver(spark, monkeypatch):
    rng = random.Random(8)
    listed = sorted({dna(rng, 16) for _ in range(3000)})
    lists = spark.createDataFrame([("b", "true" if i % 2 else "global", b) for i, b in enumerate(listed)], "class_id string, role string, barcode string")
    seen = [*listed[:40], *(b[:7] + "ACGT"[i % 4] + b[8:] for i, b in enumerate(listed[40:80])), *(dna(rng, 16) for _ in range(10))]
    obs = spark.createDataFrame([("b", b, f"GA{b}TC", 1 + i % 3) for i, b in enumerate(dict.fromkeys(seen))], "class_id string, raw string, expanded string, n int")
    run = lambda: sorted(map(tuple, correct.correct(obs, lists).collect()), key=repr)
    want = run()
    assert {"true_exact", "global_exact"} <= {r[5] for r in want}
    rows = asked(monkeypatch, 16_000_000)
    assert run() == want and max(rows) * 500 <= 1_000_000
