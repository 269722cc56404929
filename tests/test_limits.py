import pytest

from strandloom.sources import fastx, whitelists


def test_one_limit_for_all_files(spark, tmp_path):
    for f, n in (("a.fa", 3), ("b.fa", 5), ("c.fa", 2)):
        (tmp_path / f).write_text("".join(f">{f[0]}{i}\nACGT\n" for i in range(n)))
    ids = lambda k: sorted(r.read_id for r in fastx.read_fastx(spark, str(tmp_path), "read_id,seq", max_reads=k, spread=False).collect())
    assert ids(6) == ["a0", "a1", "a2", "b0", "b1", "b2"] and ids(0) == [] and len(ids(100)) == 10


def test_ordered_lists_and_pair_matrices(spark, tmp_path):
    (tmp_path / "list.csv").write_text("whitelist_bcs\nAC\nGT\nAC\n\nTT\n")
    got = {r.barcode: r.ordinal for r in whitelists.read_ordered(spark, str(tmp_path / "list.csv")).collect()}
    assert got == {"AC": 0, "GT": 1, "TT": 2}
    two = whitelists.read_ordered(spark, str(tmp_path / "list.csv"))
    (tmp_path / "m.csv").write_text("0,1,0\n0,0,0\n1,0,0\n")
    assert {tuple(r) for r in whitelists.read_pair_matrix(spark, str(tmp_path / "m.csv"), two, two).collect()} == {("AC", "GT"), ("TT", "AC")}
    (tmp_path / "long.csv").write_text("0,1,0\n" * 4)
    with pytest.raises(ValueError):
        whitelists.read_pair_matrix(spark, str(tmp_path / "long.csv"), two, two)
    (tmp_path / "codes.txt").write_text("12\n13\n")
    with pytest.raises(ValueError):
        whitelists.read_whitelist(spark, str(tmp_path / "codes.txt"))
