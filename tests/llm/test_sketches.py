import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import heavy, percentiles, termfreq

SHARES = [0.0, 0.001, 0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 1.0]


def rank_error(data, share, value):
    """How far the value's rank is off, over the distance from the nearer end."""
    data = np.sort(data)
    n = len(data)
    lo, hi, r = np.searchsorted(data, value, "left"), np.searchsorted(data, value, "right"), max(1, int(np.ceil(share * n)))
    off = 0 if lo < r <= hi else min(abs(r - lo - 1), abs(r - hi))
    return max(0, off - 1) / max(1e-9, min(share, 1 - share) * n) if 0 < share < 1 else off


@pytest.mark.parametrize("parts", [1, 30, 300])
@pytest.mark.parametrize("kind", ["uniform", "skewed", "ascending", "few"])
def test_merged_sketches_keep_the_stated_error(parts, kind):
    rng = np.random.default_rng(1)
    data = {"uniform": rng.random(200_000), "skewed": np.floor(rng.exponential(300, 200_000)), "ascending": np.arange(200_000.0), "few": rng.integers(0, 5, 200_000) * 1.0}[kind]
    total = percentiles.TwoTailSketch(3)
    for i, p in enumerate(np.array_split(data, parts)):
        s = percentiles.TwoTailSketch(11 + i)
        s.add(p)
        total.merge(percentiles.TwoTailSketch.from_bytes(s.to_bytes()))
    assert total.n == len(data) and total.held() < 24_000
    for share, v in zip(SHARES, total.quantiles(SHARES)):
        assert rank_error(data, share, v) <= percentiles.ERROR, (share, v)


def test_percentiles_of_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaab") if i % 50 else None, i % 7, rng.choice([None, rng.randint(0, 9000)]), 1, "x") for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, day int, v int, n int, sketch string").repartition(5)  # clashing extra columns
    got = {r.g: r for r in percentiles.group_percentiles(df, ["g"], ["v"], [0.5, 0.99], by="day").collect()}
    for g in ("a", "b", None):
        data = np.array([v for a, _, v, _, _ in rows if a == g and v is not None], float)
        assert got[g].n == len(data)
        assert rank_error(data, 0.5, got[g].p50) <= percentiles.ERROR and rank_error(data, 0.99, got[g].p99) <= percentiles.ERROR
    assert percentiles.group_percentiles(df.limit(0), ["g"], ["v"], [0.5]).count() == 0
    assert percentiles.group_percentiles(df.where("v is null"), ["g"], ["v"], [0.5]).count() == 0


def test_sketches_are_written_in_the_narrowest_kind_and_read_back():
    for values in ([1.0, -128.0], [300.0, 2.0], [70_000.0], [0.5, 1e300], [-0.0, 3.0], []):
        s = percentiles.TwoTailSketch()
        s.add(np.array(values, float))
        back = percentiles.TwoTailSketch.from_bytes(s.to_bytes())
        assert back.n == len(values) and back.upper.levels[0].tobytes() == np.array(values, float).tobytes()


def test_parts_can_be_put_together_and_open_sketches_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "OPEN_VALUES", 100)
    monkeypatch.setattr(percentiles, "HELD", 500)
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([None, "d1", "d2"]), f"r{rng.randrange(3)}", rng.randint(0, 10**6)) for _ in range(9000)]
    df = spark.createDataFrame(rows, "g string, day string, run string, v int").repartition(3)
    got = percentiles.part_percentiles(df, ["g"], ["day", "run"], ["v"], [0.01, 0.5, 0.99], [(), ("day",), ("day", "run")])
    assert got.where("scope = 'all'").count() == 2 and got.where("scope = 'day'").count() == 6 and got.where("scope = 'day,run'").count() == 18
    put = percentiles.percentiles(percentiles.merge_sketches(got.where("scope = 'day,run'"), ["g"]), [0.01, 0.5, 0.99])
    for frame in (put, got.where("scope = 'all'")):
        for r in frame.collect():
            data = np.array([v for g, _, _, v in rows if g == r.g], float)
            assert r.n == len(data)
            for share, v in ((0.01, r.p1), (0.5, r.p50), (0.99, r.p99)):
                assert rank_error(data, share, v) <= percentiles.ERROR


def test_burst_trie():
    rng = random.Random(2)
    trie, want = termfreq.BurstTrie(), defaultdict(lambda: [0, 0])
    words = ["", "A", "é" * 3, "x" * 5000] + ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 12))) for _ in range(9000)]
    for w in words + words[:500]:
        trie.add(w, 2, 1)
        want[w][0] += 2
        want[w][1] += 1
    got = list(trie.items())
    assert {t: [o, r] for t, o, r in got} == want and [t for t, _, _ in got] == sorted(want)
    assert trie.kids is not None


def term_rows():
    rng = random.Random(8)
    rows = [("hot", f"r{i}", f"d{i}") for i in range(900)]
    rows += [(rng.choice(["", "a", "ab", "abc", None, "z" * 4000, "ü"]), rng.choice([None, "r1", "r2", "r3"]), f"e{i}") for i in range(600)]
    return rows + rows[:100]  # the first hundred are delivered again


def check_terms(spark, got):
    occ, rec = Counter(), defaultdict(set)
    for t, r, _ in set(term_rows()):
        if t is not None:
            occ[t] += 1
            if r is not None:
                rec[t].add(r)
    assert {r.term: (r.occurrences, r.records) for r in got} == {t: (occ[t], len(rec[t])) for t in occ}


def test_terms_with_redelivery(spark):
    df = spark.createDataFrame(term_rows(), "term string, record string, id string").withColumn("field", F.lit(1)).repartition(4)
    check_terms(spark, termfreq.count_terms(df, "term", "record", delivery=["term", "record", "id"]).collect())
    assert termfreq.count_terms(df.limit(0), "term", "record").count() == 0


def test_routes_split_where_terms_are_many(spark, monkeypatch):
    monkeypatch.setattr(termfreq, "ROUTE_ROWS", 50)
    monkeypatch.setattr(termfreq, "ROUTES", 10**9)
    df = spark.createDataFrame([("", "https://x/" + str(i)) for i in range(400)] + [("", "hot")] * 200, "field string, term string")
    burst = termfreq.burst_prefixes(df)[""]
    assert "https://x/" in burst and termfreq.route("https://x/17", burst).startswith("https://x/1") and termfreq.route("hot", burst) == "ho"
    rows = spark.createDataFrame(term_rows(), "term string, record string, id string")
    check_terms(spark, termfreq.count_terms(rows, "term", "record", delivery=["term", "record", "id"]).collect())


def test_marks(spark):
    df = spark.createDataFrame([("a", 2), ("b", 3), ("c", 60), ("d", 59)], "term string, records int")
    assert {r.term: r.mark for r in termfreq.mark_terms(df, 100, 2, 600).collect()} == {"a": "rare", "b": None, "c": "common", "d": None}


def test_code_words_survive_two_wrong_symbols():
    rng = random.Random(1)
    prints = np.array([rng.getrandbits(44) for _ in range(200)], np.uint64)
    for x, row in zip(prints, heavy.encode(prints)):
        for k in (0, 1, 2):
            word = row.tolist()
            for j in rng.sample(range(heavy.WORD), k):
                word[j] ^= rng.randrange(1, 16)
            assert heavy.decode(word) == int(x)


def test_most_frequent_values(spark):
    rng = random.Random(6)
    values = ["hot"] * 2000 + [f"v{i % 40}" for i in range(2000)] + [f"rare{i}" for i in range(2000)] + ["", "long" * 5000] * 60 + [None] * 900
    rng.shuffle(values)
    df = spark.createDataFrame([(v, 1, "x") for v in values], "item string, n int, total string").repartition(4)
    got = {r.item: (r.n, r.total) for r in heavy.most_frequent(df, "item", 0.008, 10).collect()}
    c = Counter(v for v in values if v is not None)
    total = sum(c.values())
    assert got == {v: (n, total) for v, n in c.items() if n >= 0.008 * total and n >= 10}
    assert heavy.most_frequent(df.limit(0), "item", 0.01).count() == 0
    assert heavy.most_frequent(df.where("item is null"), "item", 0.01).count() == 0


def test_a_tie_at_the_threshold_lists_all(spark):
    df = spark.createDataFrame([(f"v{i % 20}",) for i in range(400)], "v string")
    assert heavy.most_frequent(df, "v", 0.05).count() == 20
