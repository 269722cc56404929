"""Barcode correction against reference lists: a ladder of joins from exact to fuzzy, decided without running counters.

Frames of observed barcodes have class_id, raw (the bases in layout orientation), expanded (the same with some bases
more on either side) and n (reads). Lists have class_id, role ('true' or 'global') and barcode.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import align
from strandloom.session import broadcast_rows, cut, fits, small_side

#: Edits allowed against the true list, against the global list in k-mer search, and against it after mutation.
TRUE_EDITS, KMER_EDITS, GLOBAL_EDITS = 2, 3, 4
#: Reads that may be given to a barcode hardly seen itself, by mode.
FREE = {"offensive": 10, "defensive": 5}
#: Entries from which mutations are written out instead of joined on parts: a barcode has some 1,100 within two bases, and
#: three parts of five bases or six meet one in 700 entries.
MANY = 500_000
#: What an entry of a list, or a part of one, takes of the driver's memory as a build side, rounded up.
ENTRY_BYTES = 500
_KEY = ["class_id", "raw", "expanded"]


def infix_edits(a: str, b: str) -> Column:
    """Edit distance of the shorter within the longer, -1 where either is empty or null; whole Arrow batches of pairs at a
    time, so that a pair costs about a microsecond instead of a hundred."""

    @F.pandas_udf("int")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            pairs = [((p, q) if len(p) <= len(q) else (q, p)) if p and q else ("", "") for p, q in zip(x.tolist(), y.tolist())]
            if not pairs:
                yield pd.Series([], dtype="int32")
                continue
            d = align.infix_pairs([p for p, _ in pairs], [q for _, q in pairs]).astype(np.int32)
            d[np.array([not p for p, _ in pairs])] = -1
            yield pd.Series(d)

    return run.asNondeterministic()(F.col(a), F.col(b))


def infix_distance(a: str, b: str, most: int) -> Column:
    """``infix_edits``, -1 above ``most``."""
    d = infix_edits(a, b)
    return F.when(d <= most, d).otherwise(-1)


def assign_roles(lists: DataFrame, spec: str = "spec") -> DataFrame:
    """Roles by size per class: one list is global from 100,000 entries on, else true; of two, the smaller is true and
    the larger global, both true if as large. Columns in: class_id, ``spec``, barcode; out: class_id, role, barcode."""
    sizes = lists.groupBy("class_id", spec).agg(F.count_distinct("barcode").alias("__n"))
    per = Window.partitionBy("class_id")
    role = (
        F.when(F.count(F.lit(1)).over(per) == 1, F.when(F.col("__n") >= 100_000, "global").otherwise("true"))
        .when(F.col("__n") == F.min("__n").over(per), "true")
        .otherwise("global")
    )
    return lists.join(F.broadcast(sizes.withColumn("role", role).drop("__n")), ["class_id", spec]).select("class_id", "role", "barcode").distinct()


def side(df: DataFrame, small: bool) -> DataFrame:
    """df as a build side: hinted for broadcasting where the lists behind it have been counted and found small."""
    return F.broadcast(df) if small else df


def split_lists(lists: DataFrame, small: bool = False) -> tuple[DataFrame, DataFrame]:
    """True list, and the global list without what is on the true one."""
    rows = lists.select("class_id", "role", "barcode").distinct()
    true = rows.where("role = 'true'").drop("role")
    return true, rows.where("role = 'global'").drop("role").join(side(true, small), ["class_id", "barcode"], "left_anti")


def adapter_kmers(adapters: list[str], length: int) -> list[str]:
    """k-mers of the static elements, read round and round where they are shorter; a few hundred at most."""
    out: set[str] = set()
    for a in adapters:
        ring = a if len(a) >= length else a * (length // max(1, len(a)) + 2)
        out.update(ring[i : i + length] for i in range(len(a) - length + 1 if len(a) >= length else len(a)))
    return sorted(out)


def exact(observed: DataFrame, named: DataFrame, small: bool = False) -> DataFrame:
    """Add ``candidate`` and ``is_true``: the list's entry that the barcode is as it stands (on either list, ``is_true``
    whether on the true one), or turned if that is on the true list; null if neither."""
    as_is = named.select("class_id", F.col("barcode").alias("raw"), F.col("is_true").alias("__here"))
    turned = named.where("is_true").select("class_id", F.col("barcode").alias("__turned"), F.lit(True).alias("__there"))
    out = observed.join(side(as_is, small), ["class_id", "raw"], "left").withColumn("__turned", dna.revcomp("raw"))
    out = out.join(side(turned, small), ["class_id", "__turned"], "left")
    candidate = F.when(F.col("__here").isNotNull(), F.col("raw")).when(F.col("__there"), F.col("__turned"))
    return out.select(*observed.columns, candidate.alias("candidate"), F.coalesce("__here", "__there").alias("is_true"))


def poor(c: str) -> Column:
    """Hardly any variety, or a run of one base at an end."""
    most = F.greatest(F.lit(4), F.floor(F.length(c) * 0.4).cast("int"))
    return (dna.distinct_kmers(c, 2) < 4) | dna.homopolymer_end(c, most)


def screened(filters: list[str]) -> Column:
    """Whether a barcode (raw, with candidate and is_true of ``exact``) is not looked at: an adapter's k-mer (unless that is
    a true barcode itself), or a poor one."""
    own = F.coalesce(F.col("is_true") & (F.col("candidate") == F.col("raw")), F.lit(False))
    hit = F.col("raw").isin(filters) | dna.revcomp("raw").isin(filters) if filters else F.lit(False)
    return F.coalesce((hit & ~own) | (poor("raw") if filters else F.lit(False)), F.lit(False))


def kmer_pairs(observed: DataFrame, lists: DataFrame, small: bool = False) -> DataFrame:
    """Entries among the k-mers of the widened window, k the barcode's length."""
    n = F.length("raw")
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("expanded") - n + 1))
    parts = observed.withColumn("barcode", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col("expanded"), i, n)))))
    return parts.join(side(lists, small), ["class_id", "barcode"])


def kmer_candidates(observed: DataFrame, lists: DataFrame, most: int, small: bool = False) -> DataFrame:
    """Entries among the k-mers of the widened window within ``most`` edits of the barcode."""
    near = kmer_pairs(observed, lists, small).withColumn("dist", infix_distance("raw", "barcode", most))
    return near.where("dist >= 0").select(*_KEY, F.col("barcode").alias("candidate"), "dist")


def _seeds(c: Column, parts: int) -> Column:
    n = F.length(c)
    bounds = [F.floor(n * k / parts).cast("int") for k in range(parts + 1)]
    return F.array(*(F.struct(F.lit(k).alias("part"), F.substring(c, bounds[k] + 1, bounds[k + 1] - bounds[k]).alias("seed")) for k in range(parts)))


def seed_pairs(observed: DataFrame, lists: DataFrame, most: int = TRUE_EDITS, window: str = "expanded", small: bool = False) -> DataFrame:
    """Pairs of a window and an entry that may lie within ``most`` edits inside it: an entry cut in most + 1 parts keeps one
    of them whole under that many edits, so entries and windows are joined on parts."""
    parts = lists.select("class_id", "barcode", F.explode(_seeds(F.col("barcode"), most + 1)).alias("s")).select("class_id", "barcode", "s.seed")
    sizes = sorted(r[0] for r in parts.select(F.length("seed")).distinct().collect())
    w = F.col(window)
    pieces = F.flatten(F.array(*(dna.kmers(w, k) for k in sizes if k > 0)))
    open_ = observed.select(*_KEY).distinct().withColumn("seed", F.explode(F.array_distinct(pieces)))
    return open_.join(side(parts, small), ["class_id", "seed"]).select(*_KEY, "barcode").distinct()


def seed_candidates(observed: DataFrame, lists: DataFrame, most: int = TRUE_EDITS, window: str = "expanded", small: bool = False) -> DataFrame:
    """All entries within ``most`` edits inside the window, without comparing everything to everything.

    Windows shorter than an entry are searched in the entry instead, as the distance is.
    """
    near = seed_pairs(observed, lists, most, window, small).withColumn("dist", infix_distance(window, "barcode", most)).where("dist >= 0")
    return near.select(*_KEY, F.col("barcode").alias("candidate"), "dist")


def _whole_pieces(c: Column, n: int, parts: int) -> list[Column]:
    """Where the parts of an entry of length n may stand in c: structs of n, part and seed, null where none can."""
    out, most, longer = [], parts - 1, F.length(c) - n
    bounds = [n * k // parts for k in range(parts + 1)]
    for k in range(parts):
        size = bounds[k + 1] - bounds[k]
        for off in range(-min(k, bounds[k]), k + 1):
            at = bounds[k] + off
            fits = (F.abs(longer - off) <= most - k) & (F.length(c) >= at + size)
            out.append(F.when(fits, F.struct(F.lit(n).alias("size"), F.lit(k).alias("part"), F.substring(c, at + 1, size).alias("seed"))))
    return out


def whole_candidates(observed: DataFrame, lists: DataFrame, most: int, bc: str = "bc", ref: str = "ref") -> DataFrame:
    """All pairs of a barcode and an entry within ``most`` edits as wholes: bc, ref, dist. Joined on parts, then verified.

    Of an entry cut in most + 1 parts, one (k, from 0) is whole with k edits before it, so that it stands k places off at
    most, and most - k edits at most behind it: the first part at which the edits so far fall below the parts so far.
    """
    parts = lists.select(ref, F.length(ref).alias("size"), F.explode(_seeds(F.col(ref), most + 1)).alias("s")).select(ref, "size", "s.part", "s.seed")
    sizes = sorted(r[0] for r in parts.select("size").distinct().collect() if r[0] is not None)
    pieces = F.array_compact(F.array(*(p for n in sizes for p in _whole_pieces(F.col(bc), n, most + 1))))
    open_ = observed.select(bc, F.explode(F.array_distinct(pieces)).alias("p")).select(bc, "p.*") if sizes else observed.select(bc, F.lit(0).alias("size"), F.lit(0).alias("part"), F.lit("").alias("seed"))
    near = open_.join(small_side(parts), ["size", "part", "seed"]).withColumn("dist", F.levenshtein(bc, ref, most)).where("dist >= 0")
    return near.select(bc, ref, "dist").distinct()


def mutation_pairs(observed: DataFrame, lists: DataFrame, radius: int, small: bool = False, many: bool = False) -> DataFrame:
    """Entries within Hamming distance ``radius`` of the barcode, other than itself.

    Joined on radius + 1 parts in place, of which one must be equal. For ``many`` entries (MANY) parts of five bases would
    meet thousands of them; then all mutations of the barcode are written out and joined as wholes.
    """
    seen = observed.select(*_KEY).distinct()
    if many:
        muts = seen.withColumn("barcode", F.explode(F.array_distinct(dna.hamming_ball("raw", radius))))
        return muts.join(side(lists, small), ["class_id", "barcode"])
    parts = lambda df, c: df.withColumn("s", F.explode(_seeds(F.col(c), radius + 1))).withColumn("size", F.length(c)).select("*", "s.part", "s.seed").drop("s")
    pairs = parts(seen, "raw").join(side(parts(lists, "barcode"), small), ["class_id", "size", "part", "seed"]).drop("size", "part", "seed").distinct()
    return pairs.where((dna.hamming("raw", "barcode") <= radius) & (F.col("raw") != F.col("barcode")))


def mutation_candidates(observed: DataFrame, lists: DataFrame, radius: int, most: int, small: bool = False, many: bool = False) -> DataFrame:
    """Entries within Hamming distance ``radius`` of the barcode and ``most`` edits inside the window."""
    near = mutation_pairs(observed, lists, radius, small, many).withColumn("dist", infix_distance("expanded", "barcode", most)).where("dist >= 0")
    return near.select(*_KEY, F.col("barcode").alias("candidate"), "dist")


def settle(candidates: DataFrame, placed: bool = False) -> DataFrame:
    """The candidate of the first rung that decides: _KEY, candidate, dist, rung.

    Columns in: _KEY, rung, candidate, dist, raw_n and nearest. On a rung of ``nearest`` the only candidate at the least
    distance wins; on others a lone candidate, or of several, at the least distance at which any was seen exactly (raw_n
    above 0), the only such one. All steps group by supersets of _KEY, so rows move once, or not at all if they are
    ``placed`` by _KEY already.
    """
    seen = F.col("raw_n") > 0
    by_dist = (candidates if placed else candidates.repartition(*_KEY)).groupBy(*_KEY, "rung", "nearest", "dist").agg(
        F.count(F.lit(1)).alias("c"), F.min("candidate").alias("any"), F.count_if(seen).alias("seen"), F.min(F.when(seen, F.col("candidate"))).alias("pick")
    )
    least = F.min_by(F.struct("c", "any", "dist"), "dist")
    least_seen = F.min_by(F.when(F.col("seen") > 0, F.struct("seen", "pick", "dist")), F.when(F.col("seen") > 0, F.col("dist")))
    per_rung = by_dist.groupBy(*_KEY, "rung", "nearest").agg(F.sum("c").alias("all"), least.alias("l"), least_seen.alias("s"))
    win = lambda c, d: F.struct(F.col(c).alias("candidate"), F.col(d).alias("dist"))
    won = F.when(F.when(F.col("nearest"), F.col("l.c") == 1).otherwise(F.col("all") == 1), win("l.any", "l.dist")).when(~F.col("nearest") & (F.col("s.seen") == 1), win("s.pick", "s.dist"))
    best = per_rung.withColumn("w", won).where("w is not null").groupBy(*_KEY).agg(F.min_by(F.struct("w.candidate", "w.dist", "rung"), "rung").alias("b"))
    return best.select(*_KEY, "b.*")


def gate(proposed: DataFrame, raw_counts: DataFrame, mode: str) -> DataFrame:
    """Accept or reject all fuzzy reads of a barcode by its exact reads and their number; independent of order.

    With two exact reads and more: few reads in all, or fuzzy ones not above 0.8 of them. With fewer: less than FREE reads.
    """
    if mode not in FREE:
        raise ValueError(f"mode must be one of {sorted(FREE)}")
    given = proposed.groupBy("class_id", "candidate").agg(F.sum("n").alias("given"))
    given = given.join(raw_counts, ["class_id", "candidate"], "left").withColumn("raw_n", F.coalesce("raw_n", F.lit(0)))
    total = F.col("raw_n") + F.col("given")
    fine = F.when(F.col("raw_n") >= 2, (total < 10) | ((F.col("given") + 1) / (total + 1) <= 0.8)).otherwise(total < FREE[mode])
    return proposed.join(given.where(fine).select("class_id", "candidate"), ["class_id", "candidate"], "left_semi")


def correct(observed: DataFrame, lists: DataFrame, mode: str = "offensive", radius: int = 2, filters: list[str] | None = None) -> DataFrame:
    """Corrected barcode of every observed one: class_id, raw, expanded, n, corrected, stage, source, write, changed.

    Rungs, the first that gives a barcode counts: global exact, true exact (either strand), k-mers of the window, seeded
    search of the true list in the window, mutations. Fuzzy rungs try true before global in 'offensive' mode, the other
    way round in 'defensive' mode, and must pass ``gate``. The candidates of all fuzzy rungs are gathered with the number
    of their rung and settled at once. Screened and unmatched barcodes come out with null ``corrected`` and the reason as
    stage. ``write`` is whether the barcode goes on: on the true list, or on the global one where the class has no true
    list. Null barcodes come out unmatched; repeated rows are added up by n. Barcodes of which any row has a true ``sure``
    (an optional column) are not screened.
    """
    if mode not in FREE:
        raise ValueError(f"mode must be one of {sorted(FREE)}")
    named = cut(lists.where("barcode is not null and role in ('true', 'global')").groupBy("class_id", "barcode").agg(F.bool_or(F.col("role") == "true").alias("is_true")))
    sizes = {r["is_true"]: r["n"] for r in named.groupBy("is_true").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    room = broadcast_rows(observed.sparkSession, ENTRY_BYTES)
    small, small_parts = total <= room, total * (max(radius, TRUE_EDITS) + 1) <= room
    true = named.where("is_true").drop("is_true")
    sure = F.max("sure") if "sure" in observed.columns else F.lit(False)
    seen = observed.groupBy(*_KEY).agg(F.sum("n").alias("n"), sure.alias("sure"))
    judged = exact(seen, named, small).withColumn("screened", screened(filters or []) & ~F.coalesce("sure", F.lit(False))).drop("sure")
    out_of = F.col("screened") | F.col("raw").isNull()
    judged = cut(judged.select(*_KEY, "n", "screened", *(F.when(~out_of, F.col(c)).alias(c) for c in ("candidate", "is_true"))))
    exact_n = cut(judged.where("candidate is not null").groupBy("class_id", "candidate").agg(F.sum("n").alias("raw_n")))  # at most as long as the lists
    tasks = int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # fuzzy search costs far more than moving the rows it is for: they are spread, however few
    rest = judged.where("not screened and raw is not null and candidate is null").select(*_KEY, "n").repartition(tasks, *_KEY)
    order = ["true", "global"] if mode == "offensive" else ["global", "true"]
    names = [f"{o}_kmer" for o in order] + ["true_seed"] + [f"{o}_mutation" for o in order]
    rung = lambda kind: F.when(F.col("is_true"), names.index(f"true_{kind}")).otherwise(names.index(f"global_{kind}"))
    most = lambda other: F.when(F.col("is_true"), TRUE_EDITS).otherwise(other)
    pair = lambda df, r, m, text: df.select(*_KEY, "barcode", r.alias("rung"), m.alias("most"), F.col(text).alias("text"))
    pairs = pair(kmer_pairs(rest, named, small), rung("kmer"), most(KMER_EDITS), "raw")
    pairs = pairs.unionByName(pair(seed_pairs(rest, true, small=small_parts), F.lit(names.index("true_seed")), F.lit(TRUE_EDITS), "expanded"))
    pairs = pairs.unionByName(pair(mutation_pairs(rest, named, radius, small_parts, total > MANY), rung("mutation"), most(GLOBAL_EDITS), "expanded"))
    near = pairs.repartition(tasks, *_KEY).withColumn("dist", infix_edits("text", "barcode")).where("dist between 0 and most").select(*_KEY, "rung", F.col("barcode").alias("candidate"), "dist")
    near = near.join(side(exact_n, small), ["class_id", "candidate"], "left").withColumn("raw_n", F.coalesce("raw_n", F.lit(0)))
    won = settle(near.withColumn("nearest", F.col("rung") == names.index("true_seed")), placed=small)
    proposed = cut(won.join(rest, _KEY))  # read twice by the gate
    stage = F.element_at(F.array(*map(F.lit, names)), F.col("rung") + 1)
    fuzzy = gate(proposed, exact_n, mode).select(*_KEY, F.col("candidate").alias("fuzzy"), stage.alias("rung_name"))
    out = judged.join(fuzzy, _KEY, "left")  # null barcodes have no match and stay
    has_true = true.select("class_id").distinct().withColumn("has_true", F.lit(True))
    out = out.join(F.broadcast(has_true), "class_id", "left")  # a row per class
    exact_stage = F.when(F.col("is_true"), "true_exact").when(F.col("candidate").isNotNull(), "global_exact")
    stage = F.when(F.col("screened"), "screened").otherwise(F.coalesce(exact_stage, "rung_name", F.lit("unmatched")))
    out = out.withColumn("stage", stage).withColumn("candidate", F.coalesce("candidate", "fuzzy"))
    source = F.when(F.startswith("stage", F.lit("true")), "true").when(F.col("candidate").isNotNull(), "global")
    changed = (F.col("candidate") != F.col("raw")) & (F.col("candidate") != dna.revcomp("raw"))
    write = F.coalesce((source == "true") | F.col("has_true").isNull() & F.col("candidate").isNotNull(), F.lit(False))
    return out.select(*_KEY, "n", F.col("candidate").alias("corrected"), "stage", source.alias("source"), write.alias("write"), changed.alias("changed"))


def apply_lists(barcodes: DataFrame, lists: DataFrame) -> DataFrame:
    """Barcodes that are on a list of their class: all columns, ``write`` (on the true list) and ``corrected`` (other than what
    was read, ``original_seq``, on either strand). Columns in: class_id, seq, original_seq."""
    w = lists.groupBy("class_id", F.col("barcode").alias("seq")).agg(F.bool_or(F.col("role") == "true").alias("write"))
    changed = F.col("original_seq").isNotNull() & (F.col("seq") != F.col("original_seq")) & (F.col("seq") != dna.revcomp("original_seq"))
    return barcodes.join(small_side(w), ["class_id", "seq"]).withColumn("corrected", changed)


def allowed_pairs(barcodes: DataFrame, pairs: DataFrame, first: str = "bc1", second: str = "bc2") -> DataFrame:
    """Rows whose two barcodes are an allowed pair (bc1, bc2)."""
    return barcodes.join(pairs.select(F.col("bc1").alias(first), F.col("bc2").alias(second)).distinct(), [first, second], "left_semi")


def joint_chain(reads: DataFrame, lists: dict[str, DataFrame], lengths: dict[str, list[int]], anchor: str, offsets: tuple[int, int] = (-3, 3), seq: str = "seq", key: str = "read_ord", allowed: DataFrame | None = None) -> DataFrame:
    """Adjoining barcodes, all exact, near an anchor (1-based start of the first): offsets tried as 0, 1, -1, 2 and so on.

    Every offset and combination of lengths is one row, filtered by a semi-join per member, first by the lists that can be
    broadcast, so that only what is left is shuffled for longer ones; of a read's hits the first by offset and then by lengths
    is taken, and must be an allowed pair where a list of pairs is given.
    """
    members = list(lists)
    order = sorted(range(offsets[0], offsets[1] + 1), key=lambda o: (abs(o), o < 0))
    combos: list[tuple[int, ...]] = [()]
    for m in members:
        combos = [c + (n,) for c in combos for n in sorted(lengths[m])]
    tries = [(i, o, j, c) for i, o in enumerate(order) for j, c in enumerate(combos)]
    cases = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(o).alias("o"), F.lit(j).alias("j"), F.array(*map(F.lit, c)).alias("c")) for i, o, j, c in tries))
    t = reads.select(key, seq, anchor, F.explode(cases).alias("t"))
    start = F.col(anchor) + F.col("t.o")
    total = F.aggregate("t.c", F.lit(0), lambda a, x: a + x)
    t = t.where((start >= 1) & (start + total - 1 <= F.length(seq)))
    at = start
    for k, m in enumerate(members):
        n = F.get(F.col("t.c"), F.lit(k))
        t = t.withColumn(m, F.substring(F.col(seq), at, n))
        at = at + n
    t = t.select(key, start.alias("start"), *members, F.col("t.i").alias("i"), F.col("t.j").alias("j"))
    own = {m: lists[m].select(F.col("barcode").alias(m)).distinct() for m in members}
    small = {m: fits(own[m], ENTRY_BYTES) for m in members}
    for m in sorted(members, key=lambda m: not small[m]):
        t = t.join(side(own[m], small[m]), m, "left_semi")
    best = t.groupBy(key).agg(F.min_by(F.struct("start", *members), F.struct("i", "j")).alias("b")).select(key, "b.*")
    return allowed_pairs(best, allowed.toDF("bc1", "bc2"), *members) if allowed is not None else best


def direction_passes(barcodes: DataFrame, key: str = "read_ord", strict: bool = False) -> DataFrame:
    """Per read and direction whether its barcodes let it pass: the only one must, of several any or, if strict, all.

    Columns in: key, direction, passed.
    """
    rule = F.bool_and("passed") if strict else F.when(F.count(F.lit(1)) > 1, F.bool_or("passed")).otherwise(F.bool_and("passed"))
    return barcodes.groupBy(key, "direction").agg(rule.alias("passed"))


def direction_pass(fixes: Column, direction: str, strict: bool = False) -> Column:
    """``direction_passes`` for one read's array of corrected barcodes; false for none."""
    own = F.filter(fixes, lambda f: f["direction"] == direction)
    n = F.coalesce(F.size(own), F.lit(0))
    passed = F.size(F.filter(own, lambda f: f["corrected"].isNotNull()))
    return F.when(n < 1, F.lit(False)).otherwise((passed == n) if strict else F.when(n > 1, passed > 0).otherwise(passed == n))
