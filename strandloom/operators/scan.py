"""Scan for barcodes behind an adapter, and their counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import align
from strandloom.plans.layout import revcomp
from strandloom.session import small_side

_HIT = "position int, is_rc boolean"


def find_exact(seq: Column, adapter: str) -> Column:
    """0-based place of the adapter, else of its reverse complement: struct of position and is_rc, null for neither."""
    f, r = F.instr(seq, adapter), F.instr(seq, revcomp(adapter))
    hit = lambda p, rc: F.struct((p - 1).alias("position"), F.lit(rc).alias("is_rc"))
    return F.when(f > 0, hit(f, False)).when(r > 0, hit(r, True))


def with_adapter(reads: DataFrame, adapter: str, ratio: float = 0.3, seq: str = "seq") -> DataFrame:
    """Add ``hit``: where the adapter begins, forward before reverse, exact before fuzzy.

    With no edits allowed this is native. Otherwise one Python stage aligns whole batches; an N of read or adapter fits
    every base.
    """
    most = dna.max_edits(len(adapter), ratio)
    if not most:
        return reads.withColumn("hit", find_exact(F.col(seq), adapter))
    sides = [(adapter, False), (revcomp(adapter), True)]

    @F.pandas_udf(_HIT)
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            texts = texts.tolist()
            where: list = [None] * len(texts)
            open_ = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
            for pattern, rc in sides:
                rest = []
                for lo in range(0, len(open_), 2048):
                    part = open_[lo : lo + 2048]
                    todo = []
                    for i in part:
                        at = texts[i].find(pattern) if "N" not in texts[i] else -1
                        if at >= 0:
                            where[i] = (at, rc)
                        else:
                            todo.append(i)
                    if todo:
                        matrix, sizes = align.as_matrix([texts[i] for i in todo])
                        scores = align.infix_scores(pattern, matrix, wild_target=True)
                        for k, i in enumerate(todo):
                            row = scores[k, : sizes[k]]
                            best = int(row.min())
                            if best <= most:
                                where[i] = (align._start_of(pattern, texts[i], int(np.argmin(row)), best, True), rc)
                            else:
                                rest.append(i)
                open_ = rest
            yield pd.DataFrame({"position": pd.array([w and w[0] for w in where], "Int32"), "is_rc": pd.array([w and w[1] for w in where], "boolean")})

    found = reads.withColumn("hit", find.asNondeterministic()(F.col(seq)))
    return found.withColumn("hit", F.when(F.col("hit.position").isNotNull(), F.col("hit")))


def barcode_window(seq: Column, position: Column, is_rc: Column, adapter: str, length: int, left: int = 0, right: int = 0) -> Column:
    """The bases behind the adapter (``left`` skipped, ``right`` more taken), or before its reverse complement, turned.

    Null where no base is left. On the reverse strand ``right`` moves the window and ``left`` does nothing.
    """
    n = F.length(seq)
    a = F.when(is_rc, F.greatest(F.lit(0), position - right - length)).otherwise(F.greatest(F.lit(0), position + len(adapter) + left))
    b = F.when(is_rc, F.least(n, position - right)).otherwise(F.least(n, a + length + right))
    window = F.substring(seq, a + 1, b - a)
    return F.when(a < b, F.when(is_rc, dna.revcomp(window)).otherwise(window))


def extract(reads: DataFrame, adapter: str, length: int = 16, left: int = 0, right: int = 0, ratio: float = 0.3, seq: str = "seq") -> DataFrame:
    """Reads with an adapter hit: all columns, ``position``, ``is_rc`` and ``barcode``."""
    hit = with_adapter(reads, adapter, ratio, seq).where("hit is not null").select("*", "hit.position", "hit.is_rc").drop("hit")
    code = barcode_window(F.col(seq), F.col("position"), F.col("is_rc"), adapter, length, left, right)
    return hit.withColumn("barcode", code).where("barcode is not null")


def count(extracted: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Barcodes and how often they were seen; with a reference list only those on it.

    The semi-join stands over the count on its key, so the planner filters before it aggregates; the aggregation is
    partial before the shuffle.
    """
    counts = extracted.groupBy("barcode").agg(F.count(F.lit(1)).alias("n"))
    if reference is None:
        return counts
    return counts.join(small_side(reference.select("barcode").distinct()), "barcode", "left_semi")


def _best_ends(adapter: str, most: int, seq: Column) -> Column:
    """Struct of forward, the bases up to the end of the adapter's best place, and reverse, those before its reverse
    complement's; null where more than ``most`` edits would be needed. Of equally good places the first."""

    @F.pandas_udf("forward int, reverse int")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            texts = texts.tolist()
            at: dict[bool, list] = {rc: [None] * len(texts) for rc in (False, True)}
            some = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
            for lo in range(0, len(some), 2048):
                part = some[lo : lo + 2048]
                matrix, sizes = align.as_matrix([texts[i] for i in part])
                for pattern, rc in ((adapter, False), (revcomp(adapter), True)):
                    scores = align.infix_scores(pattern, matrix, wild_target=True)
                    for k, i in enumerate(part):
                        row = scores[k, : sizes[k]]
                        stop, best = int(np.argmin(row)), int(row.min())
                        if best <= most:
                            at[rc][i] = align._start_of(pattern, texts[i], stop, best, True) if rc else stop + 1
            yield pd.DataFrame({"forward": pd.array(at[False], "Int32"), "reverse": pd.array(at[True], "Int32")})

    return find.asNondeterministic()(seq)


def oriented_hits(reads: DataFrame, adapter: str, ratio: float = 0.3, seq: str = "seq", key: str = "read_ord") -> DataFrame:
    """key, is_rc, s (the read in the adapter's direction) and adapter_end (bases of s up to its end).

    With no edits allowed the forward hit, or else the reverse one; otherwise a row for the best hit of either strand.
    """
    most = dna.max_edits(len(adapter), ratio)
    if most:
        hit = reads.select(key, seq, _best_ends(adapter, most, F.col(seq)).alias("hit"))
        ends = [(F.lit(False), F.col(seq), F.col("hit.forward")), (F.lit(True), dna.revcomp(seq), F.length(seq) - F.col("hit.reverse"))]
        both = hit.select(key, F.explode(F.array(*(F.struct(rc.alias("is_rc"), s.alias("s"), end.alias("adapter_end")) for rc, s, end in ends))).alias("h"))
        return both.where("h.adapter_end is not null").select(key, "h.*")
    hit = reads.withColumn("hit", find_exact(F.col(seq), adapter)).where("hit is not null")
    oriented = F.when(F.col("hit.is_rc"), dna.revcomp(seq)).otherwise(F.col(seq))
    end = F.when(F.col("hit.is_rc"), F.length(seq) - F.col("hit.position")).otherwise(F.col("hit.position") + len(adapter))
    return hit.select(key, F.col("hit.is_rc").alias("is_rc"), oriented.alias("s"), end.alias("adapter_end"))


def split_pairs(reads: DataFrame, adapter: str, first: DataFrame, second: DataFrame, umi: int = 9, offsets: tuple[int, int] = (0, 3), seq: str = "seq", key: str = "read_ord", ratio: float = 0.3) -> DataFrame:
    """Two adjoining barcodes behind adapter and UMI: the first hit by offset, then by length; with edits allowed in the
    adapter, the other strand is tried where no pair follows it.

    Windows of every strand, offset and length are joined to the lists; a read's hits are ranked afterwards.
    """
    base = oriented_hits(reads, adapter, ratio, seq, key)
    lengths = lambda df: sorted(r[0] for r in df.select(F.length("barcode")).distinct().collect())
    n1, n2 = lengths(first), lengths(second)
    windows = [F.struct(F.lit(o).alias("o"), F.lit(a).alias("a"), F.lit(b).alias("b")) for o in range(offsets[0], offsets[1] + 1) for a in n1 for b in n2]
    at = F.col("adapter_end") + umi + F.col("w.o")
    tried = base.withColumn("w", F.explode(F.array(*windows))).where((at >= 0) & (at + F.col("w.a") + F.col("w.b") <= F.length("s")))
    tried = tried.select(key, "is_rc", "adapter_end", "w", F.substring("s", at + 1, F.col("w.a")).alias("bc1"), F.substring("s", at + F.col("w.a") + 1, F.col("w.b")).alias("bc2"))
    one, two = (df.select(F.col("barcode").alias(c)).distinct() for df, c in ((first, "bc1"), (second, "bc2")))
    both = tried.join(small_side(one), "bc1", "left_semi").join(small_side(two), "bc2", "left_semi")
    best = both.groupBy(key).agg(F.min_by(F.struct("is_rc", "adapter_end", "bc1", "bc2"), F.struct("is_rc", "w.o", "w.a", "w.b")).alias("x"))
    return best.select(key, "x.*")


def pair_counts(pairs: DataFrame) -> DataFrame:
    counts = pairs.groupBy("bc1", "bc2").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pair", F.concat("bc1", "bc2"))


def pair_matrix(counts: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """One line per first barcode in list order: 0 and 1 for every second one. Lists hold barcode and ordinal.

    Only pairs that occur are grouped; the zeros are written from the number of columns.
    """
    width = second.count()
    seen = counts.join(second.select(F.col("barcode").alias("bc2"), F.col("ordinal").alias("at")), "bc2").groupBy("bc1").agg(F.collect_set("at").alias("at"))
    rows = first.select(F.col("barcode").alias("bc1"), "ordinal").join(seen, "bc1", "left")
    bits = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(F.array_contains("at", i), "1").otherwise("0"))
    line = F.when(F.col("at").isNull(), F.concat(F.lit("0"), F.repeat(F.lit(",0"), width - 1))).otherwise(F.array_join(bits, ","))
    return rows.select("ordinal", "bc1", line.alias("line"))


def matrix_pairs(lines: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The pairs a 0/1 matrix allows. ``lines``: ordinal and line."""
    cells = lines.select("ordinal", F.posexplode(F.split("line", ",")).alias("at", "bit")).where(F.trim("bit") == "1")
    one = first.select(F.col("ordinal"), F.col("barcode").alias("bc1"))
    two = second.select(F.col("ordinal").alias("at"), F.col("barcode").alias("bc2"))
    return cells.join(one, "ordinal").join(two, "at").select("bc1", "bc2")
