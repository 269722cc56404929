"""Sequence functions as native column expressions; everything here stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of the bases in the two-bit code, and the complements.
CODE_ORDER = "ACTG"
BASES, COMPLEMENTS = "ACGT", "TGCA"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(c: Column, f) -> Column:
    """f(c) with c worked out once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def revcomp(c: str | Column) -> Column:
    """Reverse complement; characters other than upper-case ACGT stay, in reversed place."""
    return F.reverse(F.translate(_c(c), BASES, COMPLEMENTS))


def is_plain(c: str | Column, longest: int = 31) -> Column:
    return _c(c).rlike(f"^[ACGT]{{1,{longest}}}$")


def _bits(c: Column, start: int) -> Column:
    digits = F.filter(F.split(c, ""), lambda x: x != "")
    order = F.array(*map(F.lit, CODE_ORDER))
    return F.aggregate(digits, F.lit(start).cast("bigint"), lambda a, x: a * F.lit(4) + F.array_position(order, x) - F.lit(1))


def encode(c: str | Column) -> Column:
    """Two-bit code, first base in the highest bits; null for anything but 1 to 31 plain bases."""
    return F.when(is_plain(c), _bits(_c(c), 0))


def pack(c: str | Column) -> Column:
    """Two-bit code behind a leading one bit, so that the length is kept."""
    return F.when(is_plain(c), _bits(_c(c), 1))


def decode(code: str | Column, length: Column | int) -> Column:
    n = length if isinstance(length, Column) else F.lit(length)
    at = F.sequence(n - 1, F.lit(0), F.lit(-1))
    base = lambda i: F.substring(F.lit(CODE_ORDER), (F.floor(_c(code) / F.pow(F.lit(4.0), i)) % 4).cast("int") + 1, F.lit(1))
    return F.when(n > 0, F.array_join(F.transform(at, base), ""))


def unpack(packed: str | Column) -> Column:
    n = ((F.length(F.bin(_c(packed))) - 1) / 2).cast("int")
    return decode(_c(packed) - F.pow(F.lit(4.0), n).cast("bigint"), n)


def kmers(c: str | Column, k: int) -> Column:
    """All k-mers in order; none for a shorter sequence."""
    c = _c(c)
    return F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, F.lit(k)))).otherwise(
        F.array().cast("array<string>")
    )


def distinct_kmers(c: str | Column, k: int) -> Column:
    return F.size(F.array_distinct(kmers(c, k)))


def circular_kmers(c: str | Column, k: int) -> Column:
    """k-mers; a sequence shorter than k is read round and round, once from every base."""
    c = _c(c)
    ring = F.repeat(c, F.ceil(F.lit(k) / F.length(c)).cast("int") + 1)
    return F.when(F.length(c) >= k, kmers(c, k)).when(
        F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(ring, i, F.lit(k)))
    )


def padded(c: str | Column, start: Column, stop: Column, pad: int) -> Column:
    """1-based inclusive slice, its ends clamped, put in order, and widened by pad within the sequence."""
    c, n = _c(c), F.length(_c(c))
    a, b = F.greatest(F.lit(1), F.least(start, n)), F.greatest(F.lit(1), F.least(stop, n))
    lo, hi = F.greatest(F.lit(1), F.least(a, b) - pad), F.least(n, F.greatest(a, b) + pad)
    return F.when(n > 0, F.substring(c, lo, hi - lo + 1)).otherwise("")


def hits(c: str | Column, pattern: str, length: int, offset: int) -> Column:
    """Windows at every (overlapping) hit of a pattern: structs of 0-based hit position and window, those in bounds."""
    c = _c(c)
    begin = lambda p: p + len(pattern) + offset if offset >= 0 else p + offset
    at = F.filter(
        F.sequence(F.lit(0), F.greatest(F.length(c) - len(pattern), F.lit(0))),
        lambda p: (F.substring(c, p + 1, F.lit(len(pattern))) == pattern) & (begin(p) >= 0) & (begin(p) + length <= F.length(c)),
    )
    return F.transform(at, lambda p: F.struct(p.alias("pos"), F.substring(c, begin(p) + 1, F.lit(length)).alias("window")))


def is_rc(c: str | Column) -> Column:
    return F.startswith(_c(c), F.lit("rc_"))


def strip_rc(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), "^rc_", "")


def homopolymer_end(c: str | Column, most: int | Column) -> Column:
    """Whether either end is a run of one base at least that long (case does not matter)."""
    s, n = F.upper(_c(c)), most if isinstance(most, Column) else F.lit(most)
    ends = (F.left(s, n) == F.repeat(F.left(s, F.lit(1)), n)) | (F.right(s, n) == F.repeat(F.right(s, F.lit(1)), n))
    return (n > 0) & (F.length(s) >= n) & ends


def infix_distance(a: str | Column, b: str | Column, most: int) -> Column:
    """Edit distance of the shorter within the longer, -1 above ``most``: least over windows of the longer."""
    a, b = _c(a), _c(b)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    spans = F.sequence(F.greatest(F.lit(0), F.length(short) - most), F.length(short) + most)
    tried = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(long))),
            lambda i: F.transform(spans, lambda n: F.levenshtein(short, F.substring(long, i, n), most)),
        )
    )
    return F.when((F.length(short) > 0), F.coalesce(F.array_min(F.filter(tried, lambda d: d >= 0)), F.lit(-1))).otherwise(-1)


def hamming(a: str | Column, b: str | Column) -> Column:
    """Differing positions of two sequences of one length; null for different lengths."""
    a, b = _c(a), _c(b)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a)))
    return F.when(F.length(a) == F.length(b), F.size(F.filter(at, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))))


def _with(c: Column, i: Column, drop: int, put: Column) -> Column:
    return F.concat(F.left(c, i - 1), put, F.substring(c, i + drop, F.length(c)))


def substitutions(c: str | Column) -> Column:
    """All sequences with one base replaced."""
    c = _c(c)
    bases = F.array(*map(F.lit, BASES))
    made = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(bases, lambda b: _with(c, i, 1, b)))
    return F.when(F.length(c) > 0, F.array_distinct(F.filter(F.flatten(made), lambda x: x != c)))


def hamming_ball(c: str | Column, radius: int) -> Column:
    """All sequences within Hamming distance ``radius``, without the sequence itself."""
    c = _c(c)
    out = shell = substitutions(c)
    for _ in range(radius - 1):
        shell = F.array_distinct(F.flatten(F.transform(shell, substitutions)))
        out = F.array_union(out, shell)
    return F.filter(out, lambda x: x != c)


def edit_ball(c: str | Column) -> Column:
    """All sequences one substitution, deletion or insertion away (a lone base is not deleted, 32 bases are not extended)."""
    c = _c(c)
    bases = F.array(*map(F.lit, BASES))
    dels = F.when(F.length(c) > 1, F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: _with(c, i, 1, F.lit("")))).otherwise(
        F.array().cast("array<string>")
    )
    ins = F.flatten(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.transform(bases, lambda b: _with(c, i, 0, b))))
    both = F.array_union(dels, F.when(F.length(c) < 32, ins).otherwise(F.array().cast("array<string>")))
    return F.filter(F.array_union(substitutions(c), both), lambda x: x != c)


def shifted(c: str | Column) -> Column:
    """Neighbours with a new first base before all but the last, or a new last base."""
    c = _c(c)
    core = F.left(c, F.length(c) - 1)
    bases = F.array(*map(F.lit, BASES))
    made = F.concat(F.transform(bases, lambda b: F.concat(b, core)), F.transform(bases, lambda b: F.concat(core, b)))
    return F.when(F.length(c) > 1, F.filter(F.array_distinct(made), lambda x: x != c))


def max_edits(length: int | Column, ratio: float) -> int | Column:
    """Edits allowed for an adapter: a share of its length, one at least, none for no or an invalid share."""
    valid = ratio > 0 and ratio != float("inf")
    if isinstance(length, Column):
        return F.when((length > 0) & F.lit(valid), F.greatest(F.lit(1), F.floor(length * ratio).cast("int"))).otherwise(0)
    return max(1, int(length * ratio)) if length > 0 and valid else 0
