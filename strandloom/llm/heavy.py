"""Most frequent values of a very large column in bounded memory, by identifying codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut, small_side

#: Symbols of a code word: DATA four-bit symbols of the value's fingerprint and CHECK parity symbols over GF(16).
DATA, CHECK = 11, 4
WORD = DATA + CHECK
#: Independent groupings and groups of each, for shares down to 1 / (GROUPS / 4). Fixed by the share, never by the data.
REPEATS = 4
#: Rows of a sketch that travel and are merged together.
BLOCK = 64
#: Rows held back and added to the counters at once.
HELD = 1 << 18

_EXP, _LOG = [0] * 30, [0] * 16
_x = 1
for _i in range(15):
    _EXP[_i] = _EXP[_i + 15] = _x
    _LOG[_x] = _i
    _x = (_x << 1) ^ (0x13 if _x & 8 else 0)


def _mul(a: int, b: int) -> int:
    return _EXP[_LOG[a] + _LOG[b]] if a and b else 0


def _parity_rows() -> list[list[int]]:
    """Parity symbols of each unit data word; the code is linear, so a word's parity is the sum of its symbols' rows."""
    gen = [1]
    for i in range(CHECK):
        gen = [(gen[j] if j < len(gen) else 0) ^ (_mul(gen[j - 1], _EXP[i]) if j else 0) for j in range(len(gen) + 1)]
    rows = []
    for p in range(DATA):
        rem = [0] * WORD
        rem[p] = 1
        for i in range(DATA):
            c = rem[i]
            if c:
                for j, g in enumerate(gen):
                    rem[i + j] ^= _mul(c, g)
        rows.append(rem[DATA:])
    return rows


_PARITY = _parity_rows()
#: product table for whole arrays
_TIMES = np.array([[_mul(a, b) for b in range(16)] for a in range(16)], np.uint8)


def encode(prints: np.ndarray) -> np.ndarray:
    """Code words (n x WORD four-bit symbols) of 44-bit fingerprints."""
    shifts = np.arange(DATA - 1, -1, -1, dtype=np.uint64) * np.uint64(4)
    data = ((prints[:, None] >> shifts) & np.uint64(15)).astype(np.uint8)
    word = np.zeros((len(prints), WORD), np.uint8)
    word[:, :DATA] = data
    for p in range(DATA):
        for k in range(CHECK):
            word[:, DATA + k] ^= _TIMES[_PARITY[p][k]][data[:, p]]
    return word


def _syndromes(word: list[int]) -> list[int]:
    out = []
    for i in range(CHECK):
        s = 0
        for c in word:
            s = _mul(s, _EXP[i]) ^ c
        out.append(s)
    return out


def decode(word: list[int]) -> int | None:
    """Fingerprint of a received word with up to two wrong symbols; None where it can't be made out."""
    word = list(word)
    s = _syndromes(word)
    if any(s):
        det = _mul(s[1], s[1]) ^ _mul(s[0], s[2])
        if det:
            inv = _EXP[15 - _LOG[det]]
            l2 = _mul(inv, _mul(s[2], s[2]) ^ _mul(s[1], s[3]))
            l1 = _mul(inv, _mul(s[0], s[3]) ^ _mul(s[1], s[2]))
        elif s[0] and s[1]:
            l1, l2 = _mul(s[1], _EXP[15 - _LOG[s[0]]]), 0
        else:
            return None
        at = [j for j in range(WORD) if 1 ^ _mul(l1, _EXP[(15 - j) % 15]) ^ _mul(l2, _EXP[(30 - 2 * j) % 15]) == 0]
        if len(at) != (2 if l2 else 1):
            return None
        if len(at) == 1:
            fix = [s[0]]
        else:
            a, b = _EXP[at[0]], _EXP[at[1]]
            second = _mul(s[1] ^ _mul(s[0], a), _EXP[15 - _LOG[a ^ b]])
            fix = [s[0] ^ second, second]
        for j, e in zip(at, fix):
            word[WORD - 1 - j] ^= e
        if any(_syndromes(word)):
            return None
    n = 0
    for c in word[:DATA]:
        n = n << 4 | c
    return n


def _group(prints: np.ndarray, repeat: int, groups: int) -> np.ndarray:
    x = prints ^ np.uint64((0x9E3779B97F4A7C15 * (repeat + 1)) & 0xFFFFFFFFFFFFFFFF)
    for m, r in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(r))) * np.uint64(m)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(groups)).astype(np.int64)


class CodeSketch:
    """Counters by grouping, group, symbol position and symbol. Sketches of the same size add up."""

    def __init__(self, groups: int):
        self.groups = groups
        self.counts = np.zeros((REPEATS, groups, WORD, 16), np.int64)

    def add(self, prints: np.ndarray, weights: np.ndarray) -> None:
        words = encode(prints).astype(np.int64)
        spot = np.arange(WORD) * 16 + words
        for r in range(REPEATS):
            at = (_group(prints, r, self.groups)[:, None] * (WORD * 16) + spot).ravel()
            self.counts[r] += np.bincount(at, np.repeat(weights, WORD), self.groups * WORD * 16).astype(np.int64).reshape(self.groups, WORD, 16)

    def heavy(self, least: int) -> set[int]:
        return set().union(*(decode_block(self.counts[r], least) for r in range(REPEATS)))


def decode_block(counts: np.ndarray, least: int) -> set[int]:
    """Fingerprints read from groups with at least ``least`` rows: the heaviest symbol of each position is decoded, its
    word is taken out, and the group is read again while enough is left, so that several may share a group."""
    found: set[int] = set()
    for g in np.flatnonzero(counts[:, 0, :].sum(axis=1) >= least):
        left = counts[g].copy()
        for _ in range(8):
            top = left.argmax(axis=1)
            tall = np.sort(left[np.arange(WORD), top])
            size = int(tall[2])  # two symbols may be wrong; the rest carry the word
            if size < least:
                break
            n = decode(top.tolist())
            if n is None:
                break
            found.add(n)
            word = encode(np.array([n], np.uint64))[0]
            left[np.arange(WORD), word] -= int(left[np.arange(WORD), word].min())
    return found


def sketch_heavy(values: DataFrame, column: str, share: float, groups: int | None = None) -> DataFrame:
    """Candidates (fingerprint) that may make up ``share`` of the non-null rows of ``column``.

    Pass one: only a 64-bit hash leaves the JVM; every partition fills one sketch of fixed size, whatever the data, and
    sketches are added block by block.
    """
    from zlib import compress, decompress

    if groups is None:
        groups = BLOCK
        while groups < 4 / share:
            groups *= 2
    size = groups

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, total, held, n_held = CodeSketch(size), 0, [], 0

        def flush() -> None:
            if held:
                prints, n = np.unique(np.concatenate(held), return_counts=True)
                for lo in range(0, len(prints), 1 << 16):
                    sketch.add(prints[lo : lo + (1 << 16)], n[lo : lo + (1 << 16)])
                held.clear()

        for pdf in batches:
            prints = (pdf["h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(20)).copy()
            held.append(prints)
            total += len(prints)
            n_held += len(prints)
            if n_held >= HELD:
                flush()
                n_held = 0
        flush()
        if total:
            for r in range(REPEATS):
                for b in range(0, size, BLOCK):
                    part = sketch.counts[r, b : b + BLOCK]
                    kind = np.int32 if part.max() < 2**31 else np.int64
                    yield pd.DataFrame({"r": [r], "b": [b], "total": [total], "wide": [kind is np.int64], "blob": [compress(part.astype(kind).tobytes(), 1)]})

    def merge(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a block arrive together; each is added and forgotten."""
        sums: dict[tuple[int, int], list] = {}
        for pdf in pdfs:
            for r, b, total, wide, blob in pdf.itertuples(index=False):
                part = np.frombuffer(decompress(blob), np.int64 if wide else np.int32)
                if (r, b) in sums:
                    sums[r, b][0] += part
                    sums[r, b][1] += total
                else:
                    sums[r, b] = [part.astype(np.int64), total]
        for part, total in sums.values():
            least = max(1, int(share * total / 2))
            found = sorted(decode_block(part.reshape(-1, WORD, 16), least))
            if found:
                yield pd.DataFrame({"print": np.array(found, np.int64)})

    hashed = values.where(F.col(column).isNotNull()).select(F.xxhash64(F.col(column)).alias("h"))
    parts = hashed.mapInPandas(fill, "r int, b int, total long, wide boolean, blob binary")
    return parts.repartition("r", "b").mapInPandas(merge, "print long").distinct()


def most_frequent(values: DataFrame, column: str, share: float, least_rows: int = 1, groups: int | None = None) -> DataFrame:
    """Values making up at least ``share`` of the non-null rows of ``column`` and at least ``least_rows`` rows.

    Columns ``item`` (as text), ``n`` and ``total``. Two passes in bounded memory: identifying codes name the candidates
    (``sketch_heavy``), then the candidates alone are counted exactly, so no count is approximate and no listed value
    wrong. A value can be missed only if, in all four groupings, its group is dominated by equally heavy others: with
    ``4 / share`` groups the chance is under 0.003 for a value at the very threshold among as many as can be, and much
    less for any other. Nulls count neither as value nor in the total. An empty text is a value. Long texts are hashed
    whole. Empty input gives an empty result. Ties at the threshold are all listed. Other columns are ignored.
    """
    rows = values.select(F.col(column).alias("item")).where(F.col("item").isNotNull())
    candidates = cut(sketch_heavy(rows, "item", share, groups))  # a few hundred fingerprints, read twice
    prints = F.shiftrightunsigned(F.xxhash64("item"), 20)
    counted = rows.withColumn("print", prints).join(small_side(candidates, 100_000), "print", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    return counted.where((F.col("n") >= F.lit(share * total - 1e-6)) & (F.col("n") >= least_rows)).withColumn("total", F.lit(total))
