"""Percentiles per group of very large numeric columns, by mergeable relative-error compactors."""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Size of a compactor's section. A compactor holds 2 * SECTIONS * K values at first and never compacts its upper half.
K = 64
SECTIONS = 3
#: Stated bound: for the value given as the p-th percentile of n values, the true rank is off by at most
#: ERROR * min(p, 1 - p) * n + 1 with probability 0.99 and more, so the error vanishes towards both tails. Held against
#: exact ranks by tests/llm/test_sketches.py and, over all rows of the tables, by the query p1_rank_check.
ERROR = 0.02

#: Values gathered before they enter the sketches.
HELD = 1 << 19
#: Kept values of a task's open sketches from which they are passed on, to be merged with later ones of their group.
OPEN_VALUES = 4_000_000
#: Sets of parts that ``sketch_sets`` covers are joined to a name by this.
JOINT = ","


class RelativeSketch:
    """Stack of compactors. Level h holds values that stand for 2**h of the input each.

    A full compactor keeps its upper half, and as many sections below it as its schedule says, and passes every second
    of the rest on to the next level. So the highest values are never thinned out, which bounds the rank error relative
    to the distance from the upper end. Two sketches merge level by level; the schedule states merge by bitwise or.
    """

    __slots__ = ("levels", "states", "n", "low", "high", "seed")

    def __init__(self, seed: int = 1):
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.states: list[int] = [0]
        self.n, self.low, self.high, self.seed = 0, math.inf, -math.inf, seed

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
            self.levels[0] = np.concatenate([self.levels[0], values.astype(float)])
            self._compress()

    def merge(self, other: RelativeSketch) -> None:
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
            self.states.append(0)
        for h, (values, state) in enumerate(zip(other.levels, other.states)):
            self.levels[h] = np.concatenate([self.levels[h], values])
            self.states[h] |= state
        self._compress()

    def _coin(self) -> int:
        self.seed = (self.seed * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        return self.seed >> 63

    def _room(self, h: int) -> tuple[int, int]:
        """Sections and capacity of a level; sections double and shrink as its schedule goes on, for unknown lengths."""
        sections = SECTIONS
        while sections < 48 and self.states[h] >= 1 << (sections - 1):
            sections *= 2
        k = max(8, int(K / math.sqrt(sections / SECTIONS)) // 2 * 2)
        return sections, 2 * sections * k

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            sections, room = self._room(h)
            buf = self.levels[h]
            if len(buf) >= room:
                buf = np.sort(buf)
                k = room // (2 * sections)
                state = self.states[h]
                ones = (~state & (state + 1)).bit_length() - 1  # trailing ones of the schedule
                keep = room // 2 + (sections - min(ones + 1, sections)) * k
                cut = len(buf) - keep
                cut -= cut & 1
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                    self.states.append(0)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], buf[self._coin() : cut : 2]])
                self.levels[h] = buf[cut:]
                self.states[h] = state + 1
            h += 1

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """Smallest kept value whose estimated rank reaches ceil(share * n); the ends are exact."""
        if not self.n:
            return [None] * len(shares)
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << h, np.int64) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, ranks = values[order], np.cumsum(weights[order])
        out = []
        for s in shares:
            target = max(1, math.ceil(s * self.n - 1e-9))
            # ranks are counted from the upper end, where they are exact
            i = int(np.searchsorted(ranks + (self.n - ranks[-1]), target))
            out.append(self.high if s >= 1 else self.low if s <= 0 else float(values[min(i, len(values) - 1)]))
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQddI", self.n, self.seed, self.low, self.high, len(self.levels))
        parts = [head]
        for state, values in zip(self.states, self.levels):
            kind = _narrowest(values)
            parts += [struct.pack("<QIB", state, len(values), _KINDS.index(kind)), values.astype(kind).tobytes()]
        return b"".join(parts)

    @classmethod
    def read(cls, blob: bytes, at: int = 0) -> tuple[RelativeSketch, int]:
        out = cls()
        out.n, out.seed, out.low, out.high, levels = struct.unpack_from("<QQddI", blob, at)
        out.levels, out.states, at = [], [], at + struct.calcsize("<QQddI")
        for _ in range(levels):
            state, size, kind = struct.unpack_from("<QIB", blob, at)
            at += struct.calcsize("<QIB")
            out.states.append(state)
            out.levels.append(np.frombuffer(blob, _KINDS[kind], size, at).astype(float))
            at += size * np.dtype(_KINDS[kind]).itemsize
        return out, at

    @classmethod
    def from_bytes(cls, blob: bytes) -> RelativeSketch:
        return cls.read(blob)[0]


#: How kept values are written: the narrowest of these that holds them all unchanged.
_KINDS = ("<i1", "<i2", "<i4", "<f8")


def _narrowest(values: np.ndarray) -> str:
    if not len(values):
        return "<i1"
    low, high = values.min(), values.max()
    if -(1 << 31) <= low and high < 1 << 31 and not (values % 1).any() and not np.signbit(values[values == 0]).any():
        return "<i1" if -128 <= low and high < 128 else "<i2" if -32768 <= low and high < 32768 else "<i4"
    return "<f8"


class TwoTailSketch:
    """Two stacks of compactors, one over the values and one over the negated values, so that either tail is protected.

    Percentiles from the median up are read from the first, those below from the second. While nothing has been
    compacted, both would hold the same values; then only the first is kept.
    """

    __slots__ = ("upper", "lower")

    def __init__(self, seed: int = 1):
        self.upper = RelativeSketch(seed)
        self.lower: RelativeSketch | None = None

    @property
    def n(self) -> int:
        return self.upper.n

    def held(self) -> int:
        return sum(map(len, self.upper.levels)) * (2 if self.lower else 1)

    def _split(self) -> RelativeSketch:
        """The lower stack, made from the plain values where there was none yet."""
        if self.lower is None:
            self.lower = RelativeSketch(self.upper.seed ^ 0x9E3779B97F4A7C15)
            self.lower.add(-self.upper.levels[0])
        return self.lower

    def add(self, values: np.ndarray) -> None:
        if self.lower is None and len(self.upper.levels[0]) + len(values) >= 2 * SECTIONS * K:
            self._split()
        if self.lower is not None:
            self.lower.add(-values)
        self.upper.add(values)

    def merge(self, other: TwoTailSketch) -> None:
        if other.lower is None:
            self.add(other.upper.levels[0])
        else:
            self._split().merge(other.lower)
            self.upper.merge(other.upper)

    def quantiles(self, shares: list[float]) -> list[float | None]:
        if self.lower is None or not self.n:
            return self.upper.quantiles(shares)
        high = self.upper.quantiles(shares)
        # the value of rank r from below is the one of rank n - r + 1 among the negated
        n = self.n
        turned = [(n - max(1, math.ceil(s * n - 1e-9)) + 1) / n for s in shares]
        low = [-v for v in self.lower.quantiles(turned)]
        return [h if s >= 0.5 else self.upper.low if s <= 0 else v for s, h, v in zip(shares, high, low)]

    def to_bytes(self) -> bytes:
        return self.upper.to_bytes() + (self.lower.to_bytes() if self.lower else b"")

    @classmethod
    def from_bytes(cls, blob: bytes) -> TwoTailSketch:
        out = cls()
        out.upper, at = RelativeSketch.read(blob)
        if at < len(blob):
            out.lower = RelativeSketch.read(blob, at)[0]
        return out


def _seed(*parts: object) -> int:
    """Coins of different tasks, groups and columns are independent, and the same when a task is run again."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def _task() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


class _Open:
    """The open sketches of a task by group and column, passed on once they hold more than OPEN_VALUES values."""

    def __init__(self, seed: int):
        self.sketches: dict[tuple, TwoTailSketch] = {}
        self.values, self.seed = 0, seed

    def at(self, key: tuple) -> TwoTailSketch:
        got = self.sketches.get(key)
        if got is None:
            got = self.sketches[key] = TwoTailSketch(_seed(self.seed, _task(), key))
        return got

    def full(self) -> bool:
        return self.values > OPEN_VALUES

    def drain(self, names: list[str]) -> Iterator[pd.DataFrame]:
        rows = [(*key, s.to_bytes()) for key, s in self.sketches.items()]
        self.sketches.clear()
        self.values = 0
        for lo in range(0, len(rows), 5000):
            yield pd.DataFrame(rows[lo : lo + 5000], columns=names, dtype=object)


def sketch_sets(rows: DataFrame, groups: list[str], parts: list[str], columns: list[str], sets: list[tuple[str, ...]], seed: int = 7) -> DataFrame:
    """Partial sketches of each partition for several sets of parts at once, as grouping sets: ``groups``, scope, ``parts``,
    column, sketch. Nothing is shuffled.

    ``sets`` names the parts (days, runs, files) that a scope keeps apart; scope is their names joined by a comma, 'all'
    for none, and parts not kept apart are null. Nulls and NaN are left out (a group with none else gives no row); null
    keys form groups of their own. A group may come out more than once per partition, to be merged.
    """
    keys = [*groups, *parts]
    names = [*groups, "scope", *parts, "column", "sketch"]
    scopes = [(JOINT.join(s) or "all", [*groups, *s]) for s in sets]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        open_ = _Open(seed)

        def flush() -> None:
            pdf = pd.concat(held, ignore_index=True)
            held.clear()
            codes, uniques = {}, {}
            for k in keys:
                codes[k], uniques[k] = pd.factorize(pdf[k], use_na_sentinel=True)
            values = {c: pdf[c].to_numpy(float, na_value=np.nan) for c in columns}
            for scope, kept in scopes:
                code = np.zeros(len(pdf), np.int64)
                for k in kept:
                    code = code * (len(uniques[k]) + 1) + codes[k] + 1
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
                heads = {k: codes[k][order[starts]].tolist() for k in kept}
                ends = [*starts[1:].tolist(), len(order)]
                sorted_ = {c: v[order] for c, v in values.items()}
                blank = {c: np.isnan(v) for c, v in sorted_.items()}
                for i, (lo, hi) in enumerate(zip(starts.tolist(), ends)):
                    name = tuple(uniques[k][heads[k][i]] if k in heads and heads[k][i] >= 0 else None for k in keys)
                    for c in columns:
                        v = sorted_[c][lo:hi]
                        if blank[c][lo:hi].any():
                            v = v[~blank[c][lo:hi]]
                        if len(v):
                            s = open_.at((*name[: len(groups)], scope, *name[len(groups) :], c))
                            before = s.held()
                            s.add(v)
                            open_.values += s.held() - before

        for pdf in batches:
            if len(pdf):
                held.append(pdf)
                n += len(pdf)
            if n >= HELD:
                flush()
                n = 0
                if open_.full():
                    yield from open_.drain(names)
        if held:
            flush()
        yield from open_.drain(names)

    src = rows.select(*keys, *columns)
    schema = [_types(src, groups), "scope string", _types(src, parts), "column string, sketch binary"]
    return src.mapInPandas(fill, ", ".join(filter(None, schema)))


def sketches(rows: DataFrame, groups: list[str], columns: list[str], seed: int = 7) -> DataFrame:
    """One partial sketch per partition, group and column: ``groups``, column, sketch. As ``sketch_sets`` otherwise."""
    return sketch_sets(rows, groups, [], columns, [()], seed).drop("scope")


def merge_sketches(partial: DataFrame, groups: list[str]) -> DataFrame:
    """Merge sketches of the same group and column, whether they come from partitions, files, runs or days.

    Sketches are a few kilobytes whatever they stand for; those of one group are merged as they stream by.
    """
    keys = [*groups, "column"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sketch, out = None, None, []
        for pdf in batches:
            for *key, blob in pdf[[*keys, "sketch"]].itertuples(index=False, name=None):
                key = tuple(None if pd.isna(x) else x for x in key)
                if key != at:
                    if sketch is not None:
                        out.append((*at, sketch.to_bytes()))
                    at, sketch = key, TwoTailSketch.from_bytes(blob)
                else:
                    sketch.merge(TwoTailSketch.from_bytes(blob))
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=[*keys, "sketch"], dtype=object)
                out = []
        if sketch is not None:
            out.append((*at, sketch.to_bytes()))
            yield pd.DataFrame(out, columns=[*keys, "sketch"], dtype=object)

    met = partial.select(*keys, "sketch").repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInPandas(run, met.schema)


def percentiles(merged: DataFrame, shares: list[float], keep_sketch: bool = False) -> DataFrame:
    """Read percentiles out of sketches: a column pNN for each share, the number of values and the relative rank error
    allowed (times min(p, 1 - p) n, plus 1); with ``keep_sketch`` the sketch too, to be merged with later ones."""
    keys = [c for c in merged.columns if c != "sketch"]
    names = ["p" + f"{s * 100:g}".replace(".", "_") for s in shares]
    kept = ["sketch"] if keep_sketch else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [TwoTailSketch.from_bytes(b) for b in pdf["sketch"]]
            out = pdf[keys].copy()
            out["n"] = [s.n for s in read]
            values = [s.quantiles(shares) for s in read]
            for i, name in enumerate(names):
                out[name] = [v[i] for v in values]
            out["relative_rank_error"] = ERROR
            for c in kept:
                out[c] = pdf[c]
            yield out

    schema = [_types(merged, keys), "n bigint", *(f"{n} double" for n in names), "relative_rank_error double", *(f"{c} binary" for c in kept)]
    return merged.mapInPandas(run, ", ".join(schema))


def group_percentiles(rows: DataFrame, groups: list[str], columns: list[str], shares: list[float], by: str | None = None) -> DataFrame:
    """Percentiles of every column per group within the stated rank error, one row per group and column.

    With ``by`` (a day, run or file) the parts are sketched and merged on their own first and then put together, as kept
    daily results would be. A group with a third of all rows costs one sketch per partition. Repeated values are values;
    empty input gives an empty result; other columns are ignored.
    """
    parts = sketches(rows, [*groups, by] if by else groups, columns)
    if by:
        parts = merge_sketches(parts, [*groups, by])
    return percentiles(merge_sketches(parts, groups), shares)


def part_percentiles(rows: DataFrame, groups: list[str], parts: list[str], columns: list[str], shares: list[float], sets: list[tuple[str, ...]]) -> DataFrame:
    """Percentiles and sketches of single parts and of the whole: ``groups``, scope, ``parts``, column, n, percentiles,
    relative_rank_error, sketch. Sketches of any rows can be kept and put together by ``merge_sketches``.

    One pass over the rows and one shuffle, of sketches. Cases as in ``sketch_sets`` and ``group_percentiles``.
    """
    made = sketch_sets(rows, groups, parts, columns, sets)
    return percentiles(merge_sketches(made, [*groups, "scope", *parts]), shares, keep_sketch=True)
