"""Occurrence and record counts of every distinct term, by burst tries merged across workers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut

#: A container of a trie holds this many terms before it bursts into one container per next character.
CONTAINER = 2048
#: Routes are split until each carries at most this share of the rows, or ROUTE_ROWS rows if that is more.
ROUTES = 4096
ROUTE_ROWS = 100_000
#: Characters by which one pass lengthens the prefixes.
STEP = 6
#: Terms of a subtree that travel in one row.
CHUNK = 4096


class BurstTrie:
    """Terms with two counters. Inner nodes are dicts by character, leaves are containers of suffixes."""

    __slots__ = ("kids", "box", "end")

    def __init__(self) -> None:
        self.kids: dict[str, BurstTrie] | None = None
        self.box: dict[str, list[int]] | None = {}
        self.end: list[int] | None = None

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at = self, 0
        while node.kids is not None:
            if at == len(term):
                if node.end is None:
                    node.end = [0, 0]
                node.end[0] += occurrences
                node.end[1] += records
                return
            nxt = node.kids.get(term[at])
            if nxt is None:
                nxt = node.kids[term[at]] = BurstTrie()
            node, at = nxt, at + 1
        have = node.box.get(term[at:])
        if have is None:
            node.box[term[at:]] = [occurrences, records]
            if len(node.box) > CONTAINER:
                node._burst()
        else:
            have[0] += occurrences
            have[1] += records

    def _burst(self) -> None:
        box, self.box, self.kids = self.box, None, {}
        for suffix, (o, r) in box.items():
            if not suffix:
                self.end = [o, r]
                continue
            kid = self.kids.get(suffix[0])
            if kid is None:
                kid = self.kids[suffix[0]] = BurstTrie()
            kid.box[suffix[1:]] = [o, r]

    def items(self) -> Iterator[tuple[str, int, int]]:
        """(term, occurrences, records) in the order of the terms."""
        todo: list[tuple[str, BurstTrie]] = [("", self)]
        while todo:
            prefix, node = todo.pop()
            if node.box is not None:
                for suffix in sorted(node.box):
                    yield prefix + suffix, *node.box[suffix]
                continue
            if node.end:
                yield prefix, *node.end
            todo.extend((prefix + c, node.kids[c]) for c in sorted(node.kids, reverse=True))


def burst_prefixes(rows: DataFrame) -> dict[str, set[str]]:
    """Per field the prefixes that are split further, from counts over all rows. At most about ROUTES for each level.

    A pass counts the rows below every prefix of up to STEP more characters; prefixes with too many rows burst. Only
    where a prefix at the last level is still too heavy, its terms are looked at again, STEP characters further on.
    """
    terms = cut(rows.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n")))  # read once a level
    total = terms.agg(F.sum("n")).first()[0] or 0
    most = max(ROUTE_ROWS, total // ROUTES)
    burst: dict[str, set[str]] = {}
    if total <= most:
        return burst
    depth, at = 0, terms
    while True:
        levels = F.explode(F.sequence(F.lit(depth), F.least(F.lit(depth + STEP), F.length("term") - 1)))
        heavy = (
            at.where(F.length("term") > depth)
            .select("field", "term", "n", levels.alias("k"))
            .groupBy("field", F.expr("substring(term, 1, k)").alias("prefix"))
            .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"))
            .where((F.col("n") > most) & (F.col("terms") > 1))  # the rows of a single term are one entry
            .select("field", "prefix")
            .collect()
        )
        for f, p in heavy:
            burst.setdefault(f, set()).add(p)
        deepest = [(f, p) for f, p in heavy if len(p) == depth + STEP]
        if not deepest:
            return burst
        depth += STEP
        keys = rows.sparkSession.createDataFrame(deepest, "field string, prefix string")
        at = terms.withColumn("prefix", F.substring("term", 1, depth)).join(F.broadcast(keys), ["field", "prefix"], "left_semi").drop("prefix")


def route(term: str, burst: set[str]) -> str:
    """The shortest prefix of the term that doesn't burst, or the term itself."""
    k = 0
    while k < len(term) and term[:k] in burst:
        k += 1
    return term[:k]


def count_terms(rows: DataFrame, term: str, record: str, field: Column | None = None, weight: Column | None = None, delivery: list[str] | None = None) -> DataFrame:
    """How often every distinct non-null term occurs (``occurrences``) and in how many records (``records``).

    Columns out: field, term, occurrences, records. ``weight`` is added per row (default 1, null counts 0).
    ``delivery`` names columns that identify a row: rows equal in them (redelivered ones) count once.

    One shuffle brings equal (field, term, record) together, which spreads a term with a third of all rows over its
    records. Each worker then fills burst tries, one per route, and only their compact subtrees travel; subtrees of one
    route meet on one worker and are merged. Routes are prefixes as long as needed for each to stay small.
    Null terms are left out; a null record adds to occurrences but is no record; the empty text is a term. Texts of any
    length are kept whole. Empty input gives an empty result; other columns are ignored.
    """
    src = rows.select(
        (field if field is not None else F.lit("")).alias("field"),
        F.col(term).alias("term"),
        F.col(record).cast("string").alias("record"),
        F.coalesce((weight if weight is not None else F.lit(1)).cast("bigint"), F.lit(0)).alias("w"),
        (F.xxhash64(*delivery) if delivery else F.lit(0)).alias("delivery"),
    ).where(F.col("term").isNotNull())
    burst = src.sparkSession.sparkContext.broadcast(burst_prefixes(src.select("field", "term")))
    near = src.repartition("field", "term", "record")
    if delivery:
        near = near.dropDuplicates(["field", "term", "record", "delivery"])
    pairs = near.groupBy("field", "term", "record").agg(F.sum("w").alias("w")).withColumn("seen", F.col("record").isNotNull().cast("int")).drop("record")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries: dict[str, dict[str, BurstTrie]] = {}
        known: dict[tuple[str, str], BurstTrie] = {}

        def give() -> Iterator[pd.DataFrame]:
            for f, by in tries.items():
                for p, trie in by.items():
                    rows = [(t[len(p) :], o, r) for t, o, r in trie.items()]
                    for lo in range(0, len(rows), CHUNK):
                        s, o, r = map(list, zip(*rows[lo : lo + CHUNK]))
                        yield pd.DataFrame({"field": [f], "route": [p], "suffixes": [s], "occ": [o], "rec": [r]})

        held = 0
        for pdf in batches:
            sums = pdf.groupby(["field", "term"], sort=False, dropna=False).agg(w=("w", "sum"), seen=("seen", "sum"))
            for (f, t), o, r in zip(sums.index, sums["w"].tolist(), sums["seen"].tolist()):
                trie = known.get((f, t))
                if trie is None:
                    p = route(t, burst.value.get(f, ()))
                    trie = known[f, t] = tries.setdefault(f, {}).setdefault(p, BurstTrie())
                    held += 1
                trie.add(t, o, r)
            if held > 1_000_000:  # memory stays bounded; a term may then travel more than once
                yield from give()
                tries, known, held = {}, {}, 0
        yield from give()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, trie = None, BurstTrie()

        def give() -> Iterator[pd.DataFrame]:
            rows = [(at[0], at[1] + t, o, r) for t, o, r in trie.items()] if at else []
            for lo in range(0, len(rows), 50_000):
                yield pd.DataFrame(rows[lo : lo + 50_000], columns=["field", "term", "occurrences", "records"])

        for pdf in batches:
            for f, p, suffixes, occ, rec in pdf.itertuples(index=False):
                if (f, p) != at:
                    yield from give()
                    at, trie = (f, p), BurstTrie()
                for s, o, r in zip(suffixes, occ.tolist(), rec.tolist()):
                    trie.add(s, o, r)
        yield from give()

    subtrees = pairs.mapInPandas(fill, "field string, route string, suffixes array<string>, occ array<bigint>, rec array<bigint>")
    # A route's subtrees stand together, so a worker holds one merged trie at a time
    met = subtrees.repartition("field", "route").sortWithinPartitions("field", "route")
    return met.mapInPandas(merge, "field string, term string, occurrences bigint, records bigint")


def mark_terms(counted: DataFrame, records: int | Column, rare: int, common_permille: int | Column) -> DataFrame:
    """Add ``mark``: 'rare' for terms in at most ``rare`` records, else 'common' from that share of all records, else null.
    The number of all records and the share may be columns, where fields differ in them."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") * 1000 >= common_permille * records, "common")
    return counted.withColumn("mark", mark)
