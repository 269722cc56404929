"""Filling containers of fixed capacity with texts, by a configuration linear program over the lengths."""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import cut, small_side

#: Folder of the public tokenizer's vocabulary.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are tokenized in pieces of about this many characters, cut after white space, so that a huge one needs no more time per character.
PIECE = 1 << 16

#: Pricing steps of one round of the linear program, and how fast prices fall as a length is covered.
STEPS, FALL = 80, 2.0
#: Extra worth of a text as long as the capacity, and lengths offered to one pricing step: half of them the dearest per
#: token, half spread from the shortest to the longest.
RISE, OFFERED = 0.2, 64
#: Part of the tokens that may be left to best fit, and how full a container of the program must be, one after the other
#: as rounds find no fuller ones.
REST, GATES = 0.01, (0.999, 0.99, 0.97, 0.9, 0.0)
#: Parts of a group of texts of one length that are numbered apart.
SALTS = 64


def count_tokens(docs: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns key and n_tokens of every text (0 for null and empty ones)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(os.path.join(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def count(t: str) -> int:
            n, lo = 0, 0
            while lo < len(t):
                hi = lo + PIECE
                while 0 < hi - lo and hi < len(t) and not (t[hi - 1].isalnum() and t[hi] == " ") and hi < lo + 2 * PIECE:
                    hi += 1
                n += len(encode(t[lo:hi]))
                lo = hi
            return n

        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "n_tokens": [count(t) if isinstance(t, str) else 0 for t in pdf["text"]]})

    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return src.mapInPandas(run, f"key {src.schema['key'].dataType.simpleString()}, n_tokens bigint")


def price_configuration(lengths: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length make the dearest content of one container; knapsack by dynamic programming.

    A length that fits several times is offered in bundles of 1, 2, 4 and so on.
    """
    which, bundle = [], []
    for i, (n, m) in enumerate(zip(lengths.tolist(), most.tolist())):
        k, m = 1, min(m, capacity // n)
        while m > 0:
            which.append(i)
            bundle.append(min(k, m))
            m -= bundle[-1]
            k *= 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(which), capacity + 1), bool)
    for j, (i, b) in enumerate(zip(which, bundle)):
        w = int(lengths[i]) * b
        with_it = best[: capacity + 1 - w] + prices[i] * b
        np.greater(with_it, best[w:] + 1e-12, out=taken[j, w:])
        np.maximum(best[w:], with_it, out=best[w:])
    out = np.zeros(len(lengths), np.int64)
    room = int(np.argmax(best))
    for j in range(len(which) - 1, -1, -1):
        if taken[j, room]:
            out[which[j]] += bundle[j]
            room -= int(lengths[which[j]]) * bundle[j]
    return out


def _offer(at: np.ndarray, worth: np.ndarray) -> np.ndarray:
    if len(at) <= OFFERED:
        return at
    spread = at[np.linspace(0, len(at) - 1, OFFERED // 2).astype(int)]
    return np.union1d(spread, at[np.argpartition(-worth[at], OFFERED // 2)[: OFFERED // 2]])


def _fractional(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations with the fractional number of containers each, by multiplicative weights.

    A length's price starts at its share of the capacity, where every full container is worth the same, and falls with
    the part of it covered; so the next configuration draws on what is behind.
    """
    if not len(lengths):
        return []
    open_ = left.astype(float)
    step = max(1.0, float((lengths * left).sum()) / capacity / STEPS)
    out = []
    for _ in range(STEPS):
        covered = 1 - open_ / np.maximum(left, 1)
        # long texts are the hard ones; a slight rise with the length places them while short ones are there to fill up
        worth = (1 + RISE * lengths / capacity) * np.exp(-FALL * (covered - covered.mean()))
        at = np.flatnonzero(open_ >= 1)
        at = _offer(at, worth)
        q = np.zeros(len(lengths), np.int64)
        q[at] = price_configuration(lengths[at], (worth * lengths / capacity)[at], np.floor(open_[at] + 1e-9).astype(np.int64), capacity)
        if not q.any():
            break
        used = q > 0
        x = min(step, float((open_[used] / q[used]).min()))
        open_[used] -= x * q[used]
        out.append((q, x))
    return out


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Configurations (how many of each length) with how many containers are filled so, and how many of those the program
    made. Covers the histogram exactly.

    The linear program is solved, rounded to whole containers, and solved again for what is left, until less than REST of
    the tokens is; containers that are not nearly full wait for later rounds, where they may be filled better. Best fit,
    longest first, places the rest. Time and memory depend on the capacity, not on the number of texts.
    """
    lengths = np.array(sorted(n for n, c in histogram.items() if c and n < capacity), np.int64)
    left = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    out: list[tuple[dict[int, int], int]] = []
    if histogram.get(capacity):
        out.append(({capacity: 1}, histogram[capacity]))
    total, gate = int((lengths * left).sum()), 0
    while gate < len(GATES) and (lengths * left).sum() > max(REST * total, capacity):
        at = np.flatnonzero(left)
        done = 0
        for q, x in sorted(_fractional(lengths[at], left[at], capacity), key=lambda c: -c[1]):
            used = q > 0
            m = min(max(1, int(x + 0.5)), int((left[at][used] // q[used]).min()))
            if m and (q * lengths[at]).sum() >= GATES[gate] * capacity:
                left[at] -= m * q
                out.append(({int(lengths[at[i]]): int(q[i]) for i in np.flatnonzero(used)}, m))
                done += m * int((q * lengths[at]).sum())
        if done < 0.2 * REST * total:
            gate += 1
    return out + _place(lengths, left, capacity), sum(m for _, m in out)


def dual_bound(histogram: dict[int, int], capacity: int) -> int:
    """Fewest containers that any packing needs, by feasible prices of the program's dual: no content of one container is
    worth more than 1, so the worth of all texts is a bound. Prices tried: shares of the capacity; 1 for more than half of
    it; and those in between for thirds."""
    whole = histogram.get(capacity, 0)
    rest = {n: c for n, c in histogram.items() if 0 < n < capacity}
    area = -(-sum(n * c for n, c in rest.items()) // capacity)
    halves = sum(c * (2 if 2 * n > capacity else 1 if 2 * n == capacity else 0) for n, c in rest.items())
    # more than 2/3: 1, less than 1/3: 0, between: a half
    thirds = sum(c * (2 if 3 * n > 2 * capacity else 1 if 3 * n >= capacity + 1 else 0) for n, c in rest.items())
    return whole + max(area, -(-halves // 2), -(-thirds // 2))


def _place(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, for whole groups of containers with the same content at once."""
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []  # those in by_room, ascending

    def keep(box: dict[int, int], copies: int, room: int) -> None:
        if copies:
            if room not in by_room:
                by_room[room] = []
                bisect.insort(rooms, room)
            by_room[room].append((box, copies))

    for n, c in zip(lengths[::-1].tolist(), left[::-1].tolist()):
        while c:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                q = min(capacity // n, c)
                box, room, copies = {}, capacity, c // q
            else:
                room = rooms[i]
                box, copies = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[i]
                q = min(room // n, c)
            m = min(copies, c // q)
            keep(box, copies - m, room)
            keep(box | {n: box.get(n, 0) + q}, m, room - n * q)
            c -= m * q
    return [group for groups in by_room.values() for group in groups]


def pack(sizes: DataFrame, capacity: int, key: str = "key", size: str = "n_tokens") -> DataFrame:
    """Columns key, part, n_tokens, container, by_program: every text in a container, only those beyond the capacity split;
    and whether the linear program made the container or best fit did.

    A text longer than the capacity gives full parts and one rest. Texts are numbered within their length (in SALTS
    parts, so that a length shared by a third of all texts is spread), and the plan says which numbers of a length go
    where. The driver sees the histogram of lengths and the plan, both bounded by the capacity. Empty and null
    texts take no space and lie in container 0. Repeated rows are packed each; empty input gives an empty result.
    """
    spark = sizes.sparkSession
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    pieces = sizes.select(F.col(key).alias("key"), n.alias("n")).select(
        "key", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1))).alias("part")
    )
    pieces = pieces.select("key", "part", F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).alias("n_tokens"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("key", "part"), F.lit(SALTS)))
    counts = salted.where("n_tokens > 0").groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("n_tokens").agg(F.sum("n")).collect()}
    lookup: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    first = 0
    groups, by_program = plan(histogram, capacity)
    for config, copies in groups:
        for length, q in config.items():
            lookup.setdefault(length, []).append((given.get(length, 0), q, first))
            given[length] = given.get(length, 0) + copies * q
        first += copies
    shared = spark.sparkContext.broadcast({k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in lookup.items()})
    offsets = counts.select(
        "n_tokens", "salt", (F.sum("n").over(Window.partitionBy("n_tokens").orderBy("salt")) - F.col("n")).alias("offset")
    )
    number = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("key", "part")) - 1
    numbered = salted.withColumn("number", number).join(offsets, ["n_tokens", "salt"], "left")
    numbered = numbered.select("key", "part", "n_tokens", (F.col("number") + F.coalesce(F.col("offset"), F.lit(0))).cast("bigint").alias("number"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            container = np.zeros(len(pdf), np.int64)
            numbers = pdf["number"].to_numpy(np.int64)
            for length, at in pdf.groupby("n_tokens").indices.items():
                if length:
                    begins, q, firsts = shared.value[int(length)]
                    i = np.searchsorted(begins, numbers[at], side="right") - 1
                    container[at] = firsts[i] + (numbers[at] - begins[i]) // q[i]
            yield pd.DataFrame({"key": pdf["key"], "part": pdf["part"], "n_tokens": pdf["n_tokens"], "container": container, "by_program": container < by_program})

    kind = numbered.schema["key"].dataType.simpleString()
    return numbered.mapInPandas(place, f"key {kind}, part int, n_tokens bigint, container bigint, by_program boolean")


def pack_texts(docs: DataFrame, kinds: DataFrame, key: str, text: str, folder: str = TOKENIZERS) -> DataFrame:
    """Pack all texts for every (kind, capacity) of ``kinds``; they are tokenized once, into a table in the shared folder."""
    sizes = cut(count_tokens(docs, key, text, folder))
    wanted = kinds.select("kind", "capacity").where("capacity > 0").distinct()
    out = None
    for (capacity,) in sorted(wanted.select("capacity").distinct().collect()):  # kinds of one capacity share its containers
        part = pack(sizes, int(capacity)).select(F.lit(capacity).alias("capacity"), "container", "key", "part", "n_tokens", "by_program")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = sizes.select(F.lit(0).alias("capacity"), F.lit(0).cast("bigint").alias("container"), "key", F.lit(0).alias("part"), "n_tokens", F.lit(True).alias("by_program")).limit(0)
    return out.join(small_side(wanted), "capacity").select("kind", "container", "key", "part", "n_tokens", "by_program")
