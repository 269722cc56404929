"""Calibration of a layout on a sample of reads, consensus of adapters, and discovery of layouts from parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import stats
from strandloom.operators import align
from strandloom.plans.layout import Layout, calibrated, compile_layout, revcomp

#: Reads of the sample; share of an adapter's length that may differ; share of differences to call two adapters alike.
SAMPLE, SLACK, ALIKE = 50_000, 0.25, 0.10


def adapters_of(layout: Layout) -> list[tuple[str, str, str]]:
    return [(e.class_id, e.seq, e.direction) for e in layout.elements if e.type == "static" and not e.terminal and not e.tail and e.seq]


def best_hits(reads: DataFrame, adapters: list[tuple[str, str, str]], slack: float = SLACK, seq: str = "seq") -> DataFrame:
    """Best place of every adapter in every read: id, direction, distance, start and stop in percent, aligned bases.

    One row per read and adapter within ``slack`` of its length; distance alone (others null) beyond.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t for t in pdf["seq"].tolist() if t]
            rows = []
            for lo in range(0, len(texts), 2048):
                part = sorted(texts[lo : lo + 2048], key=len)
                matrix, sizes = align.as_matrix(part)
                for name, pattern, direction in adapters:
                    scores = align.infix_scores(pattern, matrix, wild_target=True)
                    for k, t in enumerate(part):
                        row = scores[k, : sizes[k]]
                        best, stop = int(row.min()), int(np.argmin(row))
                        if best <= int(len(pattern) * slack):
                            start = align._start_of(pattern, t, stop, best, True)
                            rows.append((name, direction, best, 100 * start / len(t), 100 * stop / len(t), t[start : stop + 1]))
                        else:
                            rows.append((name, direction, best, None, None, None))
            yield pd.DataFrame(rows, columns=["class_id", "direction", "distance", "start_pct", "stop_pct", "aligned"])

    schema = "class_id string, direction string, distance int, start_pct double, stop_pct double, aligned string"
    return reads.select(F.col(seq).alias("seq")).mapInPandas(run, schema)


def calibration_stats(hits: DataFrame) -> DataFrame:
    """Per adapter: how often it was seen, mean and deviation of its place when exact (or, where hardly ever exact, within
    the slack), and number, mean and deviation of its distances where it is not."""
    exact = F.count_if(F.col("distance") == 0)
    share = hits.groupBy("class_id").agg((exact / F.count(F.lit(1))).alias("exact_share"))
    good = F.col("start_pct").isNotNull() & ((F.col("distance") == 0) | (F.col("exact_share") < 0.1))
    apart = F.when(~good, F.col("distance"))
    start, stop, off = (stats.mean_deviation(c) for c in (F.when(good, F.col("start_pct")), F.when(good, F.col("stop_pct")), apart))
    return hits.join(F.broadcast(share), "class_id").groupBy("class_id").agg(
        F.count_if(good).alias("seen"), start[0].alias("start_mean"), start[1].alias("start_sd"), stop[0].alias("stop_mean"), stop[1].alias("stop_sd"),
        F.count(apart).alias("n"), off[0].alias("mean"), off[1].alias("sd"),
    )


def prune_alike(layout: Layout) -> Layout:
    """Layout without reverse adapters that are nearly a forward one."""
    found = adapters_of(layout)
    alike = set()
    for name, seq, direction in found:
        if direction == "reverse":
            for _, other, d in found:
                short, long = sorted((seq, other), key=len)
                if d == "forward" and int(align.infix_scores(short, align.as_matrix([long])[0], True)[0].min()) / len(long) <= ALIKE:
                    alike.add(name)
    return Layout(tuple(e for e in layout.elements if e.class_id not in alike), layout.mode, layout.places)


def first_reads(reads: DataFrame, sample: int | None, key: str = "read_ord") -> DataFrame:
    """The ``sample`` reads of the lowest ``key``, always the same ones; all for None."""
    return reads if sample is None else reads.orderBy(key).limit(sample)


def calibrate(reads: DataFrame, layout: Layout, sample: int | None = SAMPLE) -> Layout:
    """Layout with thresholds and regions from the first ``sample`` reads by read_ord, or from all for None."""
    hits = best_hits(first_reads(reads, sample), adapters_of(layout))
    stats = {}
    for r in calibration_stats(hits).collect():
        stats[r["class_id"]] = {
            "seen": r["seen"], "aligned": (r["start_mean"] or 0.0, r["start_sd"], r["stop_mean"] or 0.0, r["stop_sd"]), "n": r["n"], "mean": r["mean"], "sd": r["sd"],
        }
    return calibrated(prune_alike(layout), stats)


def consensus(aligned: DataFrame) -> DataFrame:
    """Bases by position of aligned adapters: class_id, pos (from 1), base, n."""
    cells = aligned.where("aligned is not null").select("class_id", F.posexplode(F.filter(F.split("aligned", ""), lambda c: c != "")).alias("pos", "base"))
    return cells.groupBy("class_id", (F.col("pos") + 1).alias("pos"), "base").agg(F.count(F.lit(1)).alias("n"))


def masked_adapter(seq: str, counts: dict[int, dict[str, int]], run: int, total: int = 12) -> str:
    """The adapter with N where no base has more than half; at most ``run`` in a row and ``total`` in all."""
    out = ""
    for i, c in enumerate(seq):
        got = counts.get(i + 1, {})
        clear = max(got.values(), default=0) > 0.5 * sum(got.values()) if got else False
        tail = len(out) - len(out.rstrip("N"))
        out += c if clear or tail >= run or out.count("N") >= total else "N"
    return out


def discover(reads: DataFrame, parts: list[tuple[str, str]], sample: int | None = 25_000, support: float = 0.5, least: int = 3) -> Layout:
    """Layout of the parts that lie in the reads, in the order of their mean place, with the read between the ends.

    Parts are searched within 10 % of their length on both strands; a part is kept if at least ``support`` of the reads
    with any part, and ``least``, have it; of parts at one place (within 1 %) the best seen stays. Only the first
    ``sample`` reads by read_ord are looked at, or all for None.
    """
    both = [(n, s, "forward") for n, s in parts] + [(f"rc_{n}", revcomp(s), "reverse") for n, s in parts]
    hits = best_hits(first_reads(reads, sample), both, ALIKE).where("start_pct is not null")
    rows = hits.groupBy(F.regexp_replace("class_id", "^rc_", "").alias("id")).agg(
        F.avg(F.when(F.col("direction") == "forward", F.col("start_pct")).otherwise(100 - F.col("stop_pct"))).alias("at"), F.count(F.lit(1)).alias("n")
    )
    found = sorted((r["at"], -r["n"], r["id"]) for r in rows.collect())
    most = max((-n for _, n, _ in found), default=0)
    kept: list[tuple[float, int, str]] = []
    for at, n, name in found:
        if -n < max(least, support * most):
            continue
        if kept and at - kept[-1][0] <= 1:
            if n < kept[-1][1]:
                kept[-1] = (at, n, name)
            continue
        kept.append((at, n, name))
    if not kept:
        raise ValueError("no part is found often enough")
    seqs = dict(parts)
    blank = dict.fromkeys(("id", "seq", "expected_length", "type", "class", "whitelist", "flags"), "")
    made = [blank | {"id": n, "seq": seqs[n], "type": "static"} for _, _, n in kept]
    gaps = [b[0] - a[0] for a, b in zip(kept, kept[1:])]
    cut = int(np.argmax(gaps)) + 1 if gaps else (0 if kept[0][0] > 50 else 1)
    made.insert(cut, blank | {"id": "read", "type": "variable", "class": "read"})
    return compile_layout(made)
