"""Statistical calling of real barcodes from counts: densities, saddles, hazards and the rules that pick the cut.

Counts are reduced to levels (score, number of barcodes) first; only those come to the driver, and their number is that
of distinct counts. Everything on the driver works on these weighted levels with NumPy.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import stats

#: Score from which barcodes are considered, and percentile of the truncated Poisson that stands for real ones.
FLOOR, PERCENTILE = 2.0, 95.0
GRID, PEAK_SHARE, PEAK_GAP = 512, 0.2, 0.5
#: Bounds of the rules on what lies left of the cut.
LEFT_MOST, LEFT_BUDGET, NARROW, SIDE = 0.10, 0.20, 1.0, 5
_ROOT = math.sqrt(2 * math.pi)


def bandwidth(x: np.ndarray, w: np.ndarray) -> float:
    """Silverman's rule on weighted values (sorted): 0.9 min(sd, iqr / 1.34) n^-0.2; quartiles are order statistics."""
    n = int(w.sum())
    if n < 2:
        return 0.1
    mean = float((x * w).sum() / n)
    sd = math.sqrt(float((w * (x - mean) ** 2).sum()) / (n - 1))
    ends = np.cumsum(w)
    q1, q3 = (float(x[np.searchsorted(ends, k, side="right")]) for k in (n // 4, 3 * n // 4))
    return 0.9 * min(sd, (q3 - q1) / 1.34) * n**-0.2


def density(x: np.ndarray, w: np.ndarray, bw: float, grid: np.ndarray) -> np.ndarray:
    out = np.empty(len(grid))
    for lo in range(0, len(grid), 64):
        z = (grid[lo : lo + 64, None] - x[None]) / bw
        out[lo : lo + 64] = (np.exp(-0.5 * z * z) * w).sum(axis=1)
    return out / (w.sum() * bw * _ROOT)


def peaks(grid: np.ndarray, y: np.ndarray, share: float = PEAK_SHARE) -> np.ndarray:
    """Indexes of strict maxima of at least a share of the highest, without those near a higher one."""
    i = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] > y[2:])) + 1
    i = i[y[i] >= share * y.max(initial=0)]
    near = np.abs(grid[i][:, None] - grid[i][None]) <= PEAK_GAP
    return i[~(near & (y[i][None] > y[i][:, None])).any(axis=1)]


@dataclass
class Saddle:
    ok: bool = False
    bw: float = 0.0
    n_peaks: int = 0
    cut: float = math.nan
    final_cut: float = math.nan
    left_peak: float = math.nan
    right_peak: float = 0.0
    sole_peak: float = math.nan


def saddle_cut(x: np.ndarray, w: np.ndarray) -> Saddle:
    """Valley between the two highest peaks, moved left over its flat floor up to half the climb."""
    s = Saddle()
    if w.sum() < 10:
        return s
    s.bw = bandwidth(x, w)
    if not s.bw > 0:
        s.bw = 0.1
    grid = np.linspace(x[0], x[-1], GRID)
    y = density(x, w, s.bw, grid)
    at = peaks(grid, y)
    s.n_peaks = len(at)
    if len(at) == 1:
        s.sole_peak = float(grid[at[0]])
    if len(at) < 2:
        return s
    lo, hi = sorted(at[np.argsort(-y[at], kind="stable")[:2]].tolist())
    valley = lo + int(np.argmin(y[lo:hi]))
    s.ok = hi > lo + 1
    s.cut, s.left_peak, s.right_peak = float(grid[valley]), float(grid[lo]), float(grid[hi])
    if not s.ok:
        return s
    stop = min(0.5 * y[lo], y[valley] + 0.5 * (y[lo] - y[valley]))
    i = valley
    while i > lo + 1 and y[i - 1] <= stop and grid[i - 1] > grid[lo]:
        i -= 1
    s.final_cut = max(float(grid[lo]), float(grid[i]))
    return s


@dataclass
class Minimum:
    x: float
    hazard: float
    rank: int
    prominence: float


@dataclass
class Hazard:
    ok: bool = False
    bw: float = 0.0
    step: float = 0.0
    minima: list[Minimum] = field(default_factory=list)
    below_floor: Minimum | None = None
    at_gate: Minimum | None = None
    above_gate: Minimum | None = None


def adjusted_hazard(x: np.ndarray, w: np.ndarray, bw: float, floor: float, gate: float, upper: float = math.inf, search: float = 1.0, survivors: int = 50, least: float = 0.05) -> Hazard:
    """Prominent minima of (1 - e^-x) f / S on the upper tail, sorted by where they lie."""
    h = Hazard(bw=bw)
    if not (bw > 0 and math.isfinite(bw)) or len(x) < 2 or w.sum() < survivors:
        return h
    lo, hi = search - 4 * bw, float(x[-1]) + 4 * bw
    if not hi > lo:
        return h
    points = int(min(4096, max(512, math.ceil((hi - lo) / (bw / 12)) + 1)))
    grid = lo + np.arange(points) * ((hi - lo) / (points - 1))
    h.step = (hi - lo) / (points - 1)
    f = density(x, w, bw, grid)
    seg = 0.5 * (f[:-1] + f[1:]) * np.diff(grid)
    tail = np.append(np.cumsum(seg[::-1])[::-1], 0.0)
    if not tail[0] > 0:
        return h
    suffix = np.append(np.cumsum(w[::-1])[::-1], 0)
    rank = suffix[np.searchsorted(x, grid, side="left")]
    with np.errstate(divide="ignore", invalid="ignore"):
        z = -np.expm1(-grid) * f / tail
    z[(grid <= 0) | (tail <= 1e-15) | (rank < survivors) | ~(z >= 0)] = np.nan
    radius = max(3, math.ceil(2 * bw / h.step))
    for i in range(1, points - 1):
        if grid[i] < search or not np.isfinite(z[i - 1 : i + 2]).all() or not (z[i] <= z[i - 1] and z[i] < z[i + 1]):
            continue
        flank = min(np.nanmax(z[max(0, i - radius) : i + 1]), np.nanmax(z[i : i + radius + 1]))
        prominence = max(0.0, 1 - z[i] / flank) if flank > 0 else 0.0
        if prominence < least:
            continue
        m = Minimum(float(grid[i]), float(z[i]), int(rank[i]), float(prominence))
        h.minima.append(m)
        slot = "below_floor" if m.x < floor else "at_gate" if m.x <= gate + 0.5 * bw else "above_gate" if m.x <= upper else None
        old = getattr(h, slot) if slot else None
        if slot and (old is None or (m.hazard, -m.prominence) < (old.hazard, -old.prominence)):
            setattr(h, slot, m)
    h.ok = True
    return h


@dataclass
class AdaptiveFloor:
    ready: bool = False
    x: float = math.nan
    snapped: float = math.nan
    decision: str = "not_evaluated"


def adaptive_floor(x: np.ndarray, w: np.ndarray, bw: float, floor: float = FLOOR, search: float = 1.0, support: int = 50, gain: float = 0.01) -> AdaptiveFloor:
    """A hazard minimum between search and floor that stands at 0.8, 1 and 1.25 times the bandwidth, snapped to a level."""
    out = AdaptiveFloor()
    if not (bw > 0 and math.isfinite(bw)) or not len(x):
        return out
    runs = [adjusted_hazard(x, w, k * bw, floor, floor, floor, search, support) for k in (0.8, 1.0, 1.25)]
    inner = [[m for m in h.minima if search + 2 * h.step < m.x < floor - 2 * h.step] if h.ok else [] for h in runs]
    if not all(inner):
        out.decision = "no_interior_minimum"
        return out
    best = None
    for mid in inner[1]:
        spread, pair = min(((max(a.x, mid.x, b.x) - min(a.x, mid.x, b.x), (a, b)) for a in inner[0] for b in inner[2]), key=lambda t: t[0])
        if spread <= 0.5 * bw and (best is None or (mid.hazard, -mid.prominence, -mid.x) < best[0]):
            best = (mid.hazard, -mid.prominence, -mid.x), (pair[0], mid, pair[1])
    if best is None:
        out.decision = "no_stable_minimum"
        return out
    out.x = best[1][1].x
    if any(m.x <= search + 0.5 * h.bw for m, h in zip(best[1], runs)):
        out.decision = "boundary_minimum"
        return out
    i = int(np.searchsorted(x, out.x))
    if i == len(x) or not search < x[i] < floor:
        out.decision = "no_observed_level"
        return out
    out.snapped = float(x[i])
    before, old = int(w[int(np.searchsorted(x, search)) : i].sum()), int(w[int(np.searchsorted(x, floor)) :].sum())
    added = int(w[i:].sum()) - old
    if before < support or added < support:
        out.decision = "insufficient_side_support"
    elif added < max(50, math.ceil(gain * old)):
        out.decision = "insufficient_gain"
    else:
        out.ready, out.decision = True, "candidate_ready"
    return out


def finite_guard(universe: int, observed: int, before: int, after: int) -> str:
    """Whether widening a call from ``before`` to ``after`` barcodes of a finite list is no more than chance allows."""
    if universe == 0:
        return "invalid_universe"
    if observed > universe:
        return "invalid_observed_count"
    if before > observed:
        return "invalid_preliminary_count"
    if not before <= after <= observed:
        return "invalid_hazard_count"
    if after == before:
        return "not_an_expansion"
    return "accepted" if (after - before) * universe <= (universe - observed) * (universe - before) else "rejected"


def purity_crossing(grid: np.ndarray, real: np.ndarray, background: np.ndarray) -> float:
    """First crossing of the two weighted densities, or where they are closest."""
    d = real - background
    i = np.flatnonzero(((d[:-1] <= 0) & (d[1:] >= 0)) | ((d[:-1] >= 0) & (d[1:] <= 0)))
    if len(i):
        k = int(i[0])
        return float(grid[k] + (grid[k + 1] - grid[k]) * -d[k] / (d[k + 1] - d[k] + 1e-300))
    return float(grid[int(np.argmin(np.abs(d)))])


@dataclass
class Call:
    """Cuts on the score, and how they came about."""

    rule: str
    floor: float
    threshold: float
    rate: float
    everything: bool = False
    budget: int = 0
    band: tuple[float, float] | None = None
    guard: str = "not_evaluated"
    decision: str = "not_evaluated"


def decide(counts: np.ndarray, barcodes: np.ndarray, extractions: int, universe: int = 0) -> Call:
    """The call for a histogram: ``barcodes[i]`` barcodes were seen ``counts[i]`` times (ascending)."""
    w = barcodes.astype(np.int64)
    if not w.sum() or extractions <= 0:
        return Call("ztpois_95pct", FLOOR, FLOOR, 0.0)
    x = np.log1p(counts / extractions * 1e6)
    rate = float((counts * w).sum() / w.sum())
    pct = np.array([stats.ztp_percentile(int(c), rate) for c in counts])
    above = lambda f: (x[x >= f], w[x >= f])
    old = above(FLOOR)
    adaptive, abw = AdaptiveFloor(), 0.0
    if old[1].sum() >= 10:
        abw = bandwidth(*old)
        abw = abw if abw > 0 and math.isfinite(abw) else 0.1
        adaptive = adaptive_floor(x, w, abw)
    call = Call("af_kde_saddle", FLOOR, FLOOR, rate, decision=adaptive.decision)
    saddle, have_saddle, have, forced = Saddle(), False, False, ""
    if adaptive.ready:
        wide = saddle_cut(*above(adaptive.snapped))
        rescued = (x >= adaptive.snapped) & (x < wide.final_cut)
        if not wide.ok:
            call.decision = "no_expanded_saddle"
        elif not adaptive.snapped < wide.left_peak < wide.final_cut < wide.right_peak:
            call.decision = "invalid_hazard_saddle_order"
        elif w[rescued & (pct < PERCENTILE)].sum():
            call.decision = "rescued_background"
        else:
            call.decision, call.rule = "accepted", "adaptive_hazard_bg0"
            call.floor = call.threshold = adaptive.snapped
            saddle, have_saddle, have, forced = wide, True, True, "adaptive"
    af = above(call.floor)
    if not have and af[1].sum() >= 10:
        saddle = saddle_cut(*af)
        if saddle.ok:
            call.threshold, have, have_saddle = max(saddle.final_cut, call.floor), True, True
    if not have:
        call.rule = "ztpois_95pct"
        real = x[(x >= call.floor) & (pct >= PERCENTILE)]
        if len(real):
            best, radius = float(real.min()), 2 * saddle.bw
            sole = saddle.sole_peak
            if saddle.n_peaks == 1 and radius > 0 and sole - call.floor >= radius and 0 <= best - sole <= radius:
                call.rule, forced = "single_peak_ztpois_guard", "single"
            else:
                call.threshold = best
    first_floor, first_cut = call.floor, call.threshold
    if af[1].sum() >= 10 and saddle.bw > 0:
        upper = saddle.right_peak if saddle.ok else saddle.sole_peak if math.isfinite(saddle.sole_peak) else float(af[0][-1])
        hz = adjusted_hazard(x, w, saddle.bw, first_floor, first_cut, upper)
        pick = None
        if hz.at_gate and hz.at_gate.x < first_cut:
            pick = hz.at_gate
        elif hz.below_floor and hz.below_floor.x < first_cut:
            gap = first_floor - hz.below_floor.x
            stable = adaptive.ready and abs(hz.below_floor.x - adaptive.x) <= 0.5 * abw
            if stable or 0 <= gap <= 0.5 * hz.bw:
                pick = hz.below_floor
        if pick and have_saddle and saddle.ok:
            call.guard = finite_guard(universe, int(w.sum()), int(w[x >= first_cut].sum()), int(w[x >= pick.x].sum()))
            if call.guard == "rejected":
                pick = None
        if pick:
            call.rule, call.floor, call.threshold, forced = "guarded_upper_tail_hazard_minimum", pick.x, pick.x, "hazard"
            af = above(call.floor)
    lr, bg = (((x >= call.floor) & m) for m in (pct >= PERCENTILE, pct < PERCENTILE))
    crossing = math.nan
    if af[1].sum() >= 10 and w[lr].sum() >= 10 and w[bg].sum() >= 10:
        bw = bandwidth(x[lr], w[lr])
        bw = bw if bw > 0 else 0.1
        grid = np.linspace(af[0][0], af[0][-1], GRID)
        share = w[lr].sum() / (w[lr].sum() + w[bg].sum())
        crossing = purity_crossing(grid, share * density(x[lr], w[lr], bw, grid), (1 - share) * density(x[bg], w[bg], bw, grid))
        if forced or crossing > saddle.right_peak:
            crossing = math.nan
        elif not have_saddle:
            call.threshold = max(crossing, call.floor, call.threshold)
    if have_saddle and math.isfinite(crossing):
        call.band = min(saddle.final_cut, crossing), max(saddle.final_cut, crossing)
    inside = x >= call.floor
    left, right = inside & (x < call.threshold), inside & (x >= call.threshold)
    total, n_left, n_right = int(w[inside].sum()), int(w[left].sum()), int(w[right].sum())
    share = n_left / total if total else 1.0
    span = lambda m: float(x[m].max() - x[m].min()) if m.any() else 0.0
    narrow = n_left >= SIDE and n_right >= SIDE and span(left) <= NARROW and span(right) <= NARROW
    full = float(x[right].max() - x[left].min()) if left.any() and right.any() else 0.0
    call.everything = forced != "hazard" and (forced in ("single", "adaptive") or (total >= 10 and (share <= LEFT_MOST or narrow or 0 < full <= 2 * NARROW)))
    if forced != "hazard" and total >= 10 and not call.everything and LEFT_MOST < share <= LEFT_BUDGET:
        call.budget = min(int(LEFT_MOST * total), n_left)
    return call


def call_barcodes(counts: DataFrame, extractions: int | None = None, universe: int = 0) -> tuple[DataFrame, Call]:
    """Counts (barcode, n) to one row per barcode with score, percentile, flags and annotation, and the call behind them.

    ``extractions`` are the reads with a barcode, on the reference list or not (default: the sum of n); ``universe`` is
    the size of that list. Null counts and counts below one are left out.
    """
    counts = counts.where("n > 0 and barcode is not null").select("barcode", F.col("n").cast("bigint").alias("count"))
    levels = sorted((int(r[0]), int(r[1])) for r in counts.groupBy("count").agg(F.count(F.lit(1))).collect())
    values, times = (np.array(v, np.int64) for v in zip(*levels)) if levels else (np.zeros(0, np.int64),) * 2
    total = extractions if extractions is not None else int((values * times).sum())
    call = decide(values, times, total, universe)
    ncpm = F.col("count") / F.lit(float(max(total, 1))) * 1e6
    out = counts.withColumn("ncpm", ncpm).withColumn("log1p_ncpm", F.log1p("ncpm")).withColumn("__rate", F.lit(call.rate))
    out = out.withColumn("ztpois_percentile", stats.zero_truncated_percentile("count", "__rate")).drop("__rate")
    score = F.col("log1p_ncpm")
    out = out.withColumn("above_floor", score >= call.floor).withColumn("over_threshold", score >= call.threshold)
    rescued = F.lit(False)
    if call.budget:
        # counts above the level at which the budget ends are all in; at that level the first by name
        open_ = [(c, t) for c, t in levels[::-1] if call.floor <= math.log1p(c / total * 1e6) < call.threshold]
        left, edge = call.budget, None
        for c, t in open_:
            if t > left:
                edge = c
                break
            left -= t
        ties = out.where(F.col("above_floor") & ~F.col("over_threshold") & (F.col("count") == F.lit(edge))).orderBy("barcode").limit(left).select("barcode", F.lit(True).alias("__in"))
        out = out.join(ties, "barcode", "left")
        rescued = F.col("above_floor") & ~F.col("over_threshold") & ((F.col("count") > F.lit(edge if edge is not None else -1)) | F.coalesce("__in", F.lit(False)))
    final = F.col("above_floor") if call.everything else F.col("over_threshold") | rescued
    out = out.withColumn("final_barcode", final)
    if call.everything:
        note = F.when(F.col("final_barcode"), "high_confidence").otherwise("")
    else:
        band = F.col("above_floor") & score.between(*call.band) & (score < call.band[1]) if call.band else F.lit(False)
        note = F.when(F.col("over_threshold") & F.col("above_floor"), "high_confidence").when(rescued | band, "high_sensitivity").otherwise("low_confidence")
    out = out.withColumn("final_bc_annotation", note)
    return out.drop("__in"), call


def selected(calls: DataFrame, selection: str = "high_specificity") -> DataFrame:
    """Called barcodes: the final ones, or all above the floor."""
    if selection not in ("high_specificity", "above_floor"):
        raise ValueError("selection must be high_specificity or above_floor")
    return calls.where("final_barcode" if selection == "high_specificity" else "above_floor").select("barcode")
