"""Alignment kernels: infix edit distance, local alignment, tails. Whole batches of reads go through NumPy at once."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate

import numpy as np

#: Score of a match and costs of a mismatch, of opening and of extending a gap in local alignment.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 2, 2, 3, 2
#: Window of a tail, and how many of its bases must fit; bases of another kind it may run over.
TAIL_WINDOW, TAIL_GAP = 14, 3
TAIL_LEAST = int(TAIL_WINDOW * 0.9)
#: Bases of a piece of a long read, and pieces worked on together.
PIECE, SIDE_BY_SIDE = 2048, 64


def as_matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Reads as rows of bytes, padded with 0, and their lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    width = int(sizes.max(initial=1)) or 1
    flat = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("latin-1", "replace"), np.uint8)
    return flat.reshape(len(texts), width), sizes


@lru_cache(maxsize=256)
def _fits(pattern: str) -> list[np.ndarray]:
    """Per base of the pattern which bytes it equals: both cases, N any base, any base an N of the target not."""
    rows = []
    for c in pattern.upper():
        ok = np.zeros(256, bool)
        for x in "ACGT" if c == "N" else c:
            ok[[ord(x), ord(x.lower())]] = True
        if c != "N":
            ok[ord("x")] = True
        rows.append(ok)
    return rows


def infix_scores(pattern: str, reads: np.ndarray, wild_target: bool = False) -> np.ndarray:
    """Edit distance of the pattern to its best ending at each base, for each read (bit-parallel over the pattern).

    ``wild_target``: an N of the read equals every base.
    """
    m, n = len(pattern), len(reads)
    if reads.shape[1] > 2 * PIECE:
        # an occurrence spans at most 2 m bases: pieces with as many bases before them are worked on side by side
        pieces = -(-reads.shape[1] // PIECE)
        wide = np.zeros((n, 2 * m + pieces * PIECE), np.uint8)
        wide[:, 2 * m : 2 * m + reads.shape[1]] = reads
        parts = np.stack([wide[:, k * PIECE : (k + 1) * PIECE + 2 * m] for k in range(pieces)], axis=1).reshape(n * pieces, -1)
        found = infix_scores(pattern, parts, wild_target)[:, 2 * m :]
        return found.reshape(n, -1)[:, : reads.shape[1]]
    if m > 63:
        return _infix_wide(pattern, reads, wild_target)
    equal = np.zeros(256, np.uint64)
    for i, ok in enumerate(_fits(pattern)):
        equal[ok] |= np.uint64(1 << i)
    if wild_target:
        equal[ord("N")] = np.uint64((1 << m) - 1)
    one, top, full = np.uint64(1), np.uint64(1 << (m - 1)), np.uint64((1 << m) - 1)
    pv, mv = np.full(n, full), np.zeros(n, np.uint64)
    score = np.full(n, m, np.int16)
    out = np.empty((reads.shape[1], n), np.int16)
    for j in range(reads.shape[1]):
        eq = equal[reads[:, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += ((ph & top) != 0).astype(np.int16)
        score -= ((mh & top) != 0).astype(np.int16)
        out[j] = score
        ph <<= one
        mh <<= one
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
    return out.T


def _infix_wide(pattern: str, reads: np.ndarray, wild_target: bool) -> np.ndarray:
    """As infix_scores for patterns of any length, by rows of the distance matrix."""
    fits = _fits(pattern)
    n, width = reads.shape
    out = np.empty((width, n), np.int16)
    column = np.broadcast_to(np.arange(len(pattern) + 1, dtype=np.int16)[:, None], (len(pattern) + 1, n)).copy()
    for j in range(width):
        ch = reads[:, j]
        diag = column[0].copy()
        for i, ok in enumerate(fits):
            differs = ~ok[ch]
            if wild_target:
                differs &= ch != ord("N")
            best = np.minimum(np.minimum(column[i + 1], column[i]) + 1, diag + differs)
            diag = column[i + 1].copy()
            column[i + 1] = best
        out[j] = column[-1]
    return out.T


@lru_cache(maxsize=256)
def _backwards(pattern: str, wild_target: bool) -> list[int]:
    """Per byte the places of the reversed pattern that it equals, as bits."""
    masks = [0] * 256
    for i, ok in enumerate(_fits(pattern)[::-1]):
        for c in np.flatnonzero(ok).tolist():
            masks[c] |= 1 << i
    if wild_target:
        masks[ord("N")] = (1 << len(pattern)) - 1
    return masks


def _start_of(pattern: str, text: str, stop: int, distance: int, wild_target: bool = False) -> int:
    """First base of the match that ends at ``stop`` (0-based), the longest of equally good ones: both are read backwards
    from there, bit-parallel over the pattern."""
    if not distance:
        return stop + 1 - len(pattern)
    m = len(pattern)
    masks, full, top = _backwards(pattern, wild_target), (1 << m) - 1, 1 << (m - 1)
    back = text[max(0, stop + 1 - m - distance) : stop + 1][::-1]
    pv, mv, score = full, 0, m
    at = 0 if score == distance else -1
    for j, c in enumerate(back, 1):
        eq = masks[ord(c) & 255]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) | 1  # every base more of the text costs one
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
        if score == distance:
            at = j
    return stop - at + 1 if at >= 0 else stop


def infix_locations(pattern: str, text: str, most: int, scores: np.ndarray | None = None, wild_target: bool = False) -> tuple[int, list[tuple[int, int]]]:
    """Least distance and all 0-based (start, stop) at which it occurs; -1 and none above ``most``."""
    if not pattern or not text:
        return -1, []
    if scores is None:
        scores = infix_scores(pattern, as_matrix([text])[0], wild_target)[0]
    scores = scores[: len(text)]
    best = int(scores.min())
    if best > most:
        return -1, []
    return best, [(_start_of(pattern, text, int(j), best, wild_target), int(j)) for j in np.flatnonzero(scores == best)]


def merge_overlaps(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def local_alignment(pattern: str, text: str) -> tuple[int, int, int, str] | None:
    return local_alignments(pattern, [text])[0]


def local_alignments(pattern: str, texts: list[str]) -> list[tuple[int, int, int, str] | None]:
    """Best local alignment of the pattern in each text: score, 0-based first and last base of the text, and the operations.

    Operations as counts of = X I D S (I: base of the pattern alone, D: base of the text alone). N matches nothing. All
    texts are worked on column by column together.
    """
    p = pattern.upper()
    m = len(p)
    if not m or not texts:
        return [None] * len(texts)
    if max(map(len, texts)) > 2 * PIECE:
        # gaps cost what matches gain, so an alignment spans at most 2 m bases; pieces overlap by more
        where = [(k, lo) for k, t in enumerate(texts) for lo in range(0, max(1, len(t) - 3 * m), PIECE)]
        best: list[tuple[int, int, int, str] | None] = [None] * len(texts)
        for at in range(0, len(where), SIDE_BY_SIDE):
            some = where[at : at + SIDE_BY_SIDE]
            for (k, lo), got in zip(some, local_alignments(p, [texts[k][lo : lo + PIECE + 3 * m] for k, lo in some])):
                if got and (best[k] is None or got[0] > best[k][0]):
                    best[k] = (got[0], got[1] + lo, got[2] + lo, got[3])
        return best
    matrix, sizes = as_matrix([t.upper() for t in texts])
    gains = np.full((256, m), -MISMATCH, np.int32)
    for i, c in enumerate(p):
        if c in "ACGT":
            gains[ord(c), i] = MATCH
    n, r = matrix.shape[1], len(texts)
    h = np.zeros((n + 1, r, m + 1), np.int32)
    side = np.full((r, m + 1), -(10**6), np.int32)  # gap in the pattern (D)
    steps = np.arange(m + 1, dtype=np.int32) * GAP_EXTEND
    for j in range(1, n + 1):
        side = np.maximum(h[j - 1] - GAP_OPEN, side - GAP_EXTEND)
        row = np.zeros((r, m + 1), np.int32)
        np.maximum(h[j - 1, :, :-1] + gains[matrix[:, j - 1]], side[:, 1:], out=row[:, 1:])
        np.maximum(row, 0, out=row)
        run = np.maximum.accumulate(row + steps, axis=1)  # gap in the text (I)
        np.maximum(row[:, 1:], run[:, :-1] - steps[1:] - GAP_OPEN + GAP_EXTEND, out=row[:, 1:])
        h[j] = row
    return [_trace(p, t.upper(), h[: size + 1, k]) for k, (t, size) in enumerate(zip(texts, sizes.tolist()))]


def _trace(p: str, t: str, h: np.ndarray) -> tuple[int, int, int, str] | None:
    score = int(h.max(initial=0))
    if score <= 0:
        return None
    j, i = (int(v) for v in np.unravel_index(int(np.argmax(h)), h.shape))
    last, end_i, ops = j - 1, i, []
    while i and j and h[j, i] > 0:
        same = p[i - 1] == t[j - 1] and p[i - 1] in "ACGT"
        if h[j, i] == h[j - 1, i - 1] + (MATCH if same else -MISMATCH):
            ops.append("=" if same else "X")
            i, j = i - 1, j - 1
            continue
        for k in range(1, max(i, j) + 1):
            cost = GAP_OPEN + (k - 1) * GAP_EXTEND
            if k <= i and h[j, i] == h[j, i - k] - cost:
                ops += ["I"] * k
                i -= k
                break
            if k <= j and h[j, i] == h[j - k, i] - cost:
                ops += ["D"] * k
                j -= k
                break
        else:
            break
    text_ops = "S" * i + "".join(reversed(ops)) + "S" * (len(p) - end_i)
    return score, j, last, "".join(f"{len(g[1])}{g[2]}" for g in re.finditer(r"((.)\2*)", text_ops))


def _segments(cigar: str) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in re.findall(r"(\d+)([=XIDSM])", cigar)]


def longest_match(cigar: str) -> int:
    return max((n for n, op in _segments(cigar) if op in "=M"), default=0)


def longest_match_with_slip(cigar: str) -> int:
    """Longest run of matches that may step over one difference of up to two bases."""
    parts, best = _segments(cigar), 0
    for i, (_, op) in enumerate(parts):
        if op not in "=M":
            continue
        run, slipped = 0, False
        for n, op in parts[i:]:
            if op in "=M":
                run += n
            elif op in "IDX" and n <= 2 and not slipped:
                slipped = True
            else:
                break
            best = max(best, run)
    return best


def cigar_edits(cigar: str) -> int:
    return sum(n for n, op in _segments(cigar) if op in "XID")


def unique_place(pattern: str, text: str, most: int, region: tuple[int, int], scores: np.ndarray | None = None) -> dict | None:
    """The only place at the least distance, if it lies within the region: 1-based start and stop, distance."""
    distance, spans = infix_locations(pattern, text, most, scores)
    spans = merge_overlaps([(a + 1, b + 1) for a, b in spans])
    if len(spans) == 1 and spans[0][0] >= region[0] and spans[0][1] <= region[1]:
        return {"start": spans[0][0], "stop": spans[0][1], "distance": distance, "cigar": ""}
    return None


def accept_local(got: tuple[int, int, int, str] | None, most: int, region: tuple[int, int]) -> dict | None:
    """A local alignment as a place: it needs a run of 8 matches near the region, or one of 10 with a slip far from it, 10
    bases in all, and at most ``most`` edits."""
    if not got:
        return None
    _, a, b, cigar = got
    a, b = a + 1, b + 1
    off = max(0, region[0] - a) + max(0, b - region[1])
    run, slip = longest_match(cigar), longest_match_with_slip(cigar)
    near = off <= 100 and run >= 8 and slip >= 8
    if b - a + 1 < 10 or not (near or (off > 100 and slip >= 10)) or cigar_edits(cigar) > most:
        return None
    return {"start": a, "stop": b, "distance": cigar_edits(cigar), "cigar": cigar}


def align_static(pattern: str, text: str, most: int, region: tuple[int, int] | None = None) -> dict | None:
    """Where an adapter lies: a single place within the expected region at once, else what local alignment accepts."""
    region = region or (1, len(text))
    return unique_place(pattern, text, most, region) or accept_local(local_alignment(pattern, text), most, region)


def tail_candidates(base: str, reads: np.ndarray) -> np.ndarray:
    """Which reads have a window full enough of the base."""
    if reads.shape[1] < TAIL_WINDOW:
        return np.zeros(len(reads), bool)
    sums = np.cumsum((reads == ord(base)) | (reads == ord(base.lower())), axis=1, dtype=np.int32)
    inside = sums[:, TAIL_WINDOW - 1 :].copy()
    inside[:, 1:] -= sums[:, :-TAIL_WINDOW]
    return (inside >= TAIL_LEAST).any(axis=1)


def poly_tails(base: str, text: str) -> list[tuple[int, int, int]]:
    """Tails of one base: 1-based (start, stop, other bases of the first window)."""
    hit = [c == base for c in text.upper()]
    before = [0, *accumulate(hit)]
    out, i, n = [], 0, len(hit)
    while i + TAIL_WINDOW <= n:
        inside = before[i + TAIL_WINDOW] - before[i]
        if inside < TAIL_LEAST:
            i += 1
            continue
        last, at, gap = i + TAIL_WINDOW - 1, i + TAIL_WINDOW, 0
        while at < n and gap <= TAIL_GAP:
            if hit[at]:
                last, gap = at, 0
            else:
                gap += 1
            at += 1
        stop = last if gap > TAIL_GAP else n - 1
        out.append((i + 1, stop + 1, TAIL_WINDOW - inside))
        i = stop + 1 + TAIL_GAP
    return out


def masked_regions(pattern: str, aligned: str, cigar: str = "") -> str:
    """The aligned bases that stand at the runs of N of an adapter, joined by '-'."""
    where: dict[int, int] = {}
    if cigar:
        q = t = 0
        for n, op in _segments(cigar):
            for _ in range(n):
                if op in "=XM":
                    where[q] = t
                q += op in "=XMI"
                t += op in "=XMD"
    else:
        where = {i: i for i in range(min(len(pattern), len(aligned)))}
    runs = ["".join(aligned[where[i]] for i in range(*m.span()) if i in where and where[i] < len(aligned)) for m in re.finditer("[Nn]+", pattern)]
    return "-".join(r for r in runs if r)


def infix_pairs(short: list[str], long: list[str]) -> np.ndarray:
    """Edit distance of each short sequence (up to 63 bases) within its long one; all pairs go through one bit-parallel run.

    Only plain bases can be equal. The distance is at most the length of the short sequence.
    """
    code = np.full(256, 4, np.uint8)
    code[[65, 67, 71, 84]] = range(4)
    p, sizes = as_matrix(short)
    t, widths = as_matrix(long)
    p, t = code[p], code[t]
    n = len(short)
    equal = np.zeros((n, 5), np.uint64)
    for i in range(p.shape[1]):
        live = (i < sizes) & (p[:, i] < 4)
        equal[np.flatnonzero(live), p[live, i]] |= np.uint64(1 << i)
    full = (np.uint64(1) << sizes.astype(np.uint64)) - np.uint64(1)
    top = np.uint64(1) << (np.maximum(sizes, 1) - 1).astype(np.uint64)
    pv, mv = full.copy(), np.zeros(n, np.uint64)
    score = sizes.astype(np.int16)
    best = score.copy()
    rows = np.arange(n)
    for j in range(t.shape[1]):
        eq = equal[rows, t[:, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += ((ph & top) != 0).astype(np.int16)
        score -= ((mh & top) != 0).astype(np.int16)
        np.minimum(best, score, out=best, where=j < widths)
        ph <<= np.uint64(1)
        mh <<= np.uint64(1)
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
    return best
