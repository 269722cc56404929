"""Read layouts: reading, compiling into ordered elements of both strands, and the rules that place variable elements."""

from __future__ import annotations

import csv
import io
import math
import re
from dataclasses import asdict, dataclass, field, replace
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.dna import bind
from strandloom.functions.tags import flag_tokens

#: A static element this long is a reliable anchor; bases taken for a tail without a length.
ANCHOR, TAIL = 13, 12


def revcomp(s: str) -> str:
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def length_candidates(spec: str | None) -> list[int]:
    """Lengths of 'n' or 'a-b' (either order), those above zero; none for anything else."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", spec or "")
    if not m:
        return []
    a, b = int(m[1]), int(m[2] or m[1])
    return [n for n in range(min(a, b), max(a, b) + 1) if n > 0]


def length_range(spec: Column) -> Column:
    """Number, least and most of ``length_candidates`` as a struct n, least, most, without writing them out; nulls beyond a
    64-bit integer, 0 and nulls for a bad or null field."""
    pattern = r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$"
    return bind(spec, lambda s: bind(F.filter(F.array(F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2)), lambda x: x != ""), _range))


def _range(ends: Column) -> Column:
    """From the one or two numbers of a field, as texts; null or empty for none."""
    digits = F.transform(ends, lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    wide = F.exists(digits, lambda x: F.length(x) > 19)
    numbers = F.transform(digits, lambda x: F.when(F.length(x) <= 19, x).cast("decimal(20,0)"))
    lo, hi = F.greatest(F.array_min(numbers), F.lit(1)), F.array_max(numbers)
    known = ~wide & (hi < F.lit(str(2**63)).cast("decimal(20,0)"))
    some = known & (hi >= lo)
    none = F.coalesce(F.size(ends), F.lit(0)) < 1
    return F.struct(
        F.when(none | (known & (hi < lo)), F.lit(0).cast("bigint")).when(some, (hi - lo + 1).cast("bigint")).alias("n"),
        F.when(some, lo.cast("bigint")).alias("least"), F.when(some, hi.cast("bigint")).alias("most"),
    )


@dataclass(frozen=True)
class Ref:
    """A position beside another element: its first or last base plus an offset."""

    id: str
    at_start: bool
    offset: int
    flag: str = ""

    def __str__(self) -> str:
        text = f"{self.id}|{'start' if self.at_start else 'stop'}{self.offset:+d}"
        return f"{text}|{self.flag}" if self.flag else text

    @classmethod
    def parse(cls, text: str) -> Ref:
        m = re.fullmatch(r"([^|]+)\|(start|stop)([+-]\d+)(?:\|(.*))?", text.strip())
        if not m:
            raise ValueError(f"not a position: {text!r}")
        return cls(m[1], m[2] == "start", int(m[3]), m[4] or "")


@dataclass(frozen=True)
class Places:
    start: Ref
    stop: Ref
    start2: Ref
    stop2: Ref


@dataclass(frozen=True)
class Element:
    class_id: str
    type: str
    order: int
    direction: str
    global_class: str
    seq: str = ""
    lengths: tuple[int, ...] = ()
    whitelist: str = ""
    flags: str = ""
    one_strand: bool = False
    #: least, middle and most edits at which an adapter is still told from chance; None before calibration
    threshold: tuple[int, int, int] | None = None
    #: mean and deviation of start and stop, in percent of the read
    aligned: tuple[float, float, float, float] | None = None

    @property
    def length(self) -> int | None:
        return self.lengths[-1] if self.lengths else (0 if self.terminal else None)

    @property
    def terminal(self) -> bool:
        return self.global_class in ("start", "stop")

    @property
    def tail(self) -> bool:
        return self.global_class == "poly_tail"

    @property
    def anchor(self) -> bool:
        return self.type == "static" and not self.terminal and not self.tail and (self.length or 0) >= ANCHOR


@dataclass(frozen=True)
class Layout:
    elements: tuple[Element, ...]
    mode: str = ""
    places: dict[str, Places] = field(default_factory=dict)

    @property
    def bulk(self) -> bool:
        return "bulk" in self.mode

    def get(self, class_id: str) -> Element | None:
        return next((e for e in self.elements if e.class_id == class_id), None)

    def of(self, direction: str) -> list[Element]:
        return [e for e in self.elements if e.direction == direction]

    @property
    def structural_length(self) -> int:
        """Expected bases of one strand besides the read itself."""
        return sum(e.length or 0 for e in self.of("forward"))


def read_rows(text: str) -> tuple[str, list[dict[str, str]]]:
    """Mode and rows of a layout file; a title row and a byte-order mark are optional."""
    lines = text.lstrip("﻿").splitlines()
    mode = ""
    if lines and re.match(r"\s*\"?read layout", lines[0], re.I):
        m = re.match(r"\s*\"?read layout\s*:?\s*([^,\"]*)", lines[0], re.I)
        mode, lines = m[1].strip() if m else "", lines[1:]
    rows = [{(k or "").strip().lower(): (v or "").strip() for k, v in r.items() if isinstance(k, str)} for r in csv.DictReader(io.StringIO("\n".join(lines)))]
    if rows and {"class_id", "order"} <= rows[0].keys():
        raise ValueError("this is a compiled layout; read it with read_compiled")
    missing = {"id", "seq", "expected_length", "type", "class", "whitelist"} - (rows[0].keys() if rows else set())
    if missing:
        raise ValueError(f"layout lacks {sorted(missing)}")
    return mode, [r for r in rows if any(r.values())]


def compile_layout(rows: list[dict[str, str]], mode: str = "") -> Layout:
    """Rows in read order to elements of both strands (mode R1 or R2: of one), with terminals, and their placement rules."""
    named = [(r.get("class") or r["id"], r) for r in rows]
    times = {n: sum(m == n for m, _ in named) for n, _ in named}
    seen: dict[str, int] = {}
    forward, late = [], []
    for name, r in named:
        seen[name] = seen.get(name, 0) + 1
        where = (r.get("direction") or "forward").lower()
        seq, lengths, group = r["seq"].upper(), length_candidates(r["expected_length"]), name
        if name in ("poly_a", "poly_t"):
            lengths = lengths or [TAIL]
            seq, group = f"{name[-1].upper()}{{{lengths[-1]},}}+", "poly_tail"
        elif seq and not lengths:
            lengths = [len(seq)]
        e = Element(
            name if times[name] == 1 else f"{name}_{seen[name]}", r["type"] or "variable", 0, where.removesuffix("_only"), group, seq,
            tuple(lengths), r["whitelist"], r.get("flags", ""), where.endswith("_only"),
        )
        (late if where == "reverse_only" else forward).append(e)
    forward = [Element("seq_start", "static", 0, "forward", "start"), *forward, Element("seq_stop", "static", 0, "forward", "stop")]
    reverse = [] if "R1" in mode else [_mirrored(e) for e in forward if not e.one_strand and e.direction == "forward"]
    if reverse:
        reverse = [reverse[0], *reverse[-2:0:-1], reverse[-1]]
    elements = [replace(e, order=i + 1) for i, e in enumerate([*forward, *reverse, *([] if "R1" in mode else late)])]
    if "R2" in mode:
        elements = [e for e in elements if e.direction != "forward"]
    layout = Layout(tuple(elements), mode)
    return replace(layout, places=place_rules(layout))


def _mirrored(e: Element) -> Element:
    if e.class_id in ("poly_a", "poly_t"):
        base = "T" if e.class_id == "poly_a" else "A"
        return replace(e, class_id=f"poly_{base.lower()}", seq=f"{base}{{{e.length},}}+", direction="reverse")
    return replace(e, class_id=f"rc_{e.class_id}", seq=revcomp(e.seq), direction="reverse")


def _beside(e: Element, after: bool, gap: int, length: int, flag: str = "") -> tuple[Ref, Ref]:
    """Start and stop of something ``length`` long that lies after (or before) e, ``gap`` bases apart."""
    if after:
        return Ref(e.class_id, False, gap + 1, flag), Ref(e.class_id, False, gap + length, flag)
    return Ref(e.class_id, True, -gap - length, flag), Ref(e.class_id, True, -gap - 1, flag)


def place_rules(layout: Layout) -> dict[str, Places]:
    """For each variable element where it starts and stops, by a first and a second reference.

    What lies before the read is placed from the left, what lies after it from the right; the right side is the mirror
    image of the left, so one rule serves both.
    """
    at = {e.order: e for e in layout.elements}
    by_id = {e.class_id: e for e in layout.elements}
    places: dict[str, Places] = {}
    for direction in sorted({e.direction for e in layout.elements}):
        row = layout.of(direction)
        read = next((e for e in row if e.type == "variable" and e.global_class == "read"), None)
        if read is None:
            continue
        for e in row:
            if e.order == read.order:
                if at.get(e.order - 1):
                    places[e.class_id] = _read_places(e, at)
            elif e.type == "variable":
                got = _one_place(e, 1 if e.order < read.order else -1, at, by_id, places)
                if got:
                    places[e.class_id] = got
    return places


def _one_place(e: Element, step: int, at: dict[int, Element], by_id: dict[str, Element], places: dict[str, Places]) -> Places | None:
    left = step == 1
    back, back2 = at.get(e.order - step), at.get(e.order - 2 * step)
    front, front2 = at.get(e.order + step), at.get(e.order + 2 * step)
    if back is None:
        return None
    n = e.length or 1
    behind = lambda x, gap=0, flag="": _beside(x, left, gap, n, flag)
    ahead = lambda x, gap=0: _beside(x, not left, gap, n)
    first = behind(back)
    second: tuple[Ref, Ref] | None = None
    if back.type == "static":
        if front and front.type == "static" and not front.tail and (front.length or 0) >= ANCHOR:
            second = ahead(front)
        elif front and front.type == "variable" and front2 and front2.anchor:
            second = ahead(front2, front.length or 1)
        else:
            second = behind(back, 0, f"{'left' if left else 'right'}_terminal_linked")
    else:
        first = behind(back, 0, "var_chained")
        gap = back.length or 1
        if back2 and back2.anchor:
            second = behind(back2, gap)
        elif front and front.anchor:
            second = ahead(front)
        elif back2 and back2.terminal:
            second = behind(back2, gap)
        elif front and front.terminal:
            second = ahead(front)
        elif back.class_id in places:
            base = places[back.class_id]
            a, b = _beside(by_id[base.start.id], left, gap, n)
            second = replace(a, flag="chained_start"), Ref(base.stop.id, b.at_start, b.offset + 1, "chained_stop")
    second = second or first
    linked = back.terminal or (back.type == "variable" and back2 is not None and back2.terminal)
    if linked and second[0].id == second[1].id and by_id[second[0].id].anchor:
        first, second = second, first
    return Places(*first, *second)


def _read_places(e: Element, at: dict[int, Element]) -> Places:
    """The read lies between its neighbours, or between those one further on where a neighbour is missing."""

    def side(step: int) -> tuple[Ref, Ref] | None:
        near, far = at.get(e.order + step), at.get(e.order + 2 * step)
        if near is None:
            return None
        first = Ref(near.class_id, step == 1, -step)
        if far is None:
            return first, first
        word = "right" if step == 1 else "left"
        if near.type == "static":
            return first, Ref(far.class_id, step == 1, -step, f"{word}_truncated")
        return first, Ref(far.class_id, step == 1, -step * (1 + (near.length or 1)), f"{word}_skipped")

    start, stop = side(-1), side(1)
    stop = stop or start
    return Places(start[0], stop[0], start[1], stop[1])


def calibrated(layout: Layout, stats: dict[str, dict]) -> Layout:
    """Layout with edit thresholds and positions from calibration; adapters never seen, and strands left without one, go.

    ``stats``: per adapter aligned (mean and deviation of start and stop), seen, and of the opposite strand's best
    distances n, mean and sd.
    """
    kept = []
    for e in layout.elements:
        s = stats.get(e.class_id)
        if e.type == "static" and not e.terminal and not e.tail and s is not None:
            if not s["seen"]:
                continue
            n, mean, sd = s["n"], s["mean"], s["sd"] or 0.0
            if n < 100 or mean is None or not math.isfinite(mean) or mean < 1:
                limit = (max(1, math.ceil(0.30 * len(e.seq))),) * 3
            else:
                limit = (math.floor(mean - sd + 0.5), math.floor(mean), math.floor(mean + sd + 0.5))
            e = replace(e, threshold=limit, aligned=tuple(s["aligned"]))
        kept.append(e)
    strands = {e.direction for e in kept if e.type == "static" and not e.terminal and not e.tail}
    return replace(layout, elements=tuple(e for e in kept if e.direction in strands))


COMPILED = ["class_id", "type", "order", "direction", "global_class", "seq", "lengths", "whitelist", "flags", "one_strand"]


def write_compiled(layout: Layout) -> tuple[str, str]:
    """The compiled layout and its placement rules as two CSV texts."""
    out, pos = io.StringIO(), io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow([*COMPILED, "threshold", "aligned", "mode"])
    for e in layout.elements:
        d = asdict(e) | {"lengths": " ".join(map(str, e.lengths))}
        w.writerow([*(d[c] for c in COMPILED), " ".join(map(str, e.threshold or ())), " ".join(map(repr, e.aligned or ())), layout.mode])
    w = csv.writer(pos, lineterminator="\n")
    w.writerow(["id", "primary_start", "primary_stop", "secondary_start", "secondary_stop"])
    for k, p in layout.places.items():
        w.writerow([k, p.start, p.stop, p.start2, p.stop2])
    return out.getvalue(), pos.getvalue()


def read_compiled(elements: str, positions: str) -> Layout:
    found, mode = [], ""
    for r in csv.DictReader(io.StringIO(elements)):
        mode = r["mode"]
        found.append(
            Element(
                r["class_id"], r["type"], int(r["order"]), r["direction"], r["global_class"], r["seq"], tuple(map(int, r["lengths"].split())),
                r["whitelist"], r["flags"], r["one_strand"] == "True", tuple(map(int, r["threshold"].split())) or None,
                tuple(map(float, r["aligned"].split())) or None,
            )
        )
    places = {r["id"]: Places(*(Ref.parse(r[c]) for c in ("primary_start", "primary_stop", "secondary_start", "secondary_stop"))) for r in csv.DictReader(io.StringIO(positions))}
    return Layout(tuple(found), mode, places)


def joint_flag(flags: str) -> tuple[int, int, int] | None:
    """(group, least and most offset) of a joint_barcode flag; bare: group 0 and offsets -3 to 3; :G_O: offsets 0 to O."""
    for token in flag_tokens(flags.lower()):
        if token.startswith("joint_barcode"):
            m = re.match(r"joint_barcode:(-?\d*)(?:[^_]*)(?:_(-?\d*))?", token)
            if not m:
                return 0, -3, 3
            return (int(m[1] or 0), 0, int(m[2] or 0)) if m[2] is not None else (int(m[1] or 0), -3, 3)
    return None


@dataclass(frozen=True)
class JointGroup:
    """Barcodes of one strand that adjoin: members as they follow along the strand, allowed offsets, lengths by class."""

    group: int
    direction: str
    least: int
    most: int
    members: tuple[Element, ...]
    lengths: dict[str, tuple[int, ...]]


def joint_groups(layout: Layout) -> list[JointGroup]:
    """Runs of two and more barcodes of a strand that carry the flag with the same group number."""
    out = []
    for direction in ("forward", "reverse"):
        bcs = [e for e in layout.of(direction) if e.global_class == "barcode"]
        for flag, run in groupby(bcs, key=lambda e: joint_flag(e.flags)):
            members = tuple(run)
            if flag and len(members) > 1:
                # the reverse block lists its elements backwards; along its own strand they follow as in the forward one
                members = members[::-1] if direction == "reverse" else members
                out.append(JointGroup(*flag[:1], direction, *flag[1:], members, {e.class_id: tuple(sorted(set(e.lengths or (16,)))) for e in members}))
    return out
