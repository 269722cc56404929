"""Mapping of freely written barcodes to the closest entry of a reference list."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMATCHED = "UNMATCHED"
#: Most edits between the bases written and an entry.
MAX_EDITS = 2
#: Largest reference list, in characters, that goes to every worker whole; a longer one is joined on deletions.
LIST_CHARS = 400_000

#: Order of the bases in the decimal two-bit code.
CODE_ORDER = "ACTG"
_COMPLEMENT = str.maketrans("ACGT", "TGCA")

_TAG = re.compile(r"^\s*[A-Za-z]{2,8}\s*(?::[A-Za-z]:|[:=])\s*")
_SUFFIX = re.compile(r"[-_.]\d{1,3}\s*$")
_WRAP = " \t\r\n\"'`()[]{}<>#*?!;,.:|"
_BREAK = re.compile(r"[\s._\-]+")
_LETTERS = re.compile(r"[ACGTUNRYKMSWBDHV]+")
_BASES = frozenset("ACGTUN")
_PARTING = frozenset(" ._-")
#: Bases in a row that are read within other words, or less where entries are as short.
RUN = 8


def revcomp(s: str) -> str:
    return s.translate(_COMPLEMENT)[::-1]


def encode(bases: str) -> int:
    n = 0
    for b in bases:
        n = n * 4 + CODE_ORDER.index(b)
    return n


def decode(n: int, length: int) -> str:
    """Bases of a decimal two-bit code, the first base in the highest bits."""
    return "".join(CODE_ORDER[n >> 2 * i & 3] for i in range(length - 1, -1, -1))


def bases_written(value: str, lengths: list[int]) -> list[str]:
    """The bases a value stands for, in every reading its notation allows; empty if it names none.

    Understood: either case, U for T, tags (CB:Z:, bc=, seq:), quotes, brackets and marks around, a numbered suffix (-1),
    groups parted by blanks, dots, dashes or underscores, the decimal two-bit code (also with a leading one bit), and
    bases within other words.
    """
    text = _TAG.sub("", value).strip(_WRAP)
    if text.isascii() and text.isdigit():
        digits = text.lstrip("0") or "0"
        if len(digits) > len(str(2 * 4 ** max(lengths, default=0))):
            return []
        n = int(digits)
        plain = [decode(n, k) for k in lengths if n < 4**k]
        return plain + [decode(n - 4**k, k) for k in lengths if 4**k <= n < 2 * 4**k]
    text = _SUFFIX.sub("", text).strip(_WRAP).upper()
    joined = _BREAK.sub("", text)
    if _LETTERS.fullmatch(joined):
        return [joined.replace("U", "T")]
    least = max(1, min(RUN, min(lengths, default=RUN) - MAX_EDITS))
    return [_BREAK.sub("", m[0]).replace("U", "T") for m in re.finditer(rf"[ACGTUN]{{{least},}}(?:[ ._-]{{1,2}}[ACGTUN]+)*", text)]


def _ends(text: str, at: int, step: int) -> bool:
    """Whether a mention's side is free: beyond the signs that part groups of bases no base follows."""
    for _ in range(3):
        if not 0 <= at < len(text):
            return True
        if text[at] not in _PARTING:
            return text[at] not in _BASES
        at += step
    return True


def _codes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-width matrix of base numbers (4: no plain base, 5: past the end) and the lengths."""
    lookup = np.full(256, 4, np.uint8)
    lookup[[65, 67, 71, 84]] = range(4)
    lookup[0] = 5
    flat = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("ascii", "replace"), np.uint8)
    return lookup[flat].reshape(len(texts), width), np.array([len(t) for t in texts], np.int16)


def _token_sets(codes: np.ndarray) -> np.ndarray:
    """The set of 3-base tokens of each row as the bits of one 64-bit word."""
    a, b, c = codes[:, :-2].astype(np.uint64), codes[:, 1:-1].astype(np.uint64), codes[:, 2:].astype(np.uint64)
    bits = np.left_shift(np.uint64(1), (a * np.uint64(16) + b * np.uint64(4) + c) & np.uint64(63))
    bits[(a > 3) | (b > 3) | (c > 3)] = 0
    return np.bitwise_or.reduce(bits, axis=1) if bits.shape[1] else np.zeros(len(codes), np.uint64)


def _edits(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Edit distance of paired rows; an ambiguous base differs from every base."""
    n, wa, wb = len(a), a.shape[1], b.shape[1]
    row = np.broadcast_to(np.arange(wb + 1, dtype=np.int16), (n, wb + 1)).copy()
    out = np.where(la == 0, lb, 0).astype(np.int16)
    at = np.arange(n)
    for i in range(1, wa + 1):
        differs = (b != a[:, i - 1 : i]) | (b > 3)
        new = np.empty_like(row)
        new[:, 0] = i
        np.minimum(row[:, 1:] + 1, row[:, :-1] + differs, out=new[:, 1:])
        for j in range(1, wb + 1):
            np.minimum(new[:, j], new[:, j - 1] + 1, out=new[:, j])
        row = new
        done = la == i
        out[done] = row[at[done], lb[done]]
    return out


class ReferenceList:
    """Entries of one class with both strands: an automaton for exact mentions, token sets for the rest."""

    def __init__(self, entries: list[str]):
        import ahocorasick

        self.entries = sorted(set(entries))
        self.lengths = sorted({len(e) for e in self.entries})
        self.forms = [(e, e) for e in self.entries] + [(revcomp(e), e) for e in self.entries]
        self.automaton = ahocorasick.Automaton()
        names = [(form, (form, entry, False)) for form, entry in self.forms]
        plain = [e for e in self.entries if set(e) <= set(CODE_ORDER)]
        # aliases: the two-bit code, plain or behind a one
        for lead in (0, 1):
            for e in sorted(plain, key=len):
                names.append((alias := str(encode(e) + lead * 4 ** len(e)), (alias, e, True)))
        for name, found in reversed(names):  # a forward form outranks the other strand of another entry, a plain code one behind a one
            self.automaton.add_word(name, found)
        self.automaton.make_automaton()
        self.width = max(self.lengths, default=0)
        self.codes, self.sizes = _codes([f for f, _ in self.forms], max(3, self.width))
        self.sets = _token_sets(self.codes)

    def mention(self, value: str) -> str | None:
        """The entry that a value mentions, embedded in whatever else it says: of all hits of the automaton the longest that
        doesn't overlap a longer one and stands free of other bases. A code must be all the value says.

        Hits with bases beside them stand at one edit or more, where another entry may be as close; such values go on to
        the token sets.
        """
        if not self.forms:
            return None
        text = _TAG.sub("", value).strip(_WRAP).upper().replace("U", "T")
        joined = _BREAK.sub("", _SUFFIX.sub("", text).strip(_WRAP))
        digits = text.isascii() and text.isdigit()
        texts = [text] if digits or not _LETTERS.fullmatch(joined) else [joined]  # parted groups of bases are one word
        for t in texts:
            taken: list[tuple[int, int]] = []
            hits = [(end + 1 - len(name), end + 1, entry, code) for end, (name, entry, code) in self.automaton.iter(t)]
            for lo, hi, entry, code in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
                if any(lo < b and a < hi for a, b in taken):
                    continue
                taken.append((lo, hi))
                if code == digits and (hi - lo == len(t) if code else self._free(t, lo, hi)):
                    return entry
        return None

    def _free(self, text: str, lo: int, hi: int) -> bool:
        """Free of other bases on both sides; in a word of bases alone, all of it."""
        return _ends(text, lo - 1, -1) and _ends(text, hi, 1) and (not _LETTERS.fullmatch(text) or hi - lo == len(text))

    def closest(self, bases: list[str], block: int = 1 << 22) -> list[tuple[int, str] | None]:
        """For each the (edits, entry) at the fewest edits, MAX_EDITS at most; ties go to the first entry in order.

        One edit touches three tokens at most, so entry and bases lack at most 3 * MAX_EDITS tokens of each other: the
        token sets lose no entry. Those left are verified by edit distance.
        """
        out: list[tuple[int, str] | None] = [None] * len(bases)
        keep = [i for i, b in enumerate(bases) if b and min(self.lengths, default=99) - MAX_EDITS <= len(b) <= self.width + MAX_EDITS]
        if not keep or not self.forms:
            return out
        codes, sizes = _codes([bases[i] for i in keep], max(3, self.width + MAX_EDITS))
        sets = _token_sets(codes)
        step = max(1, block // len(self.forms))
        for lo in range(0, len(keep), step):
            v = sets[lo : lo + step, None]
            near = np.abs(sizes[lo : lo + step, None] - self.sizes[None]) <= MAX_EDITS
            near &= np.bitwise_count(self.sets[None] & ~v) <= 3 * MAX_EDITS
            near &= np.bitwise_count(v & ~self.sets[None]) <= 3 * MAX_EDITS
            i, j = np.nonzero(near)
            d = _edits(codes[lo + i], sizes[lo + i], self.codes[j], self.sizes[j])
            for a, b, n in zip(i[d <= MAX_EDITS], j[d <= MAX_EDITS], d[d <= MAX_EDITS]):
                at, hit = keep[lo + a], (int(n), self.forms[b][1])
                if out[at] is None or hit < out[at]:
                    out[at] = hit
        return out


def map_values(values: list[str], ref: ReferenceList) -> list[str]:
    """Canonical entry or UNMATCHED for each value."""
    best: list[tuple[int, str] | None] = [None] * len(values)
    rest: dict[str, list[int]] = defaultdict(list)
    for i, value in enumerate(values):
        exact = ref.mention(value)
        if exact:
            best[i] = (0, exact)
        else:
            for r in bases_written(value, ref.lengths):
                rest[r].append(i)
    for hit, at in zip(ref.closest(list(rest)), rest.values()):
        for i in at:
            if hit and (best[i] is None or hit < best[i]):
                best[i] = hit
    return [b[1] if b else UNMATCHED for b in best]


def deletions(bases: str, most: int = MAX_EDITS) -> set[str]:
    """The bases with up to ``most`` of them left out. Two texts within that many edits share one such rest."""
    out = shell = {bases}
    for _ in range(most):
        shell = {s[:i] + s[i + 1 :] for s in shell for i in range(len(s))}
        out = out | shell
    return out


def map_to_list(values: DataFrame, entries: DataFrame, class_id: str = "class_id", value: str = "value", barcode: str = "barcode", keep: tuple[str, ...] = (), list_chars: int = LIST_CHARS) -> DataFrame:
    """Map every non-null value to the closest entry of its class: columns ``keep``, class_id, value, canonical.

    A list of up to ``list_chars`` characters (checked) goes to every worker once; then the values are never shuffled, so a
    value written in a third of all rows costs one lookup per batch. A longer list (of millions) stays where it is:
    distinct values meet it by an equi-join on what up to two deletions leave of either, which loses no pair within two
    edits; results are the same. Null values, and values of a null class or one without entries, come out UNMATCHED. Texts
    of any length are read whole. Ties go to the entry first in order. Repeated rows come out as often as they go in.
    Columns not named are dropped, so clashing names do no harm.
    """
    listed = entries.select(F.col(class_id).alias("class_id"), F.upper(barcode).alias("barcode")).where(F.col("class_id").isNotNull() & (F.length("barcode") > 0)).distinct()
    src = values.select(*keep, F.col(class_id).alias("__class"), F.col(value).alias("__value"))
    if (listed.agg(F.sum(F.length("barcode"))).first()[0] or 0) > list_chars:
        return _join_long_list(src, listed, keep)
    by_class: dict[str, list[str]] = defaultdict(list)
    for c, b in listed.collect():
        by_class[c].append(b)
    shared = values.sparkSession.sparkContext.broadcast(dict(by_class))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs = {c: ReferenceList(b) for c, b in shared.value.items()}
        known: dict[tuple[str, str], str] = {}
        for pdf in batches:
            if len(known) > 500_000:
                known.clear()
            pairs = pd.MultiIndex.from_arrays([pdf["__class"], pdf["__value"]])
            todo: dict[str, list[str]] = defaultdict(list)
            for c, v in pairs.unique():
                if c in refs and isinstance(v, str) and (c, v) not in known:
                    todo[c].append(v)
            for c, vs in todo.items():
                known.update(zip(((c, v) for v in vs), map_values(vs, refs[c])))
            pdf["canonical"] = [known.get(p, UNMATCHED) for p in pairs]
            yield pdf.rename(columns={"__class": "class_id", "__value": "value"})

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[: len(keep)])
    return src.mapInPandas(run, f"{kept}class_id string, value string, canonical string")


def _join_long_list(src: DataFrame, listed: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    lengths: dict[str, list[int]] = defaultdict(list)
    for c, n in listed.select("class_id", F.length("barcode")).distinct().orderBy("class_id", F.length("barcode")).collect():  # a few lengths a class
        lengths[c].append(n)
    lengths = dict(lengths)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for c, v in zip(pdf["class_id"].tolist(), pdf["value"].tolist()):
                for r in set(bases_written(v, lengths[c])) if c in lengths else ():
                    if r and lengths[c][0] - MAX_EDITS <= len(r) <= lengths[c][-1] + MAX_EDITS:
                        rows += [(c, v, r, k) for k in deletions(r)]
            yield pd.DataFrame(rows, columns=["class_id", "value", "bases", "rest"])

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(c, b, f, k) for c, b in zip(pdf["class_id"].tolist(), pdf["barcode"].tolist()) for f in {b, revcomp(b)} for k in deletions(f)]
            yield pd.DataFrame(rows, columns=["class_id", "barcode", "form", "rest"])

    distinct = src.select(F.col("__class").alias("class_id"), F.col("__value").alias("value")).dropna().distinct()
    asked = distinct.mapInPandas(read, "class_id string, value string, bases string, rest string")
    held = listed.mapInPandas(forms, "class_id string, barcode string, form string, rest string")
    met = asked.join(held, ["class_id", "rest"]).select("class_id", "value", "bases", "barcode", "form").distinct()
    # an ambiguous base differs from every base, from itself too
    odd = F.translate("bases", "RYKMSWBDHVN", "###########")
    near = met.withColumn("edits", F.levenshtein(odd, F.translate("form", "RYKMSWBDHVN", "@@@@@@@@@@@"), MAX_EDITS)).where("edits >= 0")
    best = near.groupBy("class_id", "value").agg(F.min(F.struct("edits", "barcode"))["barcode"].alias("canonical"))
    out = src.join(best.toDF("__class", "__value", "canonical"), ["__class", "__value"], "left")
    return out.select(*keep, F.col("__class").alias("class_id"), F.col("__value").alias("value"), F.coalesce("canonical", F.lit(UNMATCHED)).alias("canonical"))
