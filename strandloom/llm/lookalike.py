"""One form for texts that look the same: decomposition, look-alike letters, ordered marks, recomposition."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut

#: Letters of other scripts (or of phonetic alphabets) and the Latin letters they look like in upright type. No
#: two letters of a script stand for the same one, so that nothing is merged within a script (tests/llm holds this).
LOOKALIKES = {
    # Cyrillic
    "а": "a", "Ь": "b", "с": "c", "ԁ": "d", "е": "e", "ԍ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I",
    "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y",
    # Greek
    "α": "a", "ϲ": "c", "ι": "i", "ϳ": "j", "κ": "k", "η": "n", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "ω": "w", "χ": "x",
    "γ": "y", "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    # Armenian
    "ց": "g", "հ": "h", "յ": "j", "ո": "n", "օ": "o", "զ": "q", "ս": "u", "Լ": "L", "Օ": "O", "Տ": "S", "Ս": "U",
    # Coptic
    "ⲥ": "c", "ⲓ": "i", "ⲟ": "o", "ⲣ": "p", "Ⲃ": "B", "Ⲥ": "C", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O",
    "Ⲣ": "P", "Ⲧ": "T", "Ⲭ": "X", "Ⲩ": "Y", "Ⲍ": "Z",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R",
    "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M",
    "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # phonetic
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v",
}

#: Kinds of compatibility decomposition that are other forms of the same letters.
FORMS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Marks without a shape of their own beside the format characters: grapheme joiner, variation selectors, fillers.
SHAPELESS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)}


def is_invisible(cp: int) -> bool:
    return cp in SHAPELESS or 0xE0000 <= cp < 0xE1000 or unicodedata.category(chr(cp)) == "Cf"


def expand(cp: int) -> list[int]:
    """What a code point becomes: nothing if invisible, a blank for any kind of space, else its parts, look-alikes as Latin."""
    ch = chr(cp)
    if ch == "\r" or is_invisible(cp):  # a carriage return shows nothing beside its line feed
        return []
    if unicodedata.category(ch) == "Zs":
        return [0x20]
    parts = unicodedata.decomposition(ch).split()
    if 0xAC00 <= cp < 0xD7A4:
        return [cp]  # a syllable block is the composed form already
    if parts and parts[0].startswith("<"):
        ligature = parts[0] == "<compat>" and "LIGATURE" in unicodedata.name(ch, "")
        if parts[0] not in FORMS and not ligature:
            parts = []
        parts = parts[1:]
    if parts:
        return [x for p in parts for x in expand(int(p, 16))]
    return [ord(LOOKALIKES.get(ch, ch))]


class _Table:
    """Grows with the distinct code points met; looked up by binary search, as a join of positions with a small table."""

    def __init__(self) -> None:
        self.parts: dict[int, list[int]] = {}
        self.orders: dict[int, int] = {}
        self.pairs: dict[int, int] = {}

    def expansions(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of the distinct code points: count, offset into the flat parts, and the flat parts."""
        rows = [self.parts.get(c) if c in self.parts else self.parts.setdefault(c, expand(c)) for c in cps.tolist()]
        n = np.array([len(r) for r in rows], np.int64)
        return n, np.concatenate([[0], np.cumsum(n)[:-1]]), np.array([x for r in rows for x in r], np.uint32)

    def order(self, cps: np.ndarray) -> np.ndarray:
        return np.array([self.orders.get(c) if c in self.orders else self.orders.setdefault(c, unicodedata.combining(chr(c))) for c in cps.tolist()], np.uint8)

    def compose(self, pairs: np.ndarray) -> np.ndarray:
        """Composed code points of (starter, mark) pairs, 0 where there is none."""
        out = []
        for p in pairs.tolist():
            if p not in self.pairs:
                both = chr(p >> 32) + chr(p & 0xFFFFFFFF)
                one = unicodedata.normalize("NFC", both)
                self.pairs[p] = ord(one) if len(one) == 1 and one != both else 0
            out.append(self.pairs[p])
        return np.array(out, np.uint32)


def _join_syllables(new: np.ndarray, gone: np.ndarray, starts: np.ndarray) -> None:
    """Conjoining letters that follow one another become syllable blocks, by their numbers."""
    v = np.flatnonzero((new >= 0x1161) & (new < 0x1176))
    v = v[(v > 0) & ~np.isin(v, starts)]
    v = v[(new[v - 1] >= 0x1100) & (new[v - 1] < 0x1113)]
    new[v - 1] = 0xAC00 + ((new[v - 1] - 0x1100) * 21 + new[v] - 0x1161) * 28
    gone[v] = True
    t = np.flatnonzero((new >= 0x11A8) & (new < 0x11C3))
    t = t[(t > 0) & ~np.isin(t, starts)]
    before = t - 1 - gone[t - 1]
    block = new[before].astype(np.int64) - 0xAC00
    ok = (block >= 0) & (block < 11172) & (block % 28 == 0)
    new[before[ok]] += new[t[ok]] - 0x11A7
    gone[t[ok]] = True


def uniform(texts: list[str], table: _Table | None = None) -> list[str]:
    """The one form of each text."""
    table = table or _Table()
    out = list(texts)
    todo = [i for i, t in enumerate(texts) if not t.isascii() or "\r" in t]
    if not todo:
        return out
    sizes = np.array([len(texts[i]) for i in todo], np.int64)
    # positioned code points: document by run length, position by order
    cp = np.frombuffer("".join(texts[i] for i in todo).encode("utf-32-le", "surrogatepass"), np.uint32)
    active = np.flatnonzero((cp > 126) | (cp == 13))
    kinds, at = np.unique(cp[active], return_inverse=True)
    n, offset, flat = table.expansions(kinds)
    counts = np.ones(len(cp), np.int64)
    counts[active] = n[at]
    ends = np.cumsum(counts)
    doc_ends = np.concatenate([[0], ends])[np.cumsum(sizes)]
    new = np.repeat(cp, counts)
    first = ends - counts
    for k in range(int(n.max(initial=0))):
        has = active[n[at] > k]
        new[first[has] + k] = flat[offset[at[n[at] > k]] + k]
    gone = np.zeros(len(new), bool)
    starts = np.concatenate([[0], doc_ends[:-1]])
    _join_syllables(new, gone, starts)
    # marks: order by class within each run, then join with the starter before
    high = np.flatnonzero(new > 126)
    kinds, at = np.unique(new[high], return_inverse=True)
    classes = table.order(kinds)[at]
    marks = high[classes > 0]
    cls = classes[classes > 0]
    if len(marks):
        breaks = np.r_[True, np.diff(marks) != 1] | np.isin(marks, starts)
        run = np.cumsum(breaks) - 1
        order = np.lexsort((np.arange(len(marks)), cls, run))
        new[marks] = new[marks[order]]
        cls = cls[order]
        head = marks[breaks]
        length = np.diff(np.append(np.flatnonzero(breaks), len(marks)))
        lead = np.flatnonzero(breaks)
        starter = head - 1
        able = ~np.isin(head, starts)  # a run at the start of a text has no starter
        blocked = np.zeros(len(head), np.int64)  # class of the last mark left standing
        for k in range(int(length.max())):
            live = np.flatnonzero(able & (length > k))
            if not len(live):
                break
            pos, c = head[live] + k, cls[lead[live] + k]
            free = blocked[live] < c
            pairs = (new[starter[live]].astype(np.int64) << 32) | new[pos]
            distinct, back = np.unique(pairs, return_inverse=True)
            joined = table.compose(distinct)[back]
            ok = free & (joined > 0)
            new[starter[live[ok]]] = joined[ok]
            gone[pos[ok]] = True
            blocked[live[~ok]] = c[~ok]
    kept = ~gone
    left = np.concatenate([[0], np.cumsum(kept)])[doc_ends]
    text = new[kept].tobytes().decode("utf-32-le", "surrogatepass")
    begin = 0
    for i, end in zip(todo, left.tolist()):
        out[i] = text[begin:end]
        begin = end
    return out


def uniform_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, text and ``form``: every text in its one form (null stays null, the empty text empty).

    Texts are taken apart into positioned code points as arrays of an Arrow batch, where the mappings are joined to them
    (README states what a row per character costs instead). No shuffle. Whole texts of any length are worked on, batch by
    batch. Other columns are dropped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _Table()
        for pdf in batches:
            texts = pdf["text"].tolist()
            given = [i for i, t in enumerate(texts) if isinstance(t, str)]
            forms: list[str | None] = [None] * len(texts)
            lo = 0
            while lo < len(given):  # about four million characters at a time
                hi, size = lo, 0
                while hi < len(given) and (hi == lo or size < 1 << 22):
                    size += len(texts[given[hi]])
                    hi += 1
                for i, f in zip(given[lo:hi], uniform([texts[i] for i in given[lo:hi]], table)):
                    forms[i] = f
                lo = hi
            pdf["form"] = forms
            yield pdf

    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    return src.mapInPandas(run, f"key {kind}, text string, form string")


def representatives(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The same groups without all their pairs, linear in the documents: key, ``variant`` (the least key with the same text)
    and ``form_rep`` (the least key with the same form), for documents whose form has several texts as stored."""
    shapes = uniform_texts(docs, key, text).where("key is not null and text is not null")
    digest = lambda c: F.unhex(F.sha2(c, 256))
    shapes = cut(shapes.select("key", digest("text").alias("stored"), digest("form").alias("form")))
    kinds = shapes.groupBy("form", "stored").agg(F.min("key").alias("variant"))
    forms = kinds.groupBy("form").agg(F.min("variant").alias("form_rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return shapes.join(forms, "form").join(kinds, ["form", "stored"]).select("key", "variant", "form_rep")


def same_looking(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (``a`` < ``b``) of keys whose texts differ as stored and are equal in their one form.

    Texts leave the workers as two digests. Stored variants of a form are paired first, one row for each; their documents
    are joined on afterwards, so exact copies never meet each other. Null keys or texts give no pair.
    """
    shapes = uniform_texts(docs, key, text).where("key is not null and text is not null")
    digest = lambda c: F.unhex(F.sha2(c, 256))
    shapes = cut(shapes.select("key", digest("text").alias("stored"), digest("form").alias("form")))  # read three times below
    variants = shapes.groupBy("form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("form")
    members = shapes.join(variants, "form", "left_semi")
    kinds = members.select("form", "stored").distinct()
    pairs = kinds.select("form", F.col("stored").alias("s1")).join(kinds.select("form", F.col("stored").alias("s2")), "form").where("s1 < s2")
    one = members.select(F.col("stored").alias("s1"), F.col("key").alias("k1"))
    two = members.select(F.col("stored").alias("s2"), F.col("key").alias("k2"))
    both = pairs.join(one, "s1").join(two, "s2").where("k1 <> k2")
    return both.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).distinct()
