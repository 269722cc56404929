"""Held-out passages turning up in corpus documents, found with suffix arrays over the words of the dialogue."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.lookalike import LOOKALIKES, uniform

#: Words per shard, the part of the corpus that one suffix array covers.
SHARD_WORDS = 1 << 20
#: Bytes of test items that go to every worker at once; more are searched block by block.
ITEM_BYTES = 64 << 20
#: Words whose numbers of letters are packed into one number of 64 bits.
PACKED = 16

#: A cue's number and time line, and what stands for it until the descriptions are out: they don't reach over cues.
_TIMES = re.compile(r"(?:^[ \t]*\d+[ \t]*\n)?^[^\n]*-->[^\n]*$", re.M)
_CUE = "\0"
_MARKUP = re.compile(r"<[^<>\n\0]*>|\{\\[^{}\n\0]*\}|&(?:nbsp|amp|lt|gt|#\d+);|\\[Nnh]")
_SOUND = re.compile(r"\[[^\[\]\0]*\]|\([^()\0]*\)|[♪♫][^♪♫\n\0]*[♪♫]?|\*[^*\n\0]*\*|^[ \t]*WEBVTT[^\n]*$", re.M)
_LABEL = re.compile(r"^([ \t]*(?:[-–—][ \t]*)?)([^\W\d_]{2,}(?:[ \t](?:\d+|[^\W\d_]+))?)[ \t]*:(?=\s|$)", re.M)
_FOREIGN = re.compile("[\u0080-ÿŒœŠšŸŽžƒˆ˜–-›€™]{2,}")

#: Letters read for one another, each set under one letter; the pairs rn and vv are read as m and w.
MISREAD = {"c": "ce", "f": "ft", "l": "li1|", "o": "o0", "b": "bh8", "s": "s5", "g": "g9", "z": "z2"}
_FOLD = str.maketrans({x: k for k, xs in MISREAD.items() for x in xs})

_DOUBLES = str.maketrans({c.casefold(): x.casefold() for c, x in LOOKALIKES.items()} | {"в": "b", "н": "h", "т": "t", "м": "m"})

_BYTES = {ch: bytes([b]) for b in range(256) for ch in (chr(b),)}
for _b in range(0x80, 0xA0):
    try:
        _BYTES[bytes([_b]).decode("cp1252")] = bytes([_b])
    except UnicodeDecodeError:
        pass


def _redecode(m: re.Match) -> str:
    """A run of characters that are UTF-8 bytes read one by one is read again; others stay.

    What comes out must be Latin, Cyrillic, East Asian or punctuation; a soft hyphen after an accented letter looks like
    two such bytes as well, so with one in the run only the most usual letters are believed.
    """
    raw = b"".join(_BYTES.get(c, b"") for c in m[0])
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]
    most = 0x100 if "\xad" in m[0] else 0x250
    fine = all(ord(c) < most or 0x400 <= ord(c) < 0x530 or 0x2000 <= ord(c) < 0x2700 or 0x3000 <= ord(c) < 0xA000 or ord(c) >= 0xFB00 for c in text)
    return text if fine else m[0]


def mend_encoding(text: str) -> str:
    for _ in range(2):
        if text.isascii():
            return text
        new = _FOREIGN.sub(_redecode, text)
        if new == text:
            return text
        text = new
    return text


def dialogue(text: str) -> list[str]:
    """The spoken text of subtitles in one form: without cue numbers, times, mark-up, speaker labels and sound descriptions.

    In a line all in capitals a word before a colon may be a label or be spoken; such a text has a second reading that
    keeps those words.
    """
    text = _TIMES.sub(_CUE, text.replace(_CUE, " "))
    text = _SOUND.sub(" ", _MARKUP.sub(" ", text)).replace(_CUE, "")
    in_doubt = False

    def unlabel(m: re.Match) -> str:
        return m[1] if m[2].isupper() else m[0]

    def unlabel_mixed(m: re.Match) -> str:
        nonlocal in_doubt
        rest = text[m.end() : (text.find("\n", m.end()) + 1 or len(text) + 1) - 1]
        if m[2].isupper() and rest.isupper():
            in_doubt = True
            return m[0]
        return unlabel(m)

    if ":" not in text:
        return [text]
    readings = [_LABEL.sub(unlabel_mixed, text)]
    return [_LABEL.sub(unlabel, text), *readings] if in_doubt else readings


class Words(dict):
    """Word to key, the same for words that differ only in case, punctuation, accents lost or letters misread."""

    def __missing__(self, token: str) -> str:
        if len(self) > 1_000_000:
            self.clear()
        # letters of other scripts were brought to Latin ones where their case has a double; here in either case
        plain = unicodedata.normalize("NFC", token.casefold()).translate(_DOUBLES)
        # a letter with an accent is what a wrong encoding destroys: it counts neither whole nor broken
        kept = [c for c in plain if c.isalnum() and (c.isascii() or not unicodedata.name(c, "").startswith("LATIN"))]
        key = "".join(kept).replace("rn", "m").replace("vv", "w").translate(_FOLD)
        if not key and any(c.isalnum() for c in plain):
            key = "é"
        self[token] = key
        return key

    def split(self, text: str) -> list[str]:
        return list(filter(None, map(self.__getitem__, text.split())))


def pack(lengths: np.ndarray) -> np.ndarray:
    """At each place the numbers of letters of PACKED words from there on, 4 bits each (15 stands for more; 0 past the end)."""
    key = np.minimum(lengths, 15).astype(np.uint64)
    width = 1
    while width < PACKED:
        ahead = np.zeros_like(key)
        ahead[: max(0, len(key) - width)] = key[width:]
        key = (key << np.uint64(4 * width)) | ahead
        width *= 2
    return key


def suffix_array(packed: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` words at least, PACKED words to a comparison."""
    n = len(packed)
    keys = []
    for off in range(0, max(1, depth), PACKED):
        key = np.zeros_like(packed)
        key[: max(0, n - off)] = packed[off:]
        keys.append(key)
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def search(packed: np.ndarray, order: np.ndarray, heads: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of a test item (a row of packed words) the range of the suffix array that begins with its first
    ``depths`` words, by bisection."""
    n, width = len(order), heads.shape[1]
    left = np.clip(depths[:, None] - PACKED * np.arange(width), 0, PACKED).astype(np.uint64)
    masks = np.where(left > 0, ~np.uint64(0) << (np.uint64(4) * (np.uint64(PACKED) - np.maximum(left, np.uint64(1)))), np.uint64(0))
    heads = heads & masks
    padded = np.concatenate([packed, np.zeros(PACKED * width, np.uint64)])
    out = []
    for after in (False, True):
        lo, hi = np.zeros(len(heads), np.int64), np.full(len(heads), n, np.int64)
        for _ in range(n.bit_length()):
            live = lo < hi
            mid = (lo + hi) >> 1
            at = order[np.minimum(mid, n - 1)]
            less, same = np.zeros(len(heads), bool), np.ones(len(heads), bool)
            for w in range(width):
                v = padded[at + PACKED * w] & masks[:, w]
                less |= same & (v < heads[:, w])
                same &= v == heads[:, w]
            right = live & (less | (same if after else False))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(live & ~right, mid, hi)
        out.append(lo)
    return out[0], out[1]


def _alike(a: str, b: str) -> bool:
    """The same word but for one letter misread."""
    if a == b:
        return True
    if len(a) != len(b) or len(a) < 3:
        return False
    i = 0
    while a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :]


class Items:
    """The suffixes of all test items that are long enough to hold half of their item's words, packed for the search."""

    def __init__(self, items: list[tuple[object, list[str]]]):
        self.items = [(i, w) for i, w in items if w]
        needs = [(len(w) + 1) // 2 for _, w in self.items]
        self.width = max(1, -(-max(needs, default=1) // PACKED))
        rows, item, offset, depth = [], [], [], []
        for k, ((_, words), need) in enumerate(zip(self.items, needs)):
            packed = pack(np.array([len(w) for w in words], np.int64))
            packed = np.concatenate([packed, np.zeros(PACKED * self.width, np.uint64)])
            starts = np.arange(len(words) - need + 1)
            rows.append(packed[starts[:, None] + PACKED * np.arange(self.width)])
            item.append(np.full(len(starts), k))
            offset.append(starts)
            depth.append(np.full(len(starts), need))
        join = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
        self.heads = np.concatenate(rows) if rows else np.empty((0, self.width), np.uint64)
        self.item, self.offset, self.depth = join(item, np.int64), join(offset, np.int64), join(depth, np.int64)


def search_shard(ids: list, words: list[list[str]], items: Items) -> list[tuple]:
    """(doc, item, longest stretch, first word of it) for stretches of at least half an item.

    The suffix array is over the numbers of letters of the words, which a misread letter leaves alone, so a stretch of n
    words is a match of n numbers however many of its words are misread. Every suffix of every item is searched to the
    depth of half its item; what is found is then read word by word for its longest stretch.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    # a 0 ends every document, so that no match runs on into the next
    lengths = np.fromiter(chain.from_iterable(chain(map(len, w), (0,)) for w in words), np.int64, int(sizes.sum()) + len(words))
    if not len(lengths) or not len(items.heads):
        return []
    packed = pack(lengths)
    order = suffix_array(packed, int(items.depth.max()))
    lo, hi = search(packed, order, items.heads, items.depth)
    n = hi - lo
    q = np.repeat(np.arange(len(n)), n)
    pos = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
    starts = np.cumsum(sizes + 1) - sizes - 1
    doc = np.searchsorted(starts, pos, side="right") - 1
    # the numbers of 15 letters and more are alike to the array; one reading of each line of a document against an item
    lines = np.unique(np.stack([doc, items.item[q], pos - starts[doc] - items.offset[q]]), axis=1)
    best: dict[tuple, tuple[int, int]] = {}
    for d, k, shift in lines.T.tolist():
        a, (item, b) = words[d], items.items[k]
        need, run = (len(b) + 1) // 2, 0
        for o in range(max(0, -shift), min(len(b), len(a) - shift)):
            x, y = a[o + shift], b[o]
            run = run + 1 if x == y or _alike(x, y) else 0
            if run >= need and run > best.get((ids[d], item), (0, 0))[0]:
                best[ids[d], item] = (run, o + shift - run + 1)
    return [(d, item, n_, p) for (d, item), (n_, p) in best.items()]


def read_items(rows: list[tuple], words: Words) -> Items:
    """Test items as they are searched; an item whose text is empty of words is left out."""
    texts = uniform([mend_encoding(t) for _, t in rows])
    return Items([(i, words.split(t)) for (i, _), t in zip(rows, texts)])


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Documents whose dialogue repeats at least half of an item's words in one stretch.

    Columns doc_id, item_id, n_words (longest stretch) and position (its first word in the dialogue). The corpus is not
    shuffled: each worker builds suffix arrays over shards of about SHARD_WORDS words of whole documents and searches
    every suffix of every item in them; words count as the same with one letter misread. The items are read once, before
    they go to the workers; beyond ``item_bytes`` of text they go in blocks, each against the whole corpus. Null or empty
    texts and null ids hold nothing; an item without words is never found; a repeated document id or item comes out once
    per shard; other columns are ignored.
    """
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // item_bytes))
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, item_id {asked.schema['item_id'].dataType.simpleString()}, n_words int, position int"
    found = None
    for block in range(blocks):
        rows = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        shared = docs.sparkSession.sparkContext.broadcast(read_items([tuple(r) for r in rows.collect()], Words()))
        part = src.mapInPandas(_searcher(shared), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _searcher(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Words()
        ids, words, size = [], [], 0

        def result() -> pd.DataFrame:
            return pd.DataFrame(search_shard(ids, words, shared.value), columns=["doc_id", "item_id", "n_words", "position"])

        for pdf in batches:
            for i, t in zip(pdf["doc_id"].tolist(), uniform([mend_encoding(t) for t in pdf["text"]])):
                for reading in dialogue(t):
                    ids.append(i)
                    words.append(vocabulary.split(reading))
                    size += len(words[-1]) + 1
                if size >= SHARD_WORDS:
                    yield result()
                    ids, words, size = [], [], 0
        if ids:
            yield result()

    return run


def without_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The corpus without affected documents."""
    return docs.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
