"""Evaluation texts leaking into training text (problem 8).

Method: pigeonhole edit matching. A passage of ``min_words`` words with at most ``errors`` edits
must contain, untouched, one of the aligned pieces an item is cut into (a window holds at least
errors + 1 whole pieces). One automaton finds exact piece hits in each document. A hit grows to the
whole run that agrees on its diagonal; a window that leaves the run on k sides has k edits or more,
so the windows with at most ``errors`` such sides are all there is to verify. Each is compared by
Myers' bit-parallel edit distance, and an exact count of the run's words follows.

Scale: one pass over the documents, no shuffle. Word places are worked out only for documents with
a hit. Items are a stated query set; they are broadcast in blocks of ``block`` items, so their
number isn't bounded by memory.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import INVISIBLE

_DROP = re.compile(f"[{INVISIBLE}\u0300-\u036f\u3099\u309a]")
_WORD = re.compile(r"[^\W_]+")
_SPACELESS = re.compile(r"[぀-ヿ㐀-鿿]")
#: Marks of letters and punctuation that is no part of a word: without them most text is ASCII.
_BARE = re.compile(f"[{INVISIBLE}\u0300-\u036f\u3099\u309a\u2010-\u2027\u2030-\u203e\u00a1\u00a7\u00ab\u00b0\u00b7\u00bb\u00bf\u20ac]+")
_NO_WORD = bytes(b for b in range(128) if not chr(b).isalnum())
_NO_WORDS = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    """The letters and digits of stream(), without the places of words; most texts take byte operations only."""
    if not text.isascii():
        text = _BARE.sub("", unicodedata.normalize("NFKD", text))
    if text.isascii():
        return text.encode().lower().translate(None, _NO_WORD).decode()
    return _NO_WORDS.sub("", text).casefold()


def stream(text: str) -> tuple[str, list[int]]:
    """Letters and digits of a text without case and accents, and where its words begin (plus the end)."""
    if not text.isascii():
        text = _DROP.sub("", unicodedata.normalize("NFKD", text))
    words = _WORD.findall(text.casefold())
    at, n = [0], 0
    for w in words:
        n += len(w)
        at.append(n)
    return "".join(words), at


def myers(pattern: str, text: str) -> int:
    """Smallest edit distance of pattern to any part of text (bit-parallel, Myers 1999)."""
    m = len(pattern)
    if not m:
        return 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        eq[ch] = eq.get(ch, 0) | 1 << i
    pv, mv, score, best = full, 0, m, m
    for ch in text:
        e = eq.get(ch, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        best = min(best, score)
    return best


class Item:
    """An item as a stream, cut into aligned pieces. unit: word starts, or every character."""

    def __init__(self, item_id: int, text: str, min_words: int, min_chars: int, errors: int) -> None:
        self.id = item_id
        self.text, self.at = stream(text)
        self.spaceless = bool(_SPACELESS.search(text))
        self.need = min_chars if self.spaceless else min_words
        if self.spaceless:
            self.at = list(range(len(self.text) + 1))
        # the longest piece of which any window of ``need`` units holds errors + 1 whole ones
        self.size = max(1, (self.need + 1) // (errors + 2))
        self.starts = list(range(0, len(self.at) - self.size, self.size)) if len(self.at) > self.size else []

    def pieces(self) -> Iterator[tuple[str, int]]:
        for k in self.starts:
            yield self.text[self.at[k] : self.at[k + self.size]], self.at[k]


def _agree(a: str, i: int, b: str, j: int) -> int:
    """How many characters of a from i and b from j agree."""
    n, most = 0, min(len(a) - i, len(b) - j)
    step = 16
    while n < most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n += step
        step *= 2
    n = min(n, most)
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


def _run(it: Item, doc: str, bounds: list[int], i: int, j: int) -> tuple[int, int, int, int]:
    """(begin, end, first, last): the run that agrees around item position i = document position j,
    and the units of the item that stand whole in it."""
    a = it.text
    lo = 0
    while i - lo > 0 and j - lo > 0 and a[i - lo - 1] == doc[j - lo - 1]:
        lo += 1
    i0, i1, shift = i - lo, i + _agree(a, i, doc, j), j - i
    first, last = bisect_left(it.at, i0), bisect_right(it.at, i1) - 1
    if not it.spaceless:
        known = lambda p: bounds[min(bisect_left(bounds, p), len(bounds) - 1)] == p
        while first < last and not known(it.at[first] + shift):
            first += 1
        while last > first and not known(it.at[last] + shift):
            last -= 1
    return i0, i1, first, last


def _windows(it: Item, first: int, last: int, errors: int) -> Iterator[int]:
    """First units of the windows around a run of units that leave it on at most ``errors`` sides.
    Of those that leave it on one side only, the window that leaves it least decides."""
    lo, hi = max(0, last - it.need), min(first, len(it.at) - 1 - it.need)
    for k in range(lo, hi + 1):
        if (k < first) + (k + it.need > last) <= errors:
            yield k


def _verify(it: Item, doc: str, shift: int, first: int, last: int, errors: int) -> tuple[int, int, int] | None:
    """(distance, units, document position) of the best window around a run that is too short itself."""
    best = None
    for k in _windows(it, first, last, errors):
        window, start = it.text[it.at[k] : it.at[k + it.need]], it.at[k] + shift
        region = doc[max(0, start - errors) : max(0, start) + len(window) + errors]
        # what the run leaves over holds at most ``errors`` edits, so one of errors + 1 parts of it is whole
        over = [x for x in (window[: max(0, it.at[first] - it.at[k])], window[max(0, it.at[last] - it.at[k]) :]) if x]
        if not all(_part_whole(x, region, errors) for x in over):
            continue
        dist = myers(window, region)
        if dist <= errors and (best is None or dist < best[0]):
            best = (max(dist, 1), it.need, max(0, start))
    return best


def _part_whole(x: str, region: str, errors: int) -> bool:
    cuts = [len(x) * k // (errors + 1) for k in range(errors + 2)]
    return len(x) <= errors or any(x[a:b] in region for a, b in zip(cuts, cuts[1:]))


def leaks_of(text: str, items: list[Item], auto: object, errors: int) -> dict[int, tuple[int, int, int]]:
    """Place in items -> (distance, units, position) of the passages one document holds."""
    doc = letters(text)
    hits = list(auto.iter(doc))
    if not hits:
        return {}
    bounds = stream(text)[1]
    best: dict[int, tuple[int, int, int]] = {}
    seen: dict[tuple[int, int], int] = {}  # (item, diagonal) -> end of the last run looked at
    for end, (length, places) in hits:
        j = end - length + 1
        for n, i in places:
            if i < seen.get((n, j - i), -1):  # another piece of the same run
                continue
            it = items[n]
            _, i1, first, last = _run(it, doc, bounds, i, j)
            seen[n, j - i] = i1
            if last - first >= it.need:
                got = (0, last - first, it.at[first] + j - i)
            else:
                got = _verify(it, doc, j - i, first, last, errors) if errors else None
            if got and (n not in best or (got[0], -got[1]) < (best[n][0], -best[n][1])):
                best[n] = got
    return best


def find_leaks(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", min_words: int = 12, min_chars: int = 24, errors: int = 1, block: int = 20_000,
) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, distance, units, at.

    distance 0: at least min_words consecutive words (min_chars characters of an item in a script
    without spaces) stand in the document; 1..errors: a window of that size is there with so many
    edits. units: words or characters of the longest passage; at: its place in the document's
    letters. Null ids or texts and empty texts leak nothing; repeated rows give repeated results
    once per (doc_id, item_id); items shorter than the window never leak.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null and text != ''")
    found = None
    query = items.select(F.col(item_id).cast("long"), item_text).filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).distinct()
    rows = query.toLocalIterator()

    def flush(part: list[tuple[int, str]]) -> None:
        nonlocal found

        sent = documents.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame], sent: object = sent) -> Iterator[pd.DataFrame]:
            import ahocorasick

            its = [Item(k, t, min_words, min_chars, errors) for k, t in sent.value]
            where: dict[str, list[tuple[int, int]]] = {}
            for n, it in enumerate(its):
                for piece, at in it.pieces():
                    where.setdefault(piece, []).append((n, at))
            auto = ahocorasick.Automaton()
            for piece, places in where.items():
                auto.add_word(piece, (len(piece), places))
            if where:
                auto.make_automaton()
            for pdf in batches:
                out = []
                for d, t in zip(pdf["doc_id"], pdf["text"]) if where else ():
                    out += [(d, its[n].id, *v) for n, v in leaks_of(t, its, auto, errors).items()]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "distance", "units", "at"])

        part_found = docs.mapInPandas(run, "doc_id long, item_id long, distance long, units long, at long")
        found = part_found if found is None else found.unionByName(part_found)

    part: list[tuple[int, str]] = []
    for k, t in rows:
        part.append((k, t))
        if len(part) >= block:
            flush(part)
            part = []
    if part or found is None:
        flush(part)
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", (-F.col("units")).alias("u"), "at")).alias("v")).select(
        "doc_id", "item_id", "v.distance", (-F.col("v.u")).alias("units"), "v.at"
    )
