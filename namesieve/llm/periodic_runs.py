"""Periodic runs of words, by enumeration of maximal pairs.

Two equal stretches of a text whose left neighbours differ and whose right neighbours differ are a maximal pair. If
they lie ``d`` words apart and are ``l >= (EXPONENT - 1) * d`` long, together they are a run: ``d + l`` words with period
``d`` that no neighbouring word extends, so nothing is left to be extended. Every run is met in this way, once for each
multiple of its smallest period that fits; of pairs with the same stretch the smallest distance is the period.

The suffixes of the texts of a slice are sorted by doubling, with numpy; only suffixes that share their first words
with another one of the same text take part after the first rounds. Neighbouring suffixes' common prefixes make the
LCP-interval tree, which is climbed bottom-up. A node keeps the places of its suffixes in order, cut into class lists:
stretches of neighbouring places with the same left word. When two children meet, each place of the smaller one is
compared with the class lists of the larger one within reach (``l / (EXPONENT - 1)`` words), and lists of its own left
word are skipped whole. Places nearer than half of their common prefix are a period apart, and all but the outermost of
them have the same neighbours, so what is enumerated is bounded by the runs, not by the pairs of places. Intervals
whose places are too far apart for any run are left out before.

A text is one row and is searched by one task, some dozen bytes a word and doubling; texts of a batch are searched in
slices of some megabytes. Words are told apart by themselves, not by hashes.

Defined results: a null, empty or blank text has no words and no runs, and its collapsed text is empty; a row with a
null id is searched like any other; repeated rows give repeated results; an empty table gives an empty table; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least words of a run, and least length in periods.
WORDS = 24
EXPONENT = 3
#: Bytes of text searched at a time (or one text).
_SLICE = 2_000_000


def suffix_levels(words: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order, text by text, and for 1, 2, 4, ... words a number for each stretch of so many words.

    Two places have the same number exactly when the stretches that begin there are equal and end within one text.
    """
    n = len(words)
    ends = np.repeat(stops, np.diff(stops, prepend=0))
    key = ends * (int(words.max()) + 1) + words
    suffixes = np.argsort(key, kind="stable")
    key = key[suffixes]
    head = np.r_[True, key[1:] != key[:-1]]
    slot = np.flatnonzero(head)[np.cumsum(head) - 1]
    rank = np.full(n + 1, -1)  # one place past the end, unlike all others
    rank[suffixes] = slot
    levels = [(1, rank.copy())]
    tied = _tied(slot)
    places, slot = suffixes[tied], slot[tied]
    width = 1
    while len(places):
        after = places + width
        key = np.where(after < ends[places], rank[np.minimum(after, n)] + 1, 0)
        order = np.lexsort((key, slot))
        places, key, slot = places[order], key[order], slot[order]
        old = np.r_[True, slot[1:] != slot[:-1]]
        at = np.arange(len(places))
        mine = slot + at - at[old][np.cumsum(old) - 1]
        suffixes[mine] = places
        head = old | np.r_[True, key[1:] != key[:-1]]
        slot = mine[head][np.cumsum(head) - 1]
        rank[places] = slot
        width *= 2
        tied = _tied(slot)
        places, slot = places[tied], slot[tied]
        levels.append((width, rank.copy()))
    return suffixes, levels


def _tied(slot: np.ndarray) -> np.ndarray:
    same = slot[1:] == slot[:-1]
    return np.r_[False, same] | np.r_[same, False]


def common_prefixes(levels: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``i`` and ``j`` have in common."""
    found = np.zeros(len(i), np.int64)
    for width, rank in reversed(levels):
        same = rank[i + found] == rank[j + found]
        found[same] += width
    return found


class Places:
    """The places of a node in order, and where their class lists begin."""

    __slots__ = ("places", "starts")

    def __init__(self, place: int):
        self.places = [place]
        self.starts = [place]

    def near(self, place: int, reach: int, left: list[int]) -> Iterator[int]:
        """Places within reach whose left word is another one."""
        places, starts, own = self.places, self.starts, left[place]
        i = bisect_left(places, place)
        j, k = i - 1, bisect_left(starts, place) - 1
        while j >= 0 and place - places[j] <= reach:
            first = bisect_left(places, starts[k], 0, j + 1)
            if left[places[j]] != own:
                nearest = max(first, bisect_left(places, place - reach, 0, j + 1))
                yield from places[nearest : j + 1]
            j, k = first - 1, k - 1
        j = i
        k = bisect_right(starts, places[j]) if j < len(places) else 0
        while j < len(places) and places[j] - place <= reach:
            after = bisect_left(places, starts[k], j) if k < len(starts) else len(places)
            if left[places[j]] != own:
                yield from places[j : min(after, bisect_right(places, place + reach, j))]
            j, k = after, k + 1

    def add(self, place: int, left: list[int]) -> None:
        places, own = self.places, left[place]
        i = bisect_left(places, place)
        before = left[places[i - 1]] if i else None
        after = left[places[i]] if i < len(places) else None
        if before != own:
            insort(self.starts, place)
            if after == own:
                del self.starts[bisect_left(self.starts, places[i])]
        elif after is not None and after != own and after == before:
            insort(self.starts, places[i])
        if before is not None and before == after and before != own:
            insort(self.starts, places[i])
        places.insert(i, place)


def _climb(places: list[int], shared: list[int], left: list[int], found: dict, words: int, exponent: int) -> None:
    """All runs of suffixes in order; ``shared[t]`` is the common prefix of suffix t and the one before."""

    def met(a: Places, b: Places, length: int) -> Places:
        if len(a.places) < len(b.places):
            a, b = b, a
        reach = length // (exponent - 1)
        for p in b.places:
            for q in a.near(p, reach, left):
                first, distance = min(p, q), abs(p - q)
                if distance + length >= words:
                    stretch = (first, distance + length)
                    found[stretch] = min(distance, found.get(stretch, distance))
        for p in b.places:
            a.add(p, left)
        return a

    open_: list[tuple[int, Places]] = []
    last = Places(places[0])
    for place, length in zip(places[1:], shared[1:]):
        while open_ and open_[-1][0] > length:
            above, node = open_.pop()
            last = met(node, last, above)
        if open_ and open_[-1][0] == length:
            open_[-1] = (length, met(open_[-1][1], last, length))
        else:
            open_.append((length, last))
        last = Places(place)
    while open_:
        above, node = open_.pop()
        last = met(node, last, above)


def runs_of(words: np.ndarray, stops: np.ndarray, least: int = WORDS, exponent: int = EXPONENT) -> dict[tuple[int, int], int]:
    """The smallest period of each run, by its first word and its length, over texts of numbered words laid end to end."""
    found: dict[tuple[int, int], int] = {}
    if not len(words):
        return found
    suffixes, levels = suffix_levels(words, stops)
    # d <= l / (e - 1) and d + l >= least: no shorter prefix is part of a run.
    prefix = -(-least * (exponent - 1) // exponent)
    wide = [level for level in levels if level[0] <= prefix][-1]
    if wide[0] * 2 <= prefix:  # the sorting was over before: no stretch of that length occurs twice
        return found
    slot = wide[1][suffixes]
    tied = _tied(slot)
    suffixes, slot = suffixes[tied], slot[tied]
    if not len(suffixes):
        return found
    head = np.r_[True, slot[1:] != slot[:-1]]
    shared = np.zeros(len(suffixes), np.int64)
    at = np.flatnonzero(~head)
    shared[at] = common_prefixes(levels, suffixes[at - 1], suffixes[at])
    # What shares too few words is cut off, and so is every interval whose places are too far apart.
    cut = shared < prefix
    group = np.cumsum(cut) - 1
    by_place = np.lexsort((suffixes, group))
    gap = np.diff(suffixes[by_place], prepend=0)
    gap[np.r_[True, group[1:] != group[:-1]]] = len(words)
    begin = np.flatnonzero(cut)
    near = np.minimum.reduceat(gap, begin) * (exponent - 1) <= np.maximum.reduceat(shared, begin)
    if not near.any():
        return found
    first = np.r_[0, stops[:-1]]
    left = np.r_[-1, words[:-1]]
    left[first[first < len(left)]] = -1
    left = left.tolist()
    for start, stop in zip(begin[near].tolist(), np.r_[begin[1:], len(suffixes)][near].tolist()):
        _climb(suffixes[start:stop].tolist(), shared[start:stop].tolist(), left, found, least, exponent)
    return found


def _searched(texts: list[bytes | None], least: int, exponent: int) -> Iterator[tuple[int, list, bytes]]:
    """Per text its number of words, its runs by start and period, and the text without their repetitions."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    split = [(t or b"").split() for t in texts]
    words = np.fromiter((ids[w] for ws in split for w in ws), np.int64)
    stops = np.cumsum([len(ws) for ws in split])
    found = sorted((start, period, length) for (start, length), period in runs_of(words, stops, least, exponent).items())
    at = begin = 0
    for ws, stop in zip(split, stops.tolist()):
        runs, kept, done = [], [], 0
        while at < len(found) and found[at][0] < stop:
            start, period, length = found[at]
            runs.append({"start": start - begin, "length": length, "period": period})
            at += 1
        for a, b in sorted((r["start"] + r["period"], r["start"] + r["length"]) for r in runs):
            if a > done:
                kept += ws[done:a]
            done = max(done, b)
        yield len(ws), runs, b" ".join(kept + ws[done:] if done else ws)
        begin = stop


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _search(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start = size = 0
            for i, text in enumerate(texts):
                size += len(text or b"")
                if size < _SLICE and i + 1 < len(texts):
                    continue
                n, runs, collapsed = zip(*_searched(texts[start : i + 1], least, exponent))
                columns = [pa.array(n, pa.int64()), pa.array(runs, _RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())]
                rows = batch.column(0).slice(start, i + 1 - start)
                yield pa.RecordBatch.from_arrays([rows, *columns], ["id", "n_words", "runs", "collapsed"])
                start, size = i + 1, 0

    return run


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, exponent: int = EXPONENT
) -> DataFrame:
    """Per row ``id``, ``n_words``, ``runs`` (start, length and period in words, by start and period) and ``collapsed``.

    ``collapsed`` is the text's words, joined by one space, without those that some run holds after its first period.
    ``exponent`` is a whole number of at least 2.
    """
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    id_type = given.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return given.mapInArrow(_search(words, exponent), schema)
