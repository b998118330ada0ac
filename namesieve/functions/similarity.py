"""Token-sort similarity: exact score, and signatures that rule pairs out without losing any.

For token-sorted strings ``x`` and ``y`` of lengths ``n`` and ``m`` the score is
``200 * LCS(x, y) / (n + m)``. A pair at or above threshold ``t`` has ``LCS >= t (n + m) / 200``,
so at most ``n - LCS`` characters are deleted from ``x`` and ``m - LCS`` inserted. Everything below
follows from that:

* lengths: ``200 min(n, m) >= t (n + m)``;
* characters: bags of characters, kept as bit sets, differ in at most ``n + m - 2 LCS`` bits;
* bigrams: a deletion removes at most two distinct bigrams of ``x`` and an insertion one, so ``y``
  has all but ``2 (n - LCS) + (m - LCS)`` of them. Sort them in one fixed order, and any two
  strings that reach the threshold share one of the first few ("prefix") bigrams;
* edit distance: Levenshtein distance is never larger than ``n + m - 2 LCS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from namesieve.functions.text import _col, let, words

MAX_PATTERN = 62  # longest pattern whose bit vector fits one 64-bit word with room for the carry
MAX_TEXT = 128
SEPARATOR = "\x01"


def token_sort_key(c) -> Column:
    """Lower case, tokens sorted and joined by one space. Null stays null."""
    return F.array_join(F.sort_array(words(F.lower(_col(c)))), " ")


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda ch: ch != "")


def _lcs_words(shorter: list[str], longer: list[str]) -> np.ndarray:
    """LCS lengths for a batch of pairs, all pairs advanced one text character at a time.

    ``v`` has a zero bit for every pattern position the best alignment has used so far.
    """
    one = np.uint64(1)
    x, y = np.array(shorter, dtype=str), np.array(longer, dtype=str)
    x, y = x.view(np.uint32).reshape(len(x), -1), y.view(np.uint32).reshape(len(y), -1)
    text_lengths = np.fromiter(map(len, longer), dtype=np.int64)
    full = (one << np.fromiter(map(len, shorter), dtype=np.uint64)) - one
    bits = one << np.arange(x.shape[1], dtype=np.uint64)
    v = full.copy()
    for j in range(y.shape[1]):
        at = ((x == y[:, j : j + 1]) * bits).sum(axis=1, dtype=np.uint64) & full
        at[j >= text_lengths] = 0
        used = v & at
        v = ((v + used) | (v - used)) & full
    return np.bitwise_count(full & ~v)


def _lcs_big(x: str, y: str) -> int:
    """The same recurrence on big integers, for the rare long strings."""
    at: dict[str, int] = {}
    for i, ch in enumerate(x):
        at[ch] = at.get(ch, 0) | (1 << i)
    full = v = (1 << len(x)) - 1
    for ch in y:
        used = v & at.get(ch, 0)
        v = ((v + used) | (v - used)) & full
    return (full & ~v).bit_count()


def _lcs_series(x: pd.Series, y: pd.Series) -> pd.Series:
    out: list[int | None] = [None] * len(x)
    batch = []
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        if a is None or b is None:
            continue
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        if not a:
            out[i] = 0
        elif len(a) <= MAX_PATTERN and len(b) <= MAX_TEXT:
            batch.append((i, a, b))
        else:
            out[i] = _lcs_big(a, b)
    if batch:
        places, shorter, longer = zip(*batch, strict=True)
        for i, n in zip(places, _lcs_words(list(shorter), list(longer)).tolist(), strict=True):
            out[i] = n
    return pd.Series(out, dtype="Int64")


# Interpreted higher-order functions can express the recurrence too, but cost some 300 microseconds
# a pair against about 2 for the Arrow batches here (100,000 pairs: 3.8 s against 0.4 s).
lcs_length = F.pandas_udf(_lcs_series, LongType())
# Marked nondeterministic where a filter follows: otherwise the optimizer runs it for both.
lcs_length_once = F.pandas_udf(_lcs_series, LongType()).asNondeterministic()


def score_from_lcs(lcs: Column, n: Column, m: Column) -> Column:
    """Similarity 0-100. Two blank strings are equal."""
    return F.when(n + m == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs / (n + m))


def key_score(x: Column, y: Column) -> Column:
    """Score of two ``token_sort_key`` columns."""
    return score_from_lcs(lcs_length(x, y), F.length(x), F.length(y))


def name_similarity(a, b) -> Column:
    """Token-sort ratio of two names; 0 when either is null or empty."""
    a, b = _col(a), _col(b)
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(missing, F.lit(0.0)).otherwise(key_score(token_sort_key(a), token_sort_key(b)))


def min_lcs(n: Column, m: Column, threshold: float) -> Column:
    """Smallest LCS that reaches the threshold."""
    return F.ceil((n + m) * F.lit(float(threshold)) / 200.0 - 1e-9)


def max_distance(n: Column, m: Column, threshold: float) -> Column:
    """Largest number of insertions and deletions that still reaches the threshold."""
    return (n + m - 2 * min_lcs(n, m, threshold)).cast("int")


def bigrams(key: Column) -> Column:
    """Distinct bigrams of a string; empty for fewer than two characters."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substr(key, i, F.lit(2)))
    return F.coalesce(F.when(F.length(key) >= 2, F.array_distinct(pairs)), F.array().cast("array<string>"))


def bigram_budget(n: Column, threshold: float) -> Column:
    """How many distinct bigrams of a string may be missing in any partner at the threshold.

    The bound is linear in the partner's length, so its maximum is at one end of the allowed range.
    """
    r = threshold / (200.0 - threshold)
    return F.floor(n * max(2 - 2 * r, 1 / r - 1) + 1e-9)


def join_keys(key: Column, grams: Column, threshold: float, common: list[str]) -> Column:
    """Prefix bigrams, rarest first, as join keys. ``grams`` are the bigrams of ``key``.

    ``common`` lists the most frequent bigrams, commonest first; all others count as rarer. Any list
    keeps results exact, a good one keeps the keys selective. Strings with too few distinct bigrams
    for the bound (very short or repetitive ones, all of them at low thresholds) also get each of
    their characters as a key: two strings with a positive score share a character. Blank strings
    get one key of their own.
    """
    ranks = F.lit("".join(SEPARATOR + g for g in common) if common else SEPARATOR)
    count = F.size(grams)
    top = 3 * len(common) + 10

    def ranked(gram: Column) -> Column:
        place = F.call_function("instr", ranks, F.concat(F.lit(SEPARATOR), gram))
        order = F.when(place == 0, 0).otherwise(F.lit(top) - place)
        return F.concat(F.lpad(order.cast("string"), 5, "0"), gram)

    n = F.length(key)
    budget = bigram_budget(n, threshold)
    prefix = F.slice(F.sort_array(F.transform(grams, ranked)), F.lit(1), (budget + 1).cast("int"))
    weak = count - budget < 1
    keys = F.when(weak, F.concat(prefix, F.array_distinct(_chars(key)))).otherwise(prefix)
    blank = F.array(F.lit(""))
    return F.coalesce(F.when(n == 0, blank).otherwise(keys), blank)


def bag_slots(key: Column) -> Column:
    """A number from 0 to 255 for every (character, occurrence) of a string.

    Up to nine occurrences of each letter have numbers of their own; anything beyond may share one,
    which can only make two bags look more alike.
    """
    return let(
        F.sort_array(_chars(key)),
        lambda ordered: F.transform(
            ordered,
            lambda ch, i: F.pmod(F.ascii(ch) * 9 + (i + 1 - F.array_position(ordered, ch)), F.lit(256)).cast("int"),
        ),
    )


def char_masks(slots: Column) -> list[Column]:
    """The numbers of :func:`bag_slots` as 256 bits in four integers."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def word(w: int) -> Column:
        def add(acc: Column, slot: Column) -> Column:
            here = slot.between(64 * w, 64 * w + 63)
            return F.when(here, acc.bitwiseOR(F.call_function("shiftleft", one, slot - 64 * w))).otherwise(acc)

        return F.coalesce(F.aggregate(slots, zero, add), zero)

    return [word(w) for w in range(4)]


def masks_differ(left: list[Column], right: list[Column]) -> Column:
    """Number of bits in which two bags differ: a lower bound on insertions plus deletions."""
    bits = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(left, right, strict=True)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def _signature(name: str) -> bytes:
    """256 bits for the bag of characters, 256 for the set of bigrams; what shares a bit only looks more alike."""
    seen: dict[str, int] = {}
    bag = grams = 0
    for ch in name:
        seen[ch] = seen.get(ch, 0) + 1
        bag |= 1 << (ord(ch) * 9 + seen[ch]) % 256
    for a, b in zip(name, name[1:]):
        grams |= 1 << (ord(a) * 31 + ord(b)) % 251
    return bag.to_bytes(32, "little") + grams.to_bytes(32, "little")


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names with their signatures."""
    for batch in batches:
        signed = [_signature(name) for name in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.binary())], ["name_key", "signature"])


#: Names of a block that are held against all others of their tile at a time, and pairs that are scored at a time.
_BLOCK = 128
_SCORED = 50_000


#: Different characters up to which the places of every character in every name of a tile are kept, and characters of a
#: text after which pairs that cannot reach the threshold any more are given up.
_ALPHABET = 512
_STEP = 12


class _Tile:
    """The names of a tile, with the places of every character in each of the shorter ones, as bits."""

    def __init__(self, names: np.ndarray, n: np.ndarray):
        self.n, self.names = n, names
        letters = {ch: i for i, ch in enumerate(sorted(set().union(*names)))}
        self.blank = len(letters)  # stands behind the end of a name and is nowhere
        self.short = (n <= MAX_PATTERN) & (len(letters) <= _ALPHABET)
        # Only texts about as long as a short name are held against one.
        width = min(int(n.max(initial=0)), MAX_TEXT)
        self.held = n <= width
        self.codes = np.full((width, len(names)), self.blank, np.int64)
        self.places = np.zeros((len(names), self.blank + 1 if self.short.any() else 0), np.uint64)
        if self.short.any():
            for k in np.flatnonzero(self.held).tolist():
                of_name = np.fromiter((letters[ch] for ch in names[k]), np.int64, n[k])
                self.codes[: n[k], k] = of_name
                if self.short[k]:
                    np.bitwise_or.at(self.places[k], of_name, np.uint64(1) << np.arange(n[k], dtype=np.uint64))

    def lcs(self, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
        """LCS lengths of pairs as far as they are ``least`` or more, else some smaller number or -1."""
        n = self.n
        p, q = np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i)
        out = np.full(len(p), -1, np.int64)
        fast = self.short[p] & self.held[q]
        slow = np.flatnonzero(~fast)
        if len(slow):
            out[slow] = _lcs_series(pd.Series(self.names[p[slow]]), pd.Series(self.names[q[slow]])).to_numpy(np.int64)
        at = np.flatnonzero(fast)
        p, q, least = p[at], q[at], least[at]
        row, places = p * self.places.shape[1], self.places.ravel()
        full = (np.uint64(1) << n[p].astype(np.uint64)) - np.uint64(1)
        v = full.copy()
        for k in range(int(n[q].max(initial=0))):
            used = v & places[row + self.codes[k][q]]
            v = ((v + used) | (v - used)) & full
            if k % _STEP == _STEP - 1:
                alive = np.bitwise_count(full & ~v) + np.maximum(n[q] - k - 1, 0) >= least
                at, q, least, row, full, v = (x[alive] for x in (at, q, least, row, full, v))
        out[at] = np.bitwise_count(full & ~v)
        return out


def _scored_tile(names: np.ndarray, bits: np.ndarray, asks: np.ndarray, answers: np.ndarray, threshold: float):
    """Similar pairs (smaller name, larger name, score) of those that ask and those that answer; of equal ones each pair once."""
    n = np.fromiter(map(len, names), np.int64, len(names))
    total = np.arange(2 * n.max(initial=0) + 1)
    least = np.ceil(total * threshold / 200 - 1e-9).astype(np.int64)
    distance = total - 2 * least
    same = asks is answers
    asks, answers = (x[np.argsort(n[x], kind="stable")] for x in (asks, answers))
    ratio = threshold / (200 - threshold)
    held: list[np.ndarray] = []
    tile = _Tile(names, n)

    def scored(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(i), _SCORED):
            x, y = i[k : k + _SCORED], j[k : k + _SCORED]
            both = n[x] + n[y]
            score = 200.0 * tile.lcs(x, y, least[both]) / both
            keep = score >= threshold - 1e-9
            pairs = [sorted(p) for p in zip(names[x[keep]], names[y[keep]], strict=True)]
            columns = [pa.array([p[c] for p in pairs], pa.string()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score[keep])], ["l_name_key", "r_name_key", "similarity"])

    for start in range(0, len(asks), _BLOCK):
        a = asks[start : start + _BLOCK]
        low = start if same else np.searchsorted(n[answers], n[a[0]] * ratio - 1e-6)
        b = answers[low : np.searchsorted(n[answers], n[a[-1]] / ratio + 1e-6, "right")]
        allowed = distance[n[a][:, None] + n[b]]
        fit = abs(n[a][:, None] - n[b]) <= allowed
        differ = np.zeros(fit.shape, np.uint16)
        for w in range(4):
            differ += np.bitwise_count(bits[a, w][:, None] ^ bits[b, w])
        fit &= differ <= allowed
        if same:
            fit &= np.arange(len(b)) > np.arange(len(a))[:, None]
        x, y = np.nonzero(fit)
        i, j = a[x], b[y]
        # A deletion takes two bigrams at most, an insertion one.
        lost = n[i] + n[j] - 2 * least[n[i] + n[j]]
        missing = [np.bitwise_count(bits[p, 4:] & ~bits[q, 4:]).sum(axis=1) for p, q in ((i, j), (j, i))]
        near = (missing[0] <= lost + n[i] - least[n[i] + n[j]]) & (missing[1] <= lost + n[j] - least[n[i] + n[j]])
        held.append(np.array([i[near], j[near]]))
        if sum(h.shape[1] for h in held) >= _SCORED:
            yield from scored(*np.concatenate(held, axis=1))
            held = []
    if held:
        yield from scored(*np.concatenate(held, axis=1))


def similar_in_tiles(threshold: float):
    """Of rows (row, col, part, name_key, signature) in the order of their tile, the similar pairs between its two parts."""

    def pairs(place: tuple[int, int], held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(held)
        part, names = tile.column(2).to_numpy(), np.array(tile.column(3).to_pylist(), object)
        bits = np.frombuffer(b"".join(tile.column(4).to_pylist()), np.uint64).reshape(-1, 8)
        asks = np.flatnonzero(part == place[0])
        answers = asks if place[0] == place[1] else np.flatnonzero(part == place[1])
        yield from _scored_tile(names, bits, asks, answers, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for batch in batches:
            row, col = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((row[1:] != row[:-1]) | (col[1:] != col[:-1])) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)]):
                if stop == start:
                    continue
                here = (int(row[start]), int(col[start]))
                if here != place and held:
                    yield from pairs(place, held)
                    held = []
                place = here
                held.append(batch.slice(start, stop - start))
        if held:
            yield from pairs(place, held)

    return run
