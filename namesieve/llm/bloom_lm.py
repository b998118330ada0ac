"""A bigram language model in a log-frequency Bloom filter.

Counts of words and word pairs over all training texts are quantised to levels, four to a doubling, and a filter
holds the entries (n-gram, 1), ..., (n-gram, level) of each. A count is read by probing for entries until one is
missing (by galloping and bisection, as the entries of an n-gram are nested). Probabilities are a pair's count
smoothed with its word's probability, ``(c(vw) + M p(w)) / (c(v) + M)``.

Levels start at ``RESOLUTION`` of the corpus, that is at count ``floor = max(1, N * RESOLUTION)``. The filter of the words is
broadcast, so its size is bounded: at most ``1 / RESOLUTION`` words can reach the floor, since their counts add up to N.
Their exact counts are broadcast too (16 bytes each), as the base score needs them.

Pairs are not broadcast. Every text sends its different pairs to the shards of their hashes, once, with the levels of their
words; a shard adds up the counts of its pairs, holds those at the floor or above in its part of the filter and the others
as they are, and answers all texts from these: it sends back what the pairs add to each text's score. A word under the floor
goes to the shard of its own hash with the pairs it ends, so its count and theirs are exact there. The logarithms add up,

    log p(w | v) = log(M p(w)) - log(c(v) + M) + log(1 + c(vw) / (M p(w))),

so the first two terms are added where the counts of w and of v are known, be it with the text or in a shard. What one slice of
texts sends to a shard is one packed row: the pairs' hashes as they are, everything else compressed. Words are told apart
by a 64-bit hash.

Defined results: a null or empty text is one end token; a null id is hashed as the empty text, so it is held out;
repeated rows count and are scored each; without training texts every count is 0; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.llm.shared import written

RESOLUTION = 2.0**-24
LEVELS_PER_DOUBLING = 4
BITS_PER_ENTRY = 10
PROBES = 6
SHARDS = 64
#: Weight M of the word's own probability, in tokens.
PRIOR = 1500.0
#: Held-out share: the remainder of the id's CRC-32 that is not learned from.
PARTS = 10
_SLICE = 2_000_000
_GATHERED = 1_500_000
#: Shards of the pairs, and tasks that take them one by one: so many at least, and one for so many training tokens.
PAIR_SHARDS = 256
PAIR_TASKS = 32
SHARD_TOKENS = 4_000_000
#: No word holds a line break, so none has this key but by a collision.
END_KEY = np.uint64(xxhash.xxh64_intdigest(b"\n"))


def is_held_out(id_col: Column) -> Column:
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "utf-8")) % PARTS == 0


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(first * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) ^ _mixed(second + np.uint64(0xD1B54A32D192ED03))


@dataclass
class Tokens:
    """Some texts as numbers: the keys of their different tokens, all tokens in order, and where texts end."""

    keys: np.ndarray
    at: np.ndarray
    stops: np.ndarray

    def of_text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.stops)), np.diff(self.stops, prepend=0))


def tokens_of(texts: Iterable[bytes | None]) -> Tokens:
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    end = ids[b"\n"]
    flat: list[int] = []
    stops: list[int] = []
    for text in texts:
        if text:
            flat += [ids[w] for w in text.lower().split()]
        flat.append(end)
        stops.append(len(flat))
    keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), np.uint64, len(ids))
    return Tokens(keys, np.array(flat, np.int64), np.array(stops, np.int64))


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, Tokens]]:
    """Runs of rows whose texts have some megabytes together, as tokens."""
    texts = batch.column(text).to_pylist()
    start = size = 0
    for i, value in enumerate(texts):
        size += len(value or b"")
        if size >= _SLICE or i + 1 == len(texts):
            yield start, i + 1, tokens_of(texts[start : i + 1])
            start, size = i + 1, 0


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, np.concatenate(counts), len(found)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(total)], ["h", "n"])


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Counts added up within the task, as far as its memory is meant to go."""
    keys, counts, size = [], [], 0
    for k, n in parts:
        keys.append(k)
        counts.append(n)
        size += len(k)
        if size >= _GATHERED:
            yield _summed(keys, counts)
            keys, counts, size = [], [], 0
    if size:
        yield _summed(keys, counts)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts():
        for batch in batches:
            for _, _, t in _slices(batch, 0):
                yield t.keys, np.bincount(t.at, minlength=len(t.keys))

    yield from _gathered(parts())


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key is in the sorted keys; -1 if it is not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _pairs_of(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of neighbours within a text, and the place of the second."""
    inner = np.ones(len(t.at), bool)
    inner[t.stops[:-1]] = False
    inner[:1] = False
    second = np.flatnonzero(inner)
    return t.at[second - 1], t.at[second], second


def level_of(n: Column, floor: int) -> Column:
    return (F.floor(F.log2(n / floor) * LEVELS_PER_DOUBLING + 1e-9) + 1).cast("int")


def levels_of(n: np.ndarray, floor: int) -> np.ndarray:
    return np.floor(np.log2(n / floor) * LEVELS_PER_DOUBLING + 1e-9).astype(np.int64) + 1


def counts_of_levels(most: int, floor: int) -> np.ndarray:
    """The middle of the whole counts of each level; 0 for level 0."""
    edges = np.ceil(floor * 2.0 ** (np.arange(most + 1) / LEVELS_PER_DOUBLING) - 1e-6)
    return np.r_[0.0, (edges[:-1] + np.maximum(edges[1:] - 1, edges[:-1])) / 2]


@dataclass
class Filter:
    """Bits of all shards side by side; ``size`` bits a shard."""

    bits: np.ndarray
    size: int
    most: int
    floor: int
    shards: int = SHARDS

    def _spots(self, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = _mixed(keys + levels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            step = _mixed(x) | np.uint64(1)
            spots = (x[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(self.size)
        return spots.astype(np.int64)

    def add(self, keys: np.ndarray, levels: np.ndarray) -> None:
        """Put in entries 1 to ``levels``; all keys belong to this one shard."""
        each = np.repeat(keys, levels)
        level = np.arange(len(each)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
        for start in range(0, len(each), 500_000):
            spots = self._spots(each[start : start + 500_000], level[start : start + 500_000]).ravel()
            np.bitwise_or.at(self.bits, spots >> 3, (1 << (spots & 7)).astype(np.uint8))

    def _has(self, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
        shard = (keys % np.uint64(self.shards)).astype(np.int64) * self.size
        spots = self._spots(keys, levels) + shard[:, None]
        return ((self.bits[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1).all(axis=1)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: the last of its nested entries that is there."""
        low = np.zeros(len(keys), np.int64)
        high = np.full(len(keys), self.most + 1)
        step = 1
        going = np.arange(len(keys)) if self.most else np.empty(0, np.int64)
        while len(going):
            there = self._has(keys[going], np.full(len(going), step))
            low[going[there]] = step
            high[going[~there]] = step
            going = going[there]
            step = step * 2
            if step > self.most:
                break
        going = np.flatnonzero(high - low > 1)
        while len(going):
            middle = (low[going] + high[going]) // 2
            there = self._has(keys[going], middle)
            low[going[there]] = middle[there]
            high[going[~there]] = middle[~there]
            going = going[high[going] - low[going] > 1]
        return low


def _build_shards(size: int, most: int, floor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, Filter] = {}
        for batch in batches:
            keys, levels = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.int64)
            of = (keys % np.uint64(SHARDS)).astype(np.int64)
            for s in np.unique(of).tolist():
                if s not in shards:
                    shards[s] = Filter(np.zeros(size // 8, np.uint8), size, most, floor)
                shards[s].add(keys[of == s], levels[of == s])
        for s, built in shards.items():
            yield pa.RecordBatch.from_pydict({"shard": [s], "bits": [built.bits.tobytes()]})

    return run


def build_filter(counts: DataFrame, floor: int) -> Filter:
    """The filter of n-gram counts (h, n), all at the floor or above."""
    graded = counts.select("h", level_of(F.col("n"), floor).alias("level"))
    # The shard of an unsigned key; SHARDS is a power of two. A shard has room for what the fullest one holds.
    shard = F.col("h").bitwiseAND(F.lit(SHARDS - 1))
    loads = graded.groupBy(shard).agg(F.sum("level").alias("load"), F.max("level").alias("most"))
    load, most = loads.agg(F.coalesce(F.max("load"), F.lit(0)), F.coalesce(F.max("most"), F.lit(0))).first()
    size = max(64, math.ceil(load * BITS_PER_ENTRY / 64) * 64)
    dealt = graded.repartition(shard)
    built = dealt.mapInArrow(_build_shards(size, most, floor), "shard long, bits binary")
    bits = np.zeros(SHARDS * size // 8, np.uint8)
    for row in built.collect():
        bits[row.shard * size // 8 : (row.shard + 1) * size // 8] = np.frombuffer(row.bits, np.uint8)
    return Filter(bits, size, most, floor)


@dataclass
class Totals:
    """Of the training tokens: all, and different ones; and what scores are worked out with."""

    tokens: int
    types: int
    floor: int
    prior: float

    @property
    def mass(self) -> float:
        return self.tokens + 0.1 * (self.types + 1)

    def at_least(self, n: int) -> int:
        """``n``, or more for many tokens."""
        return max(n, math.ceil(self.tokens / SHARD_TOKENS))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte plane by byte plane, compressed."""
    planes = (np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, *types: str) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    raw = np.frombuffer(pa.decompress(data, n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    parts = np.split(raw, np.cumsum(sizes)[:-1] * n)
    return [np.ascontiguousarray(p.reshape(k, n).T).view(t).ravel() for p, k, t in zip(parts, sizes, types, strict=True)]


#: Rows on the way to the shards: a text (its sums so far), or n-grams of a slice (``kind`` 1: by pair, 2: by word).
_TEXT = {"id": None, "held_out": "boolean", "n_tokens": "long", "known": "double", "base": "double", "score": "double"}
_CELLS = {"keys": "binary", "counts": "binary", "rows": "binary"}
_SENT = {"shard": "int", "slice": "long", "kind": "int", "row": "int", **_TEXT, **_CELLS}
#: Rows on the way back: the same texts, or what n-grams add to the texts of a slice.
_BACK = {"slice": "long", "row": "int", **_TEXT, "rows": "binary", "sums": "binary"}


def _schema(columns: dict[str, str | None], kind: str) -> str:
    return ", ".join(f"{c} {t or kind}" for c, t in columns.items())


def _record_batch(n: int, columns: dict, given: dict, id_type: pa.DataType) -> pa.RecordBatch:
    """A batch with the given columns, the others null."""
    types = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    types[None] = id_type
    arrays = []
    for name, kind in columns.items():
        value = given.get(name)
        if value is None:
            value = pa.nulls(n, types[kind])
        elif not isinstance(value, pa.Array):
            value = pa.array(value, types[kind])
        arrays.append(value)
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _grouped(keys: list[np.ndarray], text: np.ndarray, trained: np.ndarray, shards: int):
    """Tokens by their keys (the first one deals them): packed keys, counts and rows of each shard.

    Equal n-grams of the slice are one group, equal ones of a text one record of it. ``trained`` says if a token is
    learned from. Yields shard, places of the groups' first tokens, keys and the other two cells' arrays.
    """
    order = np.lexsort(keys[::-1])
    keys, text, trained = [k[order] for k in keys], text[order], trained[order]
    if not len(order):
        return
    change = np.zeros(len(order) - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    groups = np.flatnonzero(np.r_[True, change])
    records = np.flatnonzero(np.r_[True, change | (text[1:] != text[:-1])])
    times = np.diff(np.r_[records, len(order)]).astype(np.uint32)
    first = np.searchsorted(records, np.r_[groups, len(order)])
    learned = np.add.reduceat(trained.astype(np.int64), groups).astype(np.uint32)
    many, rows = np.diff(first).astype(np.uint32), text[records].astype(np.uint32)
    heads = [k[groups] for k in keys]
    shard = ((heads[0] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    stops = np.r_[np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(groups)]
    start = 0
    for stop in stops.tolist():
        of, cells = slice(start, stop), slice(first[start], first[stop])
        yield int(shard[start]), order[groups[of]], [h[of] for h in heads], (learned[of], many[of]), (rows[cells], times[cells])
        start = stop


def _send(common, model, totals: Totals):
    shards = totals.at_least(PAIR_SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = common.value
        filter_: Filter = model.value
        decoded = counts_of_levels(filter_.most, totals.floor)
        read = np.full(len(keys), -1, np.int64)
        for batch in batches:
            ids, held = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for start, stop, t in _slices(batch, 3):
                place = _place(keys, t.keys)
                frequent, at = place >= 0, place[place >= 0]
                new = at[read[at] < 0]
                read[new] = filter_.levels(keys[new])
                level, exact = np.zeros(len(t.keys), np.int64), np.zeros(len(t.keys))
                level[frequent], exact[frequent] = read[at], counts[at]
                count = decoded[level]
                text, n = t.of_text(), stop - start
                a, b, second = _pairs_of(t)
                word = np.log10((count + 0.1) / totals.mass)[t.at]
                word[second] += math.log10(totals.prior)
                word[~frequent[t.at]] = 0.0
                word[second] -= np.where(frequent[a], np.log10(count[a] + totals.prior), 0.0)
                sums = lambda x: np.bincount(text, x, n)
                based = np.where(frequent, np.log10((exact + 0.1) / totals.mass), 0.0)
                begin = batch.column(0)[start].as_py()
                given = {
                    "shard": (begin + np.arange(n)) % shards,
                    "slice": np.full(n, begin),
                    "kind": np.zeros(n, np.int32),
                    "row": np.arange(n),
                    "id": ids.slice(start, n),
                    "held_out": held[start:stop],
                    "n_tokens": np.diff(t.stops, prepend=0),
                    "known": sums(frequent[t.at].astype(float)),
                    "base": sums(based[t.at]),
                    "score": sums(word),
                }
                yield _record_batch(n, _SENT, given, ids.type)
                learn = ~held[start:stop][text]
                out = defaultdict(list)
                # Pairs that end in a frequent word.
                some = np.flatnonzero(frequent[b])
                a1, b1 = a[some], b[some]
                learn1, text1 = learn[second[some]], text[second[some]]
                pairs = pair_keys(t.keys[a1], t.keys[b1])
                for shard, one, (pair,), (learned, many), records in _grouped([pairs], text1, learn1, shards):
                    levels = level[a1[one]].astype(np.uint8), level[b1[one]].astype(np.uint8)
                    _put(out, shard, 1, pair.tobytes(), _packed(learned, many, *levels), _packed(*records))
                # Words under the floor, with the pairs they end.
                some = np.flatnonzero(~frequent[t.at])
                before = np.full(len(t.at), -1)
                before[second] = a
                a2, key = before[some], t.keys[t.at[some]]
                pairs = np.where(a2 < 0, _mixed(key), pair_keys(t.keys[a2], key))
                for shard, one, (w, pair), (learned, many), records in _grouped([key, pairs], text[some], learn[some], shards):
                    none = (a2[one] < 0).astype(np.uint8)
                    _put(out, shard, 2, w.tobytes() + pair.tobytes(), _packed(learned, many, none, none), _packed(*records))
                if out["shard"]:
                    n = len(out["shard"])
                    yield _record_batch(n, _SENT, {**out, "slice": np.full(n, begin)}, ids.type)

    return run


def _put(out: dict[str, list], *cells) -> None:
    for name, cell in zip(("shard", "kind", "keys", "counts", "rows"), cells, strict=True):
        out[name].append(cell)


@dataclass
class Sent:
    """N-grams of a slice that a shard got."""

    slice: int
    keys: bytes
    counts: bytes
    rows: bytes

    def heads(self, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
        keys = np.frombuffer(self.keys, np.uint64).reshape(width, -1)
        return keys, _unpacked(self.counts, keys.shape[1], "<u4", "<u4", "u1", "u1")

    def added(self, many: np.ndarray, terms: list[np.ndarray]) -> tuple[int, bytes, bytes]:
        """What groups with these terms add to texts: slice, rows and their sums, packed."""
        rows, times = _unpacked(self.rows, int(many.sum()), "<u4", "<u4")
        present, where = np.unique(rows, return_inverse=True)
        sums = [np.bincount(where, np.repeat(x, many) * times, len(present)) for x in terms]
        head = len(present).to_bytes(4, "little")
        return self.slice, head + _packed(np.diff(present, prepend=np.uint32(0))), _packed(*sums)


def _totalled(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, where = np.unique(keys, return_inverse=True)
    return found, where, np.bincount(where, counts, len(found))


def _counts_in_shard(keys: np.ndarray, counts: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key among the different ones, and their counts: under the floor as they are, others by the filter."""
    found, where, total = _totalled(keys, counts)
    often = total >= floor
    levels = levels_of(total[often], floor)
    most = int(levels.max(initial=0))
    size = max(64, math.ceil(int(levels.sum()) * BITS_PER_ENTRY / 64) * 64)
    filter_ = Filter(np.zeros(size // 8, np.uint8), size, most, floor, 1)
    filter_.add(found[often], levels)
    asked = often | (total == 0)
    total[asked] = counts_of_levels(most, floor)[filter_.levels(found[asked])]
    return where, total


def _answers(pairs: list[Sent], words: list[Sent], totals: Totals, decoded: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """What the n-grams of one shard add to the texts."""
    if pairs:
        heads = [s.heads(1) for s in pairs]
        where, joint = _counts_in_shard(
            np.concatenate([k[0] for k, _ in heads]), np.concatenate([c[0] for _, c in heads]), totals.floor
        )
        at = 0
        for s, (keys, (_, many, before, word)) in zip(pairs, heads, strict=True):
            j = joint[where[at : at + keys.shape[1]]]
            at += keys.shape[1]
            weight = totals.prior * (decoded[word] + 0.1) / totals.mass
            # The filter may give a pair more than its first word has; an exact count never is.
            excess = np.where(before > 0, np.maximum(j - decoded[before], 0.0), 0.0)
            term = np.log10(1.0 + j / weight) - np.log10(1.0 + excess / (decoded[before] + totals.prior))
            zero = np.zeros(len(term))
            yield s.added(many, [zero, zero, term])
    if words:
        heads = [s.heads(2) for s in words]
        learned = np.concatenate([c[0] for _, c in heads])
        _, of_word, n_word = _totalled(np.concatenate([k[0] for k, _ in heads]), learned)
        _, of_pair, n_pair = _totalled(np.concatenate([k[1] for k, _ in heads]), learned)
        at = 0
        for s, (keys, (_, many, first, _)) in zip(words, heads, strict=True):
            n, j = n_word[of_word[at : at + keys.shape[1]]], n_pair[of_pair[at : at + keys.shape[1]]]
            at += keys.shape[1]
            alone = (n + 0.1) / totals.mass
            term = np.log10(np.where(first > 0, alone, j + totals.prior * alone))
            # Every word but the end is followed by a token.
            term -= np.where(keys[0] == END_KEY, 0.0, np.log10(n + totals.prior))
            yield s.added(many, [(n > 0).astype(float), np.log10(alone), term])


def _answer(totals: Totals, decoded: np.ndarray):
    """Shards of a task, which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answered(id_type):
            out = list(zip(*_answers(held[1], held[2], totals, decoded), strict=True))
            held[1], held[2] = [], []
            for i in range(0, len(out[0]) if out else 0, 1_000):
                cells = [x[i : i + 1_000] for x in out]
                yield _record_batch(len(cells[0]), _BACK, dict(zip(("slice", "rows", "sums"), cells, strict=True)), id_type)

        held: dict[int, list[Sent]] = {1: [], 2: []}
        shard = id_type = None
        for batch in batches:
            id_type = batch.column("id").type
            kinds = batch.column("kind")
            texts = batch.filter(pc.equal(kinds, 0))
            if len(texts):
                yield _record_batch(len(texts), _BACK, {c: texts.column(c) for c in ("slice", "row", *_TEXT)}, id_type)
            grams = batch.filter(pc.greater(kinds, 0)).select(["shard", "kind", "slice", "keys", "counts", "rows"])
            for of, kind, *cells in zip(*(c.to_pylist() for c in grams.columns), strict=True):
                if of != shard:
                    yield from answered(id_type)
                    shard = of
                held[kind].append(Sent(*cells))
        if id_type is not None:
            yield from answered(id_type)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with all that was added to them; all rows of a slice come one after the other, its texts first and in order."""

    def done():
        table = pa.Table.from_batches(texts)
        at = table.column("row").to_numpy()
        total = [table.column(c).to_numpy() + x[at] for c, x in zip(("known", "base", "score"), more, strict=True)]
        columns = [table.column(c).combine_chunks() for c in ("id", "held_out", "n_tokens")]
        return pa.RecordBatch.from_arrays([*columns, *map(pa.array, (total[0].astype(np.int64), *total[1:]))], list(_TEXT))

    texts, more, of = [], None, None
    for batch in batches:
        slices = batch.column("slice").to_numpy()
        stops = np.r_[np.flatnonzero(slices[1:] != slices[:-1]) + 1, len(slices)]
        start = 0
        for stop in stops.tolist():
            if stop == start:
                continue
            part = batch.slice(start, stop - start)
            if slices[start] != of:
                if texts:
                    yield done()
                texts, more, of = [], None, slices[start]
            start = stop
            rows = part.filter(pc.is_valid(part.column("row")))
            if len(rows):
                texts.append(rows)
                size = rows.column("row")[len(rows) - 1].as_py() + 1
                more = np.zeros((3, size)) if more is None else np.pad(more, ((0, 0), (0, size - more.shape[1])))
            grams = part.filter(pc.is_valid(part.column("rows")))
            for packed, sums in zip(grams.column("rows").to_pylist(), grams.column("sums").to_pylist(), strict=True):
                n = int.from_bytes(packed[:4], "little")
                at = np.cumsum(_unpacked(packed[4:], n, "<u4")[0])
                for total, x in zip(more, _unpacked(sums, n, "<f8", "<f8", "<f8"), strict=True):
                    total[at] += x
    if texts:
        yield done()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and model score of every text, learned from those that are not held out."""
    spark = docs.sparkSession
    context = spark.sparkContext
    text = F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")
    held_out = is_held_out(F.col(f"`{id_col}`"))
    training = docs.where(~held_out).select(text)
    words = training.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    words = written(words, "lm-words")
    tokens, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = max(1, math.ceil(tokens * RESOLUTION))
    frequent = words.where(F.col("n") >= floor)
    table = frequent.toArrow()
    keys, counts = table["h"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(keys)
    common = context.broadcast((keys[order], counts[order]))
    totals = Totals(tokens, types, floor, PRIOR)
    filter_ = build_filter(frequent, floor)
    model = context.broadcast(filter_)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), held_out.alias("held_out"), text
    )
    sent = rows.mapInArrow(_send(common, model, totals), _schema(_SENT, kind))
    shards = sent.repartition(totals.at_least(PAIR_TASKS), "shard").sortWithinPartitions("shard")
    decoded = counts_of_levels(filter_.most, floor)
    back = shards.mapInArrow(_answer(totals, decoded), _schema(_BACK, kind))
    slices = back.repartition("slice").sortWithinPartitions("slice", F.col("row").asc_nulls_last())
    scored = slices.mapInArrow(_add_up, f"id {kind}, held_out boolean, n_tokens long, known long, base double, score double")
    return scored.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
