"""Near copies of texts: SimHash links and shared keys as candidates, exact Jaccard similarity as the judge.

Two texts are linked when their sets of five-word shingles have a Jaccard similarity of ``SIMILARITY`` or more.
Candidates come from two sides. The BK-trees of ``simhash_bk`` bring together fingerprints (of five-word shingles) that
differ in three bits at most; they find the closest copies. The rest comes from keys, and these lose no pair: sets that
similar share one of their first ``n - ceil(SIMILARITY * n) + 1`` shingles in any order of all shingles. The order is by
hash, but the ``HEAVY`` most frequent keys (of those that more than ``COMMON`` texts have) come last, so a passage that
many texts share is hardly ever a key. What two sets can have in common behind a shared key, and their sizes, rule out
most of the other pairs.

Texts are never shuffled, only keys: (key, node, sizes) once. Keys that one text has alone end there; texts that share
the same keys with each other are one group, however many keys these are. Each group first links its texts to the
smallest text of about their size. Groups that are then one component are done; of the others, texts outside the
group's largest component are compared with all, in tiles of ``PIECE`` by ``PIECE`` texts. In ``ROUNDS`` rounds a text
takes a few partners of other components, which makes most of a large group of near copies one component; then it
takes all that are left. So neither such a group nor a frequent key is formed into all its pairs, held by one task, or
cut short.

Candidates are first held against their sketches: how many shingles fall into each of some slots, about two to a slot;
sets have at most the sum of the smaller counts in common, so most pairs that merely share a key end here and no link
does. A tile does so itself, so only pairs that may be links leave it, some at a time. The others are compared by their whole sets. A set is made where its text is read (a bitmap of fixed size tells which
are needed; a text it lets through in vain is only work), and sent to the texts it is compared with, each of which is
kept once for many partners. A worker that packed before forgets its words (``tokens.release``). Tables in the shared folder are deleted after their last reader.

Defined results: null, empty and blank texts are copies of each other; a text of fewer than five words is one shingle;
equal texts are one node; rows with a null id take part, but are kept only if no row of their component has an id;
of rows with one id and equal texts one stays, which of them is left open; an empty table gives an empty table. Texts
and shingles are told apart by 64-bit hashes, shingles of compared sets by 48 bits of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.llm import simhash_bk
from namesieve.llm.bloom_lm import _mixed, _place, _slices
from namesieve.llm.components import components
from namesieve.llm.shared import Scratch
from namesieve.llm.tokens import release

WORDS = 5
SIMILARITY = 0.8
COMMON = 16
#: Most frequent keys that are put last; a broadcast of 4 MB at most.
HEAVY = 1 << 20
#: Texts on each side of a tile, and members of a set's row of partners.
PIECE = 4096
#: Slots of the small sketch that comes to a tile with each text.
SLOTS = 64
#: Rounds before the last, and partners that a text takes in each.
ROUNDS = 2
PARTNERS = 4
#: Bits of the map of texts whose sets are needed.
_MAP_BITS = 26
_CHUNK = 65_536
#: Counts of sketches that are compared at a time, and pairs that leave a tile at a time.
_CELLS = 1 << 21
_PAIRS = 50_000
_BYTES = 6
#: Counts of byte values, lane by lane, give the counts of bits.
_LANES = np.arange(8) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _sets(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted set of shingle hashes of each text."""
    for start, _, t in _slices(batch, text):
        words = t.keys[t.at]
        whole = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            whole = _mixed(whole * np.uint64(31) + words[k : k + len(whole)])
        begin = 0
        for i, stop in enumerate((t.stops - 1).tolist()):  # the last token of a text marks its end
            if stop - begin >= WORDS:
                found = np.unique(whole[begin : stop - WORDS + 1])
            else:
                one = np.zeros(min(1, stop - begin), np.uint64)
                for word in words[begin:stop]:
                    one = _mixed(one * np.uint64(31) + word)
                found = one
            yield start + i, found
            begin = stop + 1


def _simhash(shingles: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for start in range(0, len(shingles), _CHUNK):
        found = shingles[start : start + _CHUNK].view(np.uint8).reshape(-1, 8) + _LANES
        counts += (np.bincount(found.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<i8")[0])


def _sketch(shingles: np.ndarray) -> bytes:
    """Counts of shingles in a power of two of slots, or nothing if one is too large."""
    slots = 1 << max(0, (len(shingles) // 2).bit_length())
    counts = np.bincount((shingles >> np.uint64(32)).astype(np.int64) & (slots - 1), minlength=slots)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def _small(shingles: np.ndarray) -> bytes:
    """The same in ``SLOTS`` slots; 255 stands for that many or more."""
    counts = np.bincount((shingles >> np.uint64(32)).astype(np.int64) & (SLOTS - 1), minlength=SLOTS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What sets of these sizes must have in common to be similar."""
    return SIMILARITY / (1 + SIMILARITY) * (n + m) - 1e-6


def _folded(sketches: np.ndarray, slots: int) -> np.ndarray:
    """The sketches, each of at least so many slots, as rows of counts in so many."""
    sizes = np.fromiter(map(len, sketches), np.int64, len(sketches))
    out = np.empty((len(sketches), slots), np.int32)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        counts = np.frombuffer(b"".join(sketches[at]), np.uint8).reshape(len(at), -1, slots)
        out[at] = counts[:, 0] if size == slots else counts.sum(1, dtype=np.int32)
    return out


def _sketches_allow(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sets of these pairs of sizes and sketches can be similar; sets without a sketch can."""
    keep = np.ones(len(n), bool)
    fewer = np.fromiter((min(len(a), len(b)) for a, b in zip(x, y)), np.int64, len(n))
    for slots in np.unique(fewer[fewer > 0]).tolist():
        rows = np.flatnonzero(fewer == slots)
        for at in np.split(rows, range(_CELLS // slots + 1, len(rows), _CELLS // slots + 1)):
            both = np.minimum(_folded(x[at], slots), _folded(y[at], slots)).sum(1)
            keep[at] = both >= _need(n[at], m[at])
    return keep


def key_count(n: int) -> int:
    return n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1 if n else 0


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), kind))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text (node, text): node, size of its set, fingerprint and keys by hash alone. Copies in a task count once."""
    release()
    seen: set[int] = set()
    for batch in batches:
        nodes = batch.column(0).to_pylist()
        new = [i for i, n in enumerate(nodes) if not (n in seen or seen.add(n))]
        batch = batch.take(pa.array(new, pa.int64()))
        rows = [(i, len(s), _simhash(s), s[: key_count(len(s))].view(np.int64), _sketch(s), _small(s)) for i, s in _sets(batch, 1)]
        if rows:
            at, sizes, fps, keys, sketches, small = zip(*rows)
            columns = [batch.column(0).take(pa.array(at)), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64())]
            columns += [_lists(keys, pa.int64()), pa.array(sketches, pa.binary()), pa.array(small, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "fp", "keys", "sketch", "small"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sizes and sketches allow the similarity."""
    for batch in batches:
        keep = _sketches_allow(*[batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)])
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(2)], ["a", "b"])


def _slot(key: np.ndarray) -> np.ndarray:
    return key & np.uint64(0xFFFFFFFF)


def _has_heavy(heavy):
    """Whether a text has a heavy key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.r_[0, np.cumsum(_place(heavy.value, _slot(flat)) >= 0)]
            stops = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            has = np.diff(ends[np.r_[0, stops]]) > 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(has)], ["node", "n", "keys", "again"])

    return run


def _reordered(wanted, heavy):
    """Keys of the wanted ones of the texts (node, text) when the heavy ones come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _wanted_only(batches, wanted):
            rows = []
            for i, s in _sets(batch, 1):
                last = _place(heavy.value, _slot(s)) >= 0
                if last[: key_count(len(s))].any():
                    rows.append((i, len(s), np.r_[s[~last], s[last]][: key_count(len(s))].view(np.int64)))
            if rows:
                at, sizes, keys = zip(*rows)
                columns = [batch.column(0).take(pa.array(at)), pa.array(sizes, pa.int32()), _lists(keys, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "keys"])

    return run


def _wanted_only(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """The rows (node, text) that the bitmap may mean, each node once in a task."""
    seen: set[int] = set()
    for batch in batches:
        nodes = batch.column(0).to_numpy()
        spots = nodes.view(np.uint64) >> np.uint64(64 - _MAP_BITS)
        there = (wanted.value[(spots >> np.uint64(6)).astype(np.int64)] >> (spots & np.uint64(63))) & np.uint64(1)
        rows = [i for i in np.flatnonzero(there).tolist() if not (nodes[i] in seen or seen.add(nodes[i]))]
        if rows:
            yield batch.take(pa.array(rows))


def _bitmap(nodes: DataFrame):
    """A broadcast map of fixed size of the beginnings of ``node``."""
    spots = nodes.select(F.shiftrightunsigned("node", 64 - _MAP_BITS).alias("spot"))
    words = spots.selectExpr("shiftright(spot, 6) AS word", "shiftleft(1L, int(spot & 63)) AS bit")
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (_MAP_BITS - 6), np.uint64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return nodes.sparkSession.sparkContext.broadcast(out)


def _may_link(n_a, rem_a, n_b, rem_b) -> np.ndarray:
    """Whether sizes, and what is left from a shared key on, allow the similarity."""
    need = _need(n_a, n_b)
    return (np.minimum(n_a, n_b) >= need) & (np.minimum(rem_a, rem_b) >= need)


_GROUP = "digest long, seq int, nodes array<long>, sizes array<int>, rems array<int>, low array<long>, mid array<long>"
_GROUP_NAMES = ["digest", "seq", "nodes", "sizes", "rems", "low", "mid"]


class _Grouping:
    """From rows in the order of key, size and node to one row per key with more than one text."""

    def __init__(self):
        self.carried = [np.empty(0, np.int64) for _ in range(4)]
        self.cut: tuple[int, int] | None = None  # key and number of pieces of a key that is cut
        self.hubs: list[tuple | None] = [None, None]

    def _hubs(self, key, node, n, rem) -> list[np.ndarray]:
        """Twice, for each row the first of its key that has about its size, or itself if the two cannot link."""
        out = []
        for turn, shift in enumerate((0.0, 0.5)):
            size = np.floor(np.log(np.maximum(n, 1)) / np.log(1 / SIMILARITY) + shift)
            head = np.r_[True, (key[1:] != key[:-1]) | (size[1:] != size[:-1])]
            at = np.flatnonzero(head)[np.cumsum(head) - 1]
            hub, hub_n, hub_rem = node[at], n[at], rem[at]
            before = self.hubs[turn]
            if before and before[0] == (key[0], size[0]):
                same = np.cumsum(head) == 1
                hub, hub_n, hub_rem = (np.where(same, b, x) for b, x in zip(before[1:], (hub, hub_n, hub_rem)))
            self.hubs[turn] = ((key[-1], size[-1]), hub[-1], hub_n[-1], hub_rem[-1])
            out.append(np.where(_may_link(n, rem, hub_n, hub_rem), hub, node))
        return out

    def _rows(self, rows: list[np.ndarray], last: bool) -> pa.RecordBatch | None:
        """Complete keys, or (not ``last``) a piece of one."""
        key, node, n, rem = rows
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        pieces = np.zeros(len(starts), np.int64)
        cut = np.zeros(len(starts), bool)
        if self.cut and self.cut[0] == key[0]:
            pieces[0], cut[0] = self.cut[1], True
        if not last:
            cut[0] = True
            self.cut = (int(key[0]), int(pieces[0]) + 1)
        many = np.repeat((sizes > 1) | cut, sizes)
        kept = (sizes > 1) | cut
        if not kept.any():
            return None
        key, node, n, rem = (x[many] for x in rows)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        hubs = self._hubs(key, node, n, rem)
        with np.errstate(over="ignore"):
            members = np.add.reduceat(_mixed(node.view(np.uint64)), starts) + sizes[kept].astype(np.uint64)
            members = np.where(cut[kept], _mixed(key[starts].view(np.uint64) + np.uint64(1)), _mixed(members))
        ends = pa.array(np.r_[starts, len(key)], pa.int32())
        lists = [
            pa.ListArray.from_arrays(ends, pa.array(x, kind))
            for x, kind in ((node, pa.int64()), (n, pa.int32()), (rem, pa.int32()), (hubs[0], pa.int64()), (hubs[1], pa.int64()))
        ]
        first = [pa.array(members.view(np.int64)), pa.array(pieces[kept], pa.int32())]
        return pa.RecordBatch.from_arrays([*first, *lists], _GROUP_NAMES)

    def add(self, new: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = [np.concatenate([c, x]) for c, x in zip(self.carried, new)]
        key, node = rows[0], rows[1]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        rows = [r[fresh] for r in rows]
        stop = int(np.searchsorted(-(rows[0] != rows[0][-1]).astype(np.int8), 0))
        if stop:
            out = self._rows([r[:stop] for r in rows], True)
            if out:
                yield out
            rows = [r[stop:] for r in rows]
        while len(rows[0]) > PIECE:
            yield self._rows([r[:PIECE] for r in rows], False)
            rows = [r[PIECE:] for r in rows]
        self.carried = rows

    def end(self) -> Iterator[pa.RecordBatch]:
        if len(self.carried[0]):
            out = self._rows(self.carried, True)
            if out:
                yield out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups = _Grouping()
    for batch in batches:
        if batch.num_rows:
            yield from groups.add([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
    yield from groups.end()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same texts (in the order of their digest) as one, with the most that any key leaves."""
    last = None
    held: list = []

    def row() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        lists = [pa.array([x], pa.list_(k)) for x, k in zip(held, kinds)]
        return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int32()), *lists], _GROUP_NAMES)

    out: list[pa.RecordBatch] = []
    for batch in batches:
        places = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        columns = [batch.column(i) for i in range(2, 7)]
        ends = columns[0].offsets.to_numpy()
        flat = [c.values.to_numpy() for c in columns]
        for i, place in enumerate(places):
            now = [f[ends[i] : ends[i + 1]] for f in flat]
            if place == last and len(now[0]) == len(held[0]):
                held[2] = np.maximum(held[2], now[2])
                for k in (3, 4):
                    held[k] = np.where(held[k] == held[0], now[k], held[k])
                continue
            if last is not None:
                out.append(row())
            last, held = place, now
        if len(out) > 2000:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    if last is not None:
        out.append(row())
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def _tiles(most: int | None, seed: int = 0):
    """Pairs of texts of different components that their sketches let link, of each tile: those that ask and those that answer.

    With ``most``, each that asks takes so many of its partners, which differ with the seed.
    """

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        node, n, rem, root, asks, small, sketch = rows
        counts = np.frombuffer(b"".join(small), np.uint8).reshape(len(node), SLOTS).astype(np.int32)
        counts[counts == 255] = 1 << 20
        chance = np.random.default_rng([seed, len(node)])
        ask, own = (np.flatnonzero(asks == x) for x in (1, 0))
        own = own[np.argsort(n[own], kind="stable")]
        found: list[np.ndarray] = []
        for start in range(0, len(ask), 256):
            a = ask[start : start + 256]
            low = np.searchsorted(n[own], n[a].min() * SIMILARITY - 1e-6)
            high = np.searchsorted(n[own], n[a].max() / SIMILARITY + 1e-6, "right")
            b = own[low:high]
            fit = _may_link(n[a][:, None], rem[a][:, None], n[b], rem[b]) & (root[a][:, None] != root[b])
            x, y = np.nonzero(fit)
            step = _CELLS // SLOTS
            for k in range(0, len(x), step):
                i, j = a[x[k : k + step]], b[y[k : k + step]]
                enough = np.minimum(counts[i], counts[j]).sum(1) >= _need(n[i], n[j])
                fit[x[k : k + step], y[k : k + step]] = enough
            if most is not None and fit.shape[1] > most:
                drawn = np.where(fit, chance.random(fit.shape, np.float32), 2)
                chosen = np.argpartition(drawn, most, axis=1)[:, :most]
                taken = np.zeros_like(fit)
                np.put_along_axis(taken, chosen, True, axis=1)
                fit &= taken
            x, y = np.nonzero(fit)
            for k in range(0, len(x), _PAIRS):
                i, j = a[x[k : k + _PAIRS]], b[y[k : k + _PAIRS]]
                near = _sketches_allow(n[i], n[j], sketch[i], sketch[j])
                found.append(np.sort([node[i[near]], node[j[near]]], axis=0))
            if sum(f.shape[1] for f in found) >= _PAIRS:
                yield batch_of(found)
                found = []
        if found:
            yield batch_of(found)

    def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        place, held = None, []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            digest, tile = columns[:2]
            cuts = np.flatnonzero((digest[1:] != digest[:-1]) | (tile[1:] != tile[:-1])) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(digest)]):
                if stop == start:
                    continue
                here = (digest[start], tile[start])
                if here != place and held:
                    yield from pairs([np.concatenate(x) for x in zip(*held)])
                    held = []
                place = here
                held.append([*[c[start:stop].astype(np.int64) for c in columns[2:7]], *[c[start:stop] for c in columns[7:]]])
        if held:
            yield from pairs([np.concatenate(x) for x in zip(*held)])

    return run


def _as_sets(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in _wanted_only(batches, wanted):
            nodes = batch.column(0).to_pylist()
            rows = []
            for i, s in _sets(batch, 1):
                short = np.unique(s >> np.uint64(64 - 8 * _BYTES)).view(np.uint8).reshape(-1, 8)[:, :_BYTES]
                rows.append((nodes[i], short.tobytes()))
            if rows:
                a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary())], ["node", "shingles"])

    return run


def _set_of(column: pa.Array, i: int) -> np.ndarray:
    packed = np.frombuffer(column[i].as_buffer(), np.uint8).reshape(-1, _BYTES)
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, :_BYTES] = packed
    return out.view(np.uint64).ravel()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each hub's set comes before those of its partners."""
    hub, held = None, None
    for batch in batches:
        keep = []
        hubs, parts, nodes = (batch.column(i).to_pylist() for i in range(3))
        for i, (h, part, node) in enumerate(zip(hubs, parts, nodes)):
            if node == h:
                if (h, part) != hub:
                    hub, held = (h, part), _set_of(batch.column(4), i)
                continue
            other = _set_of(batch.column(4), i)
            both = len(np.intersect1d(held, other, assume_unique=True))
            if both >= SIMILARITY * (len(held) + len(other) - both) - 1e-9:
                keep.append(i)
        picked = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(2).take(picked)], ["a", "b"])


def _node(text: Column) -> Column:
    blank = text.isNull() | ~text.rlike(r"[^ \t\n\r\x0b\f]")
    return F.xxhash64(F.when(blank, F.lit("")).otherwise(text))


def _verified(texts: DataFrame, pairs: DataFrame, tables: Scratch) -> DataFrame:
    """Those of the pairs (a, b), each given once, that are similar."""
    hubs = pairs.groupBy(F.col("a").alias("hub")).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    partners = pairs.join(hubs, F.col("a") == F.col("hub")).select(F.col("b").alias("node"), "hub", mine.alias("part"))
    own = hubs.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    routes = tables.written(partners.union(own), "routes")
    sets = texts.mapInArrow(_as_sets(_bitmap(routes.select("node"))), "node long, shingles binary")
    once = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    sent = once.join(routes, "node").select("hub", "part", "node", (F.col("node") != F.col("hub")).alias("partner"), "shingles")
    order = ["hub", "part", "partner", "node"]
    found = sent.repartition("hub", "part").sortWithinPartitions(*order).mapInArrow(_compared, "a long, b long")
    return tables.written(found, "links")


def links(texts: DataFrame, tables: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes that span all components of similar texts. ``texts``: node and text, repeats allowed."""
    context = texts.sparkSession.sparkContext
    binary = texts.select("node", F.col("text").cast("binary").alias("text"))
    described = tables.written(binary.mapInArrow(_describe, "node long, n int, fp long, keys array<long>, sketch binary, small binary"), "texts")

    slot = F.transform("keys", lambda k: k.bitwiseAND(F.lit(0xFFFFFFFF)))
    slots = described.select(F.explode(slot).alias("slot")).groupBy("slot").count()
    top = slots.where(F.col("count") > COMMON).orderBy(F.desc("count"), "slot").limit(HEAVY).select("slot").toArrow()
    heavy = context.broadcast(np.sort(top["slot"].to_numpy().astype(np.uint64)))

    marked = described.select("node", "n", "keys").mapInArrow(_has_heavy(heavy), "node long, n int, keys array<long>, again boolean")
    again = _bitmap(marked.where("again").select("node"))
    redone = binary.mapInArrow(_reordered(again, heavy), "node long, n int, keys array<long>")
    keyed = marked.where("NOT again").select("node", "n", "keys").union(redone)
    keyed = keyed.select("node", "n", F.posexplode("keys").alias("pos", "key"))
    keyed = keyed.select("key", "node", "n", (F.col("n") - F.col("pos")).alias("rem"))
    keyed = keyed.repartition("key").sortWithinPartitions("key", "n", "node")
    groups = keyed.mapInArrow(_grouped, _GROUP).repartition("digest", "seq").sortWithinPartitions("digest", "seq")
    groups = tables.written(groups.mapInArrow(_merged, _GROUP), "groups")

    low, high = F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")
    zipped = groups.select(F.explode(F.arrays_zip("nodes", "low", "mid")).alias("r"))
    stars = zipped.select(F.col("r.nodes").alias("node"), F.explode(F.array("r.low", "r.mid")).alias("other"))
    # Copies in different tasks have the same fingerprint, so one node of each is tied to it.
    prints = tables.written(described.groupBy("fp").agg(F.min("node").alias("hub")), "prints")
    trees = simhash_bk.links(prints.select("fp"), "fp")
    trees = trees.join(prints.select(F.col("fp").alias("a"), F.col("hub").alias("node")), "a")
    trees = trees.join(prints.select(F.col("fp").alias("b"), F.col("hub").alias("other")), "b").select("node", "other")
    equal = described.join(prints, "fp").select("node", F.col("hub").alias("other"))
    first = stars.union(trees).union(equal).where("node <> other").select(low, high).distinct()
    links_ = _verified(binary, _sketched(first, described.select("node", "n", "sketch"), tables), tables)
    tables.drop("prints", "candidates")
    for turn in range(ROUNDS + 1):
        most = PARTNERS if turn < ROUNDS else None
        found = _other_pairs(groups, described, components(links_, "a", "b"), tables, most, turn)
        links_ = links_.union(_verified(binary, tables.written(found, "candidates"), tables))
        tables.drop("rooted", "candidates")
    return links_


def _sketched(pairs: DataFrame, sketches: DataFrame, tables: Scratch) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave."""
    of = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    known = pairs.join(of("a").dropDuplicates(["a"]), "a").join(of("b").dropDuplicates(["b"]), "b")
    known = known.select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return tables.written(known.mapInArrow(_alike, "a long, b long"), "candidates")


def _other_pairs(groups: DataFrame, described: DataFrame, roots: DataFrame, tables: Scratch, most: int | None, turn: int) -> DataFrame:
    """Pairs of texts of different components that share a group; some of them, with ``most``."""
    known = roots.select(F.col("node").alias("of"), "root")
    rows = groups.select("digest", F.explode(F.arrays_zip("nodes", "sizes", "rems")).alias("r"))
    rows = rows.select("digest", F.col("r.nodes").alias("node"), F.col("r.sizes").alias("n"), F.col("r.rems").alias("rem"))
    rooted = rows.join(known, F.col("node") == F.col("of"), "left")
    rooted = rooted.select("digest", "node", "n", "rem", F.coalesce("root", "node").alias("root"))
    rooted = tables.written(rooted, "rooted")
    each = rooted.groupBy("digest", "root").agg(F.count("*").alias("k"))
    mixed = each.groupBy("digest").agg(F.max(F.struct("k", "root")).alias("most"), F.sum("k").alias("all")).where("all > most.k")
    parts = lambda n: F.ceil(n / PIECE).cast("int")
    mixed = mixed.select("digest", F.col("most.root").alias("main"), parts(F.col("all") - F.col("most.k")).alias("rows"), parts(F.col("all")).alias("cols"))
    sketches = described.groupBy("node").agg(F.first("small").alias("small"), F.first("sketch").alias("sketch"))
    open_ = rooted.join(mixed, "digest").join(sketches, "node")
    at = F.xxhash64("node")
    in_row, in_col = F.pmod(at, F.col("rows")).cast("int"), F.pmod(at, F.col("cols")).cast("int")

    def place(tile: Column, asks: int) -> Column:
        return F.struct(tile.alias("tile"), F.lit(asks).alias("asks"))

    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    answering = F.transform(every("rows"), lambda r: place(r * F.col("cols") + in_col, 0))
    asking = F.transform(every("cols"), lambda c: place(in_row * F.col("cols") + c, 1))
    places = F.when(F.col("root") == F.col("main"), answering).otherwise(F.concat(answering, asking))
    tiles = open_.select("digest", "node", "n", "rem", "root", "small", "sketch", F.explode(places).alias("p"))
    tiles = tiles.select("digest", "p.tile", "node", "n", "rem", "root", "p.asks", "small", "sketch")
    tiles = tiles.repartition("digest", "tile").sortWithinPartitions("digest", "tile", "node")
    return tiles.mapInArrow(_tiles(most, turn), "a long, b long").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id. All columns stay."""
    taken = set(docs.columns)
    mark, key, kept = (next(n for n in (f"{c}{'_' * k}" for k in range(99)) if n not in taken) for c in ("node", "low", "kept"))
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), _node(text).alias("node"), text.alias("text"))
    tables = Scratch(docs.sparkSession, "near-copies")
    found = components(links(texts.select("node", "text"), tables), "a", "b").select(F.col("node").alias("of"), "root")
    each = texts.groupBy("node").agg(F.min("id").alias("low"))
    each = each.join(found, F.col("node") == F.col("of"), "left")
    each = each.select(F.coalesce("root", "node").alias("root"), F.struct(F.col("low").isNull().alias("none"), "low", "node").alias("row"))
    stay = each.groupBy("root").agg(F.min("row").alias("row"))
    stay = Scratch(docs.sparkSession, "near-copies-result").written(stay.select(F.col("row.low").alias(key), F.col("row.node").alias(kept)), "kept")
    tables.drop()
    marked = docs.withColumn(mark, _node(text))
    same = (F.col(mark) == F.col(kept)) & F.col(f"`{id_col}`").eqNullSafe(F.col(key))
    return marked.join(stay, same, "left_semi").dropDuplicates([id_col, mark]).drop(mark)
