"""SimHash near-duplicates with sharded BK-trees.

A text's fingerprint has a bit set when more than half of its shingles' XXH64 hashes have it set. Fingerprints that
differ in at most three bits are linked. Of four 16-bit blocks of two linked fingerprints one is equal, and of four
12-bit parts of the other 48 bits one is equal too, so fingerprints are dealt to shards by 16 keys of 28 bits. Each
shard is indexed by a BK-tree: a child hangs from its parent by their Hamming distance, and a search follows only
edges within the radius of the distance at hand. The trees of all shards of a batch are built and searched together,
level by level, with numpy.

Trees of the whole corpus would grow with it, so they are not broadcast from the driver: a shard's tree is brought to
its queries by the shuffle. A shard with more than ``SHARD`` fingerprints is split into trees of about that size, and its
fingerprints, in as many parts, are queries to each of them: a task holds one tree and one part of the queries at a
time, and no link is lost.
Equal fingerprints are one node, however many documents have them, so copies are never expanded into pairs. A task
reports its links as stars, and ``components`` joins them.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; a text of fewer words than
a shingle is hashed whole; repeated rows are copies; rows with a null id take part, but cannot name a component: if
no row of a component has an id, its ``component_id`` is null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.llm.components import components
from namesieve.llm.shared import materialize, written

WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints in one tree.
SHARD = 20_000
#: What a fingerprint is to a tree.
QUERY, NODE, BOTH = 0, 1, 2
#: (query, node) pairs that a search holds at a time.
FRONTIER = 4_000_000
_CHUNK = 65_536


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as a signed integer."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(tokens) - words + 1)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, _CHUNK):
        stop = min(n, start + _CHUNK)
        shifted = [tokens[start + k : stop + k] for k in range(words)] if len(tokens) >= words else [[b" ".join(tokens)]]
        hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*shifted)), np.uint64, stop - start)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return of(text.cast("string").cast("binary"))


def _keys(fp: Column) -> Column:
    """The 16 shard keys of a fingerprint: a block, a part of the rest, and which they are."""
    out = []
    for block in range(4):
        value = F.shiftrightunsigned(fp, 16 * block).bitwiseAND(F.lit(0xFFFF))
        low = fp.bitwiseAND(F.lit((1 << 16 * block) - 1))
        high = F.shiftrightunsigned(fp, 16 * (block + 1)) if block < 3 else F.lit(0)
        rest = F.shiftleft(high.cast("long"), 16 * block).bitwiseOR(low)
        for part in range(4):
            piece = F.shiftrightunsigned(rest, 12 * part).bitwiseAND(F.lit(0xFFF))
            key = F.shiftleft(value, 12).bitwiseOR(piece)
            out.append(F.shiftleft(key, 4).bitwiseOR(F.lit(4 * block + part)))
    return F.array(*out)


class Forest:
    """The BK-trees of many shards. ``shard`` is sorted; only rows marked ``member`` become nodes."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray, member: np.ndarray):
        self.fps = fps
        n = len(fps)
        self.root = np.full(n, -1)
        parents, edges, nodes = [], [], []
        rows = np.flatnonzero(member)
        slot = shard[rows]
        first = True
        while len(rows):
            order = np.argsort(slot, kind="stable")
            rows, slot = rows[order], slot[order]
            head = np.r_[True, slot[1:] != slot[:-1]]
            node = rows[head][np.cumsum(head) - 1]
            if first:
                self.root[rows] = node
            else:
                at = rows[head]
                parents.append(parent_of[order][head])
                edges.append(edge_of[order][head])
                nodes.append(at)
            distance = np.bitwise_count(fps[rows] ^ fps[node]).astype(np.int64)
            below = ~head
            rows, parent_of, edge_of = rows[below], node[below], distance[below]
            slot = parent_of * 65 + edge_of
            first = False
        parent = np.concatenate(parents) if parents else np.empty(0, np.int64)
        order = np.argsort(parent, kind="stable")
        self.child = np.concatenate(nodes)[order] if nodes else parent
        self.edge = np.concatenate(edges)[order] if edges else parent
        self.begin = np.searchsorted(parent[order], np.arange(n + 1))
        # Queries that are no members search their shard's tree as well.
        starts = np.r_[True, shard[1:] != shard[:-1]]
        group = np.cumsum(starts) - 1
        roots = np.full(int(starts.sum()), -1)
        has = self.root >= 0
        roots[group[has]] = self.root[has]
        self.root = roots[group]
        self.sizes = np.bincount(group[has], minlength=len(roots))[group]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) within the radius, the query itself left out."""
        queries = queries[self.root[queries] >= 0]
        found = [np.empty((2, 0), np.int64)]
        cost = np.cumsum(self.sizes[queries])
        start = 0
        while start < len(queries):
            spent = cost[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(cost, spent + FRONTIER, "right")))
            q = queries[start:stop]
            node = self.root[q]
            while len(q):
                d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
                hit = (d <= radius) & (q != node)
                found.append(np.stack([q[hit], node[hit]]))
                count = self.begin[node + 1] - self.begin[node]
                at = np.repeat(self.begin[node] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                follow = np.abs(self.edge[at] - np.repeat(d, count)) <= radius
                q, node = np.repeat(q, count)[follow], self.child[at[follow]]
            start = stop
        pairs = np.concatenate(found, axis=1)
        return pairs[0], pairs[1]


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n points the smallest point it is connected with by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(shard: np.ndarray, fps: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the linked fingerprints of complete shards, in the order of ``shard``."""
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
    sizes = np.diff(starts)
    keep = np.repeat(sizes > 1, sizes)
    shard, fps, role = shard[keep], fps[keep], role[keep]
    if not len(fps):
        return fps, fps
    forest = Forest(shard, fps, role != QUERY)
    a, b = forest.search(np.flatnonzero(role != NODE), radius)
    label = stars(len(fps), a, b)
    tied = label != np.arange(len(fps))
    return fps[tied], fps[label[tied]]


def _search_shards(radius: int):
    names = ["a", "b"]

    def result(shard, fps, role) -> pa.RecordBatch:
        a, b = _linked(shard, fps.view(np.uint64), role, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = [np.concatenate([h, x]) for h, x in zip(held, new)]
            key, part, fps, role = held
            if len(key) < 100_000:
                continue
            last = (key == key[-1]) & (part == part[-1])
            cut = int(last.argmax())
            if cut:
                yield result(_numbered(key[:cut], part[:cut]), fps[:cut], role[:cut])
                held = [h[cut:] for h in held]
        key, part, fps, role = held
        if len(key):
            yield result(_numbered(key, part), fps, role)

    return run


def _numbered(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    new = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
    return np.r_[0, np.cumsum(new)]


def links(fps: DataFrame, fp_col: str = "fp", radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of different fingerprints, a spanning forest of all that link within each shard.

    ``fps`` holds each fingerprint once. The shard keys are exact for a radius of up to three.
    """
    if radius > 3:
        raise ValueError("the shard keys find links of at most three bits")
    dealt = fps.select(F.explode(_keys(F.col(fp_col))).alias("key"), F.col(fp_col).alias("fp"))
    large = dealt.groupBy("key").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts")).where("parts > 1")
    sized = dealt.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("long")

    def place(tree, queries, role: int):
        return F.struct((tree * F.col("parts") + queries).alias("part"), F.lit(role).alias("role"))

    every = F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)
    split = F.concat(
        F.transform(every, lambda p: place(p, own, QUERY)), F.transform(every, lambda p: place(own, p, NODE))
    )
    whole = F.array(place(F.lit(0).cast("long"), F.lit(0).cast("long"), BOTH))
    places = F.explode(F.when(F.col("parts") > 1, split).otherwise(whole)).alias("place")
    sent = sized.select("key", "fp", places).select("key", "place.part", "fp", "place.role")
    sorted_ = sent.repartition("key", "part").sortWithinPartitions("key", "part")
    return sorted_.mapInArrow(_search_shards(radius), "a long, b long")


def classes(rows: DataFrame, id_col: str = "doc_id", fp_col: str = "fp", radius: int = RADIUS) -> DataFrame:
    """One row per fingerprint: ``fp``, its ``root`` fingerprint and ``component_id``, the smallest id reachable.

    ``rows`` is read twice and should be a written table.
    """
    each = written(
        rows.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("low")), "simhash-fingerprints"
    )
    found = components(links(each.select("fp"), "fp", radius), "a", "b")
    rooted = each.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """Per row its id, fingerprint (16 hexadecimal digits) and component."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint_column(F.col(f"`{text_col}`"), words).alias("fp"))
    rows = written(rows, "simhash-documents")
    joined = rows.join(classes(rows, "id", "fp", radius), "fp")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return joined.select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """One document of each component: the one with the smallest id. All columns stay."""
    mark, key = "simhash of the text", "simhash id"
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint_column(F.col(f"`{text_col}`"), words).alias("fp"))
    rows = written(rows, "simhash-documents")
    joined = rows.join(classes(rows, "id", "fp", radius), "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    stay = joined.groupBy("root").agg(F.first("component_id").alias(key), F.min("fp").alias("keep fp"))
    stay = stay.select(F.col(key), F.col("`keep fp`"))
    marked = docs.withColumn(mark, fingerprint_column(F.col(f"`{text_col}`"), words))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(f"`{key}`")) & (F.col(f"`{mark}`") == F.col("`keep fp`"))
    return marked.join(stay, same, "left_semi").dropDuplicates([id_col, mark]).drop(mark)
