"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a code of concatenated random hyperplane hashes, and the vectors of a label are put in
the lexicographic order of their codes. A vector is compared with its neighbours in a window of that order and with
all vectors that share the beginning of its code, whose length follows the logarithm of the number of vectors. The
latter run is what makes the search whole where many vectors lie close together: runs longer than a block are
compared block by block, so no task holds more than two blocks and no partner is left out for want of room.
Compared pairs are verified with the cosine in double precision.

A pair may be met in several passes. Every vector carries its places in all passes, so a block can tell whether an
earlier pass has met a pair and counts it only once: pairs are never written out. Blocks report per vector how many
others it links with and one star of the links found, and the stars of all passes are united by ``components``.
Equal vectors of a label are one vector with a count.

Defined results: a null, empty or zero vector, one with null or non-finite components, and one with a null label
links with nothing; vectors of different lengths link with nothing; repeated rows are equal vectors; a vector with a
null id links like any other but cannot name a component, and is kept only if it has none; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namesieve.llm.components import components
from namesieve.llm.shared import written
from namesieve.llm.simhash_bk import stars

THRESHOLD = 0.98
PASSES = 8
#: Hyperplanes of a code.
BITS = 32
WINDOW = 64
BLOCK = 1024
#: Vectors that should share the beginning of a code when codes are evenly spread.
RUN = 32
SEED = 20_240_901


def planes(passes: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, passes, dim]).standard_normal((passes, BITS, dim))


def _unit(values: list | None) -> np.ndarray | None:
    if not values or None in values:
        return None
    v = np.array(values, np.float64)
    scale = np.abs(v).max()
    if not np.isfinite(scale) or scale == 0:
        return None
    v /= scale
    return v / np.sqrt(v @ v)


def _prepared(passes: int):
    names = ["id", "label", "dim", "vector", "codes"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        places = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for i, values, label in zip(*(c.to_pylist() for c in batch.columns)):
                unit = None if label is None else _unit(values)
                codes = []
                if unit is not None:
                    if len(unit) not in known:
                        known[len(unit)] = planes(passes, len(unit))
                    codes = ((known[len(unit)] @ unit > 0) @ places).tolist()
                row = (i, label, 0 if unit is None else len(unit), None if unit is None else unit.tobytes(), codes)
                for column, value in zip(columns, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def _positions(classes: DataFrame, prefix: int) -> DataFrame:
    """Per class and pass its position in the order of all (pass, label, code), and its run."""
    each = classes.select("class", "label", "dim", F.posexplode("codes").alias("pass", "code"))
    keys = ["pass", "label", "dim", "code", "class"]
    ordered = each.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(ordered.withColumn("row", F.monotonically_increasing_id()), "projection-order")
    placed = placed.withColumn("part", F.shiftright("row", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    # One row per partition.
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    at = placed.join(before, "part").withColumn("at", F.col("before") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1)))
    run = ["pass", "label", "dim", F.shiftright("code", BITS - prefix).alias("run")]
    at = at.select("class", "at", *run)
    run = ["pass", "label", "dim", "run"]
    bounds = at.groupBy(*run).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    return at.join(bounds, run).select("class", "pass", "at", "first", "last")


def _compare(passes: int, threshold: float, window: int):
    def found(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Links between the rows of one pair of blocks; ``side`` 0 is the left block, 1 the right one."""
        v, at, first = rows["vector"], rows["at"], rows["first"]
        p, left = int(rows["pass"][0]), np.flatnonzero(rows["side"] == 0)
        within = rows["left"][0] == rows["right"][0]
        right = left if within else np.flatnonzero(rows["side"] == 1)
        a, b = np.nonzero(v[left] @ v[right].T >= threshold)
        a, b = left[a], right[b]
        ok = rows["key"][a] == rows["key"][b]
        if within:
            ok &= a < b
        a, b = a[ok], b[ok]

        def met(q: int) -> np.ndarray:
            return (first[a, q] == first[b, q]) | (np.abs(at[a, q] - at[b, q]) <= window)

        now = met(p)
        a, b = a[now], b[now]
        counted = np.ones(len(a), bool)
        for q in range(p):
            counted &= ~met(q)
        n = len(v)
        count = np.bincount(a[counted], rows["n"][b[counted]], n) + np.bincount(b[counted], rows["n"][a[counted]], n)
        label = stars(n, a, b)
        some = np.zeros(n, bool)
        some[a] = some[b] = True
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows["class"][some]),
                pa.array(rows["class"][label[some]]),
                pa.array(count[some].astype(np.int64)),
            ],
            ["class", "with", "links"],
        )

    def arrays(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(parts)
        get = lambda name: table[name].to_numpy()
        out = {x: get(x) for x in ("class", "key", "n", "pass", "side", "left", "right")}
        out["vector"] = np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(len(table), -1)
        for x in ("at", "first"):
            out[x] = table[x].combine_chunks().flatten().to_numpy().reshape(len(table), passes)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None
        for batch in batches:
            keys = np.stack([batch[x].to_numpy() for x in ("pass", "dim", "left", "right")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), keys.shape[1]]):
                if stop == start:
                    continue
                this = tuple(keys[:, start].tolist())
                if held and this != group:
                    yield found(arrays(held))
                    held = []
                group = this
                held.append(batch.slice(start, stop - start))
        if held:
            yield found(arrays(held))

    return run


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    passes: int = PASSES,
    window: int = WINDOW,
) -> DataFrame:
    """Per row its id, the number of other vectors linked directly, its component and whether it is kept."""
    given = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
        F.col(f"`{label_col}`").cast("long").alias("label"),
    )
    rows = given.mapInArrow(_prepared(passes), "id long, label long, dim int, vector binary, codes array<long>")
    # Equal vectors of a label have one 128-bit digest.
    rows = written(
        rows.withColumn("digest", F.md5(F.concat(F.col("vector"), F.encode(F.concat_ws("/", F.lit("label"), "label", "dim"), "utf-8")))),
        "projection-vectors",
    )
    valid = rows.where(F.col("vector").isNotNull())
    classes = valid.groupBy("digest").agg(
        F.min("id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"),
        F.first("dim").alias("dim"), F.first("codes").alias("codes"), F.first("vector").alias("vector"),
    )
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "projection-classes")
    size = max(1, classes.count())
    prefix = min(BITS, max(1, int(np.ceil(np.log2(size / RUN)))) if size > RUN else 1)
    placed = written(_positions(classes, prefix), "projection-places")
    places = placed.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("pass", "at", "first", "last"))).alias("p"))
    key = F.xxhash64("label", "dim")
    carried = classes.select("class", "n", "dim", "vector", key.alias("key")).join(places, "class")
    each = carried.select(
        "class", "n", "dim", "vector", "key",
        F.transform("p", lambda x: x["at"]).alias("at"), F.transform("p", lambda x: x["first"]).alias("first"),
        F.explode("p").alias("here"),
    )
    block = F.floor(F.col("here.at") / BLOCK)
    # As the left side: with every later block that its run or its window reaches; as the right side: with earlier ones.
    to = F.floor(F.greatest(F.col("here.last"), F.col("here.at") + window) / BLOCK)
    back = F.floor(F.least(F.col("here.first"), F.greatest(F.lit(0).cast("long"), F.col("here.at") - window)) / BLOCK)
    meets = F.concat(
        F.transform(
            F.sequence(block, to),
            lambda j: F.struct(block.alias("left"), j.alias("right"), F.lit(0).alias("side")),
        ),
        F.transform(
            F.filter(F.sequence(back, block), lambda i: i < block),
            lambda i: F.struct(i.alias("left"), block.alias("right"), F.lit(1).alias("side")),
        ),
    )
    dealt = each.select(
        "class", "n", "dim", "vector", "key", "at", "first", F.col("here.pass").alias("pass"), F.explode(meets).alias("m")
    ).select("class", "n", "dim", "vector", "key", "at", "first", "pass", "m.left", "m.right", "m.side")
    group = ["pass", "dim", "left", "right"]
    sorted_ = dealt.repartition(*group).sortWithinPartitions(*group)
    hits = sorted_.mapInArrow(_compare(passes, threshold, window), "class long, with long, links long")
    hits = written(hits, "projection-links")
    counts = hits.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(hits, "class", "with").withColumnsRenamed({"node": "class"})
    whole = classes.select("class", "digest", "low", "n").join(counts, "class", "left").join(roots, "class", "left")
    whole = whole.withColumn("root", F.coalesce("root", "class"))
    lowest = whole.groupBy("root").agg(F.min("low").alias("component"))
    whole = whole.join(lowest, "root").select(
        "digest", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")
    )
    out = rows.select("id", F.when(F.col("vector").isNotNull(), F.col("digest")).alias("digest")).join(
        whole, "digest", "left"
    )
    linked = F.col("links").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
