"""Exact top-k search by inner product in a paged M-tree.

Inner products have no triangle inequality, distances do. With M the largest squared length, every vector x gets one
more component, sqrt(M - |x|^2), and every query q a zero; then |q - x|^2 = |q|^2 + M - 2 qx, so the nearest vectors are
those with the largest products.

The tree has four levels. ``PIVOTS`` routing vectors (a sample of fixed size; all rows are indexed) divide the space into
regions, each with its covering radius. A region is cut into pages of ``PAGE`` vectors in the order of their distance to
its pivot, so a page is a ring with an inner and an outer radius, and a dense region is many pages. A page's nodes have a
routing vector, its covering radius and its distance to the parent, and about ``ENTRIES`` vectors each. A node's entries hold their
distance to the routing vector. A search takes nodes in the order of the least distance they allow, and ends when that
exceeds the k-th best; by |d(q, parent) - d(parent, x)| <= d(q, x) it passes over nodes and vectors whose stored distances
show that they are too far, without computing theirs.

Searches go best first through the pages as well: every query first searches the page that holds its own vector; then
the queries of a page, packed in one row, visit the pages whose rings are within reach of their k-th best. A
task holds one page and one such row of queries at a time. Scores are whole numbers and exact; distances only decide what
is left out, with some slack for rounding.

Defined results: vectors that are null or hold a null take no part; vectors of different lengths are not compared; an
empty vector's products are 0; equal scores go by id, a null id last; a row is no candidate for a query with its id,
and of query rows with one id the smallest vector counts; scores beyond a long are given as the largest or smallest one;
an empty table, or one without queries, gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesieve.llm.ranks import ranked
from namesieve.llm.shared import written

#: Routing vectors of regions: a sample, taken by hash.
PIVOTS = 64
#: Vectors of a page, and of a node.
PAGE = 4096
ENTRIES = 64
#: Regions of vectors of one length are numbered from this multiple of it; the first is for vectors without a pivot.
_SPAN = 1024
_SLACK = 1e-6
_LONG = np.iinfo(np.int64)
#: Stands for a null id: last among equals.
_NO_ID = _LONG.max


class Space:
    """The pivots by length of vector, and what distances are made from."""

    def __init__(self, pivots: list[list[int]], longest: float, largest: int):
        self.longest = longest
        self.slack = _SLACK * (1 + longest**0.5)
        self.pivots: dict[int, np.ndarray] = {}
        for dim in sorted({len(p) for p in pivots if p}):
            self.pivots[dim] = np.unique(np.array([p for p in pivots if len(p) == dim], np.int64), axis=0).astype(np.float64)
        dims = max(map(len, pivots), default=1) or 1
        self.whole = largest * largest * max(dims, 1) < 2**53

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of vectors from vectors."""
        x2, y2 = (x * x).sum(1), (y * y).sum(1)
        more_x, more_y = (np.sqrt(np.maximum(self.longest - s, 0)) for s in (x2, y2))
        square = x2[:, None] + y2 - 2 * (x @ y.T) + (more_x[:, None] - more_y) ** 2
        return np.sqrt(np.maximum(square, 0))

    def reach(self, length: np.ndarray | float, score: np.ndarray | float) -> np.ndarray | float:
        """The distance from a query of that squared length at which vectors have that score."""
        return np.sqrt(np.maximum(length + self.longest - 2 * score, 0))

    def pivot(self, region: int) -> np.ndarray | None:
        dim, number = divmod(region, _SPAN)
        return self.pivots[dim][number - 1] if number else None


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1)


def _assigned(space: Space):
    """Region of each vector and its distance from the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).value_lengths().to_numpy()
            region, dist = dims.astype(np.int64) * _SPAN, np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                if dim in space.pivots:
                    at = np.flatnonzero(dims == dim)
                    x = _matrix(batch.column(1).take(pa.array(at)), len(at)).astype(np.float64)
                    d = space.between(x, space.pivots[dim])
                    nearest = d.argmin(1)
                    region[at] += nearest + 1
                    dist[at] = d[np.arange(len(at)), nearest]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(region), pa.array(dist)], ["id", "vector", "query", "region", "dist"]
            )

    return run


class Page:
    """A page of the tree: nodes with routing vectors, covering radii and parent distances, and their entries."""

    def __init__(self, space: Space, pivot: np.ndarray | None, ids: np.ndarray, vectors: np.ndarray, dist: np.ndarray):
        self.space, self.pivot = space, pivot
        x = vectors.astype(np.float64)
        routing = np.unique(np.linspace(0, len(x) - 1, -(-len(x) // ENTRIES)).astype(np.int64))
        d = space.between(x, x[routing])
        owner = d.argmin(1)
        order = np.argsort(owner, kind="stable")
        self.ids = ids[order]
        self.exact = (vectors if space.whole else vectors.astype(object))[order]
        if space.whole:
            self.exact = x[order]
        self.parent = d[order, owner[order]]
        self.begin = np.searchsorted(owner[order], np.arange(len(routing) + 1))
        self.radius = np.zeros(len(routing))
        np.maximum.at(self.radius, owner, d[np.arange(len(x)), owner])
        self.routing, self.routing_parent = x[routing], dist[routing]
        self.computed = 0

    def search(self, own: int, query: np.ndarray, floor: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k, of those that may reach ``floor``."""
        space, q = self.space, query.astype(np.float64)
        length = float(q @ q)
        exact = q if space.whole else query.astype(object)
        ids, scores = np.empty(0, np.int64), np.empty(0, self.exact.dtype)
        reach = np.inf if floor is None else space.reach(length, float(floor)) + space.slack
        nodes = np.arange(len(self.routing))
        if self.pivot is not None:
            self.computed += 1
            to_parent = space.reach(length, float(q @ self.pivot))
            nodes = np.flatnonzero(np.abs(to_parent - self.routing_parent) - self.radius <= reach)
        self.computed += len(nodes)
        d = space.reach(length, self.routing[nodes] @ q)
        least = d - self.radius[nodes]
        for j in np.argsort(least, kind="stable"):
            if least[j] > reach:
                break
            entries = slice(self.begin[nodes[j]], self.begin[nodes[j] + 1])
            near = np.flatnonzero((np.abs(d[j] - self.parent[entries]) <= reach) & (self.ids[entries] != own)) + entries.start
            if not len(near):
                continue
            self.computed += len(near)
            ids, scores = np.r_[ids, self.ids[near]], np.r_[scores, self.exact[near] @ exact]
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) == k:
                worst = scores.min() if floor is None else max(scores.min(), floor)
                reach = space.reach(length, float(worst)) + space.slack
        return ids, np.clip(scores, float(_LONG.min), _LONG.max).astype(np.int64) if space.whole else _clipped(scores)


def _clipped(scores: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(s), _LONG.min), _LONG.max) for s in scores], np.int64)


def _visits(space: Space, k: int):
    """Rows in the order of page and kind: a page's vectors, then rows of queries, of which one is held at a time."""
    names = ["query_id", "vec_id", "score"]

    def searched(page: Page, ids: np.ndarray, vectors: np.ndarray, floors: list) -> pa.RecordBatch:
        found = [(q, *page.search(q, v, f, k)) for q, v, f in zip(ids.tolist(), vectors, floors)]
        asked = np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64)
        hit = np.concatenate([i for _, i, _ in found])
        scores = np.concatenate([s for _, _, s in found])
        return pa.RecordBatch.from_arrays([pa.array(asked), pa.array(hit, mask=hit == _NO_ID), pa.array(scores)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, page = None, [], None
        for batch in batches:
            places = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for i, (here, kind) in enumerate(zip(places, batch.column(2).to_pylist())):
                if here != where:
                    where, held, page = here, [], None
                ids, vectors = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4))
                if kind == 0:
                    held.append((ids[0], vectors, batch.column(5)[i].as_py()))
                elif held:
                    if page is None:
                        x = np.stack([v for _, v, _ in held])
                        page = Page(space, space.pivot(here[0]), np.array([h[0] for h in held]), x, np.array([h[2] for h in held]))
                    yield searched(page, ids, vectors.reshape(len(ids), -1), batch.column(6)[i].as_py())

    return run


def _reachable(space: Space, radii: dict[int, float]):
    """For rows of queries, one row for each region that some of them reach, with the ring in which they do."""
    names = ["region", "ids", "vectors", "floors", "from", "to", "home_region", "home_page"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                ids = np.array(row["ids"], np.int64)
                vectors = batch["vectors"][i].values.to_numpy().reshape(len(ids), -1)
                floors = row["floors"]
                q = vectors.astype(np.float64)
                length = (q * q).sum(1)
                known = np.array([f is not None for f in floors])
                score = np.array([f or 0 for f in floors], np.float64)
                reach = np.where(known, space.reach(length, score) + space.slack, np.inf)
                out = [(row["region"] // _SPAN * _SPAN, np.arange(len(ids)), -np.inf, np.inf)]
                pivots = space.pivots.get(q.shape[1], np.empty((0, q.shape[1])))
                d = space.reach(length[:, None], q @ pivots.T)
                for number in range(len(pivots)):
                    region = q.shape[1] * _SPAN + number + 1
                    if region in radii:
                        some = np.flatnonzero(d[:, number] - radii[region] <= reach)
                        if len(some):
                            near, far = d[some, number] - reach[some], d[some, number] + reach[some]
                            out.append((region, some, near.min(), far.max()))
                rows = [
                    (region, ids[s].tolist(), vectors[s].ravel().tolist(), [floors[x] for x in s], a, b, row["region"], row["page"])
                    for region, s, a, b in out
                ]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], _REACHED)

    return run


_REACHED = pa.schema(
    [("region", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.list_(pa.int64())), ("floors", pa.list_(pa.int64())),
     ("from", pa.float64()), ("to", pa.float64()), ("home_region", pa.int64()), ("home_page", pa.int64())]
)
_REACHED_SQL = "region long, ids array<long>, vectors array<long>, floors array<long>, from double, to double, home_region long, home_page long"


def _packed(queries: DataFrame) -> DataFrame:
    """The queries of each page in one row; a page has no more of them than vectors."""
    rows = F.array_sort(F.collect_list(F.struct("id", "vector", "floor")))
    each = queries.groupBy("region", "page").agg(rows.alias("q"))
    return each.select(
        "region", "page", F.col("q.id").alias("ids"), F.flatten("q.vector").alias("vectors"), F.col("q.floor").alias("floors")
    )


def top_k(
    vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k best rows for each query row.

    The vectors are of whole numbers; every row is a candidate for every query but those with its own id.
    """
    given = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{vector_col}`").cast("array<long>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
    )
    given = given.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = F.greatest(F.abs(F.array_max("vector").cast("double")), F.abs(F.array_min("vector").cast("double")))
    rows = written(given, "metric-rows")
    long, most = rows.agg(F.max(square), F.max(largest)).first()
    sample = rows.orderBy(F.xxhash64("id", "vector"), "vector").limit(PIVOTS).select("vector").collect()
    space = Space([r.vector for r in sample], long or 0.0, int(most or 0))

    assigned = rows.mapInArrow(_assigned(space), "id long, vector array<long>, query boolean, region long, dist double")
    placed = ranked(assigned, "region", ["dist", "id", "vector"], "metric-order").withColumn("page", F.floor(F.col("at") / PAGE))
    placed = written(placed.select("region", "page", "id", "vector", "query", "dist"), "metric-pages")
    rings = placed.groupBy("region", "page").agg(F.min("dist").alias("inner"), F.max("dist").alias("outer"))
    rings = written(rings, "metric-rings")
    radii = rings.where(F.col("region") % _SPAN > 0).groupBy("region").agg(F.max("outer")).collect()

    queries = placed.where(F.col("query") & F.col("id").isNotNull()).groupBy("id")
    queries = written(queries.agg(F.min(F.struct("vector", "region", "page")).alias("q")).select("id", "q.*"), "metric-queries")
    members = placed.select(
        "region", "page", F.lit(0).alias("kind"), F.array(F.coalesce("id", F.lit(_NO_ID))).alias("ids"), F.col("vector").alias("vectors"),
        "dist", F.lit(None).cast("array<long>").alias("floors"),
    )

    def visited(blocks: DataFrame, name: str) -> DataFrame:
        asked = blocks.select("region", "page", F.lit(1).alias("kind"), "ids", "vectors", F.lit(0.0).alias("dist"), "floors")
        order = ["region", "page", "kind"]
        sent = members.union(asked).repartition("region", "page").sortWithinPartitions(*order)
        return written(sent.mapInArrow(_visits(space, k), "query_id long, vec_id long, score long"), name)

    home = visited(_packed(queries.withColumn("floor", F.lit(None).cast("long"))), "metric-home")
    floors = home.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    blocks = _packed(queries.join(floors, "id", "left"))
    reached = blocks.mapInArrow(_reachable(space, {r[0]: r[1] for r in radii}), _REACHED_SQL)
    other = (F.col("home_region") != F.col("region")) | (F.col("home_page") != F.col("page"))
    met = reached.join(rings, "region").where(other & (F.col("outer") >= F.col("from")) & (F.col("inner") <= F.col("to")))
    found = home.union(visited(met, "metric-others"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked_ = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked_.select("query_id", "rank", "vec_id", "score")
