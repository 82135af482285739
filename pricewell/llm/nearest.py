"""Exact nearest neighbours by a block matrix join over int8 tiles.

Vectors are packed into blocks: a matrix of int8 codes with a scale for each vector, the norm of what the codes
stand for, the norm of the rounding error, and the original numbers. Blocks of queries are the rows of a grid of
cells, blocks of candidates its columns; a cell holds its queries and streams its candidates past them. The
product of two code matrices is exact and gives every distance up to the two rounding errors (the triangle
inequality). Pairs whose lower bound lies above the k-th nearest so far go; the others are recomputed
from the original numbers in double precision and pushed on the query's heap. The heaps of a query's cells
are merged by heaps again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.session import materialized

#: Vectors and components in a block at most; a tile has so many rows and columns.
BLOCK_ROWS = 1_024
BLOCK_COMPONENTS = 1 << 17
#: Queries and candidates of a cell, about: a cell's queries are held in memory, its candidates pass by.
CELL_QUERIES = 8_192
CELL_CANDIDATES = 65_536
#: Components whose products of int8 codes add up exactly in single precision: 127 * 127 * 1,024 < 2 ** 24.
EXACT_COMPONENTS = 1_024
#: Pairs recomputed at a time.
PAIRS = 16_384
#: Cells whose heaps are merged before the last merge.
MERGED_CELLS = 256
#: Slack for the rounding of the bounds themselves: relative, and for each component where squares underflow.
SLACK = 1e-9
TINY = 1e-320
BLOCK = "is_query boolean, dim int, n int, ids binary, codes binary, scales binary, norms binary, errors binary, vectors binary"
BLOCK_TYPES = [pa.bool_(), pa.int32(), pa.int32()] + [pa.binary()] * 6
NEAR = "query_id long, vec_id long, score double"


def takes_part(vector: Column) -> Column:
    """Whether a vector is there, has only finite components and is not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _norms(rows: np.ndarray) -> np.ndarray:
    """Euclidean norms, also of rows whose squares would underflow or overflow."""
    most = np.maximum(np.abs(rows).max(axis=1), np.finfo(float).tiny)
    with np.errstate(over="ignore"):
        return most * np.linalg.norm(rows / most[:, None], axis=1)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors (id, is_query, vector) to blocks of one kind and one dimension."""
    names = [x.split()[0] for x in BLOCK.split(", ")]
    waiting: dict[tuple[bool, int], list] = {}

    def block(key: tuple[bool, int], rows: list) -> pa.RecordBatch:
        ids = np.array([i for i, _ in rows], np.int64)
        vectors = np.array([v for _, v in rows], np.float64)
        scales = np.maximum(np.abs(vectors).max(axis=1) / 127, np.finfo(float).tiny)
        codes = np.clip(np.rint(vectors / scales[:, None]), -127, 127)
        stood_for = codes * scales[:, None]
        norms, errors = _norms(stood_for), _norms(vectors - stood_for)
        parts = [ids, codes.astype(np.int8), scales, norms, errors, vectors]
        values = [*key, len(ids), *[x.tobytes() for x in parts]]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, BLOCK_TYPES, strict=True)], names=names)

    for batch in batches:
        for i, is_query, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = waiting.setdefault((is_query, len(vector)), [])
            rows.append((i, vector))
            if len(rows) >= BLOCK_ROWS or len(rows) * len(vector) >= BLOCK_COMPONENTS:
                yield block((is_query, len(vector)), waiting.pop((is_query, len(vector))))
    for key, rows in waiting.items():
        yield block(key, rows)


class Nearest:
    """The k nearest of different ids, nearest first and ties to the smaller id, on a heap with the farthest on top."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.found: dict[int, float] = {}
        self.heap: list[tuple[float, int]] = []

    def _farthest(self) -> tuple[float, int]:
        while (top := self.heap[0]) and self.found.get(-top[1]) != -top[0]:
            heapq.heappop(self.heap)  # a nearer vector of the same id has come since
        return top

    def bound(self) -> float:
        return -self._farthest()[0] if len(self.found) >= self.k else np.inf

    def push(self, score: float, i: int) -> None:
        if i in self.found:
            if score >= self.found[i]:
                return
        elif len(self.found) >= self.k:
            if (-score, -i) <= self._farthest():
                return
            self.found.pop(-heapq.heappop(self.heap)[1])
        self.found[i] = score
        heapq.heappush(self.heap, (-score, -i))

    def rows(self) -> list[tuple[int, float]]:
        return sorted(self.found.items(), key=lambda x: (x[1], x[0]))


class Block:
    def __init__(self, row: dict) -> None:
        n, dim = row["n"], row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(n, dim).astype(np.float32)
        self.scales, self.norms, self.errors = (np.frombuffer(row[c], np.float64) for c in ("scales", "norms", "errors"))
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
        self.repeats = len(np.unique(self.ids)) < n


def tile_bounds(q: Block, c: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of all pairs of two blocks, from the product of their codes."""
    product = np.zeros((len(q.ids), len(c.ids)))
    for start in range(0, q.codes.shape[1], EXACT_COMPONENTS):
        part = slice(start, start + EXACT_COMPONENTS)
        product += q.codes[:, part] @ c.codes[:, part].T  # whole numbers below 2 ** 24: exact
    product *= q.scales[:, None]
    product *= -2 * c.scales
    sums = q.norms[:, None] ** 2 + c.norms**2
    product += sums
    # rounding may move the square by a fraction of the sum of squares, and a root by that root
    slack = SLACK * sums + TINY * q.codes.shape[1]
    spread = q.errors[:, None] + c.errors
    spread *= 1 + SLACK
    low = np.sqrt(np.maximum(product - slack, 0)) * (1 - SLACK) - spread
    high = np.sqrt(np.maximum(product + slack, 0)) * (1 + SLACK) + spread
    return low, high


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of each row of a from that of b; squares are added in the order of the components."""
    apart = np.ascontiguousarray((a - b).T)
    apart *= apart
    total = np.zeros(len(a))
    for squares in apart:
        total += squares
    return np.sqrt(total)


def _tile(q: Block, c: Block, best: list[Nearest], k: int) -> None:
    """Pushes the pairs of a tile that may be among the nearest on the queries' heaps."""
    with np.errstate(over="ignore", invalid="ignore"):
        low, high = tile_bounds(q, c)
    own = q.ids[:, None] == c.ids
    bound = np.array([b.bound() for b in best])
    if len(c.ids) > k and not c.repeats:  # the k-th upper bound of a tile with different ids bounds the k-th nearest
        high[own | np.isnan(high)] = np.inf
        bound = np.minimum(bound, np.partition(high, k - 1, axis=1)[:, k - 1])
    rows, columns = np.nonzero(~(low > bound[:, None]) & ~own)
    for start in range(0, len(rows), PAIRS):
        x, y = rows[start : start + PAIRS], columns[start : start + PAIRS]
        with np.errstate(over="ignore"):
            scores = distances(q.vectors[x], c.vectors[y])
        for i, j, score in zip(x.tolist(), c.ids[y].tolist(), scores.tolist()):
            best[i].push(score, j)


def _near_rows(found: dict[int, Nearest], keys: list[tuple[str, object, pa.DataType]]) -> pa.RecordBatch:
    flat = [(q, i, s) for q, near in found.items() for i, s in near.rows()]
    columns = [pa.array([x[p] for x in flat], t) for p, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
    columns += [pa.array([value] * len(flat), t) for _, value, t in keys]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", *[name for name, _, _ in keys]])


def cells_searched(k: int):
    """A function over blocks sorted by cell, a cell's queries first: each cell's nearest of each of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries = None, []

        def close() -> pa.RecordBatch:
            merged: dict[int, Nearest] = {}
            for block, best in queries:  # a query of several vectors is as near as its nearest one
                for i, near in zip(block.ids.tolist(), best, strict=True):
                    if i not in merged:
                        merged[i] = near
                        continue
                    for j, score in near.rows():
                        merged[i].push(score, j)
            return _near_rows(merged, [("strip", cell[1], pa.int64())])

        for batch in batches:
            for row in batch.to_pylist():
                if (at := (row["dim"], row["strip"], row["query_strip"])) != cell:
                    if queries:
                        yield close()
                    cell, queries = at, []
                block = Block(row)
                if row["is_query"]:
                    queries.append((block, [Nearest(k) for _ in range(row["n"])]))
                    continue
                for q, best in queries:
                    _tile(q, block, best, k)
        if queries:
            yield close()

    return run


def merged(near: DataFrame, key: list[Column], k: int) -> DataFrame:
    """The k nearest of each query within each value of the key columns, by one heap at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, Nearest(k)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("query_id", "part", "vec_id", "score")), strict=True)
            for query, part, i, score in rows:
                if (query, part) != now:
                    if now:
                        yield _near_rows({now[0]: heap}, [("strip", now[1], pa.int64())])
                    now, heap = (query, part), Nearest(k)
                heap.push(score, i)
        if now:
            yield _near_rows({now[0]: heap}, [("strip", now[1], pa.int64())])

    rows = near.withColumn("part", key[0]).repartition("query_id", "part").sortWithinPartitions("query_id", "part")
    return rows.mapInArrow(run, f"{NEAR}, strip long")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k rows nearest to each query by Euclidean distance, all others searched.

    Vectors that are null, zero or hold null or infinite components or nan take no part, nor do rows without an id.
    Vectors of another dimension than the query's are no candidates. Rows of one id are one thing: it is as near
    as its nearest vector, never its own neighbour, and repeated rows change nothing. Equal distances go to the
    smaller id. A query with fewer candidates gets them all; with none, or an empty table, no row.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("is_query"), F.col(vector_col).cast("array<double>").alias("v"))
    # equal vectors of an id once; -0.0 and 0.0 are the same component
    rows = rows.where(F.col("id").isNotNull() & takes_part(F.col("v"))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = rows.groupBy("id", "v").agg(F.max(F.coalesce("is_query", F.lit(False))).alias("is_query"))
    # each query is a candidate of the others as well
    kinds = F.when(F.col("is_query"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    blocks = rows.select("id", F.explode(kinds).alias("is_query"), "v").mapInArrow(packed, BLOCK)
    blocks = materialized(blocks, "vector-blocks")  # written, so that a lost executor can't deal vectors to blocks anew
    sizes = {r.is_query: r for r in blocks.groupBy("is_query").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")).collect()}
    if True not in sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    query_strips = -(-sizes[True].n // CELL_QUERIES)
    strips = max(-(-sizes[False].n // CELL_CANDIDATES), min(sizes[False].blocks, 2 * spark.sparkContext.defaultParallelism))
    place = F.xxhash64("ids", "vectors")
    cells = blocks.select(
        "*",
        F.when(F.col("is_query"), F.sequence(F.lit(0), F.lit(strips - 1))).otherwise(F.array(F.pmod(place, F.lit(strips)))).alias("s"),
        F.when(F.col("is_query"), F.array(F.pmod(place, F.lit(query_strips)))).otherwise(F.sequence(F.lit(0), F.lit(query_strips - 1))).alias("q"),
    )
    cells = cells.withColumn("strip", F.explode("s")).withColumn("query_strip", F.explode("q")).drop("s", "q")
    key = ["dim", "strip", "query_strip"]
    cells = cells.repartition(min(strips * query_strips, 100_000), *key).sortWithinPartitions(*key, F.desc("is_query"))
    near = cells.mapInArrow(cells_searched(k), f"{NEAR}, strip long")
    if strips > MERGED_CELLS:
        near = merged(near, [F.pmod("strip", F.lit(MERGED_CELLS))], k)
    best = merged(near, [F.lit(0).cast("long")], k)
    by_query = F.sort_array(F.collect_list(F.struct("score", "vec_id")))
    return best.groupBy("query_id").agg(by_query.alias("near")).select("query_id", F.posexplode("near").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
