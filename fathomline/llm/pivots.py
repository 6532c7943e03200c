"""Pivot tables over vectors, which bracket inner products by the triangle inequality.

A further coordinate makes all stored vectors equally long, and a query gets 0
there. The squared distance of a query from a stored vector is then M^2 + |q|^2
less twice their inner product, so the nearest vectors have the highest scores.
Each stored vector keeps its distances to the pivots; with the query's own
distances to them, these bracket any distance without a look at the vector.

Components are whole numbers, so scores are exact: in doubles as long as the
largest squared length stays below 2^52, and in Python's integers beyond that,
where nothing is pruned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import Shelf

#: Rows from which pivots are chosen: those with the smallest hashes of their ids. All rows get distances.
SAMPLE = 2048
PIVOTS = 24
#: Queries that are broadcast at a time, each with its vector and at most a few more numbers.
ROUND = 4096
#: Rows that a task looks at together.
CHUNK = 2048
#: Share of the largest length by which stored distances (floats) may be off, and more.
SLACK = 4e-6


def whole_vectors(df: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding", **more: Column) -> DataFrame:
    """Columns id, v (each component x as floor(scale * x)) and `more`.

    Rows with a null id, a null vector, or a component that is null or not
    finite (also after scaling) are left out.
    """
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(float(scale)))
    finite = F.forall(scaled, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above all numbers
    floor = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), floor.alias("v"), *(c.alias(n) for n, c in more.items()))


def matrix(vectors: list | pa.ListArray, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    lists = vectors if isinstance(vectors, pa.Array) else pa.array(vectors, pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), dim))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


@dataclass
class Pivots:
    points: np.ndarray  # their vectors
    ids: np.ndarray
    top: float  # the largest squared length, M^2
    dim: int
    exact: bool  # doubles hold every score

    @staticmethod
    def choose(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> Pivots:
        """Each pivot is the sampled row farthest from those before it; equal rows give one pivot."""
        size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        top, dim = rows.agg(F.max(size), F.max(F.size("v"))).first()
        top, dim = top or 0.0, dim or 1
        exact = top < 2.0**52
        if not exact:
            return Pivots(np.zeros((0, dim)), np.zeros(0, np.int64), top, dim, False)
        some = rows.select("id", "v").orderBy(F.xxhash64("id"), "id", F.xxhash64("v")).limit(sample).collect()
        x, ids = matrix([r.v for r in some], dim), np.array([r.id for r in some], np.int64)
        made = Pivots(x[:0], ids[:0], top, dim, True)
        chosen, far = [], np.full(len(x), np.inf)
        while len(chosen) < min(pivots, len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, Pivots(x[chosen[-1:]], ids, top, dim, True).of_rows(x)[:, 0])
            far[chosen] = 0
        made.points, made.ids = x[chosen], ids[chosen]
        return made

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of stored vectors to the pivots."""
        long_x, long_p = ((y * y).sum(1) for y in (x, self.points))
        more = np.sqrt(self.top - long_x)[:, None] - np.sqrt(self.top - long_p)[None, :]
        return np.sqrt(np.maximum(0, long_x[:, None] + long_p[None, :] - 2 * x @ self.points.T + more * more))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries to the pivots."""
        return np.sqrt(np.maximum(0, self.reach(q)[:, None] - 2 * q @ self.points.T))

    def reach(self, q: np.ndarray) -> np.ndarray:
        """M^2 + |q|^2, from which twice a score is taken to get a squared distance."""
        return self.top + (q * q).sum(1)

    def scores(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products with one query."""
        if self.exact:
            return (x @ q).astype(np.int64)
        whole = np.vectorize(int, otypes=[object])
        found = (whole(x) * whole(q)).sum(1) if len(x) else np.zeros(0, object)
        return np.clip(found, -(2**63), 2**63 - 1).astype(np.int64)  # as far as a long goes


@dataclass
class Chunk:
    """Some stored rows: ids, vectors, distances to the pivots, and the other columns."""

    ids: np.ndarray
    x: np.ndarray
    far: np.ndarray
    more: dict[str, np.ndarray]


@dataclass
class Query:
    """One query of a round: its number, row, vector, distances to the pivots, M^2 + |q|^2 and the slack of distances."""

    number: int
    row: Row
    q: np.ndarray
    far: np.ndarray
    reach: float
    slack: float

    def nearest(self, chunk: Chunk) -> np.ndarray:
        """Lower bounds of the distances: the largest over the pivots."""
        if not len(self.far):
            return np.zeros(len(chunk.ids))
        return np.maximum(0, np.abs(chunk.far - self.far).max(1) - self.slack)

    def farthest(self, chunk: Chunk) -> np.ndarray:
        """Upper bounds of the distances: the smallest over the pivots."""
        if not len(self.far):
            return np.full(len(chunk.ids), np.inf)
        return (chunk.far + self.far).min(1) + self.slack

    def distance(self, score: float) -> float:
        return float(np.sqrt(max(0.0, self.reach - 2.0 * score)))

    def score(self, distance: np.ndarray) -> np.ndarray:
        """The score at a distance."""
        return (self.reach - distance * distance) / 2


def pivot_table(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """Adds far, the distances of each row to the pivots. Rows that are near the same pivot stand together within a partition."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), pivots.dim)
            far = pivots.of_rows(x).astype("float32") if pivots.exact else np.zeros((len(x), 0), "float32")
            width = far.shape[1]
            starts = np.arange(len(x) + 1, dtype="int32") * width
            home = far.argmin(1).astype("int32") if width else np.zeros(len(x), "int32")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(starts, far.ravel()), pa.array(home)], names=[*names, "far", "home"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, far array<float>, home int").sortWithinPartitions("home").drop("home")


def rounds(queries: DataFrame, most: int = ROUND) -> Iterator[list[Row]]:
    """All rows of `queries` (a written table with an id), at most `most` at a time."""
    parts = max(1, -(-queries.count() // most))
    while True:
        part = F.pmod(F.xxhash64(*queries.columns), F.lit(parts))
        sizes = queries.groupBy(part.alias("part")).count().where(F.col("count") > most).limit(1)
        if sizes.isEmpty():
            break
        parts *= 2
    for k in range(parts):
        if found := queries.where(part == k).collect():
            yield found


def look(spark: SparkSession, table: DataFrame, pivots: Pivots, queries: list[Row], schema: str, arrow: pa.Schema, start: Callable[[Query], object], visit: Callable[[Query, Chunk, object], None], end: Callable[[Query, object], list[tuple]], number: int = 0) -> DataFrame:
    """Show every chunk of the table to every query of a round.

    Queries are numbered from `number` on. `start` makes what a query remembers within a task, `visit` changes it, and
    `end` gives the rows that are left of it after the task's last chunk.
    """
    q = matrix([r.v for r in queries], pivots.dim)
    slack = SLACK * float(np.sqrt(pivots.top) + np.sqrt((q * q).sum(1).max())) if pivots.exact else 0.0
    far = pivots.of_queries(q).astype("float32") if pivots.exact else np.zeros((len(q), 0), "float32")
    reach = pivots.reach(q)
    sent = spark.sparkContext.broadcast([Query(k, *x, slack) for k, x in enumerate(zip(queries, q, far, reach.tolist(), strict=True), number)])
    others = [c for c in table.columns if c not in ("id", "v", "far")]
    dim, width = pivots.dim, far.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_queries = sent.value
        memory = [start(query) for query in all_queries]
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                chunk = Chunk(
                    part.column("id").to_numpy(), matrix(part.column("v"), dim),
                    part.column("far").flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((part.num_rows, 0), "float32"),
                    {c: part.column(c).to_numpy(zero_copy_only=False) for c in others},
                )
                for query, known in zip(all_queries, memory, strict=True):
                    visit(query, chunk, known)
        out = [row for query, known in zip(all_queries, memory, strict=True) for row in end(query, known)]
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 10_000], strict=True), arrow.types, strict=True)], schema=arrow)

    return table.mapInArrow(run, schema)


class Best:
    """The first k of (score, id), higher scores first and ties by smaller id.

    `floor` is a score that k rows are known to reach: no lower one enters.
    """

    def __init__(self, k: int, floor: int | None = None):
        self.k, self.floor, self.scores, self.ids = k, floor, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, ~scores))[: self.k]  # ~s is -s - 1, without the overflow of -s
        self.scores, self.ids = scores[first], ids[first]

    @property
    def least(self) -> int | None:
        """The score that a newcomer must reach; None as long as there is room and no floor."""
        known = [int(self.scores[-1])] if len(self.scores) == self.k else []
        return max([*known, *([] if self.floor is None else [self.floor])], default=None)


#: Candidates that are evaluated first; each further step takes twice as many.
STEP = 64


def eliminate(query: Query, chunk: Chunk, wanted: np.ndarray, best: Best, scores: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Evaluate wanted rows in the order of their lower bounds, until no other can enter the best."""
    near = query.nearest(chunk)
    within = lambda: np.inf if best.least is None else query.distance(best.least)
    at = np.flatnonzero(wanted & (near <= within()))
    at = at[np.argsort(near[at], kind="stable")]
    done, step = 0, STEP
    while done < len(at) and near[at[done]] <= within():
        some = at[done : done + step]
        best.add(scores(chunk.x[some], query.q), chunk.ids[some])
        done, step = done + step, step * 2


def stored(rows: DataFrame, shelf: Shelf, pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[DataFrame, Pivots]:
    """The written pivot table of rows from whole_vectors."""
    rows = shelf.put("vectors", rows)
    chosen = Pivots.choose(rows, pivots, sample)
    table = shelf.put("table", pivot_table(rows, chosen))
    shelf.drop("vectors")
    return table, chosen
