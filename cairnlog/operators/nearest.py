"""An index of vectors for exact search of many queries.

Cells are the surroundings of centres, fitted on a bounded sample. Every vector belongs
to its nearest centre; rows are stored by cell and distance to the centre, and dealt to
tasks by place in that order, so a cell of any size is spread over tasks. Of a cell the
greatest distance (its radius) and the greatest length of its vectors are known.

By the triangle inequality a vector in a ring of a cell, at distances r to s from the
centre, is at least max(d - s, r - d) away from a query at distance d, and

    2 q.x = |q|^2 + |x|^2 - |q - x|^2

bounds its similarity from above; for unit vectors that is 1 - gap^2 / 2. A first round
sends every query to its best cell, which gives it a k-th best similarity. The second
round sends it to the other cells whose bound reaches that, and inside them only rings
whose bound does are multiplied. What is skipped cannot be among the best, so results
are those of a full scan. Queries are a table: they are shuffled, never collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import materialise
from ..plans.shipping import ship_code

#: Cells at most, vectors they are fitted on, and steps of the fit.
CELLS = 256
SAMPLE = 8_192
STEPS = 5
#: Numbers of one task's rows, and rows of one ring.
TASK_NUMBERS = 4_194_304
RING = 256
#: Added to bounds, more than rounding can take from a similarity of unit vectors.
SLACK = 1e-6


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of a matrix; all lists must be of one length."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8", copy=False).reshape(len(column), -1)


def similarities(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Products with one query, each summed up alike wherever its row stands."""
    return (vectors * query).sum(axis=1)


def fit_centres(sample: np.ndarray, cells: int, steps: int = STEPS) -> np.ndarray:
    """Centres of a sample: distinct vectors spread over it, then means of their cells."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(cells, len(centres))).astype(int)]
    for _ in range(steps if len(centres) else 0):
        nearest = _distances(sample, centres).argmin(axis=1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        used = counts > 0
        centres[used] = sums[used] / counts[used, None]
    return centres


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * vectors @ centres.T
    return np.sqrt(np.maximum(squares, 0.0))


def upper_bounds(
    distance: np.ndarray, length: np.ndarray, low: np.ndarray, high: np.ndarray, longest: np.ndarray
) -> np.ndarray:
    """Greatest similarity of a query with any vector of a ring.

    ``distance`` is the query's to the ring's centre, ``length`` its own; the ring's vectors
    are ``low`` to ``high`` away from the centre and at most ``longest`` long.
    """
    gap = np.maximum(np.maximum(distance - high, low - distance) - SLACK, 0.0)
    return (length**2 + longest**2 - gap**2) / 2 + SLACK * (1 + length * longest)


@dataclass
class VectorIndex:
    """Stored rows (``task, cell, place, key, vec``) and what is known of every cell.

    ``segments`` tells which tasks hold rows of a cell. The arrays have one entry per cell.
    """

    rows: DataFrame
    segments: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    longest: np.ndarray
    counts: np.ndarray
    tasks: int
    key: str

    def nearest(
        self,
        queries: DataFrame,
        top_k: int = 5,
        minimum: float | None = None,
        *,
        others_only: bool = False,
    ) -> DataFrame:
        """``query_id, <key>, similarity, rank``: the ``top_k`` most similar rows of every query.

        ``queries`` has ``query_id`` (distinct integers) and ``vec``. Ties go to the smaller
        key; with ``minimum`` only rows at least that similar count; with ``others_only`` a
        query does not find the row whose key is its id. Null vectors find nothing.
        """
        return self.search(queries, top_k, minimum, others_only=others_only)[0]

    def search(
        self,
        queries: DataFrame,
        top_k: int = 5,
        minimum: float | None = None,
        *,
        others_only: bool = False,
    ) -> tuple[DataFrame, DataFrame]:
        """``nearest`` and, per query, how many rows were multiplied: ``query_id, scored, total``."""
        spark = queries.sparkSession
        ship_code(spark)
        asking = materialise(
            queries.where(F.col("vec").isNotNull() & (F.size("vec") == self.centres.shape[1])).select(
                F.col("query_id").cast("long").alias("query_id"),
                F.transform("vec", lambda x: x.cast("double")).alias("vec"),
            ),
            "queries",
        )
        floor = -np.inf if minimum is None else float(minimum)
        start = asking.select("query_id", "vec", F.lit(floor).alias("worst"))
        first = self._round(start, top_k, others_only, first=True)
        best = _ranked(first.where(F.col(self.key).isNotNull()), self.key, top_k)
        worst = best.where(F.col("rank") == top_k).select("query_id", F.col("similarity").alias("kth"))
        again = asking.join(worst, "query_id", "left").select(
            "query_id", "vec", F.greatest(F.lit(floor), F.coalesce("kth", F.lit(float("-inf")))).alias("worst")
        )
        second = self._round(again, top_k, others_only, first=False)
        both = first.unionByName(second)
        found = _ranked(both.where(F.col(self.key).isNotNull()), self.key, top_k)
        report = both.where(F.col(self.key).isNull()).groupBy("query_id").agg(F.sum("scored").alias("scored"))
        return found, report.withColumn("total", F.lit(int(self.counts.sum())))

    def _round(self, asking: DataFrame, top_k: int, others_only: bool, *, first: bool) -> DataFrame:
        """Best rows of the tasks a query is sent to, stored, with a row on what was multiplied."""
        routed = self._routes(asking, top_k + others_only, first)
        sent = routed.join(self.segments, "cell").groupBy("task", "query_id").agg(
            F.collect_list("cell").alias("cells")
        )
        asks = sent.join(asking, "query_id").select(
            "task", F.lit(True).alias("asks"), "query_id", "vec", "worst", "cells"
        )
        # Rows of tasks that no query is sent to are not moved.
        asked = materialise(asks.select("task").distinct(), "asked-tasks")
        own = self.rows.join(asked, "task", "left_semi").select(
            "task", F.lit(False).alias("asks"), "place", F.col(self.key).alias("query_id"),
            "vec", F.col("distance").alias("worst"), F.array("cell").alias("cells"),
        )
        together = (
            own.unionByName(asks.withColumn("place", F.col("query_id")))
            .repartition(self.tasks, "task")
            .sortWithinPartitions("task", "asks", "place")
        )
        scan = _scanner(self.centres, self.key, top_k, others_only)
        kind = f"query_id long, {self.key} long, similarity double, scored long"
        return materialise(together.mapInArrow(scan, kind), "nearest-candidates")

    def _routes(self, asking: DataFrame, wanted: int, first: bool) -> DataFrame:
        """``query_id, cell`` of the cells to look into.

        The first round takes the cells with the best bounds that hold ``wanted`` rows
        between them; the second one all others whose bound reaches ``worst``.
        """
        centres, radius, longest, counts = self.centres, self.radius, self.longest, self.counts

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(centres):
                    continue
                vectors = matrix(batch.column("vec"))
                lengths = np.sqrt((vectors**2).sum(axis=1))[:, None]
                bounds = upper_bounds(_distances(vectors, centres), lengths, 0.0, radius, longest)
                order = np.argsort(-bounds, axis=1, kind="stable")
                held = np.cumsum(counts[order], axis=1) - counts[order]
                opening = np.zeros(bounds.shape, bool)
                np.put_along_axis(opening, order, held < wanted, axis=1)
                reach = bounds >= batch.column("worst").to_numpy()[:, None]
                which, cell = np.nonzero(reach & (opening if first else ~opening))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(pa.array(which)), pa.array(cell.astype("i4"))],
                    names=["query_id", "cell"],
                )

        return asking.mapInArrow(route, "query_id long, cell int")


def _scanner(centres: np.ndarray, key: str, top_k: int, others_only: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, waiting, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            tasks = batch.column("task").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(asks.astype("i1")) != 0)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for begin, end in zip(edges, edges[1:]):
                part = batch.slice(begin, end - begin)
                if task != tasks[begin]:
                    task, waiting, block = tasks[begin], [], None
                if not asks[begin]:
                    waiting.append(part)
                    continue
                if block is None:
                    block, waiting = _Rings(waiting, centres), []
                yield block.answer(part, key, top_k, others_only)

    return scan


class _Rings:
    """The rows of one task, cut into rings of their cells."""

    def __init__(self, parts: list[pa.RecordBatch], centres: np.ndarray) -> None:
        self.centres = centres
        columns = [pa.concat_arrays([part.column(name) for part in parts]) if parts else None
                   for name in ("query_id", "vec", "worst", "cells")]
        if not parts:
            self.starts = np.zeros(0, "i8")
            return
        self.keys = columns[0].to_numpy()
        self.vectors = matrix(columns[1])
        distance = columns[2].to_numpy()
        cells = columns[3].flatten().to_numpy()
        change = np.flatnonzero(np.diff(cells)) + 1
        edges = np.concatenate([[0], change, [len(cells)]])
        self.starts = np.concatenate([np.arange(a, b, RING) for a, b in zip(edges, edges[1:])])
        self.ends = np.concatenate([np.minimum(np.arange(a, b, RING) + RING, b) for a, b in zip(edges, edges[1:])])
        self.cells = cells[self.starts]
        self.low = np.minimum.reduceat(distance, self.starts)
        self.high = np.maximum.reduceat(distance, self.starts)
        self.longest = np.maximum.reduceat(np.sqrt((self.vectors**2).sum(axis=1)), self.starts)

    def answer(self, asks: pa.RecordBatch, key: str, top_k: int, others_only: bool) -> pa.RecordBatch:
        queries = asks.column("query_id").to_numpy()
        vectors, worsts = matrix(asks.column("vec")), asks.column("worst").to_numpy()
        lengths = np.sqrt((vectors**2).sum(axis=1))
        out: list[tuple[np.ndarray, ...]] = []
        scored = np.zeros(len(queries), "i8")
        for place, cells in enumerate(asks.column("cells").to_pylist() if len(self.starts) else []):
            own = np.flatnonzero(np.isin(self.cells, cells))
            distance = _distances(vectors[place : place + 1], self.centres[self.cells[own]])[0]
            bounds = upper_bounds(distance, lengths[place], self.low[own], self.high[own], self.longest[own])
            keys, near = np.zeros(0, "i8"), np.zeros(0)
            worst = worsts[place]
            for number in np.argsort(-bounds, kind="stable").tolist():
                if bounds[number] < worst:
                    break
                ring = slice(self.starts[own[number]], self.ends[own[number]])
                scored[place] += ring.stop - ring.start
                # A fast product picks those that may count; theirs is then computed alike.
                rough = self.vectors[ring] @ vectors[place]
                rows = ring.start + np.flatnonzero(rough >= worst - SLACK * (1 + abs(worst)) if np.isfinite(worst) else rough == rough)
                if others_only:
                    rows = rows[self.keys[rows] != queries[place]]
                exact = similarities(self.vectors[rows], vectors[place])
                fits = exact >= worst
                keys = np.concatenate([keys, self.keys[rows[fits]]])
                near = np.concatenate([near, exact[fits]])
                order = np.lexsort((keys, -near))[:top_k]
                keys, near = keys[order], near[order]
                if len(near) == top_k:
                    worst = max(worst, near[-1])
            out.append((np.full(len(keys), queries[place]), keys, near))
        ids, keys, near = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, "i8"),) * 3
        # One more row per query, without key, says how many rows were multiplied.
        none = len(queries)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids, queries]).astype("i8")),
                pa.array(np.concatenate([keys, np.zeros(none, "i8")]).astype("i8"),
                         mask=np.arange(len(keys) + none) >= len(keys)),
                pa.array(np.concatenate([near, np.zeros(none)]).astype("f8")),
                pa.array(np.concatenate([np.zeros(len(keys), "i8"), scored])),
            ],
            names=["query_id", key, "similarity", "scored"],
        )


def _ranked(found: DataFrame, key: str, top_k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked.select("query_id", key, "similarity", "rank")


def build_index(
    corpus: DataFrame, path: str | None = None, *, column: str = "vec", key: str = "chunk_index", cells: int = CELLS
) -> VectorIndex:
    """An index of all rows with a vector, stored under ``path`` or in the shared folder.

    Keys are distinct integers, vectors of one length and without null components. Centres
    are fitted on the ``SAMPLE`` rows with the smallest hashed keys; every row is indexed.
    """
    spark = corpus.sparkSession
    ship_code(spark)
    given = corpus.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(column).alias("vec"))
    sample = given.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("vec").collect()
    vectors = np.array([row["vec"] for row in sample], "f8") if sample else np.zeros((0, 0))
    centres = fit_centres(vectors, cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("vec"))
            distances = _distances(vectors, centres) if len(vectors) else np.zeros((0, 1))
            cell = distances.argmin(axis=1)
            extra = [pa.array(cell.astype("i4")), pa.array(distances[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[key, "vec", "cell", "distance"])

    dim = centres.shape[1] if len(centres) else 0
    doubles = given.withColumn("vec", F.col("vec").cast("array<double>"))
    placed = doubles.mapInArrow(place, f"{key} long, vec array<double>, cell int, distance double")
    if not dim:
        placed = doubles.where(F.lit(False)).select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("distance"))
    stored = materialise(placed, "placed-vectors")
    count = stored.count()
    tasks = max(1, -(-count * max(dim, 1) // TASK_NUMBERS), min(-(-count // 2_048), spark.sparkContext.defaultParallelism))
    ordered = stored.repartitionByRange(tasks, "cell", "distance", key).sortWithinPartitions("cell", "distance", key)
    rows = ordered.select(
        F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("place"), "cell", "distance", key, "vec"
    )
    if path is None:
        rows = materialise(rows, "vector-index")
    else:
        rows.write.parquet(f"{path}/rows")
        # One row per cell: the centres.
        spark.createDataFrame(
            [(i, centre.tolist()) for i, centre in enumerate(centres)], "cell int, centre array<double>"
        ).coalesce(1).write.parquet(f"{path}/centres")
        rows = spark.read.parquet(f"{path}/rows")
    return _index(rows, centres, tasks, key)


def read_index(spark: SparkSession, path: str, *, key: str = "chunk_index") -> VectorIndex:
    """An index that ``build_index`` stored under ``path``."""
    ship_code(spark)
    rows = spark.read.parquet(f"{path}/rows")
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    tasks = (rows.agg(F.max("task")).first()[0] or 0) + 1
    dim = len(centres[0]["centre"]) if centres else 0
    return _index(rows, np.array([row["centre"] for row in centres], "f8").reshape(-1, dim), tasks, key)


def _index(rows: DataFrame, centres: np.ndarray, tasks: int, key: str) -> VectorIndex:
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x))
    # One row per cell and task.
    segments = materialise(
        rows.groupBy("cell", "task").agg(
            F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"), F.max(length).alias("longest")
        ),
        "index-segments",
    )
    known = segments.groupBy("cell").agg(
        F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("longest").alias("longest")
    )
    radius, longest, counts = np.zeros(len(centres)), np.zeros(len(centres)), np.zeros(len(centres), "i8")
    # At most ``CELLS`` rows.
    for row in known.collect():
        radius[row["cell"]], longest[row["cell"]], counts[row["cell"]] = row["radius"], row["longest"], row["n"]
    return VectorIndex(rows, segments.select("cell", "task"), centres, radius, longest, counts, tasks, key)
