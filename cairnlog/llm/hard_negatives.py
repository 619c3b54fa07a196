"""Hard negatives of anchors, found through angles to reference directions.

Every row is stored with its norm and its angles to a few reference directions. On the
unit sphere angles obey the triangle inequality: an anchor at angle a and a row at angle
b to the same direction are between |a - b| and a + b (or its reflection at 180 degrees)
apart. That gives an interval of cosines, and times both norms one of scores, widened so
that rounding cannot exclude a row.

Rows are sorted by nearest direction and the angle to it and cut into windows. A window
knows the range of its angles and norms, hence bounds of all its scores with an anchor.
Only windows whose bounds overlap the scores that still count get integer scores: above
the worst of the best so far for positives, between two scores for negatives.

Rows are dealt to tasks by place in that order, never by label, and anchors stream past
the rows of each task, so neither is collected and a hot label is spread like any other.
Positives are looked for in all tasks, negatives in those whose rows, taken as one long
window, can have such a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlog.plans.durable import materialise

from .shipping import ship_code
from .vector_rows import integer_vectors, matrix, usual_length

#: Reference directions, chosen among this many vectors. Results do not depend on them.
DIRECTIONS = 16
SAMPLE = 1024
#: Rows of a window, components held by one task, rows below which no task is made.
WINDOW = 256
TASK_NUMBERS = 4_194_304
LEAST_ROWS = 2_048
#: Anchors scored together, and candidates that wait before the best are taken of them.
TOGETHER = 64
WAITING = 8_192
#: Angles in radians are widened by this, far more than their rounding error.
SLACK = 1e-6


def reference_directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of the sample, each as far as can be from those before it."""
    norms = np.linalg.norm(sample, axis=1)
    units = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(units):
        units = np.ones((1, sample.shape[1])) / np.sqrt(sample.shape[1])
    chosen = [units[0]]
    nearest = units @ units[0]
    while len(chosen) < min(count, len(units)):
        chosen.append(units[int(nearest.argmin())])
        nearest = np.maximum(nearest, units @ chosen[-1])
    return np.array(chosen)


def angles_to(vectors: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of every vector to every direction; those of a null vector are 0."""
    cosines = vectors @ directions.T / np.where(norms > 0, norms, 1.0)[:, None]
    return np.where(norms[:, None] > 0, np.arccos(np.clip(cosines, -1.0, 1.0)), 0.0)


def score_bounds(
    angles: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, small: np.ndarray, great: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor with any row of each window.

    ``angles`` and ``norms`` are the anchors'; ``low`` to ``high`` and ``small`` to ``great``
    hold the angles and norms of each window. Null vectors have norm 0, so any angle is right.
    """
    a = angles[:, None, :]
    near = np.maximum(np.maximum(a - high, low - a), 0.0).max(axis=2)
    turned = np.where(a + low >= np.pi, 2 * np.pi - a - low, np.pi)
    far = np.where(a + high <= np.pi, a + high, turned).min(axis=2)
    most = np.cos(np.maximum(near - SLACK, 0.0))
    least = np.cos(np.minimum(far + SLACK, np.pi))
    upper = norms[:, None] * np.where(most >= 0, most * great, most * small)
    lower = norms[:, None] * np.where(least >= 0, least * small, least * great)
    # A score is a whole number, so one more than covers the rounding of the products.
    return lower - 1 - 1e-9 * np.abs(lower), upper + 1 + 1e-9 * np.abs(upper)


class _Best:
    """The first ``count`` candidates of every slot by score, then id, then row."""

    def __init__(self, slots: int, count: int) -> None:
        self.count = count
        self.worst = np.full(slots, -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.parts.append((slot, score, ids, rows))
        self.size += len(slot)
        if self.size > WAITING or len(self.parts) == 1:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            none = np.zeros(0, "i8")
            return none, none.astype("f8"), none, none
        slot, score, ids, rows = (np.concatenate(column) for column in zip(*self.parts))
        order = np.lexsort((rows, ids, -score, slot))
        slot, score, ids, rows = slot[order], score[order], ids[order], rows[order]
        first = np.searchsorted(slot, slot, "left")
        stays = np.arange(len(slot)) - first < self.count
        last = np.arange(len(slot)) - first == self.count - 1
        self.worst[slot[last]] = score[last]
        self.parts = [(slot[stays], score[stays], ids[stays], rows[stays])]
        self.size = 0
        return self.parts[0]


class Block:
    """The rows of one task, in windows."""

    def __init__(self, vectors: np.ndarray, norms: np.ndarray, angles: np.ndarray, labels: np.ndarray,
                 ids: np.ndarray, rows: np.ndarray) -> None:
        self.vectors, self.labels, self.ids, self.rows = vectors.astype("f8"), labels, ids, rows
        self.starts = np.arange(0, len(ids), WINDOW)
        self.low = np.minimum.reduceat(angles, self.starts)
        self.high = np.maximum.reduceat(angles, self.starts)
        self.small = np.minimum.reduceat(norms, self.starts)
        self.great = np.maximum.reduceat(norms, self.starts)
        self.scored = self.skipped = 0

    def bounds(self, norms: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return score_bounds(angles, norms, self.low, self.high, self.small, self.great)

    def _windows(self, upper: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Windows that promise most first."""
        for number in np.argsort(-upper.max(axis=0), kind="stable").tolist():
            yield number, slice(self.starts[number], self.starts[number] + WINDOW)

    def _scores(self, vectors: np.ndarray, active: np.ndarray, window: slice) -> np.ndarray:
        self.scored += len(active) * len(self.ids[window])
        return vectors[active] @ self.vectors[window].T

    def positives(self, anchors: dict[str, np.ndarray], count: int) -> tuple[np.ndarray, ...]:
        """Slot (anchor), score, id and row of the best rows of the anchor's label, itself excepted."""
        _, upper = self.bounds(anchors["norm"], anchors["angles"])
        best = _Best(len(upper), count)
        for number, window in self._windows(upper):
            active = np.flatnonzero(upper[:, number] >= best.worst)
            self.skipped += (len(upper) - len(active)) * len(self.ids[window])
            if not len(active):
                continue
            scores = self._scores(anchors["q"], active, window)
            counts = (anchors["label"][active, None] == self.labels[window]) & (
                anchors["row"][active, None] != self.rows[window]
            )
            which, column = np.nonzero(counts & (scores >= best.worst[active, None]))
            place = window.start + column
            best.add(active[which], scores[which, column], self.ids[place], self.rows[place])
        return best.settle()

    def negatives(
        self, anchors: dict[str, np.ndarray], count: int, low: int, of: int
    ) -> tuple[np.ndarray, ...]:
        """Slot (anchor times positives plus positive), score, id and row of rows with other labels.

        A negative score is between ``low`` / ``of`` of the positive score and that score.
        """
        slots = anchors["positive"].shape[1]
        most = anchors["positive"]
        # NaN stands for a positive that is not there.
        least = np.ceil(low * most / of)
        lower, upper = self.bounds(anchors["norm"], anchors["angles"])
        best = _Best(most.size, count)
        for number, window in self._windows(upper):
            floor = np.fmax(least, best.worst.reshape(most.shape))
            open_ = (upper[:, number, None] >= floor) & (lower[:, number, None] <= most) & (floor <= most)
            active = np.flatnonzero(open_.any(axis=1))
            self.skipped += (len(upper) - len(active)) * len(self.ids[window])
            if not len(active):
                continue
            scores = self._scores(anchors["q"], active, window)
            other = anchors["label"][active, None] != self.labels[window]
            for slot in range(slots):
                fits = other & (scores >= floor[active, slot, None]) & (scores <= most[active, slot, None])
                which, column = np.nonzero(fits & (least[active, slot] <= most[active, slot])[:, None])
                if len(which):
                    place = window.start + column
                    best.add(
                        active[which] * slots + slot, scores[which, column], self.ids[place], self.rows[place]
                    )
        return best.settle()


def _stored_rows(
    table: DataFrame, is_anchor: Column, scale: int, columns: tuple[str, str, str]
) -> tuple[DataFrame, int, int]:
    """Rows with norm, angles and task, stored; the vectors' length; tasks are numbered below the third value."""
    id_column, vector_column, label_column = columns
    named = table.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    asked = named.withColumn(label_column, F.struct(F.col(label_column).cast("string").alias("label"),
                                                    F.coalesce(is_anchor, F.lit(False)).alias("anchor")))
    whole = materialise(
        integer_vectors(asked, scale, id_column, vector_column, label_column).select(
            F.monotonically_increasing_id().alias("row"), "id", "label.label", "label.anchor", "q"
        ),
        "integer-vectors",
    )
    width, count = usual_length(whole)
    vectors = whole.where(F.size("q") == width)
    greatest = vectors.agg(F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))).first()[0] or 0
    if width * greatest**2 >= 2**53 // 100:
        raise ValueError("components are too large for exact scores")
    sample = vectors.orderBy(F.xxhash64("id"), "row").select("q").limit(SAMPLE).collect()
    directions = reference_directions(
        np.array([row["q"] for row in sample], "f8").reshape(-1, max(width, 1)), DIRECTIONS
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("q"), width, "f8")
            norms = np.sqrt((rows**2).sum(axis=1))
            angles = angles_to(rows, norms, directions)
            home = angles.argmin(axis=1) if len(rows) else np.zeros(0, "i8")
            extra = {
                "norm": pa.array(norms),
                "angles": pa.FixedSizeListArray.from_arrays(
                    pa.array(angles.reshape(-1)), len(directions)
                ).cast(pa.list_(pa.float64())),
                "home": pa.array(home.astype("i4")),
                "turn": pa.array(angles[np.arange(len(rows)), home]),
            }
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *extra.values()], names=[*batch.schema.names, *extra]
            )

    kind = (
        "row long, id long, label string, anchor boolean, q array<int>, "
        "norm double, angles array<double>, home int, turn double"
    )
    per_task = max(WINDOW, TASK_NUMBERS // max(width, 1))
    spread = min(-(-count // LEAST_ROWS), table.sparkSession.sparkContext.defaultParallelism)
    tasks = max(1, -(-count // per_task), spread)
    measured = vectors.mapInArrow(measure, kind) if width else vectors.where(F.lit(False)).select(
        "*", F.lit(0.0).alias("norm"), F.array(F.lit(0.0)).alias("angles"), F.lit(0).alias("home"),
        F.lit(0.0).alias("turn"),
    )
    placed = measured.repartitionByRange(tasks, "home", "turn", "row").sortWithinPartitions(
        "home", "turn", "row"
    )
    stored = placed.select(
        F.spark_partition_id().alias("task"),
        F.monotonically_increasing_id().alias("place"),
        "row", "id", "label", "anchor", "q", "norm", "angles",
    )
    kept = materialise(stored, "measured-vectors")
    # The session may have dealt the rows to another number of partitions than asked for.
    last = kept.agg(F.max("task")).first()[0]
    return kept, width, 1 if last is None else last + 1


def _everywhere(anchors: DataFrame, tasks: int) -> DataFrame:
    """Anchors once for every task."""
    return anchors.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))


def _where_negatives_can_be(rows: DataFrame, anchors: DataFrame, tasks: int, low: int, of: int) -> DataFrame:
    """Anchors once for every task whose rows can have a score that one of their positives asks for.

    A task's rows are one long window: their bounds are those of its angles and norms.
    """
    directions = F.max(F.size("angles"))
    count = rows.agg(directions).first()[0] or 0
    ends = [(f"{name}{i}", end(F.col("angles")[i])) for i in range(count) for name, end in (("low", F.min), ("high", F.max))]
    ends += [("small", F.min("norm")), ("great", F.max("norm"))]
    low_angles, high_angles = np.zeros((tasks, count)), np.full((tasks, count), np.pi)
    small, great, held = np.zeros(tasks), np.zeros(tasks), np.zeros(tasks, bool)
    # One row per task.
    for row in rows.groupBy("task").agg(*(value.alias(name) for name, value in ends)).collect():
        task = row["task"]
        low_angles[task] = [row[f"low{i}"] for i in range(count)]
        high_angles[task] = [row[f"high{i}"] for i in range(count)]
        small[task], great[task], held[task] = row["small"], row["great"], True

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            most = matrix(batch.column("positive"), len(batch.column("positive")[0]), "f8")
            lower, upper = score_bounds(
                matrix(batch.column("angles"), count, "f8"), batch.column("norm").to_numpy(),
                low_angles, high_angles, small, great,
            )
            least = np.ceil(low * most / of)[:, None, :]
            fits = (upper[:, :, None] >= least) & (lower[:, :, None] <= most[:, None, :]) & (least <= most[:, None, :])
            which, task = np.nonzero(fits.any(axis=2) & held)
            sent = batch.take(pa.array(which))
            place = batch.schema.get_field_index("task")
            yield sent.set_column(place, "task", pa.array(task.astype("i4")))

    return anchors.mapInArrow(route, anchors.schema)


_FOUND = "anchor_row long, anchor long, slot int, score long, id long, row long"


def _scan(
    rows: DataFrame, anchors: DataFrame, width: int, tasks: int, slots: int, count: int, limits: tuple[int, int] | None
) -> DataFrame:
    """The best rows of every task for every anchor sent to it, and slot.

    ``anchors`` has the columns of ``rows``, of which ``task`` says where it is sent, and
    ``positive``, an array of ``slots`` scores (NaN where there is none). Each task gets its
    rows first, then its anchors.
    """
    # A task's rows are its windows in stored order; anchors follow in the same order.
    own = rows.select("*", F.lit(False).alias("asks"), F.lit(None).cast("array<double>").alias("positive"))
    asking = anchors.select(*rows.columns, F.lit(True).alias("asks"), "positive")
    together = (
        own.unionByName(asking)
        .repartition(tasks, "task")
        .sortWithinPartitions("task", "asks", "place")
        .drop("place", "anchor")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, waiting, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {
                "task": batch.column("task").to_numpy(),
                "asks": batch.column("asks").to_numpy(zero_copy_only=False),
                "row": batch.column("row").to_numpy(),
                "id": batch.column("id").to_numpy(),
                "label": batch.column("label").to_numpy(zero_copy_only=False),
                "norm": batch.column("norm").to_numpy(),
                "q": matrix(batch.column("q"), width, "f8"),
            }
            columns["angles"] = matrix(batch.column("angles"), len(batch.column("angles")[0]), "f8")
            change = np.flatnonzero(
                (np.diff(columns["task"]) != 0) | (np.diff(columns["asks"].astype("i1")) != 0)
            )
            edges = [0, *(change + 1).tolist(), batch.num_rows]
            for begin, end in zip(edges, edges[1:]):
                part = {name: values[begin:end] for name, values in columns.items()}
                if task != part["task"][0]:
                    task, waiting, block = part["task"][0], [], None
                if not part["asks"][0]:
                    waiting.append(part)
                    continue
                if block is None:
                    block = _block(waiting)
                    waiting = []
                scores = batch.column("positive").slice(begin, end - begin)
                part["positive"] = matrix(scores, slots, "f8") if slots else np.zeros((end - begin, 0))
                if block is None:
                    continue
                for at in range(0, end - begin, TOGETHER):
                    few = {name: values[at : at + TOGETHER] for name, values in part.items()}
                    yield _answer(block, few, count, limits)

    return together.mapInArrow(scan, _FOUND)


def _block(parts: list[dict[str, np.ndarray]]) -> Block | None:
    if not parts:
        return None
    joined = {name: np.concatenate([part[name] for part in parts]) for name in parts[0]}
    return Block(*(joined[name] for name in ("q", "norm", "angles", "label", "id", "row")))


def _answer(
    block: Block, anchors: dict[str, np.ndarray], count: int, limits: tuple[int, int] | None
) -> pa.RecordBatch:
    if limits is None:
        slot, score, ids, rows = block.positives(anchors, count)
        anchor, slot = slot, np.zeros(len(slot), "i8")
    else:
        slot, score, ids, rows = block.negatives(anchors, count, *limits)
        anchor, slot = np.divmod(slot, anchors["positive"].shape[1])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(anchors["row"][anchor]),
            pa.array(anchors["id"][anchor]),
            pa.array(slot.astype("i4")),
            pa.array(score.astype("i8")),
            pa.array(ids),
            pa.array(rows),
        ],
        names=["anchor_row", "anchor", "slot", "score", "id", "row"],
    )


def _first(found: DataFrame, count: int, label: str) -> DataFrame:
    """The first ``count`` of every anchor and slot over all tasks, with ``rank`` from 1; stored."""
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    return materialise(ranked, label)


def mine_hard_negatives(
    table: DataFrame,
    is_anchor: Column,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    of: int = 100,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components times ``scale`` are rounded down; a score is the inner product with the
    anchor, higher scores first, ties by smaller id. Positives of an anchor (a row with
    ``is_anchor``) are its first other rows of its label. For each, the first rows of other
    labels are returned whose score is at most the positive's and at least ``low`` / ``of``
    of it; for a negative positive score there are none.

    Rows without id or label, with a null or empty vector, with null or other than finite
    components, or with another vector length than most rows have take no part. Rows that
    repeat an id are rows of their own, also as anchors and as positives of each other.
    Null vectors (all components 0) have score 0. An empty table gives no rows. Vectors
    whose scores would not be exact are refused. Other columns are ignored.
    """
    ship_code(table.sparkSession)
    rows, width, tasks = _stored_rows(table, is_anchor, scale, (id_column, vector_column, label_column))
    anchors = rows.where("anchor")
    none = F.array().cast("array<double>").alias("positive")
    found = _first(
        _scan(rows, _everywhere(anchors.select("*", none), tasks), width, tasks, 0, positives, None),
        positives,
        "positives",
    )
    scores = found.groupBy("anchor_row").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", F.col("score").cast("double")))).alias("by_rank")
    )
    every = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda rank: F.try_element_at("by_rank", rank))
    asking = anchors.join(scores, F.col("row") == F.col("anchor_row")).select(
        *rows.columns, F.transform(every, lambda x: F.coalesce(x, F.lit(float("nan")))).alias("positive")
    )
    sent = _where_negatives_can_be(rows, asking, tasks, low, of)
    mined = _first(
        _scan(rows, sent, width, tasks, positives, negatives, (low, of)), negatives, "hard-negatives"
    )
    known = found.select(
        F.col("anchor_row").alias("of_row"),
        (F.col("rank") - 1).alias("of_slot"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    same = (F.col("anchor_row") == F.col("of_row")) & (F.col("slot") == F.col("of_slot"))
    return mined.join(known, same).select(
        F.col("anchor").alias("anchor_id"),
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
