"""Exact nearest neighbours between two tables, partitioned by pivots.

Every target belongs to its nearest pivot; a cell is such a group, dealt into
blocks of at most ``BLOCK_ROWS`` rows, and blocks into slots of about ``SLOT_ROWS``. A point first visits the nearest cells that
hold enough targets, which bounds the distance of its last neighbour. It then
visits only those other cells that the triangle inequality leaves possible:
d(point, pivot) minus the cell's radius, and the distance to the plane half-way
between the point's own pivot and the other, must not exceed that bound.
It travels once to each slot with cells that it visits, and what leaves a slot is within
that bound. Points stream past the slots, so no task holds more than one slot of targets
and one batch of points, and no table travels whole to any task. What every
task gets are the pivots, at most ``MOST_PIVOTS``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from tarn.functions.tables import written
from tarn.operators.drawing import smallest

CELL_ROWS, MOST_PIVOTS, BLOCK_ROWS, SLOT_ROWS, STEP = 1024, 2048, 4096, 32_768, 256
# Visits of one slot; more are dealt to copies of the slot.
VISITS = 50_000
SLACK = 1e-9

FEATURES = ArrayType(DoubleType())


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def keys(column: pa.Array) -> list[tuple]:
    return [tuple(v.values()) for v in column.to_pylist()]


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """All distances between two small sets."""
    d = (points**2).sum(1)[:, None] - 2 * points @ others.T + (others**2).sum(1)[None, :]
    return np.sqrt(np.maximum(d, 0))


def _cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``df`` with cell, its nearest pivot, and gap, the distance to it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, own, gap = matrix(batch.column("features"), pivots.shape[1]), [], []
            for a in range(0, len(points), STEP):
                d = distances(points[a : a + STEP], pivots)
                own.append(d.argmin(1))
                gap.append(np.sqrt(((points[a : a + STEP] - pivots[own[-1]]) ** 2).sum(1)))
            own, gap = (np.concatenate(x) if x else np.zeros(0) for x in (own, gap))
            yield batch.append_column("cell", pa.array(own, pa.int32())).append_column("gap", pa.array(gap, pa.float64()))

    return df.mapInArrow(task, StructType([*df.schema.fields, StructField("cell", IntegerType()), StructField("gap", DoubleType())]))


def _visits(df: DataFrame, pivots: np.ndarray, sizes: np.ndarray, radii: np.ndarray, within: np.ndarray, enough: int, again: bool) -> DataFrame:
    """(point, features, bound, slot, cells): the cells that a point visits at first, or ``again``, within ``bound``, all others that may hold a neighbour.

    One row for every slot that holds some of them; ``within`` tells which cells (rows) lie in which slots.
    """
    between = distances(pivots, pivots)

    def chosen(points: np.ndarray, bound: np.ndarray | None) -> np.ndarray:
        d = distances(points, pivots)
        order = np.argsort(np.where(sizes > 0, d, np.inf), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(sizes))[None, :], axis=1)
        first = rank <= (held < enough).sum(1)[:, None]
        if bound is None:
            return first & (sizes > 0)[None, :]
        own = d.argmin(1)
        gap = between[own]
        plane = np.divide(d**2 - d[np.arange(len(d)), own][:, None] ** 2, 2 * gap, out=np.zeros_like(d), where=gap > 0)
        reach = (bound * (1 + SLACK) + SLACK)[:, None]
        return ~first & (sizes > 0)[None, :] & (d - radii[None, :] <= reach) & (plane <= reach)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column("features"), pivots.shape[1])
            bound = batch.column("bound").to_numpy(zero_copy_only=False)
            for a in range(0, len(points), STEP):
                seen = chosen(points[a : a + STEP], bound[a : a + STEP] if again else None)
                for slot in range(within.shape[1]):
                    cells = np.flatnonzero(within[:, slot])
                    part = seen[:, cells]
                    rows = np.flatnonzero(part.any(axis=1))
                    if len(rows):
                        at = np.concatenate([[0], np.cumsum(part[rows].sum(axis=1))])
                        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(cells[np.nonzero(part[rows])[1]], pa.int32()))
                        met = batch.slice(a, STEP).select(["point", "features", "bound"]).take(pa.array(rows))
                        yield met.append_column("slot", pa.array(np.full(len(rows), slot), pa.int32())).append_column("cells", lists)

    added = [StructField("features", FEATURES), StructField("bound", DoubleType()), StructField("slot", IntegerType()), StructField("cells", ArrayType(IntegerType()))]
    return df.mapInArrow(task, StructType([df.schema["point"], *added]))


def _meet_task(k: int, width: int, same: bool):
    """Slots of targets (no point), each followed by the points that visit its cells: their ``k`` nearest of the slot, of those within their bound."""

    def nearest(points: pa.RecordBatch, names: pa.Array, block: np.ndarray, of_cell: dict[int, np.ndarray], own: list) -> pa.RecordBatch:
        known, rows, at, gaps = {v: i for i, v in enumerate(own)}, [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        longest = float((block**2).sum(1).max())
        for a in range(0, points.num_rows, STEP):
            some = points.slice(a, STEP)
            part, cells = matrix(some.column("features"), width), some.column("cells")
            visited, row_of = cells.flatten().to_numpy(), np.repeat(np.arange(len(part)), cells.value_lengths().to_numpy())
            me = np.array([known.get(p, -1) for p in keys(some.column("point"))]) if same else np.full(len(part), -1)
            bound = some.column("bound").to_numpy(zero_copy_only=False)
            # Distances by products are off by roundings of the squares.
            reach = np.sqrt(bound**2 + SLACK * ((part**2).sum(1) + longest)) * (1 + SLACK) + SLACK
            found = []
            for cell in np.unique(visited):
                if cell not in of_cell:
                    continue
                r, held = row_of[visited == cell], of_cell[cell]
                d = distances(part[r], block[held])
                d[held[None, :] == me[r][:, None]] = np.inf
                last = np.partition(d, min(k, len(held)) - 1, axis=1)[:, min(k, len(held)) - 1]
                row, col = np.nonzero((d <= np.minimum(last * (1 + SLACK) + SLACK, reach[r])[:, None]) & np.isfinite(d))
                found.append((r[row], held[col]))
            if not found:
                continue
            row, col = (np.concatenate(x) for x in zip(*found, strict=True))
            exact = np.sqrt(((part[row] - block[col]) ** 2).sum(1))
            by = np.lexsort((col, exact, row))
            row, col, exact = row[by], col[by], exact[by]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            rows.append(row[keep] + a)
            at.append(col[keep])
            gaps.append(exact[keep])
        row, col, gap = np.concatenate(rows), np.concatenate(at), np.concatenate(gaps)
        return pa.RecordBatch.from_arrays([points.column("point").take(pa.array(row)), names.take(pa.array(col)), pa.array(gap, pa.float64())], names=["point", "target", "distance"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            edges = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, len(place)], strict=True):
                part, where = batch.slice(a, b - a), tuple(place[a, :2]) if b > a else None
                if where is None:
                    continue
                if where != current:
                    current, held, block = where, [], None
                if not place[a, 2]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if block is None:
                    names = pa.concat_arrays([h.column("target") for h in held])
                    block = np.concatenate([matrix(h.column("features"), width) for h in held])
                    cell = np.concatenate([h.column("cell").to_numpy(zero_copy_only=False) for h in held]).astype(int)
                    of_cell = {int(c): np.flatnonzero(cell == c) for c in np.unique(cell)}
                    own = keys(names) if same else []
                yield nearest(part, names, block, of_cell, own)

    return task


def _met(visits: DataFrame, targets: DataFrame, k: int, width: int, same: bool) -> DataFrame:
    """(point, target, distance): up to ``k`` nearest of each slot visited."""
    point, target = visits.schema["point"].dataType, targets.schema["target"].dataType
    visits = written(visits, "visits")
    shape = visits.groupBy("slot").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("_copies"))
    shape = F.broadcast(shape)  # a row a slot
    null = lambda kind: F.lit(None).cast(kind)
    blocks = targets.join(shape, "slot").select(
        "slot", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("copy"), F.lit(0).alias("tag"), "target", null(point).alias("point"), "features", "cell", null("array<int>").alias("cells"), null("double").alias("bound")
    )
    asked = visits.join(shape, "slot").select(
        "slot", (F.abs(F.xxhash64("point")) % F.col("_copies")).cast("int").alias("copy"), F.lit(1).alias("tag"), null(target).alias("target"), "point", "features", null("int").alias("cell"), "cells", "bound"
    )
    dealt = blocks.union(asked).repartition("slot", "copy").sortWithinPartitions("slot", "copy", "tag", "target")
    return dealt.mapInArrow(_meet_task(k, width, same), StructType([visits.schema["point"], targets.schema["target"], StructField("distance", DoubleType())]))


def nearest(points: DataFrame, targets: DataFrame, key: Sequence[str], target_key: Sequence[str], k: int = 1, seed: int = 0, same: bool = False) -> DataFrame:
    """(point, target, distance, place): the ``k`` nearest targets of every point, ties to the smaller target.

    Both tables have ``features``, arrays of one width without nulls; point and
    target are structs of their key columns. ``same``: the two tables are one, and a point
    is not its own neighbour. Points keep all targets if there are fewer than
    ``k``; without points or targets there are no rows. Keys are unique.
    """
    asked = points.select(F.struct(*key).alias("point"), F.col("features").cast(FEATURES).alias("features"))
    known = targets.select(F.struct(*target_key).alias("target"), F.col("features").cast(FEATURES).alias("features"))
    one = known.first()
    if one is None:
        return asked.select("point", F.lit(None).cast(known.schema["target"].dataType).alias("target"), F.lit(0.0).alias("distance"), F.lit(0).alias("place")).limit(0)
    width, total = len(one.features), known.count()
    wanted = int(min(MOST_PIVOTS, max(1, total // CELL_ROWS)))
    drawn = smallest(known.select("target.*", "features"), wanted, target_key, seed)[0].select("features").distinct().collect()  # at most MOST_PIVOTS rows
    pivots = np.array(sorted(list(r.features) for r in drawn), float).reshape(len(drawn), width)
    celled = _cells(known, pivots)
    summary = celled.groupBy("cell").agg(F.count("*").alias("rows"), F.max("gap").alias("radius")).collect()  # a row a pivot
    sizes, radii = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in summary:
        sizes[r.cell], radii[r.cell] = r.rows, r.radius
    # Blocks follow one another into slots: a point travels once to each slot, however many of its cells it visits.
    parts = np.maximum(1, -(-sizes // BLOCK_ROWS))
    first = np.cumsum(parts) - parts
    share = np.repeat(sizes / parts, parts)
    slot_of = ((np.cumsum(share) - share) // SLOT_ROWS).astype(int)
    within = np.zeros((len(pivots), int(slot_of.max()) + 1), bool)
    within[np.repeat(np.arange(len(pivots)), parts), slot_of] = True
    of = lambda numbers, at: F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), at + 1)
    block = of(first, F.col("cell")) + (F.abs(F.xxhash64("target")) % of(parts, F.col("cell"))).cast("int")
    placed = written(celled.select(of(slot_of, block).alias("slot"), "cell", "target", "features"), "cells")
    enough = min(k + same, total)
    by_point = Window.partitionBy("point").orderBy("distance", "target")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(by_point)).filter(F.col("place") <= k)

    found = _met(_visits(asked.withColumn("bound", F.lit(float("inf"))), pivots, sizes, radii, within, enough, False), placed, k, width, same)
    if len(pivots) > 1:
        found = written(best(found).drop("place"), "near")
        bounds = found.groupBy("point").agg(F.max("distance").alias("bound"), F.count("*").alias("_n")).select("point", F.when(F.col("_n") < k, float("inf")).otherwise(F.col("bound")).alias("bound"))
        rest = _visits(asked.join(bounds, "point").select("point", "features", "bound"), pivots, sizes, radii, within, enough, True)
        found = found.union(_met(rest, placed, k, width, same))
    return best(found)
