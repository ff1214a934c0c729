"""Cluster-based reduction: outliers, proportional allocation, sub-groups, representatives.

Centres are fitted on all rows: base ones by mini-batches in every task, sub-groups' in
rounds that sum where the rows lie; a draw
(SUB_ROWS rows, or four per sub-group in a cluster) only gives the sub-groups'
first centres, and those of a cluster with very many sub-groups part by part. No
cluster is ever held by one task.

Where features take few values (``different_points``), equal rows are one point with its number of
rows: everything but the representatives themselves is then found on the points, a table of checked size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tarn.functions.tables import written
from tarn.operators.drawing import check_size, few_smallest, smallest_of_groups
from tarn.operators.ordered import quantiles, quantiles_of_counts
from tarn.operators.stratified import allocate

# Fixed values of the reduction.
MIN_PER_CLUSTER, LEAST_BASE, MOST_BASE, OUTLIER_SHARE, OUTLIER_LEAST_ROWS = 30, 5, 50, 0.001, 10
SUB_ROWS, SEED_ROWS, LLOYD_ROUNDS, MOST_AT_ONCE = 2_000, 5_000, 12, 128
LEAST_GAIN = 0.01  # a round that lowers the squared distances by a smaller share is the last
STREAM_BATCH, STREAM_PASSES = 1024, 3
COMPILED_WIDTH = 64  # features of a distance that is written out as one sum
POINT_VALUES, LEAST_SHARED = 1_000_000, 4  # numbers of all points (8 MB), and rows a point, from which points stand for rows


@dataclass
class ClusterReduction:
    """Representatives with _weight; members (key columns, rep_id); rows left out as outliers."""

    rows: DataFrame
    members: DataFrame
    excluded: int
    notes: list[str] = field(default_factory=list)


def lloyd(points: np.ndarray, k: int, seed: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Centres of k-means with k-means++ seeding; fewer if there are fewer distinct points. ``rows``: how many each point, then unlike all others, stands for."""
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0) if rows is None else points
    weight = np.ones(len(points)) if rows is None else rows
    k = min(k, len(points))
    centres = [points[rng.integers(len(points))]]
    near = weight * ((points - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        total = near.sum()
        at = int(np.searchsorted(np.cumsum(near), rng.random() * total)) if total > 0 else int(rng.integers(len(points)))
        centres.append(points[min(at, len(points) - 1)])
        near = np.minimum(near, weight * ((points - centres[-1]) ** 2).sum(1))
    return moved_centres(points, np.array(centres), weight)


def moved_centres(points: np.ndarray, centres: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``centres`` after rounds over all points; an empty one stays."""
    for _ in range(LLOYD_ROUNDS):
        own = nearest_centre(points, centres)[0]
        count = np.bincount(own, weight, minlength=len(centres))
        sums = np.stack([np.bincount(own, weight * x, minlength=len(centres)) for x in points.T], axis=1)
        moved = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def nearest_centre(points: np.ndarray, centres: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to the nearest centre, in blocks of ``step`` points."""
    own, near = np.empty(len(points), np.int64), np.empty(len(points))
    for a in range(0, len(points), step):
        part = points[a : a + step]
        if len(centres) * step * points.shape[1] < 1 << 23:
            # A feature at a time: what is held stays in the processor's cache.
            d, gap = np.zeros((2, len(part), len(centres)))
            for x, c in zip(part.T, centres.T, strict=True):
                np.subtract(x[:, None], c, out=gap)
                gap *= gap
                d += gap
        else:
            d = (part**2).sum(1)[:, None] - 2 * part @ centres.T + (centres**2).sum(1)[None, :]
        own[a : a + step] = d.argmin(1)
        near[a : a + step] = np.sqrt(np.maximum(d.min(1), 0))
    return own, near


def fit_centres(df: DataFrame, k: int, seed: int, key: Sequence[str] = ()) -> np.ndarray:
    """k-means centres of the ``features`` of all rows: a draw of SEED_ROWS rows gives the first ones, mini-batches of all rows move them."""
    width = len(df.select("features").first().features)
    if k == 1:
        return np.array([df.agg(*[F.avg(F.col("features")[i]) for i in range(width)]).first()], float)
    drawn = few_smallest(df.select(*key, "features"), SEED_ROWS, key, seed).select(F.lit(0).alias("_cluster"), F.lit(k).alias("_alloc"), "features")
    first = drawn.groupBy("_cluster").applyInPandas(_sub_centres(seed), "_cluster int, centres array<double>").first()
    return stream_centres(df, np.array(first.centres).reshape(-1, width))


def _stream_batches(centres: np.ndarray):
    """Centres moved by the mini-batches of a task; each comes as rows held, summed squared distances, and rows times centre."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved, held, spread = centres.copy(), np.zeros(len(centres)), np.zeros(len(centres))
        for batch in batches:
            points = points_of(batch.column("features")) if batch.num_rows else np.zeros((0, centres.shape[1]))
            for a in range(0, len(points), STREAM_BATCH):
                part = points[a : a + STREAM_BATCH]
                own, near = nearest_centre(part, moved)
                new = np.bincount(own, minlength=len(moved))
                spread += np.bincount(own, near * near, minlength=len(moved))
                sums = np.stack([np.bincount(own, x, minlength=len(moved)) for x in part.T], axis=1)
                on = new > 0
                held += new
                # A centre's rate is the share of its rows so far that are new.
                moved[on] += (sums[on] - new[on, None] * moved[on]) / held[on, None]
        on = np.flatnonzero(held)
        whole = np.concatenate([held[on, None], spread[on, None], held[on, None] * moved[on]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(whole.tolist(), pa.list_(pa.float64()))], names=["centre", "sums"])

    return task


def stream_centres(df: DataFrame, centres: np.ndarray, passes: int = STREAM_PASSES) -> np.ndarray:
    """``centres`` after at most ``passes`` passes of mini-batch k-means over all rows and one full round.

    Every task streams its rows in batches of STREAM_BATCH and moves its own copy of the centres, each by
    its own falling rate; the copies are averaged by the rows that they hold. One job a pass, and a
    task holds one batch and k centres. The full round leaves true means. A centre without rows stays.
    """
    width, before = centres.shape[1], np.inf
    for _ in range(passes):
        parts = df.select("features").mapInArrow(_stream_batches(centres), "centre long, sums array<double>")
        total = parts.groupBy("centre").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width + 2)]).alias("sums")).collect()  # at most k rows
        spread = sum(r.sums[1] for r in total)
        centres = centres.copy()
        for r in total:
            centres[r.centre] = np.array(r.sums[2:]) / r.sums[0]
        if spread >= (1 - LEAST_GAIN) * before:
            break
        before = spread
    return sub_lloyd(df.select(F.lit(0).alias("_cluster"), "features"), {0: centres}, width, rounds=1)[0]


def points_of(column: pa.Array) -> np.ndarray:
    """A features column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def assign(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """``df`` with _cluster and _distance: the nearest of at most MOST_BASE centres. Features alone go to Python."""

    @F.arrow_udf("struct<_cluster: int, _distance: double>")
    def nearest(features: pa.Array) -> pa.Array:
        own, near = nearest_centre(points_of(features), centres)
        return pa.StructArray.from_arrays([pa.array(own, pa.int32()), pa.array(near)], names=["_cluster", "_distance"])

    return df.withColumn("_near", nearest("features")).select(*df.columns, "_near._cluster", "_near._distance")


def outlier_clusters(rows: int) -> int:
    return int(min(MOST_BASE, max(LEAST_BASE, round(np.sqrt(rows) / 4))))


def without_outliers(df: DataFrame, key: Sequence[str], seed: int = 0, share: float = OUTLIER_SHARE) -> tuple[DataFrame, int]:
    """Rows no farther from their centre than the (1 - share) quantile, and how many went.

    A centre that holds no more than that share of the rows is an outlier's own and does not count.
    """
    rows = df.count()
    if rows < OUTLIER_LEAST_ROWS or share <= 0:
        return df, 0
    centres = fit_centres(df, outlier_clusters(rows), seed, key)
    far = assign(df, centres).persist()
    sizes = {r["_cluster"]: r["count"] for r in far.groupBy("_cluster").count().collect()}  # at most MOST_BASE rows
    held = [i for i in range(len(centres)) if sizes.get(i, 0) > max(1, share * rows)]
    if held and len(held) < len(centres):
        far.unpersist()
        far = assign(df, centres[held]).persist()
    # The rows beyond a rough quantile below the one asked for hold it, and are few.
    low = far.approxQuantile("_distance", [1 - 2 * share], share / 4)[0] if 2 * share < 1 else 0.0
    tail = far.filter(F.col("_distance") >= F.lit(low))
    few = tail.count()
    place = ((1 - share) * (rows - 1) - (rows - few)) / max(few - 1, 1)
    edge = quantiles(tail, "_distance", [place])[place]
    kept = far.filter(F.col("_distance") <= F.lit(edge)).drop("_cluster", "_distance")  # read from ``far``, not held twice
    return kept, rows - kept.count()


def floored_allocation(sizes: DataFrame, n: int, order: Sequence[str], floor: int = MIN_PER_CLUSTER) -> DataFrame:
    """``sizes`` with alloc: proportional shares, at least min(floor, size); lifted marks raised ones."""
    shared = allocate(sizes, n, order)
    least = F.least(F.lit(floor), F.col("size"))
    return shared.withColumn("lifted", F.col("alloc") < least).withColumn("alloc", F.greatest("alloc", least))


def first_centres(points: np.ndarray, k: int, seed: int, rows: np.ndarray | None = None) -> np.ndarray:
    """About k centres; beyond MOST_AT_ONCE of parts of the points, each with its share of k. ``rows`` as in ``lloyd``."""
    if k <= MOST_AT_ONCE:
        return lloyd(points, k, seed, rows)
    parts = nearest_centre(points, lloyd(points, -(-k // MOST_AT_ONCE), seed, rows))[0]
    weight = np.ones(len(points)) if rows is None else rows
    inside = [parts == part for part in np.unique(parts)]
    return np.concatenate([lloyd(points[x], max(1, round(k * weight[x].sum() / weight.sum())), seed, None if rows is None else rows[x]) for x in inside])


def _sub_centres(seed: int):
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        points = np.array(frame["features"].tolist())
        centres = first_centres(points, int(frame["_alloc"].iloc[0]), seed)
        return pd.DataFrame({"_cluster": int(frame["_cluster"].iloc[0]), "centres": [centres.ravel().tolist()]})

    return fit


def _sub_assign(centres: dict[int, np.ndarray]):
    @F.arrow_udf("long")
    def nearest(features: pa.Array, clusters: pa.Array) -> pa.Array:
        points, cluster = points_of(features), clusters.to_numpy(zero_copy_only=False)
        rep = np.zeros(len(cluster), np.int64)
        for c in np.unique(cluster):
            at = np.flatnonzero(cluster == c)
            rep[at] = (int(c) << 32) + nearest_centre(points[at], centres[int(c)])[0]
        return pa.array(rep)

    return nearest("features", "_cluster")


def _sub_sums(centres: dict[int, np.ndarray]):
    """Rows, summed features and summed squared distances of each sub-group in a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros((len(x), x.shape[1] + 2)) for c, x in centres.items()}
        for batch in batches:
            if batch.num_rows:
                points, cluster = points_of(batch.column("features")), batch.column("_cluster").to_numpy(zero_copy_only=False)
                for c in np.unique(cluster):
                    at = points[cluster == c]
                    own, near = nearest_centre(at, centres[int(c)])
                    for k, x in enumerate([np.ones(len(at)), *at.T, near * near]):
                        sums[int(c)][:, k] += np.bincount(own, x, minlength=len(sums[int(c)]))
        for c, x in sums.items():
            on = np.flatnonzero(x[:, 0])
            rep = pa.array((c << 32) + on, pa.int64())
            yield pa.RecordBatch.from_arrays([rep, pa.array(x[on].tolist(), pa.list_(pa.float64()))], names=["rep_id", "sums"])

    return task


def sub_lloyd(based: DataFrame, centres: dict[int, np.ndarray], width: int, rounds: int = LLOYD_ROUNDS) -> dict[int, np.ndarray]:
    """``centres`` of each cluster's sub-groups after k-means rounds over all rows; an empty one stays."""
    before = np.inf
    for _ in range(rounds):
        parts = based.select("_cluster", "features").mapInArrow(_sub_sums(centres), "rep_id long, sums array<double>")
        total = parts.groupBy("rep_id").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width + 2)]).alias("sums")).collect()  # about n rows
        spread = sum(r.sums[-1] for r in total)
        centres = {c: x.copy() for c, x in centres.items()}
        for r in total:
            centres[r.rep_id >> 32][r.rep_id & 0xFFFFFFFF] = np.array(r.sums[1:-1]) / r.sums[0]
        if spread >= (1 - LEAST_GAIN) * before:
            break
        before = spread
    return centres


def subgroups(df: DataFrame, n: int, key: Sequence[str], seed: int, floor: int, known: dict[int, np.ndarray] | None = None) -> tuple[DataFrame, int]:
    """``df`` with rep_id: base clusters split into about n groups by size; and how many clusters were lifted.

    ``known`` holds base centres by their number; those fitted here are added. The result is persisted.
    """
    k = min(int(min(MOST_BASE, max(LEAST_BASE, round(n / max(floor, 1))))), max(1, df.count()))
    known = {} if known is None else known
    if k not in known:
        known[k] = fit_centres(df, k, seed, key)
    based = assign(df, known[k]).drop("_distance").persist()
    sizes = based.groupBy("_cluster").agg(F.count("*").alias("size"))
    alloc = floored_allocation(sizes, n, ["_cluster"], floor).persist()  # at most MOST_BASE rows
    lifted = alloc.agg(F.count_if("lifted")).first()[0]
    takes = alloc.select("_cluster", F.col("alloc").alias("_alloc"), F.greatest(F.lit(SUB_ROWS), 4 * F.col("alloc")).alias("_take"))
    sample = smallest_of_groups(based.select("_cluster", *key, "features"), ["_cluster"], takes, key, seed, once=True).select("_cluster", "_alloc", "features")
    fitted = sample.groupBy("_cluster").applyInPandas(_sub_centres(seed), "_cluster int, centres array<double>").collect()  # about n centres
    width = len(df.select("features").first().features)
    centres = sub_lloyd(based, {r["_cluster"]: np.array(r.centres).reshape(-1, width) for r in fitted}, width)
    grouped = based.withColumn("rep_id", _sub_assign(centres)).drop("_cluster").persist()
    grouped.count()
    based.unpersist(), alloc.unpersist()
    return grouped, lifted


def group_means(grouped: DataFrame, width: int) -> DataFrame:
    """(rep_id, size, centre): the mean features of each group."""
    return grouped.groupBy("rep_id").agg(F.count("*").alias("size"), F.array(*[F.avg(F.col("features")[i]) for i in range(width)]).alias("centre"))


def squared_gap(a: Column, b: Column, width: int | None = None) -> Column:
    """The squared distance of two arrays; of known width, a sum that Spark compiles."""
    if width:
        return reduce(lambda s, i: s + (a[i] - b[i]) * (a[i] - b[i]), range(width), F.lit(0.0))
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def medoids(grouped: DataFrame, means: DataFrame, key: Sequence[str], width: int | None = None) -> DataFrame:
    """The member nearest to its group's mean, one row per group, ties by key; with _weight."""
    # Written means and gaps are known to be small, so that members are not exchanged; those at the least gap alone are compared by key.
    near = grouped.join(written(means, "means"), "rep_id").withColumn("_gap", squared_gap(F.col("features"), F.col("centre"), width))
    least = written(near.groupBy("rep_id").agg(F.min("_gap").alias("_least")), "gaps")
    near = near.join(least, "rep_id").filter(F.col("_gap") == F.col("_least"))
    rest = [c for c in grouped.columns if c != "rep_id"]
    best = near.groupBy("rep_id").agg(F.min_by(F.struct(*rest), F.struct(*key)).alias("_row"), F.first("size").alias("size"))
    return best.select("_row.*", F.col("size").cast("double").alias("_weight"))


def different_points(df: DataFrame) -> DataFrame | None:
    """(features, _n): the different features of ``df`` and the rows at each, a table of checked size; None if there are too many to stand for the rows."""
    first = df.select("features").first()
    seen = df.agg(F.count("*").alias("rows"), F.approx_count_distinct("features").alias("points")).first()
    if first is None or LEAST_SHARED * seen.points > seen.rows or seen.points * len(first.features) > POINT_VALUES:
        return None
    return written(df.groupBy("features").agg(F.count("*").alias("_n")), "points")


def _fit_points(names: Sequence[str], seed: int):
    """For the points of one group: their sub-groups (rep_id, in the order of centres), base cluster and distance."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        # In one order, so that draws are the same each time.
        points = np.array(frame["features"].tolist())
        by = np.lexsort(points.T)
        points, frame = points[by], frame.iloc[by]
        rows, k, cluster = frame["_n"].to_numpy(float), int(frame["_alloc"].iloc[0]), int(frame["_cluster"].iloc[0])
        centres = first_centres(points, k, seed, rows)
        if k > MOST_AT_ONCE:
            centres = moved_centres(points, centres, rows)
        own, near = nearest_centre(points, centres)
        return pd.DataFrame({"features": frame["features"], "_n": frame["_n"], "rep_id": (cluster << 32) + own, "_distance": near})[list(names)]

    return fit


def fit_points(points: DataFrame, seed: int) -> DataFrame:
    """``points`` (features, _n, _cluster, _alloc) as (features, _n, rep_id, _distance): k-means of each cluster, points counted as the rows that they stand for.

    A task holds points of some clusters, of at most POINT_VALUES numbers in all.
    """
    names = ("features", "_n", "rep_id", "_distance")
    slots = points.sparkSession.sparkContext.defaultParallelism
    fitted = points.repartition(slots, "_cluster").groupBy("_cluster").applyInPandas(_fit_points(names, seed), "features array<double>, _n long, rep_id long, _distance double")
    return written(fitted, "fitted")


def points_without_outliers(points: DataFrame, seed: int = 0, share: float = OUTLIER_SHARE) -> tuple[DataFrame, int]:
    """``without_outliers`` for ``different_points``: those that stay, and how many rows went."""
    rows = points.agg(F.sum("_n")).first()[0] or 0
    if rows < OUTLIER_LEAST_ROWS or share <= 0:
        return points, 0
    whole = points.withColumns({"_cluster": F.lit(0), "_alloc": F.lit(outlier_clusters(rows))})
    far = fit_points(whole, seed)
    width = len(points.first().features)
    means = far.groupBy("rep_id").agg(F.sum("_n").alias("size"), F.array(*[F.sum(F.col("features")[i] * F.col("_n")) / F.sum("_n") for i in range(width)]).alias("centre")).collect()  # at most MOST_BASE rows
    held = [np.array(r.centre) for r in means if r["size"] > max(1, share * rows)]
    if held:
        far = written(assign(points, np.array(held)), "far")
    edge = quantiles_of_counts(far.groupBy(F.col("_distance").alias("v")).agg(F.sum("_n").alias("n")), [1 - share])[1 - share]
    kept = written(far.filter(F.col("_distance") <= F.lit(edge)).select("features", "_n"), "points")
    return kept, rows - kept.agg(F.sum("_n")).first()[0]


def subgroups_of_points(points: DataFrame, n: int, seed: int, floor: int) -> tuple[DataFrame, int]:
    """``subgroups`` for ``different_points``: (features, _n, rep_id), and how many clusters were lifted."""
    rows = points.agg(F.sum("_n")).first()[0]
    k = min(int(min(MOST_BASE, max(LEAST_BASE, round(n / max(floor, 1))))), max(1, rows))
    based = fit_points(points.withColumns({"_cluster": F.lit(0), "_alloc": F.lit(k)}), seed).select("features", "_n", F.col("rep_id").cast("int").alias("_cluster"))
    sizes = based.groupBy("_cluster").agg(F.sum("_n").alias("size"))
    alloc = written(floored_allocation(sizes, n, ["_cluster"], floor).select("_cluster", F.col("alloc").alias("_alloc"), "lifted"), "alloc")  # at most MOST_BASE rows
    fitted = fit_points(based.join(F.broadcast(alloc.drop("lifted")), "_cluster"), seed)
    return fitted.drop("_distance"), alloc.agg(F.count_if("lifted")).first()[0]


def representatives_of_points(df: DataFrame, points: DataFrame, key: Sequence[str], virtual: bool) -> DataFrame:
    """``representatives`` of the rows of ``df`` whose features are among ``points`` (features, _n, rep_id), which are sent to every task."""
    width = len(points.first().features)
    means = points.groupBy("rep_id").agg(F.sum("_n").alias("size"), F.array(*[F.sum(F.col("features")[i] * F.col("_n")) / F.sum("_n") for i in range(width)]).alias("centre"))
    if virtual:
        grouped = df.join(F.broadcast(points.select("features", "rep_id")), "features")
        plain = [c for c in df.columns if c != "features"]
        return virtual_rows(grouped, plain).join(means.select("rep_id", F.col("centre").alias("features")), "rep_id").drop("rep_id")
    near = points.join(means, "rep_id").withColumn("_gap", squared_gap(F.col("features"), F.col("centre"), width if width <= COMPILED_WIDTH else None))
    least = near.groupBy("rep_id").agg(F.min("_gap").alias("_least"))
    # Rows at the least gap alone are read in full; few of them leave their task.
    near = written(near.join(least, "rep_id").filter(F.col("_gap") == F.col("_least")).select("features", "rep_id", "size"), "gaps")
    met = df.join(F.broadcast(near), "features")
    best = met.groupBy("rep_id").agg(F.min_by(F.struct(*df.columns), F.struct(*key)).alias("_row"), F.first("size").alias("size"))
    return best.select("_row.*", F.col("size").cast("double").alias("_weight"))


def virtual_rows(grouped: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One made-up row per group: means of numbers, the commonest (then smallest) value of others; with _weight."""
    if "rep_id" not in grouped.columns:
        raise ValueError("virtual rows need the members of each group")
    parts = []
    for c in columns:
        kind = grouped.schema[c].dataType
        numeric = isinstance(kind, (NumericType, BooleanType))
        parts.append((F.avg(F.col(c).cast("double")) if numeric else F.mode(c, deterministic=True)).alias(c))
    return grouped.groupBy("rep_id").agg(*parts, F.count("*").cast("double").alias("_weight"))


def representatives(grouped: DataFrame, key: Sequence[str], virtual: bool) -> DataFrame:
    """The rows that stand for the groups of ``grouped`` (with features and rep_id): members, or made-up ones."""
    width = len(grouped.select("features").first().features)
    means = group_means(grouped, width)
    if not virtual:
        return medoids(grouped, means, key, width if width <= COMPILED_WIDTH else None)
    plain = [c for c in grouped.columns if c not in ("features", "rep_id")]
    return virtual_rows(grouped, plain).join(means.select("rep_id", F.col("centre").alias("features")), "rep_id").drop("rep_id")


def notes_of(gone: int, lifted: int, floor: int = MIN_PER_CLUSTER) -> list[str]:
    return [f"{gone} outliers left out"] * bool(gone) + [f"{lifted} rare clusters keep at least {floor} rows"] * bool(lifted)


def cluster_reduce(df: DataFrame, n: int, key: Sequence[str], seed: int = 0, virtual: bool = False, floor: int = MIN_PER_CLUSTER, drop_outliers: bool = True) -> ClusterReduction:
    """About n representatives of ``df`` (with features); the weights and excluded rows add up to all rows."""
    n = check_size(n, df.count())
    points = different_points(df)
    if points is not None:
        points, gone = points_without_outliers(points, seed) if drop_outliers else (points, 0)
        fitted, lifted = subgroups_of_points(points, n, seed, floor)
        members = df.join(F.broadcast(fitted), "features").select(*key, "rep_id")
        return ClusterReduction(representatives_of_points(df, fitted, key, virtual), members, gone, notes_of(gone, lifted, floor))
    live, gone = without_outliers(df, key, seed) if drop_outliers else (df, 0)
    grouped, lifted = subgroups(live, n, key, seed, floor)
    return ClusterReduction(representatives(grouped, key, virtual), grouped.select(*key, "rep_id"), gone, notes_of(gone, lifted, floor))
