"""Two-dimensional layouts of all rows: t-SNE, and one of a fuzzy neighbour graph.

Both start from the principal components and a table of nearest neighbours
(``neighbours``), and move the rows in rounds. Rows are dealt into blocks of at most
``BLOCK_ROWS``, cut along the first component, so that most neighbours of a row
are in its block. A round hands every block its own rows, its links and the
places of neighbours elsewhere as they were at the round's begin; the block makes
``STEPS`` steps (``STEPS_ALONE`` if there is no other) and gives its rows' new places, a written table. What every task
gets besides is bounded: for t-SNE the field of all repulsions on a grid of at
most ``GRID`` by ``GRID`` nodes, for the other a draw of ``NEGATIVES`` places.
Draws are by key and seed, so a layout is the same each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.tables import written
from tarn.operators.charts import axes_of
from tarn.operators.neighbours import nearest

BLOCK_ROWS, SLICES = 2_000, 256
# Steps of a round: a block that is alone needs no news of others.
STEPS, STEPS_ALONE = 4, 25
PERPLEXITY, TSNE_STEPS, EARLY_SHARE, EXAGGERATION = 30.0, 400, 0.25, 12.0
GRID, SPACING = 512, 0.25
MET_AT_ONCE = 64
GRAPH_NEIGHBOURS, NEGATIVES, PUSHES, GRAPH_STEPS = 15, 4_096, 5, 200
# 1 / (1 + A d^2B) is near 1 up to a distance of 0.1 and then falls like exp(0.1 - d).
A, B = 1.577, 0.8951
LONGEST = 5.0


def neighbour_rows(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """(i, near: array of (distance, j)): the ``k`` nearest other rows of every row, nearest first."""
    met = nearest(df, df, [key], [key], k, seed, same=True)
    return met.groupBy(F.col("point")[key].alias("i")).agg(F.array_sort(F.collect_list(F.struct("distance", F.col("target")[key].alias("j")))).alias("near"))


def perplexity_weights(distance: np.ndarray, perplexity: float) -> np.ndarray:
    """Rows of probabilities, falling with the squared distance, whose entropy is that of ``perplexity`` equal ones."""
    d = distance**2 - (distance**2).min(axis=1, keepdims=True)
    scale = np.maximum(d.mean(axis=1), 1e-12)
    low, high, beta = np.zeros(len(d)), np.full(len(d), np.inf), 1 / scale
    want = np.log(min(perplexity, d.shape[1]))
    for _ in range(100):
        p = np.exp(-d * beta[:, None])
        total = p.sum(axis=1)
        entropy = np.log(total) + beta * (d * p).sum(axis=1) / total
        flat = entropy > want
        low, high = np.where(flat, beta, low), np.where(flat, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return p / total[:, None]


def fuzzy_weights(distance: np.ndarray) -> np.ndarray:
    """Memberships that are 1 at the nearest row and whose sum is the logarithm of the number of neighbours."""
    gap = distance - distance.min(axis=1, keepdims=True)
    low, high, width = np.zeros(len(gap)), np.full(len(gap), np.inf), np.ones(len(gap))
    want = np.log2(gap.shape[1]) if gap.shape[1] > 1 else 1.0
    for _ in range(100):
        wide = np.exp(-gap / width[:, None]).sum(axis=1) > want
        low, high = np.where(wide, low, width), np.where(wide, width, high)
        width = np.where(np.isinf(high), width * 2, np.maximum((low + high) / 2, 1e-12))
    return np.exp(-gap / width[:, None])


def weighted_links(near: DataFrame, weigh: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(i, j, w) from neighbour rows."""
    kind = near.schema["i"].dataType.simpleString()

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            # Rows of one number of neighbours make a matrix; a table has few such numbers.
            for size, part in f.groupby(f["near"].map(len)):
                distance = np.array([[n["distance"] for n in row] for row in part["near"]])
                yield pd.DataFrame({"i": np.repeat(part["i"].to_numpy(), size), "j": [n["j"] for row in part["near"] for n in row], "w": weigh(distance).ravel()})

    return near.mapInPandas(task, f"i {kind}, j {kind}, w double")


def both_ways(links: DataFrame) -> DataFrame:
    """(i, j, w, back): every link in either direction with the weights it has there, 0 if none."""
    forth = links.select("i", "j", "w", F.lit(0.0).alias("back"))
    back = links.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("w"), F.col("w").alias("back"))
    return forth.union(back).groupBy("i", "j").agg(F.sum("w").alias("w"), F.sum("back").alias("back"))


def start(df: DataFrame, key: str, deviation: float) -> tuple[DataFrame, int]:
    """(i, block, x, y, vx, vy): first places, the two principal components scaled to ``deviation``; and the number of rows."""
    first = df.select("features").first()
    mean, axes = axes_of(df, len(first.features))
    width = len(mean)
    parts = [sum(((F.col("features")[i] - float(mean[i])) * float(a[i]) for i in range(width)), F.lit(0.0)) for a in axes]
    parts += [F.lit(0.0)] * (2 - len(parts))
    spread = df.agg(F.count("*").alias("n"), F.stddev_pop(parts[0]).alias("d")).first()
    scale = deviation / spread.d if spread.d else 0.0
    # Rows of equal features part by their keys.
    shift = [(F.xxhash64(F.lit(c), F.col(key)) % 1000) / 1000 * (deviation * 1e-3) for c in "xy"]
    placed = df.select(F.col(key).alias("i"), *[(p * scale + s).alias(c) for p, s, c in zip(parts, shift, "xy", strict=True)])
    slices = int(min(SLICES, -(-spread.n // BLOCK_ROWS)))
    cuts = sorted(set(placed.approxQuantile("x", [j / slices for j in range(1, slices)], 0.001))) if slices > 1 else []
    slice_of = sum((F.when(F.col("x") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    parts_of_slice = -(-spread.n // (SLICES * BLOCK_ROWS))
    block = slice_of * parts_of_slice + (F.abs(F.xxhash64("i")) % parts_of_slice).cast("int")
    return placed.select("i", block.cast("int").alias("block"), "x", "y", F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy")), spread.n


@dataclass
class Block:
    """A block in a round: places and speeds of its rows, then places of their neighbours elsewhere, and links by position."""

    places: np.ndarray
    speed: np.ndarray
    own: int
    i: np.ndarray
    j: np.ndarray
    w: np.ndarray
    number: int


def run_round(at: DataFrame, links: DataFrame, abroad: DataFrame, move: Callable[[Block], None]) -> DataFrame:
    """New places after ``move`` has changed the first ``own`` places and speeds of each block."""
    kind = at.schema["i"].dataType.simpleString()
    guests = abroad.join(at.select(F.col("i").alias("j"), "x", "y"), "j").select("j", "block", "x", "y", F.lit(None).cast("double").alias("vx"), F.lit(None).cast("double").alias("vy"))
    rows = at.union(guests)

    def task(links: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        # Links come sorted, so that sums are the same each time.
        rows = rows.assign(guest=rows["vx"].isna()).sort_values(["guest", "i"], ignore_index=True)
        own = int((~rows["guest"]).sum())
        index = pd.Index(rows["i"])
        block = Block(rows[["x", "y"]].to_numpy(float), rows[["vx", "vy"]].to_numpy(float)[:own].copy(), own, index.get_indexer(links["i"]), index.get_indexer(links["j"]), links["w"].to_numpy(float), int(rows["block"].iloc[0]))
        block.places = block.places.copy()
        move(block)
        out = rows.iloc[:own][["i", "block"]]
        return out.assign(x=block.places[:own, 0], y=block.places[:own, 1], vx=block.speed[:, 0], vy=block.speed[:, 1])

    moved = links.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(task, f"i {kind}, block int, x double, y double, vx double, vy double")
    return written(moved, "layout")


def parts_of(steps: int, rows: int) -> Iterator[tuple[int, int]]:
    """(steps before, steps) of each round."""
    most = STEPS_ALONE if rows <= BLOCK_ROWS else STEPS
    for done in range(0, steps, most):
        yield done, min(most, steps - done)


def dealt_links(links: DataFrame, at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, i, j, w), and (block, j) of the rows that a block needs from others."""
    blocks = at.select("i", "block")
    own = written(links.join(blocks, "i"), "links")
    far = own.join(blocks.select(F.col("i").alias("j"), F.col("block").alias("home")), "j").filter(F.col("home") != F.col("block"))
    own = own.repartition("block").sortWithinPartitions("block", "i", "j").persist()  # read in every round
    return own, written(far.select("block", "j").distinct(), "abroad")


class Field:
    """Sums of repulsion over all rows on a grid: kernels 1 / (1 + d^2) and its square, by Fourier transform."""

    def __init__(self, at: DataFrame) -> None:
        ends = at.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]).first()
        self.low = np.array([ends.lowx, ends.lowy])
        span = max(ends.highx - ends.lowx, ends.highy - ends.lowy, 1e-9)
        self.size = int(min(GRID, max(32, np.ceil(span / SPACING) + 2)))
        self.step = span / (self.size - 2)
        u, v = ((F.col(c) - float(low)) / float(self.step) for c, low in zip("xy", self.low, strict=True))
        a, b = F.floor(u), F.floor(v)
        p, q = u - a, v - b
        nodes = [F.struct((a + i).alias("a"), (b + j).alias("b"), ((p if i else 1 - p) * (q if j else 1 - q)).alias("c")) for i in (0, 1) for j in (0, 1)]
        sums = at.select("x", "y", F.explode(F.array(*nodes)).alias("n")).groupBy("n.a", "n.b").agg(F.sum("n.c"), F.sum(F.col("n.c") * F.col("x")), F.sum(F.col("n.c") * F.col("y")))
        charge = np.zeros((3, self.size, self.size))
        for row in sums.collect():  # at most GRID * GRID nodes
            charge[:, row[0], row[1]] = row[2:]
        self.count = charge[0].sum()
        shift = np.minimum(np.arange(2 * self.size), 2 * self.size - np.arange(2 * self.size)) * self.step
        kernel = 1 / (1 + shift[:, None] ** 2 + shift[None, :] ** 2)
        spread = lambda k, c: np.fft.irfft2(np.fft.rfft2(k) * np.fft.rfft2(c, (2 * self.size,) * 2), (2 * self.size,) * 2)[: self.size, : self.size]
        self.sums = np.stack([spread(kernel**2, c) for c in charge])
        # Every row meets itself once.
        self.total = max(float((spread(kernel, charge[0]) * charge[0]).sum() - self.count), 1e-9)

    def push(self, places: np.ndarray) -> np.ndarray:
        """The repulsion at ``places``, not yet divided by the total."""
        at = np.clip((places - self.low) / self.step, 0, self.size - 1.001)
        node = at.astype(int)
        part = at - node
        value = sum(
            self.sums[:, node[:, 0] + i, node[:, 1] + j] * (part[:, 0] if i else 1 - part[:, 0]) * (part[:, 1] if j else 1 - part[:, 1]) for i in (0, 1) for j in (0, 1)
        )
        return places * value[0][:, None] - value[1:].T


def mutual(places: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, float]:
    """The repulsion at ``places`` from ``others``, and the sum of the kernel; MET_AT_ONCE places at a time stay in the processor's cache."""
    # The product of left and right is 1 + d^2.
    left = np.column_stack([places, (places**2).sum(1) + 1, np.ones(len(places))])
    right = np.ascontiguousarray(np.column_stack([-2 * others, np.ones(len(others)), (others**2).sum(1)]).T)
    charges = np.column_stack([np.ones(len(others)), others])
    push, total = np.empty((len(places), 2)), 0.0
    room = np.empty((min(MET_AT_ONCE, len(places)), len(others)))
    for a in range(0, len(places), MET_AT_ONCE):
        part = places[a : a + MET_AT_ONCE]
        q = np.matmul(left[a : a + MET_AT_ONCE], right, out=room[: len(part)])
        np.maximum(q, 1, out=q)
        np.divide(1, q, out=q)
        total += float(q.sum())
        np.multiply(q, q, out=q)
        sums = q @ charges
        push[a : a + MET_AT_ONCE] = part * sums[:, :1] - sums[:, 1:]
    return push, total


def pull(block: Block) -> np.ndarray:
    """The attraction of a block's own rows along their links."""
    gap = block.places[block.i] - block.places[block.j]
    force = (block.w / (1 + (gap**2).sum(axis=1)))[:, None] * gap
    return np.stack([np.bincount(block.i, force[:, c], block.own) for c in (0, 1)], axis=1)


def tsne(df: DataFrame, key: str, perplexity: float = PERPLEXITY, steps: int = TSNE_STEPS, seed: int = 0) -> DataFrame:
    """(``key``, x, y): t-SNE of the ``features`` of all rows.

    Probabilities reach over three times ``perplexity`` neighbours; a table of
    fewer rows takes all. The first rounds pull ``EXAGGERATION`` times as hard.
    Repulsion comes from the field at the round's begin. Rows of equal features
    stay close; a table of one row, or none, is its own layout. Keys are unique and not null,
    features without nulls.
    """
    if df.isEmpty():
        return df.select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    at, n = start(df, key, 0.1)
    at = written(at, "layout")
    if n > 1:
        near = neighbour_rows(df, key, int(3 * perplexity), seed)
        pairs = both_ways(weighted_links(near, lambda d: perplexity_weights(d, perplexity)))
        links, abroad = dealt_links(pairs.select("i", "j", ((F.col("w") + F.col("back")) / (2 * n)).alias("w")), at)
        for done, some in parts_of(steps, n):
            early = done < EARLY_SHARE * steps
            at = run_round(at, links, abroad, _tsne_move(Field(at), some, EXAGGERATION if early else 1.0, max(n / EXAGGERATION / 4, 50.0), 0.5 if early else 0.8))
    return at.select(F.col("i").alias(key), "x", "y")


def _tsne_move(field: Field, steps: int, exaggeration: float, rate: float, momentum: float) -> Callable[[Block], None]:
    def move(block: Block) -> None:
        at = block.places[: block.own]
        begin = at.copy()
        alone = block.own == field.count
        # The sum over pairs that are not both in the block.
        met = mutual(begin, begin)
        rest = 0.0 if alone else max(field.total - (met[1] - block.own), 0.0)
        for step in range(steps):
            # Rows of the block repel each other as they are now, all others as they were.
            push, now = mutual(at, at) if step else met
            now = max(now, block.own + 1e-9)
            if not alone:
                push = push + field.push(at) - (mutual(at, begin) if step else met)[0]
            slope = 4 * (exaggeration * pull(block) - push / (rest + now - block.own))
            block.speed = momentum * block.speed - rate * slope
            length = np.sqrt((block.speed**2).sum(axis=1))[:, None]
            block.speed *= np.minimum(1.0, LONGEST / np.maximum(length, 1e-12))
            at += block.speed

    return move


def graph_layout(df: DataFrame, key: str, neighbours: int = GRAPH_NEIGHBOURS, steps: int = GRAPH_STEPS, seed: int = 0) -> DataFrame:
    """(``key``, x, y): a layout of the fuzzy neighbour graph of the ``features`` of all rows.

    A link has the weight a + b - ab of its two directions. In each step a row is
    pulled along links drawn by their weights and pushed from ``PUSHES`` places for each of
    them, taken from a draw of ``NEGATIVES`` rows at the round's begin. Steps
    shorten to nothing. Cases as in ``tsne``.
    """
    if df.isEmpty():
        return df.select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    at, n = start(df, key, 3.0)
    at = written(at, "layout")
    if n > 1:
        pairs = both_ways(weighted_links(neighbour_rows(df, key, neighbours, seed), fuzzy_weights))
        links, abroad = dealt_links(pairs.select("i", "j", (F.col("w") + F.col("back") - F.col("w") * F.col("back")).alias("w")), at)
        for done, some in parts_of(steps, n):
            # NEGATIVES rows more or less, others in every round.
            mine = F.abs(F.xxhash64(F.lit(seed), F.lit(done), "i")) % max(1, n // NEGATIVES) == 0
            drawn = at.filter(mine).select("i", "x", "y").sort("i").drop("i").limit(2 * NEGATIVES).collect()
            at = run_round(at, links, abroad, _graph_move(np.array(drawn, float), range(done, done + some), steps, seed))
    return at.select(F.col("i").alias(key), "x", "y")


def _graph_move(others: np.ndarray, numbers: range, steps: int, seed: int) -> Callable[[Block], None]:
    def move(block: Block) -> None:
        rng = np.random.default_rng([seed, numbers.start, block.number])
        for step in numbers:
            rate = 1 - step / steps
            drawn = np.flatnonzero(rng.random(len(block.w)) < block.w)
            i = block.i[drawn]
            gap = block.places[i] - block.places[block.j[drawn]]
            d = (gap**2).sum(axis=1)
            near = np.where(d > 0, -2 * A * B * np.maximum(d, 1e-12) ** (B - 1) / (1 + A * d**B), 0.0)
            force = np.clip(near[:, None] * gap, -4, 4)
            for _ in range(PUSHES):
                gap = block.places[i] - others[rng.integers(len(others), size=len(i))]
                d = (gap**2).sum(axis=1)
                # A row that meets its own place is not pushed.
                far = np.where(d > 1e-18, 2 * B / ((0.001 + d) * (1 + A * d**B)), 0.0)
                force += np.clip(far[:, None] * gap, -4, 4)
            # The mean over the row's links: their sum, taken at once, would leap over the neighbours.
            links = np.maximum(np.bincount(i, minlength=block.own), 1)
            block.places[: block.own] += 0.5 * rate * np.stack([np.bincount(i, force[:, c], block.own) / links for c in (0, 1)], axis=1)

    return move
