"""Sharding by histogram sort: exact byte counts below candidate keys, then one exchange.

The sort key is (60 bits of the text's digest, doc_id): equal texts stand side by
side, and a text with very many copies can still be cut between two of them. Each
round counts, across all partitions, the exact bytes in a fan of probe intervals
for every splitter that is still open, and keeps the one interval in which its
target is reached. A splitter is settled when the interval ends within the
tolerance or holds one key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.llm.scratch import write_table

ROW_OVERHEAD = 16
FAN_BITS = 10
RUN_ROWS = 1_000_000  # rows that one task numbers, about
DIGEST_BITS, MOST_KEY = 60, 2**63 - 1
MOST_HOT, CUTS = 1000, 256  # texts with more than that share of all rows are cut between their copies

Key = tuple[int, int]


@dataclass
class Splitter:
    """The bytes up to some key in [low, high] reach ``target``; ``below`` of them lie under ``low``."""

    target: int
    low: Key
    high: Key
    below: int = 0
    settled: bool = False


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _size, _crc, and the two parts of the sort key, _k0 and _k1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    as_text = F.col("doc_id").cast("string")
    return docs.drop("_of", "_part", "_ahead").withColumns(
        {
            "_size": (F.octet_length(text) + ROW_OVERHEAD).cast("long"),
            "_crc": F.crc32(text.cast("binary")),
            "_k0": F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"),
            "_k1": F.coalesce(as_text.try_cast("long"), F.xxhash64(as_text)),
        }
    )


def _beyond(key: Key, inclusive: bool = False) -> Column:
    k0, k1 = F.col("_k0"), F.col("_k1")
    return (k0 > key[0]) | ((k0 == key[0]) & (k1 >= key[1] if inclusive else k1 > key[1]))


def _probe(table: DataFrame, spans: list[tuple[Key, Key]]) -> dict[int, list[tuple[int, Key, Key]]]:
    """Exact bytes, least and greatest key of every probe interval of every span."""
    which, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (low, high) in enumerate(spans):
        part = 0 if low[0] != high[0] else 1
        shift = max(0, (high[part] - low[part]).bit_length() - FAN_BITS)
        inside = _beyond(low, inclusive=True) & ~_beyond(high)
        which = F.when(inside, F.lit(i)).otherwise(which)
        cell = F.when(inside, F.shiftright(F.col(f"_k{part}"), shift) - F.lit(low[part] >> shift)).otherwise(cell)
    key = F.struct("_k0", "_k1")
    counted = (
        table.select("_size", "_k0", "_k1", which.alias("span"), cell.alias("cell"))
        .filter(F.col("span").isNotNull())
        .groupBy("span", "cell")
        .agg(F.sum("_size").alias("bytes"), F.min(key).alias("least"), F.max(key).alias("most"))
    )
    found: dict[int, list[tuple[int, Key, Key]]] = {}
    for r in sorted(counted.collect(), key=lambda r: (r.span, r.cell)):  # 2**FAN_BITS cells a span, and spans as splitters
        found.setdefault(r.span, []).append((r.bytes, tuple(r.least), tuple(r.most)))
    return found


def splitters(table: DataFrame, shards: int, tolerance: int = 0) -> list[Key]:
    """Last keys of shards 0..shards-2 for a table with _size, _k0, _k1.

    The bytes up to the j-th key are the fewest that reach j / shards of all
    bytes, or up to ``tolerance`` bytes more.
    """
    key = F.struct("_k0", "_k1")
    whole = table.agg(F.sum("_size").alias("bytes"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    if not whole.bytes:
        return []
    ends = tuple(whole.low), tuple(whole.high)
    wanted = [Splitter(-(-j * whole.bytes // shards), *ends) for j in range(1, shards)]
    while live := [s for s in wanted if not s.settled]:
        spans = sorted({(s.low, s.high) for s in live})
        cells = _probe(table, spans)
        for s in live:
            for size, least, most in cells[spans.index((s.low, s.high))]:
                if s.below + size >= s.target:
                    s.low, s.high = least, most
                    s.settled = least == most or s.below + size - s.target <= tolerance
                    break
                s.below += size
    return [s.high for s in wanted]


def shard_documents(docs: DataFrame, shards: int = 40, tolerance: int = 0, run_rows: int = RUN_ROWS) -> DataFrame:
    """``docs`` with _size, _crc, _shard and _slot (gapless from 0 in a shard).

    Law ``bytes``: in key order, a row is in shard floor(shards * bytes before it
    / all bytes); no shard is off its share by more than its two end rows and
    twice ``tolerance``. A null text counts as empty; every row counts 16 bytes
    besides its text. Rows that repeat both doc_id and text share one key and
    stay together; rows without a doc_id use the key of a null. An empty table
    gives an empty result. Clashing columns named _size, _crc, _k0, _k1, _run,
    _of, _part, _ahead, _shard, _slot are replaced or left out; all others pass through.
    """
    table = keyed(docs)
    keys = write_table(table.select("_size", "_k0", "_k1"), "shard-keys")
    bounds = splitters(keys, shards, tolerance)
    numbered = with_runs(table.withColumn("_shard", _passed(bounds)), keys, run_rows)
    order = Window.partitionBy("_shard", "_run").orderBy("_k0", "_k1")
    placed = numbered.withColumn("_slot", (F.row_number().over(order) - 1).cast("long"))
    if keys.count() > run_rows:
        sizes = with_runs(keys.withColumn("_shard", _passed(bounds)), keys, run_rows).groupBy("_shard", "_run").count()
        before = F.sum("count").over(Window.partitionBy("_shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
        offsets = sizes.select(F.col("_shard").alias("_of"), F.col("_run").alias("_part"), F.coalesce(before, F.lit(0)).alias("_ahead"))
        met = placed.join(offsets, (F.col("_shard") == F.col("_of")) & (F.col("_run") == F.col("_part")))
        placed = met.withColumn("_slot", F.col("_ahead") + F.col("_slot")).drop("_of", "_part", "_ahead")
    return placed.drop("_k0", "_k1", "_run")


def with_runs(df: DataFrame, keys: DataFrame, run_rows: int) -> DataFrame:
    """``df`` with _run, which grows with the key and holds about ``run_rows`` rows: a shard is numbered run by run, by no task whole.

    Digests are even, so their first bits cut them; the copies of a text with very
    many of them are cut between sampled quantiles of the second part of the key.
    """
    rows = keys.count()
    shift = DIGEST_BITS - max(0, rows // run_rows).bit_length()
    least = max(run_rows, rows // MOST_HOT)
    counts = keys.groupBy("_k0").count().filter(F.col("count") > least).select("_k0") if rows > run_rows else None
    hot = sorted(r["_k0"] for r in counts.collect()) if counts is not None else []  # fewer than MOST_HOT
    first = F.shiftright("_k0", shift)
    if not hot:
        return df.withColumn("_run", F.struct(first.alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")))
    shares = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    cuts = keys.join(F.broadcast(counts), "_k0").groupBy(F.col("_k0").alias("_of")).agg(F.percentile_approx("_k1", shares).alias("_part"))
    place = _passed([(h, MOST_KEY) for h in hot]) * 2 + F.col("_k0").isin(hot).cast("int")
    piece = F.coalesce(F.size(F.filter("_part", lambda c: c < F.col("_k1"))), F.lit(0))
    met = df.join(F.broadcast(cuts), F.col("_k0") == F.col("_of"), "left")  # fewer than MOST_HOT rows of CUTS numbers
    return met.withColumn("_run", F.struct(first.alias("a"), place.alias("b"), F.when(F.col("_of").isNull(), 0).otherwise(piece).alias("c"))).drop("_of", "_part")


def _passed(bounds: list[Key]) -> Column:
    """How many of the ``bounds`` a row's key lies beyond, by halving."""
    if not bounds:
        return F.lit(0)
    if len(bounds) == 1:
        return _beyond(bounds[0]).cast("int")
    half = len(bounds) // 2
    return F.when(_beyond(bounds[half]), _passed(bounds[half + 1 :]) + F.lit(half + 1)).otherwise(_passed(bounds[:half]))
