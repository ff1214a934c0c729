"""Mixing to target weights by iterative proportional fitting.

Documents are summed into cells (one per source, language and topic) once. Each
round scales the cells' weights to every marginal in turn, under the bound that no
document is taken more than once: in each level the factor is found for which the
tokens times the smaller of 1 and the weight add up to the target. Rounds end when
all marginals are within a tolerance. Documents are then drawn with their cell's
weight as probability. All of it is DataFrame operations.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.llm.scratch import write_table

MISSING = "(none)"
WORDS = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
ROUNDS, LOWER, LEAST_KEEP = 25, 0.75, 0.4  # rounds until the share kept is lowered, by how much, and down to what part of the bound
MOST_WEIGHT, SAME = 1e12, 1e-9
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CAPITALS_SHARE, SHORT_CHARS, LONG_CHARS = 0.3, 1000, 5000
NAMES = ("_tokens", "_ratio", "_probability", "_gap", "_kept")


def words_in(text: Column) -> Column:
    """Words between blanks; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def form_topic(text: Column) -> Column:
    """The form of a text, which stands for its topic where documents carry none.

    "capitals" if so many of the characters are A to Z, else "short", "medium" or
    "long" by the length; "short" if null or empty. Rare forms would bound the
    share kept, so there are few and broad ones.
    """
    size = F.coalesce(F.length(text), F.lit(0))
    capitals = F.try_divide(size - F.length(F.translate(text, CAPITALS, "")), size)
    return F.when(capitals >= CAPITALS_SHARE, "capitals").when(size < SHORT_CHARS, "short").when(size > LONG_CHARS, "long").otherwise("medium")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(MISSING))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 1) / F.lit(4294967297.0)


def with_goals(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, dimensions: Sequence[str], temperature: float) -> DataFrame:
    """``cells`` with total, and for each dimension goal_<name>: the share of all tokens that the cell's level shall have.

    Given shares are normalised over the levels that have tokens; a level that none
    is given for gets nothing. Without given ones the natural shares are raised to
    ``temperature`` and normalised.
    """
    every = Window.partitionBy(F.lit(0))
    out = cells.withColumn("total", F.sum("tokens").over(every).cast("double"))
    for d in dimensions:
        natural = F.sum("tokens").over(Window.partitionBy(d)).cast("double")
        if targets and d in targets:
            given = F.create_map(*[F.lit(x) for pair in targets[d].items() for x in (pair[0], float(pair[1]))])
            wish = F.coalesce(F.element_at(given, F.col(d)), F.lit(0.0))
        else:
            wish = F.pow("natural", F.lit(temperature))
        out = out.withColumn("natural", natural).withColumn("wish", F.when(F.col("natural") > 0, wish).otherwise(0.0))
        # A level's tokens add up to its natural ones, so this sums every level once.
        levels = F.sum(F.coalesce(F.try_divide(F.col("wish") * F.col("tokens"), "natural"), F.lit(0.0))).over(every)
        out = out.withColumns({f"goal_{d}": F.coalesce(F.try_divide("wish", levels), F.lit(0.0)), f"natural_{d}": F.col("natural")}).drop("natural", "wish")
    return out


def scaled_to(cells: DataFrame, d: str, dimensions: Sequence[str], keep: Column) -> DataFrame:
    """``cells`` whose weight is multiplied, level by level of ``d``, so that tokens times min(1, weight) meet the level's goal."""
    level = Window.partitionBy(d)
    order = level.orderBy(F.desc("weight"), *dimensions)
    bound = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")  # of cells ahead, at their bound
    free = F.sum(F.col("tokens") * F.col("weight")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = cells.withColumns({"factor": F.greatest(F.lit(0.0), F.try_divide(F.col(f"goal_{d}") * keep * F.col("total") - bound, free)), "place": F.row_number().over(order)})
    fits = F.col("factor") * F.col("weight") <= 1 + SAME
    first = F.min(F.when(fits, F.struct("place", "factor"))).over(level)["factor"]
    return ranked.withColumn("weight", F.least(F.lit(MOST_WEIGHT), F.col("weight") * F.coalesce(first, F.lit(MOST_WEIGHT)))).drop("factor", "place")


def with_gap(cells: DataFrame, dimensions: Sequence[str], keep: Column) -> DataFrame:
    """``cells`` with gap: the largest relative distance of a marginal from its goal, the same in all rows."""
    drawn = F.col("tokens") * F.least(F.lit(1.0), "weight")
    gaps = [F.coalesce(F.abs(F.try_divide(F.sum(drawn).over(Window.partitionBy(d)), F.col(f"goal_{d}") * keep * F.col("total")) - 1), F.lit(0.0)) for d in dimensions]
    out = cells.withColumns({f"gap_{d}": g for d, g in zip(dimensions, gaps, strict=True)})
    return out.withColumn("gap", F.max(F.greatest(*[f"gap_{d}" for d in dimensions], F.lit(0.0))).over(Window.partitionBy(F.lit(0)))).drop(*[f"gap_{d}" for d in dimensions])


def fit(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, dimensions: Sequence[str], temperature: float, keep: float, tolerance: float) -> DataFrame:
    """``cells`` (dimensions, tokens) with probability, ratio (probability by the share kept) and gap.

    The share kept is the largest the levels allow, ``keep`` at most: no level can
    give more tokens than it has. Where the levels together allow less, it is
    lowered until all marginals are within ``tolerance``, or down to LEAST_KEEP of
    that bound. Cells are few rows whatever the number of documents (one per
    combination of levels), so one task holds them and no round shuffles.
    """
    table = write_table(with_goals(cells.coalesce(1), targets, dimensions, temperature).withColumn("weight", F.lit(1.0)), "cells-goals").coalesce(1)
    allowed = [F.min(F.when((F.col(f"goal_{d}") > 0) & (F.col("total") > 0), F.col(f"natural_{d}") / F.col("total") / F.col(f"goal_{d}"))) for d in dimensions]
    bound = min([keep, *(x for x in table.agg(*[a.alias(f"b{i}") for i, a in enumerate(allowed)]).first() if x is not None)])
    at, rounds, gap = bound, 0, 0.0
    while True:
        step = table
        for d in dimensions:
            step = scaled_to(step, d, dimensions, F.lit(at))
        table = write_table(with_gap(step, dimensions, F.lit(at)), "raked").coalesce(1)
        gap, rounds = table.agg(F.max("gap")).first()[0] or 0.0, rounds + 1
        if gap <= tolerance or (rounds % ROUNDS == 0 and at * LOWER < LEAST_KEEP * bound):
            break
        table = table.drop("gap")
        if rounds % ROUNDS == 0:
            at, table = at * LOWER, table.withColumn("weight", F.lit(1.0))
    if gap > tolerance:
        warnings.warn(f"mixing: a marginal is {gap:.2%} from its target", stacklevel=2)
    probability = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), "weight")).otherwise(F.lit(at))
    return table.select(*dimensions, "tokens", probability.alias("probability"), "gap").withColumn("ratio", F.col("probability") / F.lit(at))


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    dimensions: Sequence[str] = DIMENSIONS,
    temperature: float = 0.7,
    keep: float = 0.9,
    seed: int = 0,
    tolerance: float = 0.001,
) -> DataFrame:
    """``docs`` with _tokens, _ratio, _probability, _gap and _kept.

    ``targets`` gives token shares by dimension and level; a dimension without
    one takes its natural shares raised to ``temperature``. A document is kept if
    a number drawn from its doc_id and ``seed`` is below its cell's probability,
    so copies with other ids are drawn on their own and repeated rows alike. The
    expected shares after the draw meet the targets to the relative distance
    ``tolerance``; ``keep`` is an upper bound, and a smaller share of the tokens is
    kept where a level has too few of them. _gap is the largest distance left; a
    warning tells if it is beyond the tolerance. Null levels count as the level
    "(none)"; a document without words weighs nothing and is kept with the share
    of tokens kept, if its cell has no words at all. A ``topic`` column is used if
    there is one, else the form of the text. An empty table gives an empty
    result. The new columns, also _source, _lang, _topic and _at_*, replace any of
    their names.
    """
    own = {d: F.col(d) if d in docs.columns else form_topic(F.col("text")) if d == "topic" else F.lit(None) for d in dimensions}
    at = {d: f"_at_{d}" for d in dimensions}
    bare = docs.drop(*NAMES, *[f"_{d}" for d in dimensions if f"_{d}" not in own], *at.values())
    marked = bare.withColumns({"_tokens": words_in(F.col("text"))} | {at[d]: F.coalesce(c.cast("string"), F.lit(MISSING)) for d, c in own.items()})
    cells = write_table(marked.groupBy(*[F.col(at[d]).alias(d) for d in dimensions]).agg(F.sum("_tokens").alias("tokens")), "cells")
    drawn = fit(cells, targets, dimensions, temperature, keep, tolerance)
    rates = write_table(drawn.select(*[F.col(d).alias(at[d]) for d in dimensions], F.col("ratio").alias("_ratio"), F.col("probability").alias("_probability"), F.col("gap").alias("_gap")), "rates")
    kept = marked.join(rates, list(at.values())).withColumn("_kept", uniform(F.col("doc_id"), seed) < F.col("_probability"))
    return kept.withColumnsRenamed({at[d]: f"_{d}" for d in dimensions})


def mix_sql(source: str = "documents", temperature: float = 0.7, keep: float = 0.9, seed: int = 0, tolerance: float = 0.001) -> str:
    """DuckDB SQL for the rows of ``mix`` over ``source``: the rounds are one recursion over the cells."""
    dims = ", ".join(DIMENSIONS)
    each = lambda text: ", ".join(text.format(d=d) for d in DIMENSIONS)
    columns = f"{dims}, tokens, total, {each('goal_{d}, natural_{d}')}, bound, at_share, weight, round"

    def step(table: str, d: str) -> str:
        order = f"PARTITION BY {d} ORDER BY weight DESC, {dims}"
        ahead, free = f"sum(tokens) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", f"sum(tokens * weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        ranked = f"(SELECT *, row_number() OVER ({order}) AS place, greatest(0.0, (goal_{d} * at_share * total - coalesce({ahead}, 0)::DOUBLE) / nullif({free}, 0)) AS factor FROM {table})"
        found = f"(SELECT *, min(CASE WHEN factor * weight <= {1 + SAME!r} THEN place END) OVER (PARTITION BY {d}) AS first_place FROM {ranked})"
        scaled = f"(SELECT *, max(CASE WHEN place = first_place THEN factor END) OVER (PARTITION BY {d}) AS scale FROM {found})"
        return f"(SELECT * EXCLUDE (place, factor, first_place, scale) REPLACE (least({MOST_WEIGHT!r}::DOUBLE, weight * coalesce(scale, {MOST_WEIGHT!r}::DOUBLE)) AS weight) FROM {scaled})"

    again = f"round > 0 AND round % {ROUNDS} = 0"
    table = f"(SELECT * REPLACE (CASE WHEN {again} THEN at_share * {LOWER} ELSE at_share END AS at_share, CASE WHEN {again} THEN 1.0::DOUBLE ELSE weight END AS weight) FROM rounds WHERE gap > {tolerance} AND NOT ({again} AND at_share * {LOWER} < {LEAST_KEEP} * bound))"
    for d in DIMENSIONS:
        table = step(table, d)
    parted = f"(SELECT *, {each('coalesce(abs(sum(tokens * least(1.0, weight)) OVER (PARTITION BY {d}) / nullif(goal_{d} * at_share * total, 0) - 1), 0) AS gap_{d}')} FROM {table})"
    allowed = each("min(CASE WHEN goal_{d} > 0 AND total > 0 THEN natural_{d} / total / goal_{d} END)")
    parts = [
        f"""marked AS (SELECT doc_id, coalesce(source, '{MISSING}') AS source, coalesce(lang, '{MISSING}') AS lang,
  CASE WHEN (length(text) - length(translate(text, '{CAPITALS}', '')))::DOUBLE / nullif(length(text), 0) >= {CAPITALS_SHARE} THEN 'capitals'
       WHEN coalesce(length(text), 0) < {SHORT_CHARS} THEN 'short' WHEN length(text) > {LONG_CHARS} THEN 'long' ELSE 'medium' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM {source})""",
        f"cells AS (SELECT {dims}, sum(tokens)::BIGINT AS tokens FROM marked GROUP BY {dims})",
        f"levels AS (SELECT *, sum(tokens) OVER ()::DOUBLE AS total, {each('sum(tokens) OVER (PARTITION BY {d})::DOUBLE AS natural_{d}')} FROM cells)",
        f"wishes AS (SELECT *, {each(f'CASE WHEN natural_{{d}} > 0 THEN pow(natural_{{d}}, {temperature}) ELSE 0 END AS wish_{{d}}')} FROM levels)",
        f"goals AS (SELECT *, {each('coalesce(wish_{d} / nullif(sum(coalesce(wish_{d} * tokens / nullif(natural_{d}, 0), 0)) OVER (), 0), 0) AS goal_{d}')} FROM wishes)",
        f"reach AS (SELECT least({keep}::DOUBLE, {allowed}) AS bound FROM goals)",
        f"""rounds AS (SELECT {columns}, 2.0::DOUBLE AS gap FROM (SELECT *, bound AS at_share, 1.0::DOUBLE AS weight, 0 AS round FROM goals, reach)
  UNION ALL SELECT {columns.replace('round', 'round + 1')}, max(greatest({each('gap_{d}')}, 0.0)) OVER () AS gap FROM {parted})""",
        f"rates AS (SELECT {dims}, CASE WHEN tokens > 0 THEN least(1.0, weight) ELSE at_share END AS probability, at_share FROM rounds WHERE round = (SELECT max(round) FROM rounds))",
    ]
    draw = f"((('0x' || substr(md5('{seed}:' || doc_id), 1, 8))::BIGINT + 1) / 4294967297::DOUBLE)"
    return (
        "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT doc_id, {dims}, tokens, round(probability / at_share, 6) AS ratio, round(probability, 6) AS probability,"
        f" {draw} < probability AS kept FROM marked JOIN rates USING ({dims})"
    )
