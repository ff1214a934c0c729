"""Reduction that keeps whole units and the mix of strata."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.expressions import composite_key
from tarn.operators.drawing import placed


@dataclass
class UnitReduction:
    """Kept rows with _weight, and what was drawn."""

    rows: DataFrame
    units: Sequence[str]
    strata: Sequence[str]
    order: Sequence[str]
    units_total: int
    units_kept: int
    strata_total: int
    notes: list[str] = field(default_factory=list)


def unit_table(df: DataFrame, units: Sequence[str], strata: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(unit, stratum, rows, mixed): the stratum of a unit's first row by ``order``, its rows and distinct strata."""
    keyed = df.select(composite_key(df, units).alias("unit"), composite_key(df, strata).alias("stratum"), F.struct(*order).alias("_order"))
    return keyed.groupBy("unit").agg(
        F.min_by("stratum", "_order").alias("stratum"), F.count("*").alias("rows"), F.count_distinct("stratum").alias("mixed")
    )


def taken_units(table: DataFrame, ratio: float, min_units: int = 1, seed: int = 0) -> DataFrame:
    """``table`` rows drawn per stratum: min(units, max(min_units, units * ratio rounded half to even))."""
    if not 0 < ratio <= 1:
        raise ValueError("ratio must be above 0 and at most 1")
    sizes = table.groupBy("stratum").agg(F.count("*").alias("_units"))
    fair = F.bround(F.col("_units") * F.lit(float(ratio)), 0).cast("long")
    takes = sizes.select(F.col("stratum").alias("_of"), F.least("_units", F.greatest(F.lit(min_units), fair)).alias("_take"))
    drawn = placed(table, ["stratum"], ["unit"], seed).join(takes, F.col("stratum") == F.col("_of"))
    return drawn.filter(F.col("_place") <= F.col("_take")).select(*table.columns)


def laddered_units(table: DataFrame, ratios: Sequence[float], min_units: int = 1, seed: int = 0) -> DataFrame:
    """``table`` with rung: the place (from 0) of the first of the rising ``ratios`` that draws the unit; their number if none does.

    The units of every ratio are those that taken_units draws for it.
    """
    if not ratios or not all(0 < r <= 1 for r in ratios) or list(ratios) != sorted(ratios):
        raise ValueError("ratios must rise, be above 0 and at most 1")
    sizes = table.groupBy("stratum").agg(F.count("*").alias("_units"))
    takes = [F.least("_units", F.greatest(F.lit(min_units), F.bround(F.col("_units") * F.lit(float(r)), 0).cast("long"))) for r in ratios]
    upto = sizes.select(F.col("stratum").alias("_of"), F.array(*takes).alias("_takes"))
    drawn = placed(table, ["stratum"], ["unit"], seed).join(upto, F.col("stratum") == F.col("_of"))
    return drawn.select(*table.columns, F.size(F.filter("_takes", lambda take: take < F.col("_place"))).alias("rung"))


def row_weights(df: DataFrame, kept: DataFrame, strata: Sequence[str]) -> DataFrame:
    """``kept`` with _weight: original rows over kept rows of the row's own stratum."""
    key = composite_key(df, strata)
    total = df.groupBy(key.alias("_of")).agg(F.count("*").alias("_total"))
    left = kept.groupBy(key.alias("_of")).agg(F.count("*").alias("_left"))
    factors = total.join(left, "_of").select("_of", (F.col("_total") / F.col("_left")).alias("_weight"))
    return kept.withColumn("_stratum", key).join(factors, F.col("_stratum") == F.col("_of")).select(*kept.columns, "_weight")


def stratified_units(
    df: DataFrame, units: Sequence[str], strata: Sequence[str], order: Sequence[str], ratio: float, min_units: int = 1, seed: int = 0, table: DataFrame | None = None
) -> UnitReduction:
    """Whole units drawn stratum by stratum, with row weights that restore the strata; ``table`` is their unit table, if it is there already."""
    table = unit_table(df, units, strata, order) if table is None else table
    taken = taken_units(table, ratio, min_units, seed)
    unit = composite_key(df, units)
    kept = df.withColumn("_unit", unit).join(taken.select(F.col("unit").alias("_unit")), "_unit", "left_semi").select(*df.columns)
    counts = table.agg(F.count("*").alias("units"), F.count_distinct("stratum").alias("strata"), F.count_if(F.col("mixed") > 1).alias("mixed")).first()
    sizes = table.groupBy("stratum").agg(F.count("*").alias("n"))
    fair = F.bround(F.col("n") * F.lit(float(ratio)), 0)
    lifted = sizes.agg(F.count_if((fair < min_units) & (F.col("n") > fair)).alias("lifted"), F.sum(F.least("n", F.greatest(F.lit(min_units), fair))).alias("kept")).first()
    if not lifted.kept:
        raise ValueError("no rows are left; raise the ratio or check the unit columns")
    notes = []
    if counts.mixed:
        notes.append(f"{counts.mixed} units span several strata and count for the stratum of their first row")
    if lifted.lifted:
        notes.append(f"{lifted.lifted} rare strata keep at least {min_units} units")
    return UnitReduction(row_weights(df, kept, strata), units, strata, order, counts.units, int(lifted.kept), counts.strata, notes)


def stratum_report(df: DataFrame, kept: DataFrame, units: Sequence[str], strata: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Units, rows and unit shares per stratum, original beside reduced; most original units first."""

    def summed(table: DataFrame, side: str) -> DataFrame:
        return table.groupBy("stratum").agg(F.count("*").alias(f"units_{side}"), F.sum("rows").alias(f"rows_{side}"))

    orig = summed(unit_table(df, units, strata, order), "orig")
    red = summed(unit_table(kept, units, strata, order), "red")
    both = orig.join(red, "stratum", "left").na.fill(0, ["units_red", "rows_red"])
    sums = both.agg(F.sum("units_orig").alias("_all_orig"), F.greatest(F.sum("units_red"), F.lit(1)).alias("_all_red"))
    shares = both.crossJoin(F.broadcast(sums)).withColumns(  # one row
        {"unit_ratio_orig": F.col("units_orig") / F.col("_all_orig"), "unit_ratio_red": F.col("units_red") / F.col("_all_red")}
    )
    return shares.withColumn("ratio_gap", F.abs(F.col("unit_ratio_red") - F.col("unit_ratio_orig"))).drop("_all_orig", "_all_red").orderBy(F.desc("units_orig"), "stratum")


def unit_summary(df: DataFrame, units: Sequence[str], strata: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row: units, strata, mean and most rows a unit, strata of at most two units."""
    table = unit_table(df, units, strata, order)
    per = table.groupBy("stratum").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.max("rows").alias("most"))
    return per.agg(
        F.sum("n").alias("units"),
        F.count("*").alias("strata"),
        (F.sum("rows") / F.sum("n")).alias("mean_rows"),
        F.max("most").alias("max_rows"),
        F.count_if(F.col("n") <= 2).alias("rare_strata"),
    )
