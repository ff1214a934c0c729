"""Seeded tables for trials: sales with latent clusters, customers by tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.expressions import uniform

# Share, age, income, visits, score and spend of the six latent groups.
GROUPS = (
    ("student", 0.22, 22, 900, 3, 55, 20),
    ("starter", 0.20, 29, 2600, 6, 62, 60),
    ("family", 0.24, 41, 4800, 9, 70, 140),
    ("senior", 0.16, 66, 2100, 12, 66, 70),
    ("affluent", 0.12, 50, 9800, 7, 82, 420),
    ("dormant", 0.06, 37, 3300, 1, 40, 15),
)
REGIONS = ("north", "south", "east", "west", "centre")
PLANS, CHANNELS = ("basic", "plus", "pro"), ("store", "web", "app")
OUTLIER_SHARE, MISSING_SHARE = 0.001, 0.02


def _u(seed: int, name: str) -> Column:
    return uniform(F.concat(F.lit(f"{name}:"), F.col("id").cast("string")), seed)


def _normal(seed: int, name: str) -> Column:
    """A standard normal from two uniforms (Box and Muller)."""
    return F.sqrt(-2 * F.ln(_u(seed, name + "a"))) * F.cos(2 * F.pi() * _u(seed, name + "b"))


def _pick(values: tuple, u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def sales(spark: SparkSession, rows: int, seed: int = 7, clean: bool = False) -> DataFrame:
    """sales_of ``rows`` new ids."""
    return sales_of(spark.range(rows), seed, clean)


def sales_of(base: DataFrame, seed: int = 7, clean: bool = False) -> DataFrame:
    """A row for each id: fifteen columns with six latent groups; outliers and missing values unless ``clean``."""
    edge, group, mean = 0.0, F.lit(GROUPS[-1][0]), [F.lit(float(x)) for x in GROUPS[-1][2:]]
    bounds = []
    for g in GROUPS:
        edge += g[1]
        bounds.append((edge, g))
    u = F.col("_u")
    for edge, g in reversed(bounds[:-1]):
        group = F.when(u < edge, g[0]).otherwise(group)
        mean = [F.when(u < edge, float(x)).otherwise(m) for x, m in zip(g[2:], mean, strict=True)]
    age, income, visits, score, spend = mean
    df = base.withColumn("_u", _u(seed, "group")).select(
        F.col("id"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (_u(seed, "day") * 366).cast("int")), "yyyy-MM-dd").alias("date"),
        F.format_string("S%03d", (_u(seed, "store") * 400).cast("int")).alias("store_id"),
        _pick(REGIONS, _u(seed, "region")).alias("region"),
        _pick(PLANS, F.pow(_u(seed, "plan"), F.lit(1.5))).alias("plan"),
        _pick(CHANNELS, _u(seed, "channel")).alias("channel"),
        (_u(seed, "member") < 0.4).alias("is_member"),
        F.round(age + 4 * _normal(seed, "age"), 1).alias("age"),
        F.round(income * (1 + 0.15 * _normal(seed, "income")), 0).alias("income"),
        F.greatest(F.lit(0.0), F.round(visits + 2 * _normal(seed, "visits"), 0)).alias("visits"),
        F.round(score + 6 * _normal(seed, "score"), 1).alias("score"),
        F.round(12 * _u(seed, "tenure") + visits / 4, 1).alias("tenure"),
        F.round(spend * (1 + 0.25 * _normal(seed, "spend")), 2).alias("spend"),
        F.round(0.3 * _u(seed, "discount"), 3).alias("discount_rate"),
        group.alias("cluster"),
        F.concat(F.lit("visit note of a customer in group "), group, F.lit(" number "), F.col("id").cast("string")).alias("memo"),
    )
    return (df if clean else with_missing(with_outliers(df, seed), seed)).drop("id")


def with_outliers(df: DataFrame, seed: int) -> DataFrame:
    """One row in a thousand with extreme income, spend and visits."""
    far = _u(seed, "outlier") < OUTLIER_SHARE
    return df.withColumns({c: F.when(far, F.col(c) * k + k).otherwise(F.col(c)) for c, k in (("income", 40.0), ("spend", 60.0), ("visits", 25.0))})


def with_missing(df: DataFrame, seed: int) -> DataFrame:
    """Two in a hundred values missing, independently, in income, score and plan."""
    return df.withColumns({c: F.when(_u(seed, f"missing {c}") >= MISSING_SHARE, F.col(c)) for c in ("income", "score", "plan")})


def customers(spark: SparkSession, rows: int, seed: int = 7) -> DataFrame:
    """customers_of ``rows`` new ids."""
    return customers_of(spark.range(rows), seed)


def customers_of(base: DataFrame, seed: int = 7) -> DataFrame:
    """A row for each id: nine columns with values that depend on the tier."""
    tier = F.when(_u(seed, "tier") < 0.6, "bronze").when(_u(seed, "tier") < 0.9, "silver").otherwise("gold")
    worth = F.when(F.col("tier") == "gold", 5200.0).when(F.col("tier") == "silver", 1900.0).otherwise(600.0)
    return (
        base.select("id")
        .withColumn("tier", tier)
        .select(
            F.format_string("C%06d", F.col("id")).alias("customer_id"),
            F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (_u(seed, "signup") * 1500).cast("int")), "yyyy-MM-dd").alias("signup"),
            "tier",
            F.round(40 + 12 * _normal(seed, "age"), 1).alias("age"),
            F.round(worth * (1 + 0.3 * _normal(seed, "worth")), 2).alias("ltv"),
            (worth / 150 + 10 * _u(seed, "orders")).cast("long").alias("orders"),
            (3 * _u(seed, "refunds")).cast("long").alias("refunds"),
            (11 * _u(seed, "nps")).cast("long").alias("nps"),
            (_u(seed, "active") < 0.8).alias("active"),
        )
    )
