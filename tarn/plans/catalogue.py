"""Registered queries of the reduction engine on the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.expressions import level
from tarn.functions.tables import dealt, written
from tarn.operators import catfidelity, charts, clustering, drawing, features, fidelity, items, layout, ordered, profile, relations, stratified, structure, units, vocabulary
from tarn.plans import cli, search
from tarn.sources import delimited, reports, synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

UNIT, STRATA = ["l_orderkey"], ["l_returnflag", "l_linestatus"]
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_KEY = ["l_orderkey", *ORDER]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RATIO, SAMPLE = 0.1, 600


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share; a local one only where the session names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/tarn-{name}"


# --- SQL parts -------------------------------------------------------------

KEYED = "keyed AS (SELECT *, l_orderkey::VARCHAR AS unit, l_returnflag || chr(31) || l_linestatus AS stratum FROM lineitem)"
UNITS = """units AS (SELECT unit, arg_min(stratum, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS stratum,
  count(*) AS rows, count(DISTINCT stratum) AS mixed FROM keyed GROUP BY unit)"""
DRAWN = """drawn AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('0:' || unit), unit) AS place,
  count(*) OVER (PARTITION BY stratum) AS n FROM units)"""


def taken_sql(ratio: float) -> str:
    return f"taken AS (SELECT unit, stratum, rows, mixed FROM drawn WHERE place <= least(n, greatest(1, round_even(n * {ratio}, 0)::BIGINT)))"


TAKEN = taken_sql(RATIO)
KEPT = """kept AS (SELECT k.*, t.total / l.kept_rows AS w FROM keyed k SEMI JOIN taken USING (unit)
  JOIN (SELECT stratum, count(*)::DOUBLE AS total FROM keyed GROUP BY stratum) t USING (stratum)
  JOIN (SELECT stratum, count(*) AS kept_rows FROM keyed SEMI JOIN taken USING (unit) GROUP BY stratum) l USING (stratum))"""
UNIT_PARTS = f"WITH {KEYED}, {UNITS}, {DRAWN}, {TAKEN}, {KEPT}"
SAMPLED = f"""samp AS (SELECT *, (SELECT count(*) FROM orders) / {SAMPLE}.0::DOUBLE AS w FROM orders ORDER BY md5('0:' || o_orderkey), o_orderkey LIMIT {SAMPLE})"""
# The commonest values of a categorical column, original and reduced.
SHARES = """p AS (SELECT {v} AS value, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM {o} GROUP BY 1),
q AS (SELECT {v} AS value, sum(w) / sum(sum(w)) OVER () AS q FROM {r} GROUP BY 1),
pq AS (SELECT value, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM p FULL JOIN q USING (value)),
d AS (SELECT least(1, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END)))) AS js,
  max(abs(p - q)) AS gap, count(*) AS levels, avg(CASE WHEN q > 0 THEN 1.0 ELSE 0 END) AS coverage FROM pq)"""
RATED = "round(100 * (1 - least(1, 0.6 * js + 0.4 * gap)), 1) AS score, round(js, 4) AS js, round(gap, 4) AS max_gap, levels, round(coverage, 4)::DOUBLE AS coverage"


def ks_sql(o: str, r: str) -> str:
    """KS over two selects of a column v."""
    return f"""both_sides AS (SELECT v, 1 AS o, 0 AS r FROM ({o}) AS x(v) UNION ALL SELECT v, 0, 1 FROM ({r}) AS y(v)),
steps AS (SELECT v, sum(o) AS o, sum(r) AS r FROM both_sides GROUP BY v),
ecdf AS (SELECT sum(o) OVER (ORDER BY v) / (SELECT sum(o) FROM steps) AS fo, sum(r) OVER (ORDER BY v) / (SELECT sum(r) FROM steps) AS fr FROM steps),
ks AS (SELECT max(abs(fo - fr))::DOUBLE AS ks FROM ecdf)"""


MOMENTS = """mo AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders),
mr AS (SELECT sum(w * o_totalprice) / sum(w) AS m FROM samp),
sr AS (SELECT sqrt(sum(w * pow(o_totalprice - mr.m, 2)) / sum(w)) AS s FROM samp, mr)"""


def units_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """lineitem and the rows that a tenth of its units keeps, with weights."""
    line = read(spark, sf_dir, "lineitem")
    table = written(units.unit_table(line, UNIT, STRATA, ORDER), "units")
    taken = units.taken_units(table, RATIO)
    kept = line.withColumn("_unit", level("l_orderkey")).join(taken.select(F.col("unit").alias("_unit")), "_unit", "left_semi").select(*line.columns)
    # Written, as several parts of a query read it and its plan is three passes over lineitem.
    return line, written(units.row_weights(line, written(kept, "kept"), STRATA), "weighted")


def sample_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders and a random sample of it, with weights."""
    orders = read(spark, sf_dir, "orders")
    return orders, drawing.random_sample(orders, SAMPLE, ["o_orderkey"])


# --- units -----------------------------------------------------------------


@query(f"WITH {KEYED}, {UNITS} SELECT unit, stratum, rows, mixed FROM units")
def unit_table(spark, sf_dir):
    return units.unit_table(read(spark, sf_dir, "lineitem"), UNIT, STRATA, ORDER)


@query(f"WITH {KEYED}, {UNITS}, {DRAWN}, {TAKEN} SELECT * FROM taken")
def stratified_units(spark, sf_dir):
    return units.taken_units(units.unit_table(read(spark, sf_dir, "lineitem"), UNIT, STRATA, ORDER), RATIO)


@query(f"{UNIT_PARTS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(w, 6) AS weight FROM kept")
def row_weights(spark, sf_dir):
    return units_of(spark, sf_dir)[1].select(*LINE_KEY, F.round("_weight", 6).alias("weight"))


@query(
    f"""{UNIT_PARTS}, again AS (SELECT unit, arg_min(stratum, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS stratum, count(*) AS rows FROM kept GROUP BY unit),
o AS (SELECT stratum, count(*) AS units_orig, sum(rows)::BIGINT AS rows_orig FROM units GROUP BY stratum),
r AS (SELECT stratum, count(*) AS units_red, sum(rows)::BIGINT AS rows_red FROM again GROUP BY stratum),
j AS (SELECT stratum, units_orig, rows_orig, coalesce(units_red, 0) AS units_red, coalesce(rows_red, 0) AS rows_red FROM o LEFT JOIN r USING (stratum)),
s AS (SELECT *, units_orig / sum(units_orig) OVER ()::DOUBLE AS a, units_red / greatest(sum(units_red) OVER (), 1)::DOUBLE AS b FROM j)
SELECT stratum, units_orig, rows_orig, units_red, rows_red, round(a, 9) AS unit_ratio_orig, round(b, 9) AS unit_ratio_red, round(abs(b - a), 9) AS ratio_gap FROM s"""
)
def stratum_report(spark, sf_dir):
    line, kept = units_of(spark, sf_dir)
    out = units.stratum_report(line, kept, UNIT, STRATA, ORDER)
    return out.withColumns({c: F.round(c, 9) for c in ("unit_ratio_orig", "unit_ratio_red", "ratio_gap")})


@query(
    f"""WITH {KEYED}, {UNITS}, per AS (SELECT stratum, count(*) AS n, sum(rows) AS rows, max(rows) AS most FROM units GROUP BY stratum)
SELECT sum(n)::BIGINT AS units, count(*) AS strata, round((sum(rows) / sum(n))::DOUBLE, 9) AS mean_rows, max(most) AS max_rows, count(*) FILTER (n <= 2) AS rare_strata FROM per"""
)
def unit_summary(spark, sf_dir):
    return units.unit_summary(read(spark, sf_dir, "lineitem"), UNIT, STRATA, ORDER).withColumn("mean_rows", F.round("mean_rows", 9))


@query(
    """SELECT user_id::VARCHAR AS unit, arg_min(event_type, event_id) AS stratum, count(*) AS rows, count(DISTINCT event_type) AS mixed
FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1"""
)
def mixed_units(spark, sf_dir):
    return units.unit_table(read(spark, sf_dir, "events"), ["user_id"], ["event_type"], ["event_id"]).filter("mixed > 1")


@query(
    f"""WITH {KEYED}, {UNITS}, {DRAWN}, ladder AS (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS ratio)
SELECT ratio, count(*) AS units_kept, sum(rows)::BIGINT AS rows_kept FROM drawn, ladder WHERE place <= least(n, greatest(1, round_even(n * ratio, 0)::BIGINT)) GROUP BY ratio"""
)
def ratio_ladder(spark, sf_dir):
    return search.ratio_ladder(read(spark, sf_dir, "lineitem"), UNIT, STRATA, ORDER, [])


# --- draws and allocation --------------------------------------------------


@query(f"WITH {SAMPLED} SELECT o_orderkey, o_totalprice, w AS weight FROM samp")
def random_sample(spark, sf_dir):
    return sample_of(spark, sf_dir)[1].select("o_orderkey", "o_totalprice", F.col("_weight").alias("weight"))


def allocation_sql(table: str, stratum: str, n: int) -> str:
    return f"""sizes AS (SELECT {stratum} AS stratum, count(*) AS size FROM {table} GROUP BY 1),
raws AS (SELECT *, size * {n}::DOUBLE / sum(size) OVER () AS raw FROM sizes),
base AS (SELECT *, least(size, greatest(1, floor(raw)::BIGINT)) AS a FROM raws),
spare AS (SELECT *, {n} - sum(a) OVER () AS spare, row_number() OVER (ORDER BY stratum) AS pos FROM base),
gain AS (SELECT *, CASE WHEN size > a AND row_number() OVER (ORDER BY CASE WHEN size > a THEN 0 ELSE 1 END, raw - a DESC, pos) <= spare THEN 1 ELSE 0 END AS g FROM spare),
steps AS (SELECT pos, spare, row_number() OVER (ORDER BY a - raw - j DESC, pos) AS turn FROM (SELECT pos, spare, a, raw, unnest(range(0, a - 1)) AS j FROM spare WHERE spare < 0)),
loss AS (SELECT pos, count(*) AS l FROM steps WHERE turn <= -spare GROUP BY pos),
alloc AS (SELECT stratum, size, raw, (a + g - coalesce(l, 0))::BIGINT AS alloc FROM gain LEFT JOIN loss USING (pos))"""


@query(f"WITH {allocation_sql('documents', 'source', 137)} SELECT stratum, size, round(raw, 9) AS raw, alloc FROM alloc")
def allocation(spark, sf_dir):
    sizes = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("stratum")).agg(F.count("*").alias("size"))
    return stratified.allocate(sizes, 137, ["stratum"]).withColumn("raw", F.round("raw", 9))


SMALL_STRATA = "CASE WHEN l_orderkey % 100 < 60 THEN 'all' ELSE 's' || (l_orderkey % 100) END"


@query(f"WITH {allocation_sql('lineitem', SMALL_STRATA, 60)} SELECT stratum, size, round(raw, 9) AS raw, alloc FROM alloc")
def allocation_surplus(spark, sf_dir):
    sizes = read(spark, sf_dir, "lineitem").groupBy(F.expr(SMALL_STRATA).alias("stratum")).agg(F.count("*").alias("size"))
    return stratified.allocate(sizes, 60, ["stratum"]).withColumn("raw", F.round("raw", 9))


@query(
    f"""WITH {allocation_sql('orders', 'o_orderpriority', 500)},
drawn AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('0:' || o_orderkey), o_orderkey::VARCHAR) AS place FROM orders)
SELECT o_orderkey, o_orderpriority, round(size / alloc, 9) AS weight FROM drawn JOIN alloc ON o_orderpriority = stratum WHERE place <= alloc"""
)
def stratified_sample(spark, sf_dir):
    red = stratified.stratified_sample(read(spark, sf_dir, "orders"), 500, "o_orderpriority", ["o_orderkey"])
    return red.select("o_orderkey", "o_orderpriority", F.round("_weight", 9).alias("weight"))


ENTROPY = "SELECT '{c}' AS name, count(*) AS levels, round(-sum(p * ln(p)), 9) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM orders GROUP BY {c})"


@query(" UNION ALL ".join(ENTROPY.format(c=c) for c in ("o_orderstatus", "o_orderpriority")))
def stratify_choice(spark, sf_dir):
    found = stratified.entropies(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
    return found.select(F.col("column").alias("name"), "levels", F.round("entropy", 9).alias("entropy"))


# --- value limits ----------------------------------------------------------


@query("SELECT p_brand AS value, count(*) AS rows FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def limit_top(spark, sf_dir):
    return vocabulary.choose_values(read(spark, sf_dir, "part"), "p_brand", 5)


U_OF = "((('0x' || substr(md5('0:' || {k}), 1, 8))::BIGINT + 1) / 4294967297::DOUBLE)"


@query(f"SELECT source AS value, count(*) AS rows FROM documents GROUP BY 1 ORDER BY ln({U_OF.format(k='source')}) / count(*) DESC, 1 LIMIT 3")
def limit_sample(spark, sf_dir):
    return vocabulary.choose_values(read(spark, sf_dir, "documents"), "source", 3, "sample")


@query(
    """WITH c AS (SELECT p_brand AS value, count(*) AS rows FROM part GROUP BY 1), t AS (SELECT * FROM c ORDER BY rows DESC, value LIMIT 5)
SELECT value, round(rows / (SELECT sum(rows) FROM c)::DOUBLE, 6) AS orig_ratio, round(rows / (SELECT sum(rows) FROM t)::DOUBLE, 6) AS ratio_after_limit, rows FROM t"""
)
def limit_report(spark, sf_dir):
    return vocabulary.limit_values(read(spark, sf_dir, "part"), {"p_brand": 5})[1].select(F.inline("kept"))


@query(
    """WITH a AS (SELECT * FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)),
b AS (SELECT * FROM a WHERE p_type IN (SELECT p_type FROM a GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)) SELECT p_partkey, p_brand, p_type FROM b"""
)
def limit_multi(spark, sf_dir):
    return vocabulary.limit_values(read(spark, sf_dir, "part"), {"p_brand": 5, "p_type": 2})[0].select("p_partkey", "p_brand", "p_type")


# --- fidelity --------------------------------------------------------------


@query(f"WITH {SAMPLED}, {MOMENTS} SELECT round(mr.m, 4) AS mean, round(sr.s, 4) AS std FROM mr, sr")
def weighted_moments(spark, sf_dir):
    m = fidelity.moments(sample_of(spark, sf_dir)[1], features.number("o_totalprice"), F.col("_weight"))
    return m.select(F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


KS_PRICE = ks_sql("SELECT o_totalprice AS v FROM orders", "SELECT o_totalprice FROM samp")


@query(f"WITH {SAMPLED}, {KS_PRICE} SELECT round(ks, 9) AS ks FROM ks")
def ks_numeric(spark, sf_dir):
    o, r = sample_of(spark, sf_dir)
    return ordered.ks_statistic(o, r, F.col("o_totalprice")).select(F.round("ks", 9).alias("ks"))


NUMERIC = f"""{MOMENTS}, {KS_PRICE},
g AS (SELECT ks, abs(mr.m - mo.m) / CASE WHEN abs(mo.m) > 1e-9 THEN abs(mo.m) ELSE 1 END AS dm, abs(sr.s - mo.s) / CASE WHEN mo.s > 1e-9 THEN mo.s ELSE 1 END AS ds FROM mo, mr, sr, ks),
num AS (SELECT round(100 * (1 - least(1, 0.5 * ks + 0.25 * least(dm, 1) + 0.25 * least(ds, 1))), 1) AS score, round(dm, 4) AS mean_diff_ratio, round(ds, 4) AS std_diff_ratio, round(ks, 4) AS ks FROM g)"""
CATEGORICAL = SHARES.format(v="o_orderpriority", o="orders", r="samp") + ", cat AS (SELECT round(100 * (1 - least(1, 0.7 * js + 0.3 * gap)), 1) AS score, round(js, 4) AS js_divergence, round(gap, 4) AS max_ratio_gap, levels FROM d)"


@query(f"WITH {SAMPLED}, {NUMERIC} SELECT * FROM num")
def numeric_score(spark, sf_dir):
    return fidelity.numeric_score(*sample_of(spark, sf_dir), "o_totalprice")


@query(f"WITH {SAMPLED}, {SHARES.format(v='o_orderpriority', o='orders', r='samp')} SELECT round(js, 9) AS js, round(gap, 9) AS max_gap FROM d")
def js_distance(spark, sf_dir):
    o, r = sample_of(spark, sf_dir)
    return fidelity.divergence(fidelity.level_shares(o, r, level("o_orderpriority"))).select(F.round("js", 9).alias("js"), F.round("max_gap", 9).alias("max_gap"))


@query(f"WITH {SAMPLED}, {CATEGORICAL} SELECT * FROM cat")
def categorical_score(spark, sf_dir):
    return fidelity.categorical_score(*sample_of(spark, sf_dir), "o_orderpriority")


@query(f"WITH {SAMPLED}, {NUMERIC}, {CATEGORICAL} SELECT round((num.score + cat.score) / 2, 1) AS score FROM num, cat")
def distribution_score(spark, sf_dir):
    return fidelity.distribution_score(fidelity.column_metrics(*sample_of(spark, sf_dir), ["o_totalprice", "o_orderpriority"]))


PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


def edges_sql(table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {table}" for a, b in PAIRS)


CHANGES = f"{UNIT_PARTS}, o AS ({edges_sql('lineitem')}), r AS ({edges_sql('kept')}), ch AS (SELECT a, b, o.r AS r_o, r.r AS r_r, abs(o.r - r.r) AS gap FROM o JOIN r USING (a, b))"


def changes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, kept = units_of(spark, sf_dir)
    return fidelity.edge_changes(fidelity.correlation_edges(line, NUMBERS), fidelity.correlation_edges(kept, NUMBERS))


@query(f"SELECT a, b, round(r, 6) AS r FROM ({edges_sql('lineitem')})")
def corr_pearson(spark, sf_dir):
    return fidelity.correlation_edges(read(spark, sf_dir, "lineitem"), NUMBERS).withColumn("r", F.round("r", 6))


RANKED = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in NUMBERS)


@query(f"SELECT a, b, round(r, 6) AS r FROM (WITH k AS (SELECT {RANKED} FROM lineitem) {edges_sql('k')})")
def corr_spearman(spark, sf_dir):
    return fidelity.correlation_edges(read(spark, sf_dir, "lineitem"), NUMBERS, "spearman").withColumn("r", F.round("r", 6))


@query(
    f"""{CHANGES} SELECT round(100 * (1 - least(1, 0.6 * avg(gap) + 0.4 * max(gap))), 1) AS score, round(sqrt(2 * sum(gap * gap)), 4) AS frobenius,
round(avg(gap), 4) AS mean_gap, round(max(gap), 4) AS max_gap, round(corr(r_o, r_r), 4) AS corr_of_corr FROM ch"""
)
def corr_preservation(spark, sf_dir):
    return fidelity.correlation_preservation(changes_of(spark, sf_dir))


CUSTOMER_NUMBERS = ["c_custkey", "c_nationkey", "c_acctbal"]
TAU = " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, round(sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})) / sqrt(sum(abs(sign(x.{a} - y.{a})))::DOUBLE * sum(abs(sign(x.{b} - y.{b})))), 9) AS r FROM customer x, customer y"""
    for a, b in (("c_custkey", "c_nationkey"), ("c_custkey", "c_acctbal"), ("c_nationkey", "c_acctbal"))
)


@query(TAU)
def corr_kendall(spark, sf_dir):
    return fidelity.correlation_edges(read(spark, sf_dir, "customer"), CUSTOMER_NUMBERS, "kendall").withColumn("r", F.round("r", 9))


@query("SELECT 'same' AS a, 'l_quantity' AS b, CASE WHEN stddev_pop(same) = 0 OR stddev_pop(l_quantity) = 0 THEN 0.0::DOUBLE ELSE corr(same, l_quantity) END AS r FROM (SELECT *, 1.5::DOUBLE AS same FROM lineitem)")
def corr_constant_guard(spark, sf_dir):
    return fidelity.correlation_edges(read(spark, sf_dir, "lineitem").withColumn("same", F.lit(1.5)), ["same", "l_quantity"])


def column_sql(c: str, name: str) -> str:
    shares = SHARES.format(v=c, o="keyed", r="kept")
    return f"SELECT '{name}' AS name, {RATED} FROM (WITH {shares} SELECT * FROM d)"


COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber"]
SCORES = " UNION ALL ".join(column_sql(f"{c}::VARCHAR", c) for c in COLUMNS)
COMBOS = [["l_returnflag", "l_linestatus"], ["l_returnflag", "l_linenumber"]]
COMBO_SCORES = " UNION ALL ".join(column_sql(f"{a}::VARCHAR || chr(31) || {b}::VARCHAR", f"{a}+{b}") for a, b in COMBOS)
AGAIN = "again AS (SELECT unit, count(*) AS rows FROM kept GROUP BY unit)"
COMBO_SCORE = column_sql("l_returnflag || chr(31) || l_linestatus", "x")
SIZES = f"""{ks_sql('SELECT rows::DOUBLE AS v FROM units', 'SELECT rows::DOUBLE FROM again')},
size AS (SELECT round(100 * (1 - least(1, ks)), 1) AS score, round(ks, 4) AS ks, (SELECT round(avg(rows), 3) FROM units) AS mean_orig, (SELECT round(avg(rows), 3) FROM again) AS mean_reduced,
  (SELECT max(rows) FROM units) AS max_orig, (SELECT max(rows) FROM again) AS max_reduced FROM ks)"""


@query(f"{UNIT_PARTS} {SCORES}")
def column_scores(spark, sf_dir):
    return catfidelity.column_scores(*units_of(spark, sf_dir), COLUMNS)


@query(f"{UNIT_PARTS} {COMBO_SCORES}")
def combo_scores(spark, sf_dir):
    return catfidelity.combo_scores(*units_of(spark, sf_dir), COMBOS)


@query(f"{UNIT_PARTS}, {AGAIN}, {SIZES} SELECT * FROM size")
def unit_size_score(spark, sf_dir):
    return catfidelity.unit_size_score(*units_of(spark, sf_dir), UNIT, STRATA, ORDER)


TOTALS = f"""c AS (SELECT round(avg(score), 1) AS s FROM ({SCORES})), k AS (SELECT round(avg(score), 1) AS s FROM ({COMBO_SCORE})),
totals AS (SELECT round((c.s + k.s + size.score) / 3, 1) AS total, c.s AS columns, k.s AS combos, size.score AS unit_size FROM c, k, size)"""


@query(f"{UNIT_PARTS}, {AGAIN}, {SIZES}, {TOTALS} SELECT * FROM totals")
def grouped_similarity(spark, sf_dir):
    return catfidelity.grouped_similarity(*units_of(spark, sf_dir), COLUMNS, UNIT, STRATA, ORDER)


def table_sql(c: str, top: int) -> str:
    return f"""SELECT '{c}' AS "column", CASE WHEN place > {top} THEN '(rest: ' || count(*) || ' values)' ELSE min(value) END AS value, sum(orig_rows)::BIGINT AS orig_rows, round(sum(p), 9) AS orig_ratio,
sum(reduced_rows)::BIGINT AS reduced_rows, round(sum(q), 9) AS reduced_ratio, round((sum(q) - sum(p)) * 100, 6) + 0.0::DOUBLE AS gap_pp FROM (
SELECT o.value, o.n AS orig_rows, coalesce(r.n, 0) AS reduced_rows, o.n / sum(o.n) OVER ()::DOUBLE AS p, coalesce(r.w / (SELECT sum(w) FROM kept), 0) AS q,
least({top + 1}, row_number() OVER (ORDER BY o.n DESC, o.value)) AS place FROM (SELECT {c}::VARCHAR AS value, count(*) AS n FROM keyed GROUP BY 1) o
LEFT JOIN (SELECT {c}::VARCHAR AS value, count(*) AS n, sum(w) AS w FROM kept GROUP BY 1) r USING (value)) GROUP BY place"""


@query(f"{UNIT_PARTS} " + " UNION ALL ".join(table_sql(c, 4) for c in COLUMNS))
def distribution_table(spark, sf_dir):
    out = catfidelity.distribution_table(*units_of(spark, sf_dir), COLUMNS, top=4)
    return out.withColumns({"orig_ratio": F.round("orig_ratio", 9), "reduced_ratio": F.round("reduced_ratio", 9), "gap_pp": F.round("gap_pp", 6) + F.lit(0.0)})


# --- profile and features --------------------------------------------------

PROFILES = {
    "c_custkey": ("identifier", "bigint"), "c_name": ("identifier", "string"), "c_nationkey": ("numeric", "int"), "c_acctbal": ("numeric", "double"), "c_mktsegment": ("categorical", "string"),
}


@query(
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS name, '{k}' AS kind, '{t}' AS dtype, round(count(DISTINCT {c}) / count({c})::DOUBLE, 4) AS unique_ratio, round(1 - count({c}) / count(*)::DOUBLE, 4) AS missing_ratio, {k != 'identifier'} AS selected FROM customer"
        for i, (c, (k, t)) in enumerate(PROFILES.items())
    )
)
def classify_columns(spark, sf_dir):
    return profile.classify(read(spark, sf_dir, "customer"), sample_rows=None).drop("reason")


@query("SELECT avg(CASE WHEN s = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS share FROM (SELECT p_partkey - lag(p_partkey) OVER (ORDER BY p_partkey) AS s FROM part) WHERE s IS NOT NULL")
def integer_id(spark, sf_dir):
    return profile.step_share(read(spark, sf_dir, "part"), "p_partkey")


@query("SELECT avg(CASE WHEN try_strptime(day, '%Y/%m/%d') IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE AS share FROM (SELECT year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) AS day FROM orders)")
def datetime_share(spark, sf_dir):
    days = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy/M/d").alias("day"))
    return profile.datetime_share(days, "day")


HOLED = "holed AS (SELECT nullif(l_discount, 0.05) AS l_discount, nullif(l_tax, 0.02) AS l_tax, l_quantity FROM lineitem)"


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.select(F.nullif("l_discount", F.lit(0.05)).alias("l_discount"), F.nullif("l_tax", F.lit(0.02)).alias("l_tax"), "l_quantity")


@query(f"WITH {HOLED} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END), 9)::DOUBLE AS ratio FROM holed" for c in ("l_discount", "l_tax", "l_quantity")))
def missing_report(spark, sf_dir):
    return profile.missing_report(holed(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


@query(f"WITH {HOLED} SELECT count(*) FILTER (l_discount IS NOT NULL AND l_tax IS NOT NULL) AS kept, count(*) FILTER (l_discount IS NULL OR l_tax IS NULL) AS dropped FROM holed")
def drop_missing(spark, sf_dir):
    kept, dropped = profile.drop_missing(holed(spark, sf_dir), ["l_discount", "l_tax"])
    return kept.agg(F.count("*").alias("kept"), F.lit(dropped).cast("long").alias("dropped"))


@query("SELECT unnest(['c_nationkey', 'c_acctbal', 'c_mktsegment']) AS name")
def default_selection(spark, sf_dir):
    return profile.classify(read(spark, sf_dir, "customer"), sample_rows=None).filter("selected").select("name")


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS z FROM orders")
def zscore(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.round(features.zscores(orders, ["o_totalprice"])[0]["o_totalprice"], 6).alias("z"))


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::INT::DOUBLE AS is_{v}" for v in "FOP") + " FROM orders")
def onehot(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", *[c.alias(n.replace("o_orderstatus=", "is_")) for n, c in features.one_hot(orders, "o_orderstatus").items()])


@query("SELECT p_partkey, round(count(*) OVER (PARTITION BY p_brand) / count(*) OVER ()::DOUBLE, 9) AS freq FROM part")
def freq_encode(spark, sf_dir):
    return features.frequency(read(spark, sf_dir, "part"), "p_brand").select("p_partkey", F.round("`p_brand#freq`", 9).alias("freq"))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.999) AS edge FROM orders) SELECT o_orderkey, o_totalprice FROM orders, q WHERE o_totalprice > edge")
def quantile_outliers(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.filter(F.col("o_totalprice") > F.lit(ordered.quantiles(orders, "o_totalprice", [0.999])[0.999])).select("o_orderkey", "o_totalprice")


# --- clusters on a given assignment ---------------------------------------


def grouped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderpriority").alias("rep_id"), F.array("o_totalprice").alias("features"))


@query(
    """WITH m AS (SELECT o_orderpriority, avg(o_totalprice) AS c, count(*)::DOUBLE AS weight FROM orders GROUP BY 1)
SELECT arg_min(o_orderkey, (round(pow(o_totalprice - c, 2), 6), o_orderkey)) AS o_orderkey, any_value(weight) AS weight FROM orders JOIN m USING (o_orderpriority) GROUP BY o_orderpriority"""
)
def medoid(spark, sf_dir):
    g = grouped_orders(spark, sf_dir)
    return clustering.medoids(g, clustering.group_means(g, 1), ["o_orderkey"]).select("o_orderkey", F.col("_weight").alias("weight"))


@query(
    """SELECT o_orderpriority AS priority, round(avg(o_totalprice), 4) AS o_totalprice, (SELECT o_orderstatus FROM orders i WHERE i.o_orderpriority = o.o_orderpriority GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS o_orderstatus,
count(*)::DOUBLE AS weight FROM orders o GROUP BY 1"""
)
def virtual_rows(spark, sf_dir):
    made = clustering.virtual_rows(grouped_orders(spark, sf_dir), ["o_totalprice", "o_orderstatus"])
    return made.select(F.col("rep_id").alias("priority"), F.round("o_totalprice", 4).alias("o_totalprice"), "o_orderstatus", F.col("_weight").alias("weight"))


@query(f"WITH {allocation_sql('documents', 'source', 100)} SELECT stratum, size, greatest(alloc, least(30, size)) AS alloc, alloc < least(30, size) AS lifted FROM alloc")
def floor_allocation(spark, sf_dir):
    sizes = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("stratum")).agg(F.count("*").alias("size"))
    return clustering.floored_allocation(sizes, 100, ["stratum"]).select("stratum", "size", "alloc", "lifted")


def problem_of(spark: SparkSession, sf_dir: str, name: str = "orders", key: tuple[str, ...] = ("o_orderkey",), columns: tuple[str, ...] = ("o_totalprice", "o_orderpriority", "o_orderstatus", "o_custkey")) -> search.Problem:
    df = read(spark, sf_dir, name)
    return search.Problem(features.prepare(df, None, columns), list(key))


@query()
def cluster_reduce_actual(spark, sf_dir):
    p = problem_of(spark, sf_dir)
    return clustering.cluster_reduce(p.rows, 300, p.key).rows.drop("features")


@query()
def cluster_reduce_mean(spark, sf_dir):
    p = problem_of(spark, sf_dir)
    return clustering.cluster_reduce(p.rows, 300, p.key, virtual=True).rows.drop("features")


# --- structure -------------------------------------------------------------


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", F.array("c_acctbal").alias("features"))


NEAR = """t AS (SELECT c_acctbal AS b FROM customer ORDER BY md5('0:' || c_custkey), c_custkey LIMIT 50),
near AS (SELECT c_custkey, min(abs(c_acctbal - b)) AS distance FROM customer, t GROUP BY c_custkey)"""


@query(f"WITH {NEAR} SELECT c_custkey, round(distance, 4) AS distance FROM near")
def nearest_distance(spark, sf_dir):
    df = balances(spark, sf_dir)
    near = structure.nearest_distances(df, drawing.random_sample(df, 50, ["c_custkey"]), ["c_custkey"])
    return near.select("c_custkey", F.round("distance", 4).alias("distance"))


@query(
    f"""WITH {NEAR}, t1 AS (SELECT c_acctbal AS b FROM customer ORDER BY md5('1:' || c_custkey), c_custkey LIMIT 50),
base AS (SELECT c_custkey, min(abs(c_acctbal - b)) AS distance FROM customer, t1 GROUP BY c_custkey), a AS (SELECT avg(distance) AS m, quantile_cont(distance, 0.95) AS p, count(*) AS n FROM near), f AS (SELECT avg(distance) AS m FROM base)
SELECT round(100 * least(1, f.m / a.m), 1) AS score, round(a.m / f.m, 4) AS mean_distance, round(a.p / f.m, 4) AS p95_distance, round(f.m / a.m, 4) AS vs_random, n AS sampled FROM a, f"""
)
def coverage(spark, sf_dir):
    df = balances(spark, sf_dir)
    found = structure.coverage(df, drawing.random_sample(df, 50, ["c_custkey"]), ["c_custkey"])
    return spark.createDataFrame([tuple(found.values())], "score double, mean_distance double, p95_distance double, vs_random double, sampled long")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


@query()
def trustworthiness(spark, sf_dir):
    return structure.trustworthiness(vectors(spark, sf_dir), ["vec_id"])


def attempt_frame(spark: SparkSession, made: list[dict]) -> DataFrame:
    names = [n for n in ("method", "size", "score", "distribution", "correlation", "structure") if n in made[0]]
    kinds = {"method": "string", "size": "long"}
    return spark.createDataFrame([tuple(m[n] for n in names) for m in made], ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names))


@query()
def overall_score(spark, sf_dir):
    return attempt_frame(spark, [search.attempt(problem_of(spark, sf_dir), "random", 300).summary()])


@query()
def search_size(spark, sf_dir):
    return attempt_frame(spark, search.search_size(problem_of(spark, sf_dir))[1])


@query()
def choose_method(spark, sf_dir):
    return attempt_frame(spark, search.choose_method(problem_of(spark, sf_dir), 300)[1])


@query()
def reduce_lineitem(spark, sf_dir):
    """The whole reduction of lineitem: size search, then the comparison of methods at that size."""
    p = problem_of(spark, sf_dir, "lineitem", tuple(LINE_KEY), ("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))
    first, _ = search.search_size(p)
    return attempt_frame(spark, search.choose_method(p, first.size)[1])


RATIO_TOTALS = " UNION ALL ".join(
    f"SELECT {r}::DOUBLE AS ratio, (SELECT count(*) FROM (WITH {KEYED}, {UNITS}, {DRAWN}, {taken_sql(r)} SELECT unit FROM taken)) AS units_kept, total FROM (WITH {KEYED}, {UNITS}, {DRAWN}, {taken_sql(r)}, {KEPT}, {AGAIN}, {SIZES}, {TOTALS} SELECT total FROM totals)"
    for r in search.RATIOS
)


@query(f"WITH tried AS ({RATIO_TOTALS}) SELECT * FROM tried WHERE ratio = coalesce((SELECT min(ratio) FROM tried WHERE total >= {search.TARGET}), (SELECT max(ratio) FROM tried))")
def ratio_search(spark, sf_dir):
    made = search.search_ratio(read(spark, sf_dir, "lineitem"), UNIT, STRATA, ORDER, COLUMNS)
    return spark.createDataFrame([(made.ratio, made.reduction.units_kept, made.scores["total"])], "ratio double, units_kept long, total double")


SIZED_TABLES = ("nation", "customer", "part", "orders", "lineitem", "events")
COUNTED = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in SIZED_TABLES)


@query(
    f"""WITH t AS ({COUNTED}), b AS (SELECT name, rows, floor(least({search.MOST_SIZE}, greatest({2 * search.LEAST_SIZE}, 0.2::DOUBLE * rows))) AS upper, least({search.LEAST_SIZE}, greatest(10, rows // 20))::DOUBLE AS lower FROM t)
SELECT DISTINCT name, rows, round_even(lower * pow(upper / lower, i / {search.STEPS - 1}::DOUBLE), 0)::BIGINT AS size FROM b, range({search.STEPS}) AS s(i) WHERE round_even(lower * pow(upper / lower, i / {search.STEPS - 1}::DOUBLE), 0) < rows"""
)
def size_candidates(spark, sf_dir):
    """The sizes that a search would try on each of the tables."""
    sizes = [(t, n, s) for t in SIZED_TABLES for n in [read(spark, sf_dir, t).count()] for s in search.size_candidates(n)]
    return spark.createDataFrame(sizes, "name string, rows long, size long")


# --- charts ----------------------------------------------------------------

EDGES = "e AS (SELECT quantile_cont(o_totalprice, 0.001) AS lo, quantile_cont(o_totalprice, 0.999) AS hi FROM orders)"
HIST = "SELECT least(38, floor((o_totalprice - lo) / ((hi - lo) / 39)))::INT AS bin, sum({w}) AS s FROM {t}, e WHERE o_totalprice BETWEEN lo AND hi GROUP BY 1"


@query(
    f"""WITH {SAMPLED}, {EDGES}, o AS ({HIST.format(w='1.0::DOUBLE', t='orders')}), r AS ({HIST.format(w='w', t='samp')}), g AS (SELECT unnest(range(39))::INT AS bin)
SELECT bin, round(lo + bin * ((hi - lo) / 39), 4) AS low, round(lo + (bin + 1) * ((hi - lo) / 39), 4) AS high, round(coalesce(o.s / (SELECT sum(s) FROM o) / ((hi - lo) / 39), 0), 12) AS original,
round(coalesce(r.s / (SELECT sum(s) FROM r) / ((hi - lo) / 39), 0), 12) AS reduced FROM g CROSS JOIN e LEFT JOIN o USING (bin) LEFT JOIN r USING (bin)"""
)
def hist_density(spark, sf_dir):
    h = charts.histogram(*sample_of(spark, sf_dir), "o_totalprice")
    return h.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), F.round("original", 12).alias("original"), F.round("reduced", 12).alias("reduced"))


@query(f"WITH {SAMPLED}, {SHARES.format(v='o_orderpriority', o='orders', r='samp')} SELECT value, round(p, 9) AS p, round(q, 9) AS q FROM pq WHERE p > 0 ORDER BY p DESC, value LIMIT 12")
def category_bars(spark, sf_dir):
    bars = charts.category_bars(*sample_of(spark, sf_dir), "o_orderpriority")
    return bars.select("value", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query(f"WITH {KEYED}, {UNITS} SELECT rows, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 9) AS density FROM units GROUP BY rows")
def unit_size_hist(spark, sf_dir):
    return charts.unit_sizes(units.unit_table(read(spark, sf_dir, "lineitem"), UNIT, STRATA, ORDER)).withColumn("density", F.round("density", 9))


@query(f"{UNIT_PARTS} SELECT *, max(abs(gap_pp)) OVER (PARTITION BY \"column\") AS max_gap_pp FROM (" + " UNION ALL ".join(table_sql(c, 12) for c in COLUMNS) + ")")
def distribution_panels(spark, sf_dir):
    out = charts.distribution_panels(*units_of(spark, sf_dir), COLUMNS)
    return out.withColumns({"orig_ratio": F.round("orig_ratio", 9), "reduced_ratio": F.round("reduced_ratio", 9), "gap_pp": F.round("gap_pp", 6) + F.lit(0.0), "max_gap_pp": F.round("max_gap_pp", 6)})


@query()
def pca_scatter(spark, sf_dir):
    df = vectors(spark, sf_dir).select("vec_id", F.slice("features", 1, 8).alias("features"))
    return charts.scatter(df, drawing.random_sample(df, 50, ["vec_id"]), ["vec_id"], components=3)


@query()
def tsne_layout(spark, sf_dir):
    return layout.tsne(vectors(spark, sf_dir).filter("features IS NOT NULL"), "vec_id")


@query()
def graph_layout(spark, sf_dir):
    return layout.graph_layout(vectors(spark, sf_dir).filter("features IS NOT NULL"), "vec_id")


@query("SELECT o_orderkey, round(least(40, greatest(2, 6 * o_totalprice / avg(o_totalprice) OVER ())), 6) AS size FROM orders")
def point_size(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    mean = orders.agg(F.avg("o_totalprice")).first()[0]
    return orders.select("o_orderkey", F.round(charts.point_size(F.col("o_totalprice"), mean), 6).alias("size"))


# --- relations -------------------------------------------------------------


@query(f"SELECT a, b, round(r, 6) AS r, CASE WHEN r < 0 THEN 'negative' ELSE 'positive' END AS sign, round(abs(r), 6) AS width FROM ({edges_sql('lineitem')}) WHERE abs(r) >= 0.003")
def corr_edges(spark, sf_dir):
    net = relations.network(fidelity.correlation_edges(read(spark, sf_dir, "lineitem"), NUMBERS), 0.003)
    return net.withColumns({"r": F.round("r", 6), "width": F.round("width", 6)})


OUTCOME = """CASE WHEN abs(r_o) >= 0.005 AND abs(r_r) < 0.005 THEN 'vanished' WHEN abs(r_o) < 0.005 AND abs(r_r) >= 0.005 THEN 'new'
WHEN abs(r_r) < abs(r_o) - 0.01 THEN 'weaker' WHEN abs(r_r) > abs(r_o) + 0.01 THEN 'stronger' ELSE 'kept' END"""


@query(f"{CHANGES} SELECT a, b, round(r_o, 6) AS r_o, round(r_r, 6) AS r_r, round(gap, 6) AS gap, {OUTCOME} AS outcome FROM ch WHERE abs(r_o) >= 0.005 OR abs(r_r) >= 0.005")
def relation_outcome(spark, sf_dir):
    out = relations.outcomes(changes_of(spark, sf_dir), 0.005, 0.01)
    return out.withColumns({c: F.round(c, 6) for c in ("r_o", "r_r", "gap")})


@query(f"{CHANGES} SELECT a, b, CASE WHEN abs(r_o) >= 0.005 THEN 'vanished' ELSE 'new' END AS status FROM ch WHERE (abs(r_o) >= 0.005) <> (abs(r_r) >= 0.005)")
def edge_changes(spark, sf_dir):
    line, kept = units_of(spark, sf_dir)
    return relations.vanished_and_new(fidelity.correlation_edges(line, NUMBERS), fidelity.correlation_edges(kept, NUMBERS), 0.005)


@query(f"{CHANGES} SELECT a, b, round(r_o, 6) AS r_o, round(r_r, 6) AS r_r, round(gap, 6) AS gap FROM ch")
def pair_rank(spark, sf_dir):
    return relations.ranked_changes(changes_of(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("r_o", "r_r", "gap")})


@query(
    f"{CHANGES}, b2 AS (SELECT a, b, r_r - r_o AS d FROM ch UNION ALL SELECT b, a, r_r - r_o FROM ch) SELECT a AS name, "
    + ", ".join(f"round(coalesce(max(CASE WHEN b = '{c}' THEN d END), 0), 6) AS {c}" for c in NUMBERS)
    + " FROM b2 GROUP BY a"
)
def difference_matrix(spark, sf_dir):
    return relations.difference_matrix(changes_of(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in NUMBERS})


@query(
    f"""WITH {SAMPLED}, o AS (SELECT o_orderpriority, count(*) AS orig_rows FROM orders GROUP BY 1), r AS (SELECT o_orderpriority, count(*) AS reduced_rows FROM samp GROUP BY 1)
SELECT o_orderpriority, orig_rows, coalesce(reduced_rows, 0) AS reduced_rows, round(orig_rows / sum(orig_rows) OVER ()::DOUBLE, 9) AS orig_ratio, round(coalesce(reduced_rows, 0) / sum(reduced_rows) OVER ()::DOUBLE, 9) AS reduced_ratio,
CASE WHEN reduced_rows IS NULL THEN 'not reflected' WHEN reduced_rows <= least(30, orig_rows) THEN 'by minimum guarantee' ELSE 'reflected' END AS status FROM o LEFT JOIN r USING (o_orderpriority)"""
)
def cluster_reflection(spark, sf_dir):
    out = relations.cluster_reflection(*sample_of(spark, sf_dir), "o_orderpriority")
    return out.withColumns({"orig_ratio": F.round("orig_ratio", 9), "reduced_ratio": F.round("reduced_ratio", 9)})


@query(f"WITH {SAMPLED} SELECT (SELECT count(*) FROM orders) AS orig_rows, count(*) AS reduced_rows, avg(w) AS mean_weight, max(w) AS max_weight FROM samp")
def scale_comparison(spark, sf_dir):
    return relations.scale_comparison(*sample_of(spark, sf_dir))


@query(
    f"""{CHANGES}, edge AS (SELECT quantile_cont(l_extendedprice, 0.999) AS x FROM lineitem), clean AS (SELECT l.* FROM lineitem l, edge WHERE l_extendedprice <= x), w AS ({edges_sql('clean')}),
f AS (SELECT ch.*, {OUTCOME} AS outcome, w.r AS r_c FROM ch JOIN w USING (a, b) WHERE abs(r_o) >= 0.005 OR abs(r_r) >= 0.005)
SELECT a, b, outcome, CASE WHEN abs(r_o - r_c) >= 0.5 * gap THEN 'outliers left out' WHEN abs(abs(r_o) - 0.005) <= 0.001 AND outcome IN ('vanished', 'new') THEN 'near the threshold' ELSE 'representatives' END AS cause FROM f WHERE outcome <> 'kept'"""
)
def change_causes(spark, sf_dir):
    line, _ = units_of(spark, sf_dir)
    edge = ordered.quantiles(line, "l_extendedprice", [0.999])[0.999]
    clean = fidelity.correlation_edges(line.filter(F.col("l_extendedprice") <= edge), NUMBERS)
    return relations.causes(changes_of(spark, sf_dir), clean, threshold=0.005, margin=0.01, border=0.001)


# --- sources and sinks -----------------------------------------------------


def folder_of(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{scratch(spark, name)}/{np.random.default_rng().integers(2**62)}"


def draw_sql(seed: int, name: str) -> str:
    return f"((('0x' || substr(md5('{seed}:{name}:' || id), 1, 8))::BIGINT + 1) / 4294967297::DOUBLE)"


def normal_sql(seed: int, name: str) -> str:
    return f"(sqrt(-2 * ln({draw_sql(seed, name + 'a')})) * cos(2 * pi() * {draw_sql(seed, name + 'b')}))"


def pick_sql(values: tuple[str, ...], u: str) -> str:
    return f"list_extract({list(values)}, floor({u} * {len(values)})::INT + 1)"


def sales_sql(ids: str, seed: int) -> str:
    """The columns of the synthetic sales table with outliers and missing values, one row for each id of a select."""
    u = draw_sql(seed, "group")
    edges = np.cumsum([g[1] for g in synthetic.GROUPS[:-1]]).tolist()

    def of_group(i: int) -> str:
        show = lambda g: f"'{g[i]}'" if i == 0 else f"{float(g[i])}::DOUBLE"
        return "CASE " + " ".join(f"WHEN u < {e!r} THEN {show(g)}" for e, g in zip(edges, synthetic.GROUPS, strict=False)) + f" ELSE {show(synthetic.GROUPS[-1])} END"

    far = lambda c, k: f"CASE WHEN {draw_sql(seed, 'outlier')} < 0.001 THEN {c} * {k} + {k} ELSE {c} END"
    some = lambda c, value: f"CASE WHEN {draw_sql(seed, 'missing ' + c)} >= 0.02 THEN {value} END AS {c}"
    return f"""SELECT date, store_id, region, {some('plan', 'plan')}, channel, is_member, age, {some('income', far('income', 40.0))}, {far('visits', 25.0)} AS visits, {some('score', 'score')}, tenure,
{far('spend', 60.0)} AS spend, discount_rate, cluster, memo FROM (SELECT id, strftime(DATE '2024-01-01' + floor({draw_sql(seed, 'day')} * 366)::INT, '%Y-%m-%d') AS date,
printf('S%03d', floor({draw_sql(seed, 'store')} * 400)::INT) AS store_id, {pick_sql(synthetic.REGIONS, draw_sql(seed, 'region'))} AS region, {pick_sql(synthetic.PLANS, f"pow({draw_sql(seed, 'plan')}, 1.5)")} AS plan,
{pick_sql(synthetic.CHANNELS, draw_sql(seed, 'channel'))} AS channel, {draw_sql(seed, 'member')} < 0.4 AS is_member, round(age + 4 * {normal_sql(seed, 'age')}, 1) AS age,
round(income * (1 + 0.15::DOUBLE * {normal_sql(seed, 'income')}), 0) AS income, greatest(0.0::DOUBLE, round(visits + 2 * {normal_sql(seed, 'visits')}, 0)) AS visits, round(score + 6 * {normal_sql(seed, 'score')}, 1) AS score,
round(12 * {draw_sql(seed, 'tenure')} + visits / 4, 1) AS tenure, round(spend * (1 + 0.25::DOUBLE * {normal_sql(seed, 'spend')}), 2) AS spend, round(0.3::DOUBLE * {draw_sql(seed, 'discount')}, 3) AS discount_rate,
cluster, 'visit note of a customer in group ' || cluster || ' number ' || id AS memo
FROM (SELECT id, {of_group(0)} AS cluster, {of_group(2)} AS age, {of_group(3)} AS income, {of_group(4)} AS visits, {of_group(5)} AS score, {of_group(6)} AS spend FROM (SELECT id, {u} AS u FROM ({ids}))))"""


def customers_sql(ids: str, seed: int) -> str:
    return f"""SELECT printf('C%06d', id) AS customer_id, strftime(DATE '2020-01-01' + floor({draw_sql(seed, 'signup')} * 1500)::INT, '%Y-%m-%d') AS signup, tier, round(40 + 12 * {normal_sql(seed, 'age')}, 1) AS age,
round(worth * (1 + 0.3::DOUBLE * {normal_sql(seed, 'worth')}), 2) AS ltv, floor(worth / 150 + 10 * {draw_sql(seed, 'orders')})::BIGINT AS orders, floor(3 * {draw_sql(seed, 'refunds')})::BIGINT AS refunds,
floor(11 * {draw_sql(seed, 'nps')})::BIGINT AS nps, {draw_sql(seed, 'active')} < 0.8 AS active FROM (SELECT id, tier, CASE tier WHEN 'gold' THEN 5200.0::DOUBLE WHEN 'silver' THEN 1900.0::DOUBLE ELSE 600.0::DOUBLE END AS worth
FROM (SELECT id, CASE WHEN {draw_sql(seed, 'tier')} < 0.6 THEN 'bronze' WHEN {draw_sql(seed, 'tier')} < 0.9 THEN 'silver' ELSE 'gold' END AS tier FROM ({ids})))"""


ORDER_IDS, CUSTOMER_IDS, PART_IDS = "SELECT o_orderkey AS id FROM orders", "SELECT c_custkey AS id FROM customer", "SELECT p_partkey AS id FROM part"


def ids_of(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """Ids, in as many parts as there are task slots: few bytes a row in a file, but dozens of digests for each."""
    return dealt(read(spark, sf_dir, name).select(F.col(key).alias("id")), ["id"])


@query(" UNION ALL ".join(f"SELECT *, 'sales_{i}' AS file FROM ({sales_sql(ids, 7 + i)})" for i, ids in enumerate((CUSTOMER_IDS, PART_IDS))))
def merge_group(spark, sf_dir):
    """Synthetic sales of each customer and each part written to a folder, found, merged."""
    folder = folder_of(spark, "merge")
    for i, (name, key) in enumerate((("customer", "c_custkey"), ("part", "p_partkey"))):
        delimited.write_delimited(synthetic.sales_of(ids_of(spark, sf_dir, name, key), 7 + i), f"{folder}/sales_{i}.csv")
    merged = delimited.merge_group(spark, delimited.find_files(spark, folder))
    return merged.withColumn("file", F.split(delimited.SOURCE, r"\.").getItem(0)).drop(delimited.SOURCE)


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, sf_dir):
    """customer written as CSV, sniffed, read and typed again."""
    folder = folder_of(spark, "csv")
    delimited.write_delimited(read(spark, sf_dir, "customer"), folder)
    return delimited.merge_group(spark, delimited.find_files(spark, folder)).drop(delimited.SOURCE)


SMALL_TABLES = {"region": ",", "nation": ";", "part": "|", "supplier": "\t"}


def header_sql(table: str) -> str:
    return f"SELECT '{table}' AS file, column_name AS name, row_number() OVER () - 1 AS position FROM (DESCRIBE {table})"


def written_tables(spark: SparkSession, sf_dir: str, tables: dict[str, str]) -> str:
    folder = folder_of(spark, "tables")
    for name, separator in tables.items():
        delimited.write_delimited(read(spark, sf_dir, name), f"{folder}/{name}", separator=separator)
    return folder


@query(" UNION ALL ".join(f"SELECT *, '{sep}' AS separator FROM ({header_sql(t)})" for t, sep in SMALL_TABLES.items()))
def header_columns(spark, sf_dir):
    """Tables written with four delimiters: delimiter and columns from the files' first lines."""
    files = delimited.find_files(spark, written_tables(spark, sf_dir, SMALL_TABLES))
    rows = [(name.partition("/")[0], c, i, kind.separator) for name, kind in delimited.headers(spark, files).items() for i, c in enumerate(kind.header)]
    return spark.createDataFrame(rows, "file string, name string, position long, separator string")


LISTED = " UNION ALL ".join(f"SELECT '{f}' AS file, string_agg(name, ',' ORDER BY position) AS header FROM ({header_sql(t)})" for f, t in (("a", "region"), ("b", "nation"), ("c", "region")))


@query(f"SELECT header, string_agg(file, ',' ORDER BY file) AS files, count(*) AS n, count(*) > 1 AS merge FROM ({LISTED}) GROUP BY header")
def schema_groups(spark, sf_dir):
    files = [(f, read(spark, sf_dir, t).columns) for f, t in (("a", "region"), ("b", "nation"), ("c", "region"))]
    grouped = profile.group_by_header(spark.createDataFrame(files, "file string, header array<string>"))
    return grouped.select(F.array_join("header", ",").alias("header"), F.array_join("files", ",").alias("files"), "n", "merge")


@query(f"{UNIT_PARTS}, {AGAIN}, {SIZES}, {TOTALS} SELECT 'A' AS \"group\", totals.*, 'l_orderkey' AS unit_columns, 'l_returnflag,l_linestatus' AS strata_columns FROM totals")
def unit_report(spark, sf_dir):
    """A report document written and read again."""
    line, kept = units_of(spark, sf_dir)
    scores = catfidelity.grouped_similarity(line, kept, COLUMNS, UNIT, STRATA, ORDER).first().asDict()
    path = folder_of(spark, "report")
    reports.write_report(spark, {"group": "A", "score": scores, "unit_columns": UNIT, "strata_columns": STRATA}, path)
    return spark.read.json(path).select("group", "score.*", *[F.array_join(c, ",").alias(c) for c in ("unit_columns", "strata_columns")])


def read_back(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


@query(f"WITH {SAMPLED} SELECT w AS weight, o_orderkey, o_orderstatus, o_totalprice FROM samp")
def reduced_csv(spark, sf_dir):
    """A reduced table as its CSV says."""
    path = folder_of(spark, "reduced")
    delimited.write_reduced(sample_of(spark, sf_dir)[1].select("o_orderkey", "o_orderstatus", "o_totalprice", "_weight"), path)
    return read_back(spark, path, "weight double, o_orderkey long, o_orderstatus string, o_totalprice double")


@query(SQL["stratum_report"])
def stratum_csv(spark, sf_dir):
    path = folder_of(spark, "stratum")
    made = stratum_report(spark, sf_dir)
    reports.write_table(made, path)
    return read_back(spark, path, made.schema.simpleString()[7:-1].replace(":", " "))


@query(SQL["distribution_table"])
def distribution_csv(spark, sf_dir):
    path = folder_of(spark, "distribution")
    made = distribution_table(spark, sf_dir)
    reports.write_table(made, path)
    return read_back(spark, path, ", ".join(f"`{n}` {t}" for n, t in made.dtypes))


@query(sales_sql(ORDER_IDS, 7))
def synthetic_sales(spark, sf_dir):
    """A synthetic visit for each order."""
    return synthetic.sales_of(ids_of(spark, sf_dir, "orders", "o_orderkey"))


@query(customers_sql(CUSTOMER_IDS, 7))
def synthetic_customers(spark, sf_dir):
    """A synthetic customer for each given one."""
    return synthetic.customers_of(ids_of(spark, sf_dir, "customer", "c_custkey"))


U_OF_ORDER = "((('0x' || substr(md5('3:{name}:' || o_orderkey), 1, 8))::BIGINT + 1) / 4294967297::DOUBLE)"
THREE = "o_totalprice AS income, o_totalprice / 2 AS spend, o_custkey::DOUBLE AS visits"


def three_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), price.alias("income"), (price / 2).alias("spend"), F.col("o_custkey").cast("double").alias("visits"))


@query(
    f"SELECT id, " + ", ".join(f"CASE WHEN far THEN {c} * {k} + {k} ELSE {c} END AS {c}" for c, k in (("income", 40.0), ("spend", 60.0), ("visits", 25.0)))
    + f" FROM (SELECT o_orderkey AS id, {THREE}, {U_OF_ORDER.format(name='outlier')} < 0.001 AS far FROM orders)"
)
def outliers_in(spark, sf_dir):
    return synthetic.with_outliers(three_columns(spark, sf_dir), 3)


@query(
    f"SELECT o_orderkey AS id, CASE WHEN {U_OF_ORDER.format(name='missing income')} >= 0.02 THEN o_totalprice END AS income, CASE WHEN {U_OF_ORDER.format(name='missing score')} >= 0.02 THEN o_custkey END AS score,"
    f" CASE WHEN {U_OF_ORDER.format(name='missing plan')} >= 0.02 THEN o_orderstatus END AS plan FROM orders"
)
def missing_in(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("income"), F.col("o_custkey").alias("score"), F.col("o_orderstatus").alias("plan"))
    return synthetic.with_missing(orders, 3)


# --- choices and their reports ---------------------------------------------


@query(
    f"""WITH {HOLED}, r AS (SELECT c, avg(m) AS m, pos FROM (SELECT unnest([1, 2, 3]) AS pos, unnest(['l_discount', 'l_tax', 'l_quantity']) AS c, unnest([(l_discount IS NULL)::INT, (l_tax IS NULL)::INT, (l_quantity IS NULL)::INT]) AS m FROM holed) GROUP BY c, pos)
SELECT string_agg(printf('%s (%.1f%% missing)', c, 100 * m), ', ' ORDER BY m DESC, pos) AS reason FROM r WHERE m > 0"""
)
def missing_reason(spark, sf_dir):
    return spark.createDataFrame([(profile.missing_reason(holed(spark, sf_dir)),)], "reason string")


@query(SQL["classify_columns"].replace("AS kind,", "AS kind, '' AS reason,").replace("'identifier' AS kind, '' AS reason", "'identifier' AS kind, 'identifier columns are left out' AS reason"))
def inspection(spark, sf_dir):
    """The listing of columns that the command line shows."""
    return profile.classify(read(spark, sf_dir, "customer"), sample_rows=None)


@query(f"WITH {HOLED} SELECT name FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, avg(({c} IS NULL)::INT) AS m FROM holed" for c in ("l_discount", "l_tax", "l_quantity")) + ") WHERE m <= 0.1 AND name <> 'l_quantity'")
def override_selection(spark, sf_dir):
    found = profile.classify(holed(spark, sf_dir), sample_rows=None)
    return spark.createDataFrame([(n,) for n in features.override_selection(found, None, ["l_quantity"], 0.1)], "name string")


@query("SELECT column_name AS name FROM (DESCRIBE orders) WHERE column_type IN ('INTEGER', 'BIGINT', 'DOUBLE', 'BOOLEAN')")
def numeric_columns(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return spark.createDataFrame([(c,) for c in orders.columns if features.is_numeric(orders, c)], "name string")


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("SELECT name FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS d FROM orders" for c in ORDER_COLUMNS) + ") WHERE d <= 20")
def display_columns(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in cli.few_level_columns(read(spark, sf_dir, "orders"), ORDER_COLUMNS)], "name string")


@query(
    """WITH lv AS (SELECT o_orderstatus AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS pos FROM orders GROUP BY 1),
st AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)
SELECT o_orderkey, 0 AS position, round((o_totalprice - m) / s, 6) AS value FROM orders, st UNION ALL SELECT o_orderkey, pos, CASE WHEN o_orderstatus = v THEN 1.0 ELSE 0.0 END FROM orders, lv"""
)
def feature_matrix(spark, sf_dir):
    rows, _, _ = features.feature_matrix(read(spark, sf_dir, "orders"), ["o_totalprice", "o_orderstatus"])
    return rows.select("o_orderkey", F.posexplode("features").alias("position", "value")).select("o_orderkey", F.col("position").cast("long").alias("position"), F.round("value", 6).alias("value"))


@query(
    f"""WITH {HOLED}, k AS (SELECT * FROM holed WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL) SELECT count(*) AS rows, (SELECT count(*) FROM holed) - count(*) AS dropped, 'l_discount,l_tax,l_quantity' AS names,
round(corr(l_discount, l_quantity), 6) AS r FROM k"""
)
def prepared(spark, sf_dir):
    """Rows without missing basis values; features are as correlated as the columns they come from."""
    made = features.prepare(holed(spark, sf_dir), None, ["l_discount", "l_tax", "l_quantity"])
    both = F.round(F.corr(F.col("features")[0], F.col("features")[2]), 6)
    return made.rows.agg(F.count("*").alias("rows"), F.lit(made.dropped).cast("long").alias("dropped"), F.lit(",".join(made.names)).alias("names"), both.alias("r"))


@query("SELECT n::BIGINT AS asked, least(n, total)::BIGINT AS taken FROM (SELECT unnest([1, 50, 149, 10000000]) AS n), (SELECT count(*) AS total FROM customer)")
def size_check(spark, sf_dir):
    total = read(spark, sf_dir, "customer").count()
    return spark.createDataFrame([(n, drawing.check_size(n, total)) for n in (1, 50, 149, 10_000_000)], "asked long, taken long")


LIMITS = "p_brand=5, ,p_type = 2,"


@query(
    f"""WITH l AS (SELECT trim(split_part(part, '=', 1)) AS name, trim(split_part(part, '=', 2))::BIGINT AS n FROM (SELECT unnest(string_split('{LIMITS}', ',')) AS part) WHERE trim(part) <> ''),
d AS (SELECT 'p_brand' AS name, count(DISTINCT p_brand) AS levels FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part)
SELECT name, n, levels, least(n, levels) AS kept FROM l JOIN d USING (name)"""
)
def parsed_limits(spark, sf_dir):
    """Limits as the command line gives them, beside the levels that they meet."""
    limits = vocabulary.parse_limits(LIMITS)
    levels = read(spark, sf_dir, "part").agg(*[F.count_distinct(c).alias(c) for c in limits])
    rows = [F.struct(F.lit(c).alias("name"), F.lit(n).cast("long").alias("n"), F.col(c).alias("levels"), F.least(F.lit(n).cast("long"), F.col(c)).alias("kept")) for c, n in limits.items()]
    return levels.select(F.inline(F.array(*rows)))


@query(
    """WITH a AS (SELECT * FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)),
b AS (SELECT * FROM a WHERE p_type IN (SELECT p_type FROM a GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)),
r AS (SELECT 'p_brand' AS name, count(DISTINCT p_brand) AS levels_before, count(*) AS rows_before, (SELECT count(DISTINCT p_brand) FROM a) AS levels_after, (SELECT count(*) FROM a) AS rows_after FROM part
UNION ALL SELECT 'p_type', count(DISTINCT p_type), count(*), (SELECT count(DISTINCT p_type) FROM b), (SELECT count(*) FROM b) FROM a)
SELECT *, round(rows_after / rows_before::DOUBLE, 9) AS coverage, printf('%s: %d -> %d values, %d -> %d rows (%.1f%%)', name, levels_before, levels_after, rows_before, rows_after, 100.0 * rows_after / rows_before) AS summary FROM r"""
)
def limit_coverage(spark, sf_dir):
    found = vocabulary.limit_values(read(spark, sf_dir, "part"), vocabulary.parse_limits(LIMITS))[1]
    return found.select(F.col("column").alias("name"), "levels_before", "rows_before", "levels_after", "rows_after", F.round("row_coverage", 9).alias("coverage"), "summary")


AXES = """axes AS (SELECT p_brand AS brand, avg(p_retailprice) / (SELECT max(p_retailprice) FROM part) AS trust, 100 * avg((p_retailprice < (SELECT avg(p_retailprice) FROM part))::INT) AS covered, 100 * avg((p_type LIKE '%STEEL%')::INT) AS related FROM part GROUP BY 1)"""


def axes_of(spark: SparkSession, sf_dir: str) -> list:
    """Three measures of the parts of each brand (25 brands) as stand-ins for measured axes."""
    part = read(spark, sf_dir, "part")
    mean, most = part.agg(F.avg("p_retailprice"), F.max("p_retailprice")).first()
    shares = part.groupBy("p_brand").agg(
        (F.avg("p_retailprice") / F.lit(most)).alias("trust"),
        (100 * F.avg((F.col("p_retailprice") < F.lit(mean)).cast("int"))).alias("covered"),
        (100 * F.avg(F.col("p_type").contains("STEEL").cast("int"))).alias("related"),
    )
    return shares.collect()


@query(f"WITH {AXES} SELECT brand, trust, covered, round(50 * trust + 0.5::DOUBLE * covered, 1) AS score FROM axes")
def structure_score(spark, sf_dir):
    rows = [(r.p_brand, r.trust, r.covered, structure.structure_score(r.trust, r.covered)) for r in axes_of(spark, sf_dir)]
    return spark.createDataFrame(rows, "brand string, trust double, covered double, score double")


@query(f"WITH {AXES} SELECT brand, covered AS distribution, related AS correlation, 100 * trust AS structure, round((covered + related + 100 * trust) / 3, 1) AS total FROM axes")
def axes_score(spark, sf_dir):
    rows = [(r.p_brand, r.covered, r.related, 100 * r.trust, structure.overall_score(r.covered, r.related, 100 * r.trust)["total"]) for r in axes_of(spark, sf_dir)]
    return spark.createDataFrame(rows, "brand string, distribution double, correlation double, structure double, total double")


@query("SELECT count(*) AS accounted, count(*) AS members, true AS reps_are_rows FROM orders")
def cluster_accounts(spark, sf_dir):
    """Weights and rows left out add up to all rows, so do members; representatives are rows of the table, once each."""
    p = problem_of(spark, sf_dir)
    made = clustering.cluster_reduce(p.rows, 300, p.key)
    known = made.rows.join(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    kept = made.rows.agg((F.round(F.sum("_weight")).cast("long") + made.excluded).alias("accounted"), F.count("*").alias("rows"))
    members = made.members.agg((F.count_distinct("o_orderkey") + made.excluded).alias("members"))
    return kept.crossJoin(members).crossJoin(known.agg(F.count_distinct("o_orderkey").alias("found"))).select("accounted", "members", (F.col("rows") == F.col("found")).alias("reps_are_rows"))  # one row each


@query(f"WITH {SAMPLED}, d AS (SELECT * FROM orders ORDER BY md5('0:' || o_orderkey), o_orderkey LIMIT 400) SELECT 'original' AS side, o_totalprice AS x, o_custkey::DOUBLE AS y, 2.0::DOUBLE AS size FROM d UNION ALL SELECT 'reduced', o_totalprice, o_custkey::DOUBLE, 6.0::DOUBLE FROM samp")
def pair_scatter(spark, sf_dir):
    return charts.pair_scatter(*sample_of(spark, sf_dir), ("o_totalprice", "o_custkey"), ["o_orderkey"], limit=400)


def box_sql(side: str, table: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", '{side}' AS side, min({c})::DOUBLE AS least, min(CASE WHEN inside THEN {c} END)::DOUBLE AS low, any_value(a)::DOUBLE AS q1, any_value(b)::DOUBLE AS median, any_value(d)::DOUBLE AS q3, max(CASE WHEN inside THEN {c} END)::DOUBLE AS high, max({c})::DOUBLE AS most
FROM (SELECT {c}, a, b, d, {c} BETWEEN a - 1.5 * (d - a) AND d + 1.5 * (d - a) AS inside FROM {table}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.5) AS b, quantile_cont({c}, 0.75) AS d FROM {table}))"""


@query(f"WITH {SAMPLED} " + " UNION ALL ".join(box_sql(side, t, c) for c in ("o_totalprice", "o_custkey") for side, t in (("original", "orders"), ("reduced", "samp"))))
def box_plots(spark, sf_dir):
    return charts.box_plots(*sample_of(spark, sf_dir), ["o_totalprice", "o_custkey"])


CLI_KEYED = "keyed AS (SELECT *, user_id::VARCHAR AS unit, event_type AS stratum FROM events)"
CLI_UNITS = "units AS (SELECT unit, arg_min(stratum, event_id) AS stratum, count(*) AS rows, count(DISTINCT stratum) AS mixed FROM keyed GROUP BY unit)"


@query(
    f"""WITH {CLI_KEYED}, {CLI_UNITS}, {DRAWN}, {taken_sql(0.2)} SELECT (SELECT count(*) FROM events) AS original_rows, sum(rows)::BIGINT AS reduced_rows, (SELECT count(*) FROM units) AS units_total, count(*) AS units_kept,
(SELECT count(DISTINCT stratum) FROM units) AS strata_total FROM taken"""
)
def units_command(spark, sf_dir):
    """The command line over a folder with the events, whole users kept by their first event's type."""
    folder = folder_of(spark, "units")
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy("event_id").coalesce(1)
    delimited.write_delimited(events, f"{folder}/in")
    arguments = [f"{folder}/in", "--unit", "user_id", "--strata", "event_type", "--ratio", "0.2", "--columns", "event_type", "--show-dist", "event_type", "--out", f"{folder}/out"]
    done = cli.units_main(spark, arguments)[0]
    names = ("original_rows", "reduced_rows", "units_total", "units_kept", "strata_total")
    return spark.createDataFrame([tuple(done[n] for n in names)], ", ".join(f"{n} long" for n in names))


# --- items -----------------------------------------------------------------


@query(
    """WITH t AS (SELECT conv_id, turn, bool_and(coalesce(length(text) >= 200, false)) AS done FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL)
SELECT conv_id, turn FROM t WHERE NOT done AND (turn < 1 OR EXISTS (SELECT 1 FROM t p WHERE p.conv_id = t.conv_id AND p.turn = t.turn - 1 AND p.done))
AND (turn < 2 OR EXISTS (SELECT 1 FROM t p WHERE p.conv_id = t.conv_id AND p.turn = t.turn - 2 AND p.done))"""
)
def ready_turns(spark, sf_dir):
    """Turns of under 200 characters whose two turns before them have more: those to be written next."""
    turn = F.col("turn")
    before = F.array(*[F.struct("conv_id", (turn - k).alias("turn")) for k in (1, 2)])
    return items.ready_items(read(spark, sf_dir, "conversations"), ["conv_id", "turn"], F.length("text") >= 200, F.filter(before, lambda need: need["turn"] >= 0))


@query(
    """SELECT r_name AS region, n_name AS nation, (2 - grouping(r_name) - grouping(n_name))::INT AS depth, count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open_orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"""
)
def order_rollup(spark, sf_dir):
    """Orders by region and nation, with totals of regions and of all."""
    tables = {t: read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region")}
    # Orders are summed by customer before they travel, so the joins meet one row a customer.
    per = tables["orders"].groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.sum("o_totalprice").alias("price"))
    named = per.join(tables["customer"], F.col("o_custkey") == F.col("c_custkey")).join(tables["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    measures = [F.sum("n").alias("orders"), F.sum("open").alias("open_orders"), F.round(F.sum("price"), 2).alias("total")]
    return items.rolled_up(named.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "n", "open", "price"), ["region", "nation"], measures)
