"""Command lines: reduce a folder, reduce keeping whole units, generate trial files."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import catfidelity, profile as profiling, units
from tarn.operators.features import override_selection, prepare
from tarn.operators.vocabulary import limit_values, parse_limits
from tarn.plans.progress import progress
from tarn.plans.search import TARGET, Problem, attempt_ratio, choose_method, search_ratio, search_size
from tarn.sources import delimited, reports, synthetic

FEW_LEVELS = 20


def groups(spark: SparkSession, folder: str, merge: bool = True) -> list[tuple[str, list[delimited.SourceFile]]]:
    """(letter, files) of every header found, most files first; files that cannot be read are left out.

    Without ``merge`` every file is a group of its own, in the same order.
    """
    files = {f.name: f for f in delimited.find_files(spark, folder)}
    found = delimited.headers(spark, list(files.values())) if files else {}
    for name, kind in found.items():
        if kind.problem:
            print(f"skipped {name}: {kind.problem}")
    readable = [(name, list(kind.header)) for name, kind in found.items() if not kind.problem]
    if not readable:
        raise SystemExit("no readable files")
    grouped = profiling.group_by_header(spark.createDataFrame(readable, "file string, header array<string>")).collect()  # one row a file
    parts = [g.files for g in grouped] if merge else [[name] for g in grouped for name in g.files]
    return [(chr(ord("A") + i) if i < 26 else f"G{i}", [files[name] for name in names]) for i, names in enumerate(parts)]


def reduce_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("reduce")
    p.add_argument("folder")
    p.add_argument("--target", type=float, default=TARGET)
    p.add_argument("--out", default="results")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--no-plot", action="store_true")
    p.add_argument("--inspect", action="store_true")
    p.add_argument("--columns", type=lambda s: [c.strip() for c in s.split(",")])
    p.add_argument("--exclude", type=lambda s: [c.strip() for c in s.split(",")], default=[])
    p.add_argument("--max-missing", type=float)
    p.add_argument("--per-file", action="store_true", help="do not merge files of one header")
    return p


def reduce_main(spark: SparkSession, argv: Sequence[str]) -> list[dict]:
    """Reduce every group of files; returns the reports that it writes."""
    a = reduce_parser().parse_args(argv)
    done = []
    for letter, files in groups(spark, a.folder, not a.per_file):
        began = time.time()
        df = delimited.with_row_id(delimited.merge_group(spark, files)).persist()
        shown = df.drop("_row_id", delimited.SOURCE)
        found = profiling.classify(shown).persist()
        if a.inspect:
            found.orderBy("position").show(1000, truncate=60)
            continue
        try:
            prepared = prepare(df, found, override_selection(found, a.columns, a.exclude, a.max_missing))
        except ValueError as e:
            print(f"group {letter} skipped: {e}")
            continue
        problem = Problem(prepared, ["_row_id"], a.seed)
        with progress(spark, f"group {letter}: size search") as step:
            first, curve = search_size(problem, a.target, told=step.attempt)
        with progress(spark, f"group {letter}: comparison of methods") as step:
            best, methods = choose_method(problem, first.size, told=step.attempt)
        report = {
            "group": letter,
            "original_rows": problem.total,
            "reduced_rows": best.size,
            "ratio": round(best.size / problem.total, 6),
            "method": best.method,
            "score": {"total": best.score, "distribution": best.distribution, "correlation": best.correlation, "structure": best.structure},
            "size_curve": curve,
            "methods": methods,
            "detail": best.detail | {"notes": [*prepared.notes, *best.notes], "excluded": best.excluded},
        }
        delimited.write_reduced(best.rows.drop("features", "_row_id"), f"{a.out}/reduced_{letter}")
        reports.write_report(spark, report, f"{a.out}/report_{letter}")
        worst = sorted(best.detail["columns"], key=lambda c: c["score"])[:3]
        print(f"group {letter}: {problem.total} -> {best.size} rows by {best.method}, score {best.score}, worst {[c['name'] for c in worst]}, {time.time() - began:.0f} s")
        for m in sorted(methods, key=lambda m: -m["score"]):
            print(f"  {m['method']}: {m['score']}")
        done.append(report)
    return done


def units_parser() -> argparse.ArgumentParser:
    names = lambda s: [c.strip() for c in s.split(",")]
    p = argparse.ArgumentParser("reduce-units")
    p.add_argument("folder")
    p.add_argument("--unit", type=names, required=True)
    p.add_argument("--strata", type=names, required=True)
    p.add_argument("--ratio", type=float)
    p.add_argument("--target", type=float, default=TARGET)
    p.add_argument("--combo", type=names, action="append")
    p.add_argument("--min-units", type=int, default=1)
    p.add_argument("--columns", type=names)
    p.add_argument("--out", default="results")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--inspect", action="store_true")
    p.add_argument("--show-dist", type=names, help="columns whose distribution is shown; those of few values if not given")
    p.add_argument("--dist-top", type=int, default=10)
    p.add_argument("--no-plot", action="store_true")
    p.add_argument("--limit", type=parse_limits, default={})
    p.add_argument("--limit-mode", choices=("top", "sample"), default="top")
    p.add_argument("--per-file", action="store_true", help="do not merge files of one header")
    return p


def shown_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def few_level_columns(df: DataFrame, columns: Sequence[str], most: int = FEW_LEVELS) -> list[str]:
    """Columns of few distinct values, for display."""
    row = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"d{i}"] <= most]


def units_main(spark: SparkSession, argv: Sequence[str]) -> list[dict]:
    """Reduce every group of files keeping whole units; returns the reports that it writes."""
    a = units_parser().parse_args(argv)
    done = []
    for letter, files in groups(spark, a.folder, not a.per_file):
        df = delimited.with_row_id(delimited.merge_group(spark, files)).persist()
        order = ["_row_id"]
        try:
            limited, limits = limit_values(df, a.limit, a.limit_mode, a.seed)
            told = [r.asDict(recursive=True) for r in limits.collect()]  # one row per limit
            print(*[x.pop("summary") for x in told], sep="\n")
            summary = units.unit_summary(limited, a.unit, a.strata, order).first().asDict()
            if a.inspect:
                print(summary)
                continue
            columns = a.columns or shown_columns(limited)
            with progress(spark, f"group {letter}: drawing of units") as step:
                if a.ratio:
                    made = attempt_ratio(limited, a.unit, a.strata, order, a.ratio, columns, a.combo, a.min_units, a.seed)
                else:
                    made = search_ratio(limited, a.unit, a.strata, order, columns, a.target, a.combo, a.min_units, a.seed, told=step.attempt)
        except ValueError as e:
            print(f"group {letter} skipped: {e}")
            continue
        red = made.reduction
        kept = red.rows.persist()
        report = {
            "group": letter,
            "original_rows": limited.count(),
            "reduced_rows": kept.count(),
            "units_total": red.units_total,
            "units_kept": red.units_kept,
            "strata_total": red.strata_total,
            "unit_columns": list(a.unit),
            "strata_columns": list(a.strata),
            "score": made.scores,
            "value_limits": told,
        }
        delimited.write_reduced(kept.drop("_row_id"), f"{a.out}/units_{letter}")
        reports.write_report(spark, report, f"{a.out}/units_report_{letter}")
        reports.write_table(units.stratum_report(limited, kept, a.unit, a.strata, order), f"{a.out}/strata_{letter}")
        table = catfidelity.distribution_table(limited, kept, columns, a.dist_top)
        reports.write_table(table, f"{a.out}/distribution_{letter}")
        seen = [c for c in a.show_dist if c in limited.columns] if a.show_dist else few_level_columns(limited, columns)
        if seen:
            catfidelity.distribution_table(limited, kept, seen, a.dist_top).show(200, truncate=False)
        catfidelity.column_scores(limited, kept, columns).orderBy("score").limit(10).show(truncate=False)
        print(f"group {letter}: {red.units_total} -> {red.units_kept} units, score {made.scores['total']}", *red.notes, sep="\n  ")
        done.append(report)
    return done


def generate_main(spark: SparkSession, argv: Sequence[str]) -> None:
    """Write the trial folder."""
    p = argparse.ArgumentParser("generate")
    p.add_argument("--rows", type=int, default=10_000)
    p.add_argument("--files", type=int, default=3)
    p.add_argument("--out", required=True)
    p.add_argument("--encoding", default="utf-8")
    p.add_argument("--seed", type=int, default=7)
    p.add_argument("--no-group-b", action="store_true")
    p.add_argument("--clean", action="store_true")
    a = p.parse_args(argv)
    per = max(1, a.rows // a.files)
    for i in range(a.files):
        delimited.write_delimited(synthetic.sales(spark, per, a.seed + i, a.clean).coalesce(1), f"{a.out}/sales_2024_{i + 1:02d}.csv", a.encoding)
    if not a.no_group_b:
        delimited.write_delimited(synthetic.customers(spark, max(1, a.rows // 5), a.seed).coalesce(1), f"{a.out}/customers.csv", a.encoding)


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("tarn").getOrCreate()
    command, rest = (sys.argv[1:2] or ["reduce"])[0], sys.argv[2:]
    {"reduce": reduce_main, "units": units_main, "generate": generate_main}[command](spark, rest)


if __name__ == "__main__":
    main()
