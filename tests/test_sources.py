from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarn.plans import catalogue, cli
from tarn.sources import delimited, reports, synthetic


def put(folder: Path, name: str, text: str, encoding: str = "utf-8") -> Path:
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return path


def test_scan_takes_tables_and_skips_prose(spark, tmp_path):
    for name in ("b.csv", "a.CSV", "sub/c.csv", "d.tsv"):
        put(tmp_path, name, "x\ty\n1\t2\n" if name == "d.tsv" else "x,y\n1,2\n")
    put(tmp_path, "readme.txt", "no table in here\n")
    put(tmp_path, ".hidden.csv", "x,y\n1,2\n")
    assert [f.name for f in delimited.find_files(spark, str(tmp_path))] == ["a.CSV", "b.csv", "d.tsv", "sub/c.csv"]
    assert "sub/c.csv" not in [f.name for f in delimited.find_files(spark, str(tmp_path), recursive=False)]
    with pytest.raises(NotADirectoryError):
        delimited.find_files(spark, str(tmp_path / "none"))


@pytest.mark.parametrize(("encoding", "found"), [("utf-8", "utf-8-sig"), ("utf-8-sig", "utf-8-sig"), ("cp949", "cp949")])
def test_encodings(spark, tmp_path, encoding, found):
    path = put(tmp_path, "k.csv", "지역,소득\n서울,100\n부산,200\n", encoding)
    df, seen = delimited.read_delimited(spark, str(path))
    assert seen == found and df.columns == ["지역", "소득"]
    assert sorted((r[0], r[1]) for r in df.collect()) == [("부산", 200), ("서울", 100)]
    assert delimited.header_of(spark, str(path)) == ["지역", "소득"]


@pytest.mark.parametrize("mark", [",", "\t", ";", "|"])
def test_delimiters(spark, tmp_path, mark):
    path = put(tmp_path, "d.csv", f"region{mark}income\nnorth{mark}1\nsouth{mark}2\n")
    assert delimited.read_delimited(spark, str(path))[0].columns == ["region", "income"]


def test_types_and_null_tokens(spark, tmp_path):
    path = put(tmp_path, "t.csv", "i,d,b,s,e\n1,1.5,True,x,NA\nnan,2,False,,\n3,N/A,True,z,null\n")
    df, _ = delimited.read_delimited(spark, str(path))
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "s": "string", "e": "string"}
    assert [tuple(r) for r in df.orderBy("d").collect()][0][:2] == (3, None)
    assert delimited.read_delimited(spark, str(path), rows=1)[0].count() == 1


def test_no_cast_is_tried_on_texts_unlike_numbers_and_none_is_lost(spark):
    read = ["5", "+5", "-0", " 7 ", "\t8", "9223372036854775807", "-9223372036854775808", "0" * 30 + "12", "1.", ".5", "-1.5e-3", "1E5f", "2d", "0x1p3", "0X.8P-1D", "NaN", "nan", "-Infinity", "iNF", "+inf", " 3\x1f"]
    other = ["", " ", "S001", "2024-01-01", "north", "1.5.2", "e5", "0x", "note 7", "9223372036854775808", "٣", "1_0", "--1", "12ab", "True", "infinit"]
    df = spark.createDataFrame([(v,) for v in read + other], "v string")
    for kind, form in delimited.FORMS.items():
        cast = df.withColumn("cast", F.trim("v").try_cast(kind)).withColumn("like", F.col("v").rlike(form))
        assert cast.filter("cast IS NOT NULL AND NOT like").isEmpty()
        assert cast.filter(F.col("v").isin("S001", "2024-01-01", "north", "note 7", "12ab", "True") & F.col("like")).isEmpty()
    assert df.filter(F.trim("v").try_cast("double").isNotNull()).count() >= len(read)


def test_wide_integers_and_odd_doubles_keep_their_types(spark, tmp_path):
    path = put(tmp_path, "t.csv", "a,b,c,d,e\n9223372036854775807,9223372036854775808,0x1p3,2024-01-01,1\n-1,1,inf,2024-01-02,1x\n")
    df, _ = delimited.read_delimited(spark, str(path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "double", "d": "string", "e": "string"}
    assert {tuple(r)[:3] for r in df.collect()} == {(2**63 - 1, 2.0**63, 8.0), (-1, 1.0, float("inf"))}


def test_ids_of_tables_in_few_parts_are_dealt(spark):
    ids = catalogue.ids_of(spark, "/root/testdata/sf0.001", "customer", "c_custkey")
    held = [r["count"] for r in ids.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == spark.sparkContext.defaultParallelism and max(held) < sum(held) / 2


def test_empty_file_and_empty_group_are_errors(spark, tmp_path):
    path = put(tmp_path, "e.csv", "  \n")
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(path))
    with pytest.raises(ValueError):
        delimited.merge_group(spark, [])
    with pytest.raises(ValueError):
        delimited.delimiter_of(" ")


def test_merge_names_the_source_and_widens_types(spark, tmp_path):
    put(tmp_path, "a.csv", "x,y\n1,2\n")
    put(tmp_path, "b.csv", "x,y\n1.5,k\n")
    df = delimited.merge_group(spark, delimited.find_files(spark, str(tmp_path)))
    assert dict(df.dtypes) == {"x": "double", "y": "string", "_source_file": "string"}
    assert {r["_source_file"] for r in df.collect()} == {"a.csv", "b.csv"}


def test_formats_are_read_together_and_values_may_span_lines(spark, tmp_path):
    put(tmp_path, "a b.csv", "x,y\n1,2\n")
    put(tmp_path, "b.csv", "x;y\n3;4\n")
    put(tmp_path, "c.csv", 'x,y\n5,"two\nlines"\n')
    put(tmp_path, "d.csv", "지역,y\n서울,6\n", "cp949")
    files = delimited.find_files(spark, str(tmp_path))
    found = delimited.headers(spark, files)
    assert [found[n].separator for n in ("a b.csv", "b.csv", "c.csv")] == [",", ";", ","] and found["c.csv"].many_lines and not found["b.csv"].many_lines
    rows = {(r.x, r.y, r["_source_file"]) for r in delimited.merge_group(spark, [f for f in files if f.name != "d.csv"]).collect()}
    assert rows == {(1, "2", "a b.csv"), (3, "4", "b.csv"), (5, "two\nlines", "c.csv")}
    merged, apart = cli.groups(spark, str(tmp_path)), cli.groups(spark, str(tmp_path), merge=False)
    assert [len(f) for _, f in merged] == [3, 1] and [len(f) for _, f in apart] == [1, 1, 1, 1]


def test_report_and_table_sinks(spark, tmp_path):
    reports.write_report(spark, {"a": [1, {"b": "ü"}]}, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part*"))
    assert json.loads(text) == {"a": [1, {"b": "ü"}]}
    assert not reports.write_table(spark.range(0), str(tmp_path / "t"))
    delimited.write_reduced(spark.createDataFrame([(1, 2.0)], "x int, _weight double").coalesce(1), str(tmp_path / "w"))
    assert next((tmp_path / "w").glob("part*")).read_bytes().startswith("﻿_weight,x".encode())


def test_synthetic_tables(spark):
    sales = synthetic.sales(spark, 4000)
    assert len(sales.columns) == 15 and sales.select("cluster").distinct().count() == 6
    gone = sales.filter("income IS NULL").count()
    assert 30 < gone < 150 and synthetic.sales(spark, 500, clean=True).dropna().count() == 500
    assert sales.exceptAll(synthetic.sales(spark, 4000)).isEmpty()
    assert len(synthetic.customers(spark, 100).columns) == 9


def test_command_lines(spark, tmp_path, capsys):
    cli.generate_main(spark, ["--rows", "900", "--files", "2", "--out", str(tmp_path / "in"), "--no-group-b"])
    assert cli.reduce_main(spark, [str(tmp_path / "in"), "--inspect"]) == []
    unit = cli.units_main(spark, [str(tmp_path / "in"), "--unit", "store_id", "--strata", "region", "--ratio", "0.3", "--limit", "plan=2", "--out", str(tmp_path / "out"), "--columns", "region,plan"])
    assert unit[0]["units_kept"] < unit[0]["units_total"] and (tmp_path / "out" / "units_A").exists()
    done = cli.reduce_main(spark, [str(tmp_path / "in"), "--columns", "age,income,region", "--target", "10", "--out", str(tmp_path / "out")])
    assert done[0]["reduced_rows"] < done[0]["original_rows"] and len(done[0]["methods"]) == 4
    assert (tmp_path / "out" / "reduced_A").exists() and (tmp_path / "out" / "report_A").exists()
    (tmp_path / "bare").mkdir()
    with pytest.raises(SystemExit):
        cli.groups(spark, str(tmp_path / "bare"))
