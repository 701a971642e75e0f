"""CSV, workbooks, sinks, catalogue, batch job and streams."""

from __future__ import annotations

import csv as python_csv
import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from catalog.workbook_files import encode_workbooks
from tallyframe.operators.outliers import fit_outliers
from tallyframe.operators.scaling import fit_scaling
from tallyframe.plans import jobs
from tallyframe.sources import catalogue, csv, csv_records, sinks, workbooks
from tallyframe.streaming import apply_fitted, micro_batched_files


def test_csv_with_mark_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿Key,"Two\nlines",n\nx,"He said ""yes"", twice\n",1\ny,plain,2\n'.encode())
    df = csv.read_csv(spark, str(tmp_path))
    assert df.columns == ["Key", "Two\nlines", "n"]
    rows = df.orderBy("n").collect()
    assert rows[0][1] == 'He said "yes", twice\n' and [r["n"] for r in rows] == [1, 2]


def test_only_files_with_line_breaks_are_put_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,t\n1,"one\ntwo"\n')
    (tmp_path / "b.csv").write_text('k,t\n2,"a ""quoted"" word"\n3,\n')
    heads = csv.file_heads(spark, str(tmp_path))
    assert [(name[-5:], head, spread) for name, head, spread in heads] == [("a.csv", "k,t", True), ("b.csv", "k,t", False)]
    rows = csv.read_csv(spark, str(tmp_path)).orderBy("k").collect()
    assert [(r["k"], r["t"]) for r in rows] == [(1, "one\ntwo"), (2, 'a "quoted" word'), (3, None)]


@pytest.fixture
def tiny_splits(spark):
    """Files are cut every 400 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for n in names:
        spark.conf.set(n, "400")
    yield
    for n in names:
        spark.conf.unset(n)


@pytest.mark.parametrize("newline, broadcast", [("\n", 100_000), ("\r\n", 1)])
def test_records_over_many_splits(spark, tmp_path, tiny_splits, monkeypatch, newline, broadcast):
    monkeypatch.setattr("tallyframe.limits.BROADCAST_ROWS", broadcast)
    rng = random.Random(17)
    bits = ["a", "b c", '"', ",", "\n", "\r\n", "ü", "\n\n", '""', "long " * 30]
    rows = []
    for f in range(2):
        mine = [[str(f * 1000 + i), *["".join(rng.choice(bits) for _ in range(rng.randint(0, 5))) or "-" for _ in range(2)]] for i in range(25)]
        mine += [[str(f * 1000 + 900), 'x\n"' * 400, "one field over many splits"], [str(f * 1000 + 901), "plain", "end"]]
        with (tmp_path / f"{f}.csv").open("w", newline="", encoding="utf-8") as out:
            python_csv.writer(out, lineterminator=newline).writerows([["k", "t", "u"], *mine])
        rows += mine
    df = csv.read_csv(spark, str(tmp_path))
    assert [t for _, t in df.dtypes] == ["int", "string", "string"]
    assert sorted(([str(r["k"]), r["t"], r["u"]] for r in df.collect()), key=str) == sorted(rows, key=str)


def test_line_breaks_and_stray_quotes(spark, tmp_path, tiny_splits):
    """A quote inside an unquoted field is only a character."""
    (tmp_path / "a.csv").write_text('n,t,size\n1,"two\nlines",5" pipe\n2,plain,"6"" pipe"\n\n3,"a ""b""\n\n,""c""",\n4,,7" pipe\n5,"",x\n' + "".join(f'{i},"p\nq",z\n' for i in range(6, 60)))
    want = spark.read.csv(str(tmp_path), header=True, inferSchema=True, multiLine=True, escape='"', quote='"')
    got = csv.read_csv(spark, str(tmp_path))
    assert got.schema == want.schema and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert got.count() == 59


def test_line_breaks_in_folders_and_types(spark, tmp_path, tiny_splits):
    for year in (2023, 2024):
        folder = tmp_path / "t" / f"year={year}"
        folder.mkdir(parents=True)
        (folder / "a.csv").write_text('a,b,c,d,e\n' + "".join(f'{i},{i * 3_000_000_000},{i}.5,2024-01-02 03:04:05,"x\ny"\n' for i in range(30)))
    df = csv.read_csv(spark, str(tmp_path / "t"))
    assert dict(df.dtypes) == {"a": "int", "b": "bigint", "c": "double", "d": "timestamp", "e": "string", "year": "int"}
    assert df.groupBy("year").agg(F.sum("a").alias("s")).collect()[0]["s"] == 435
    assert df.where("e = 'x\ny'").count() == 60


def test_one_file_with_line_breaks_is_read_in_several_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,t\n' + "".join(f'{i},"one\ntwo"\n' for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        lines = csv_records._lines(spark, str(tmp_path), None)
        assert lines.select(F.spark_partition_id().alias("p")).distinct().count() > 4
        assert csv.read_csv(spark, str(tmp_path)).agg(F.sum("k"), F.count("t")).first()[:] == (199_990_000, 20_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sampled_types_widen(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,m\n" + "\n".join(f"{i},{i}" for i in range(1500)) + "\nlate,7\n")
    for types in ("all", "sample"):
        whole = csv.read_csv(spark, str(tmp_path), types=types)
        assert [t for _, t in whole.dtypes] == ["string", "int"] and whole.count() == 1501
        assert whole.where("n = 'late'").count() == 1


def test_unlike_headers_and_folders(spark, tmp_path):
    for year, text in ((2023, "x,y\n1,a\n"), (2024, "y,x,z\nb,2,9\n")):
        folder = tmp_path / "my dir" / f"year={year}"
        folder.mkdir(parents=True)
        (folder / "a+b %41.csv").write_text(text)
    rows = csv.read_csv(spark, str(tmp_path / "my dir")).select("year", "x", "y", "z").orderBy("year").collect()
    assert [tuple(r) for r in rows] == [(2023, 1, "a", None), (2024, 2, "b", 9)]
    given = csv.read_csv(spark, str(tmp_path / "my dir"), schema="x double, y string").orderBy("x").collect()
    assert [(r["x"], r["y"]) for r in given] == [(1.0, "a"), (2.0, "b")]


def test_leading_zeros_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,t\n007,x\n")
    (tmp_path / "b.csv").write_text('code,t\nA1,"two\nlines"\n')
    assert {r["code"] for r in csv.read_csv(spark, str(tmp_path)).collect()} == {"007", "A1"}


def test_names_are_taken_as_they_are(spark, tmp_path):
    for name in ("a+b.xlsx", "c%20d.xlsx", "e f.xlsx", "~$e f.xlsx"):
        (tmp_path / name).write_bytes(b"x")
    assert {r["name"] for r in catalogue.list_files(spark, str(tmp_path)).collect()} == {"a+b.xlsx", "c%20d.xlsx", "e f.xlsx"}


def test_sinks_keep_every_value(spark, tmp_path, answers):
    df = answers.select("id", "category", "value1", "text")
    for name in sinks.FORMATS:
        path = sinks.write_table(df, str(tmp_path / name), name)
        reader = spark.read.schema(df.schema)
        back = reader.option("header", True).csv(path) if name == "csv" else reader.format(name).load(path)
        assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str), name
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "x"), "xls")


def test_catalogue_and_load_info(spark, tmp_path, answers):
    for name in ("a.xlsx", "b c.xlsx", "~$a.xlsx", "d.txt"):
        (tmp_path / name).write_bytes(b"12345")
    rows = catalogue.list_files(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r["name"], r["size"]) for r in rows] == [("a.xlsx", 5), ("b c.xlsx", 5)]
    path = sinks.write_table(answers.drop("duration").coalesce(1), str(tmp_path / "t"))
    info = catalogue.load_info(spark.read.parquet(path)).collect()
    assert len(info) == 1 and info[0]["row_count"] == 10 and info[0]["column_count"] == 6 and info[0]["missing_count"] == 3


def test_catalogue_takes_a_table_of_many_files_as_one(spark, tmp_path):
    (tmp_path / "one.parquet").write_bytes(b"123")
    (tmp_path / "note.txt").write_bytes(b"1")
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(10).withColumn("k", F.col("id") % 2).write.partitionBy("k").parquet(str(tmp_path / "parted.parquet"))
    size = sum(f.stat().st_size for f in (tmp_path / "many.parquet").glob("part-*.parquet"))
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        rows = {r["name"]: r["size"] for r in catalogue.list_files(spark, folder, "*.parquet").collect()}
        assert sorted(rows) == ["many.parquet", "one.parquet", "parted.parquet"]
        assert rows["many.parquet"] == size and rows["one.parquet"] == 3
    assert catalogue.list_files(spark, str(tmp_path), "*.csv").collect() == []


def write_books(df, folder, **options):
    for r in encode_workbooks(df, **options).collect():
        (folder / r["path"]).write_bytes(r["content"])


def test_workbooks_round_trip(spark, tmp_path):
    rows = [
        (1, "a & <b>", 1.5, True, dt.datetime(2024, 3, 1, 12, 30)),
        (2, None, None, False, None),
        (3, "끝", -2.0, None, dt.datetime(1999, 12, 31)),
    ]
    df = spark.createDataFrame(rows, "id long, name string, x double, ok boolean, at timestamp_ntz").coalesce(1)
    write_books(df, tmp_path, sheet="Data", rows_per_book=2)
    (tmp_path / "~$lock.xlsx").write_bytes(b"no workbook")
    books = workbooks.read_workbooks(spark, str(tmp_path))
    names = workbooks.sheet_names(books).collect()
    assert len(names) == 2 and {r["sheet"] for r in names} == {"Data"}
    back = workbooks.sheet_table(books, "Data").select(
        F.col("id").cast("long"), "name", F.col("x").cast("double"), F.col("ok").cast("boolean"), F.col("at").cast("timestamp_ntz")
    )
    assert sorted(tuple(r) for r in back.collect()) == rows


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def test_workbooks_of_other_writers(spark, tmp_path):
    """Shared strings, skipped cells, absolute part names, several sheets, error cells."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="rId1"/>'
            '<sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Target="/xl/worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>',
        )
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>k</t></si><si><r><t>v</t></r><r><t>al</t></r></si></sst>')
        z.writestr(
            "xl/worksheets/sheet1.xml",
            SHEET.format('<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
                         '<row><c r="A2"><v>5</v></c><c r="C2" t="e"><v>#N/A</v></c></row>'),
        )
        z.writestr("xl/worksheets/sheet2.xml", SHEET.format('<row><c r="AB1" t="b"><v>1</v></c></row>'))
    (tmp_path / "x.xlsx").write_bytes(out.getvalue())
    books = workbooks.read_workbooks(spark, str(tmp_path))
    first = [r["cells"] for r in workbooks.sheet_rows(books, 0).orderBy("row_no").collect()]
    assert first == [["k", None, "val"], ["5", None, None]]
    assert workbooks.sheet_rows(books, "Two").first()["cells"][27] == "true"
    assert workbooks.sheet_rows(books, "Absent").first()["sheet"] == "One"
    assert workbooks.sheet_rows(books, None).count() == 3
    assert workbooks.sheet_table(books, "One").collect()[0].asDict()["k"] == "5"


def test_batch_job_writes_every_table(spark, tmp_path, answers):
    paths = jobs.run_batch(answers.drop("duration"), str(tmp_path / "out"), free_text=["text"])
    assert {"cleaned", "profile_numeric", "profile_text_word_freq", "report_before_after", "charts"} <= set(paths)
    assert spark.read.parquet(paths["profile_numeric"]).count() >= 2


def test_rules_run_on_a_stream(spark, tmp_path, answers):
    stored = answers.select("id", "value1")
    stored.repartition(3).write.parquet(str(tmp_path / "in"))
    rules = [fit_outliers(stored, ["value1"]), fit_scaling(stored, ["value1"])]
    stream = micro_batched_files(spark, str(tmp_path / "in"), stored.schema)
    assert stream.isStreaming
    run = (
        apply_fitted(stream, rules)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    run.awaitTermination()
    got = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=str)
    assert got == sorted(apply_fitted(stored, rules).collect(), key=str)


def test_headers_that_repeat_are_empty_or_absent(spark, tmp_path):
    assert workbooks.header_names(["q", "q", None, "q.1", "q"], 6) == ["q", "q.1", "Unnamed: 2", "q.1.1", "q.2", "Unnamed: 5"]
    rows = spark.createDataFrame([(1, 2, 3, 4, 5)], "a long, b long, c long, d long, e long")
    books = encode_workbooks(rows, headers=["q", "q", "", "r"]).collect()
    (tmp_path / "a.xlsx").write_bytes(books[0]["content"])
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    found = workbooks.read_workbooks(spark, str(tmp_path))
    errors = workbooks.workbook_errors(found).collect()
    assert [r["source_path"].rsplit("/", 1)[1] for r in errors] == ["bad.xlsx"] and errors[0]["error"].startswith("BadZipFile")
    table = workbooks.sheet_table(found, skip_unreadable=True)
    assert table.columns == ["source_path", "q", "q.1", "Unnamed: 2", "r", "Unnamed: 4"]
    assert tuple(table.first())[1:] == ("1", "2", "3", "4", "5")


def test_first_lines_are_found_without_sorting_lines(spark, tmp_path, monkeypatch):
    """Lines stay where they are: a sort by file would hold all lines of a task in its memory."""
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f"a{k},b\n" + '1,"x"\n' * 50)
    (tmp_path / "3.csv").write_text('a3,"b\nc"\n1,2\n')
    plans, kind = [], type(spark.range(1))
    real = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (plans.append(self._jdf.queryExecution().toString()), real(self))[1])
    heads = csv.file_heads(spark, str(tmp_path))
    assert [(h, odd) for _, h, odd in heads] == [("a0,b", False), ("a1,b", False), ("a2,b", False), ('a3,"b', True)]
    assert any("HashAggregate" in p for p in plans) and not any("SortAggregate" in p or "Sort [" in p for p in plans)
