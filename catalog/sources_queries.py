"""Sources and sinks. Files are written below the cluster's shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators.aggregate import union_by_name
from tallyframe.plans.storage import checkpointed, scratch_path
from tallyframe.sources import catalogue, csv, sinks, workbooks
from tallyframe.streaming import apply_fitted, micro_batched_files
from tallyframe.operators.outliers import fit_outliers
from tallyframe.operators.scaling import fit_scaling

from .registry import fix, fix_sql, query, table, union_all
from .workbook_files import encode_workbooks


@query(
    "scan_csv",
    """SELECT c_custkey, c_name || ', "' || c_mktsegment || '"' AS c_label, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer""",
)
def _(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey",
        F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("c_label"),
        "c_nationkey",
        "c_acctbal",
    )
    path = sinks.write_table(df, scratch_path(spark, "scan-csv"), "csv")
    back = csv.read_csv(spark, path)
    return back.select(
        F.col("c_custkey").cast("bigint"), "c_label", F.col("c_nationkey").cast("bigint"), F.col("c_acctbal").cast("double")
    )


@query("scan_csv_line_breaks", "SELECT doc_id, lang, text FROM documents")
def _(spark, sf):
    """Whole documents, with line breaks and quotes inside fields."""
    df = table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = sinks.write_table(df, scratch_path(spark, "scan-csv-lines"), "csv")
    return csv.read_csv(spark, path, schema="doc_id bigint, lang string, text string")


@query("scan_csv_sampled", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_returnflag FROM lineitem")
def _(spark, sf):
    """Types guessed from the first lines and checked."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    path = sinks.write_table(df, scratch_path(spark, "scan-csv-sampled"), "csv")
    back = csv.read_csv(spark, path, types="sample")
    return back.select(
        F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("bigint"), "l_quantity", "l_returnflag"
    )


def _halves(spark, sf, name):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    even = F.col("c_custkey") % 2 == 0
    return customers.where(even), customers.where(~even), scratch_path(spark, name)


def _one_file(df, path):
    df.coalesce(1).write.mode("append").option("header", True).option("escape", '"').csv(path)


@query("scan_csv_header_order", "SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, CASE WHEN c_custkey % 2 = 1 THEN 'odd' END AS kind FROM customer")
def _(spark, sf):
    """Two files with their columns in another order, one with a column more."""
    even, odd, path = _halves(spark, sf, "scan-csv-order")
    _one_file(even, path)
    _one_file(odd.select("c_nationkey", F.lit("odd").alias("kind"), "c_name", "c_custkey"), path)
    back = csv.read_csv(spark, path)
    return back.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("bigint"), "kind")


@query("scan_csv_partitioned", "SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey FROM customer")
def _(spark, sf):
    """Folders by nation, which give a column; files of one of them have their columns in another order."""
    even, odd, path = _halves(spark, sf, "scan-csv-folders")
    even.write.partitionBy("c_nationkey").option("header", True).csv(path)
    odd.select("c_name", "c_custkey", "c_nationkey").write.mode("append").partitionBy("c_nationkey").option("header", True).csv(path)
    back = csv.read_csv(spark, path)
    return back.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("bigint"))


@query("scan_csv_spaced_path", "SELECT c_custkey::BIGINT AS c_custkey, c_name FROM customer")
def _(spark, sf):
    """A blank, a plus and a percent sign in the folder's name, and files with and without line breaks in fields."""
    even, odd, path = _halves(spark, sf, "scan csv+odd%20name")
    _one_file(even.select("c_custkey", "c_name"), path)
    _one_file(odd.select("c_custkey", F.concat("c_name", F.lit("\n")).alias("c_name")), path)
    back = csv.read_csv(spark, path)
    return back.select(F.col("c_custkey").cast("bigint"), F.regexp_replace("c_name", "\n$", "").alias("c_name"))


@query("scan_csv_mixed_files", "SELECT printf('%06d', c_custkey) AS code, c_name FROM customer")
def _(spark, sf):
    """Codes with leading zeros stay text where only one of the files makes them so."""
    even, odd, path = _halves(spark, sf, "scan-csv-mixed")
    code = F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code")
    _one_file(even.select(code, "c_name"), path)
    _one_file(odd.select(code, F.concat("c_name", F.lit("\nx")).alias("c_name")).union(spark.createDataFrame([("none", "-")], "code string, c_name string")), path)
    back = csv.read_csv(spark, path).where("code <> 'none'")
    return back.select("code", F.regexp_replace("c_name", "\nx$", "").alias("c_name"))


@query(
    "sink_roundtrip",
    union_all(
        [
            f"SELECT '{f}' AS format, o_orderkey, o_totalprice, o_orderpriority FROM orders"
            for f in ("csv", "json", "parquet")
        ]
    ),
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    parts = []
    for name in sinks.FORMATS:
        path = sinks.write_table(df, scratch_path(spark, f"sink-{name}"), name)
        reader = spark.read.schema(df.schema)
        back = reader.option("header", True).csv(path) if name == "csv" else reader.format(name).load(path)
        parts.append(back.select(F.lit(name).alias("format"), *df.columns))
    return union_by_name(*parts)


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@query("file_catalogue", "SELECT unnest(string_split('" + _TABLES + "', ' ')) || '.parquet' AS name")
def _(spark, sf):
    return catalogue.list_files(spark, sf, "*.parquet").select("name")


@query(
    "load_info",
    "SELECT 'orders.parquet' AS name, count(*) AS row_count, 6 AS column_count, 0 AS missing_count FROM orders",
)
def _(spark, sf):
    return catalogue.load_info(table(spark, sf, "orders")).select("name", "row_count", "column_count", "missing_count")


def _books(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    # Written once, spread by workbook, as a folder of files would be.
    return checkpointed(encode_workbooks(rows, "Orders", rows_per_book=5_000).repartition("path"))


@query("workbook_sheets", "SELECT 'Orders' AS sheet, 0 AS sheet_index, true AS every_book_once")
def _(spark, sf):
    names = workbooks.sheet_names(_books(spark, sf))
    once = (F.count(F.lit(1)) == F.count_distinct("source_path")).alias("every_book_once")
    return names.groupBy("sheet", "sheet_index").agg(once)


@query(
    "workbook_duplicate_headers",
    """SELECT o_orderkey AS key, o_totalprice AS amount, o_orderpriority AS "amount.1", o_custkey AS "Unnamed: 3", o_orderstatus AS "Unnamed: 4" FROM orders""",
)
def _(spark, sf):
    """Two equal headers, an empty one, and a column that has no header at all."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_custkey", "o_orderstatus")
    books = checkpointed(encode_workbooks(rows, rows_per_book=5_000, headers=["key", "amount", "amount", ""]).repartition("path"))
    cells = workbooks.sheet_table(books).drop("source_path")
    types = {"key": "bigint", "amount": "double", "Unnamed: 3": "bigint"}
    return cells.select([F.col(f"`{c}`").cast(types.get(c, "string")).alias(c) for c in cells.columns])


@query(
    "workbook_rows",
    "SELECT o_orderkey, o_totalprice, o_orderdate::TIMESTAMP AS o_orderdate, o_orderpriority FROM orders",
)
def _(spark, sf):
    """The orders as workbooks, read back by header name."""
    cells = workbooks.sheet_table(_books(spark, sf), "Orders")
    return cells.select(
        F.col("o_orderkey").cast("bigint"),
        F.col("o_totalprice").cast("double"),
        F.col("o_orderdate").cast("timestamp_ntz"),
        "o_orderpriority",
    )


@query("workbook_cells", "SELECT count(*) AS data_rows, count(*) * 4 AS cells FROM orders")
def _(spark, sf):
    rows = workbooks.sheet_rows(_books(spark, sf), sheet=None).where("row_no > 0")
    return rows.agg(F.count(F.lit(1)).alias("data_rows"), F.sum(F.size("cells")).cast("bigint").alias("cells"))


_BOUNDS = """(SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo,
                     quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events)"""


@query(
    "fitted_on_stream",
    f"""WITH k AS (SELECT e.* FROM events e, {_BOUNDS} WHERE value BETWEEN lo AND hi)
        SELECT event_id, event_type, {fix_sql('(value - (SELECT avg(value) FROM k)) / (SELECT stddev_pop(value) FROM k)')} AS value FROM k""",
)
def _(spark, sf):
    """Rules fitted on the stored events, applied to the same events read as a stream of files."""
    events = table(spark, sf, "events")
    cut = fit_outliers(events, ["value"])
    scale = fit_scaling(cut.apply(events), ["value"], "zscore")
    stream = micro_batched_files(spark, sf, events.schema, pattern="events.parquet")
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    run = (
        apply_fitted(stream, [cut, scale])
        .select("event_id", "event_type", fix("value").alias("value"))
        .writeStream.format("parquet")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(out)
    )
    run.awaitTermination()
    return spark.read.parquet(out)
