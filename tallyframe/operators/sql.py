"""SQL over a table under the name ``df`` and over any further tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame


def execute_sql(df: DataFrame, query: str, **tables: DataFrame) -> DataFrame:
    """Run Spark SQL in which ``df`` (and each keyword's name) is a table.

    Spark resolves the statement at once, so the views are taken down again
    before returning, and a view the caller had under that name comes back.
    """
    spark = df.sparkSession
    views = {"df": df, **tables}
    temporary = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in views if name in temporary}
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    try:
        return spark.sql(query)
    finally:
        for name in views:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
