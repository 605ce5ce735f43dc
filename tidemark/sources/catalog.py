"""Tables declared by name: databases, tables over files and databases, primary keys, and inserts.

Spark's catalog keeps no primary keys; a declared one is a table property, not enforced, that upserts read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = "tidemark.primaryKey"


def _quoted(name: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def _text(value: str) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_database(spark: SparkSession, name: str, use: bool = False) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(name)}")
    if use:
        spark.sql(f"USE {_quoted(name)}")


def use_catalog(spark: SparkSession, name: str, database: str | None = None) -> None:
    """Make a configured catalog (spark.sql.catalog.<name>) the current one."""
    spark.catalog.setCurrentCatalog(name)
    if database:
        spark.sql(f"USE {_quoted(database)}")


def create_table(
    spark: SparkSession, name: str, schema: str | None, source: str = "parquet", keys: list[str] = (), partitioned_by: list[str] = (), location: str | None = None, **options: str
) -> None:
    """CREATE TABLE IF NOT EXISTS over a source (parquet, csv, json, jdbc ...) with its options and a primary key that is not enforced."""
    sql = f"CREATE TABLE IF NOT EXISTS {_quoted(name)}" + (f" ({schema})" if schema else "") + f" USING {source}"
    if options:
        sql += " OPTIONS (" + ", ".join(f"{_text(k)} {_text(v)}" for k, v in options.items()) + ")"
    if partitioned_by:
        sql += " PARTITIONED BY (" + ", ".join(map(_quoted, partitioned_by)) + ")"
    if location:
        sql += f" LOCATION {_text(location)}"
    if keys:
        sql += f" TBLPROPERTIES ({_text(KEY)} = {_text(','.join(keys))})"
    spark.sql(sql)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")


def primary_key(spark: SparkSession, name: str) -> list[str]:
    """The declared key of a table; empty if it has none."""
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {_quoted(name)}").collect()}
    return found[KEY].split(",") if found.get(KEY) else []


def insert_into(spark: SparkSession, target: str, rows: DataFrame | str) -> None:
    """INSERT INTO ... SELECT, by column name: ``rows`` is a query or a DataFrame."""
    if isinstance(rows, str):
        spark.sql(f"INSERT INTO {_quoted(target)} BY NAME {rows}")
    else:
        rows.select(*spark.table(target).columns).write.insertInto(target)


def described(df: DataFrame) -> str:
    """Schema and formatted plan of a table or query as text."""
    jvm = df.sparkSession.sparkContext._jvm
    plan = jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return df._jdf.schema().treeString() + plan
