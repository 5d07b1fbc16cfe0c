"""Table and column catalog, and the options of a JDBC source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Product names and the dialect that serves them, with its default port (0: none).
DIALECTS = {"mysql": "mysql", "pg": "pg", "postgres": "pg", "postgresql": "pg", "kingbase": "pg", "sqlite": "sqlite", "mssql": "mssql", "sqlserver": "mssql"}
PORTS = {"mysql": 3306, "pg": 5432, "mssql": 1433, "sqlite": 0}


def register_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views over the parquet tables of a folder."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of the tables and views in reach, in order."""
    return spark.sql("SHOW TABLES").selectExpr("tableName AS name").distinct().orderBy("name")


def list_columns(spark: SparkSession, table: str) -> DataFrame:
    """tabname, id (from 1), name, type and nullable of a table's columns; the schema alone is read."""
    rows = [(table, k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(spark.table(table).schema.fields, 1)]
    return spark.createDataFrame(rows, "tabname string, id int, name string, type string, nullable boolean").orderBy("id")


def dialect(db_type: str) -> str:
    found = DIALECTS.get((db_type or "").strip().lower())
    if not found:
        raise ValueError(f"unknown database type: {db_type!r}")
    return found


def jdbc_options(db_type: str, conn: dict) -> dict[str, str]:
    """Options of spark.read.format('jdbc') from a connection with any of the usual key names."""
    def first(*keys, default=None):
        return next((conn[k] for k in keys if conn.get(k) not in (None, "")), default)

    if conn.get("url"):
        out = {"url": conn["url"]}
    else:
        kind = dialect(db_type)
        host, port = first("host", "server", default="localhost"), int(first("port", default=PORTS[kind]))
        name = first("database", "db", "file", default="")
        out = {"url": {"mysql": f"jdbc:mysql://{host}:{port}/{name}", "pg": f"jdbc:postgresql://{host}:{port}/{name}", "mssql": f"jdbc:sqlserver://{host}:{port};databaseName={name}", "sqlite": f"jdbc:sqlite:{name}"}[kind]}
    for key, value in (("user", first("user", "username")), ("password", first("password", "pass")), ("driver", first("driver"))):
        if value is not None:
            out[key] = str(value)
    return out


def jdbc_partitions(spark: SparkSession, options: dict[str, str], table: str, column: str, rows_each: int, most: int) -> dict[str, str]:
    """Options that read a table in parts of about rows_each rows, by ranges of a numeric or time column.

    One statistics query gives the bounds and the count, which the database answers; a small table is read as one part.
    """
    quote = "`" if options["url"].startswith("jdbc:mysql") else '"'
    name = f"{quote}{column}{quote}"
    asked = f"SELECT min({name}) AS {quote}low{quote}, max({name}) AS {quote}high{quote}, count(*) AS {quote}n{quote} FROM {table}"
    seen = spark.read.format("jdbc").options(**options).option("query", asked).load().first()
    parts = min(most, -(-seen["n"] // rows_each))
    if parts < 2 or seen["low"] is None or seen["low"] == seen["high"]:
        return {}
    return {"partitionColumn": column, "lowerBound": str(seen["low"]), "upperBound": str(seen["high"]), "numPartitions": str(parts)}


def read_jdbc(spark: SparkSession, db_type: str, conn: dict, table: str, *, partition_column: str | None = None, rows_each: int = 1_000_000, most_partitions: int = 1000) -> DataFrame:
    """A JDBC table. With a partition column it is read in parallel, by bounds that the database is asked for; filters,
    limits and column lists that follow are pushed down to the database by the planner."""
    options = jdbc_options(db_type, conn)
    more = jdbc_partitions(spark, options, table, partition_column, rows_each, most_partitions) if partition_column else {}
    return spark.read.format("jdbc").options(**options, **more).option("dbtable", table).load()


def write_jdbc(rows: DataFrame, db_type: str, conn: dict, table: str, types: str | None = None, batch: int = 10_000) -> None:
    """Replace a JDBC table by the rows, each task over a connection of its own; types as in CREATE TABLE."""
    writer = rows.write.format("jdbc").mode("overwrite").options(**jdbc_options(db_type, conn)).option("dbtable", table).option("batchsize", batch)
    (writer.option("createTableColumnTypes", types) if types else writer).save()
