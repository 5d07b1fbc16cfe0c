"""A guarded front for read-only SQL: SELECT only, allowed tables only, joins reduced to semi-joins, points as GeoJSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rewrite import reduced, with_points

#: Fixed value: the statements that a read-only service refuses, as whole words.
FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "truncate", "create", "grant", "revoke", "exec", "execute")


def is_select(statement: Column) -> Column:
    """Text form of the guard: begins with select, and holds no forbidden word."""
    plain = F.lower(statement)
    return plain.rlike(r"^\s*select\b") & ~plain.rlike(rf"\b({'|'.join(FORBIDDEN)})\b")


def first_table(statement: Column) -> Column:
    """Lower-case name after the first FROM; empty if there is none."""
    return F.regexp_extract(F.lower(statement), r"\bfrom\s+([a-z0-9_]+)", 1)


def check_statements(statements: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """statements with table_name and allowed (is_select and a table on the list)."""
    name = first_table(F.col(column))
    return statements.withColumn("table_name", name).withColumn("allowed", is_select(F.col(column)) & name.isin([a.lower() for a in allowed]))


def plan_tables(spark: SparkSession, statement: str) -> set[str] | None:
    """Tables that a statement reads anywhere, by Spark's own parser; None if it isn't a query.

    Words inside literals don't matter here, and joined tables and subqueries are seen, unlike in the text form.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    lines = plan.treeString().splitlines()
    if any(re.match(r"^[\s:+\-]*'?(?:\w*Command|InsertInto\w*|Drop\w+|Create\w+|Alter\w+|Delete\w+|Update\w+|Merge\w+|Truncate\w+)\b", x) for x in lines):
        return None
    names = re.findall(r"UnresolvedRelation \[([^\]]+)\]", plan.treeString())
    ctes = set(re.findall(r"CTE \[([^\]]+)\]", plan.treeString()))
    return {n.replace(", ", ".").lower() for n in names} - {c.lower() for x in ctes for c in x.split(", ")}


def guarded(spark: SparkSession, statement: str, allowed: list[str]) -> DataFrame:
    """The statement's rows, if it is a query over allowed tables alone."""
    tables = plan_tables(spark, statement)
    if tables is None:
        raise PermissionError("only SELECT is allowed")
    if refused := tables - {a.lower() for a in allowed}:
        raise PermissionError(f"tables not allowed: {sorted(refused)}")
    return spark.sql(statement)


def answer(spark: SparkSession, statement: str, allowed: list[str], srids: dict[str, int] | None = None, compat: bool = False) -> DataFrame:
    """A guarded statement's rows: joins that only filter the main table become semi-joins, and rows of a table with a
    reference system (srids, by table name) get their points in degrees."""
    found = guarded(spark, statement, allowed)
    rewritten = reduced(spark, statement, compat)
    named = spark.range(1).select(F.lit(statement).alias("s")).select(first_table(F.col("s"))).first()[0]
    srid = {k.lower(): v for k, v in (srids or {}).items()}.get(named)
    if srid is not None:
        return with_points(spark, rewritten, srid)
    return found if rewritten == statement else spark.sql(rewritten)


def point_columns(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """GeoJSON text, lon and lat of a point; all null where a coordinate is."""
    known = lon.isNotNull() & lat.isNotNull()
    text = F.concat(F.lit('{"type":"Point","coordinates":['), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit("]}"))
    return F.when(known, text), F.when(known, lon), F.when(known, lat)


def parse_point(geojson: Column) -> tuple[Column, Column]:
    """lon and lat of GeoJSON points; null for null and for other geometries."""
    point = F.get_json_object(geojson, "$.type") == "Point"
    return tuple(F.when(point, F.get_json_object(geojson, f"$.coordinates[{k}]").cast("double")) for k in (0, 1))
