"""Declarative requests: select, from, where, args, group, having, order, page and total, answered by Spark SQL.

Values never become SQL text: those in braces of a free-text condition and those of structured conditions are bound as
parameters, and Catalyst sees one ordinary query, so that filters and columns reach the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType

COMPARISONS = ("=", "!=", ">", ">=", "<", "<=")
OPERATORS = (*COMPARISONS, "like", "not like", "in", "not in", "between", "is null", "is not null")
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*$")
DEFAULT_LIMIT, MOST_ROWS = 20, 5000


@dataclass
class Cond:
    """One structured condition; `logic` joins it to those before it."""

    field: str
    op: str
    value: Any = None
    logic: str = "and"

    @classmethod
    def of(cls, item) -> Cond:
        if isinstance(item, Cond):
            return item
        if isinstance(item, dict):
            return cls(item["field"], item.get("operator", item.get("op", "=")), item.get("value"), item.get("logic") or "and")
        return cls(*[x if x is not None else d for x, d in zip([*item, None, None, None, None][:4], ("", "=", None, "and"), strict=True)])


@dataclass
class QuerySpec:
    source: str
    select: str | list[str] = "*"
    where: str | None = None
    args: list = field(default_factory=list)
    group_by: str | None = None
    having: str | None = None
    order_by: str | list | None = None
    limit: Any = DEFAULT_LIMIT
    offset: Any = 0


@dataclass
class QueryResult:
    """The page, and the number of rows without paging as a frame of one row; neither runs before it is used."""

    source: str
    page: DataFrame
    total: DataFrame
    limit: int
    offset: int

    def to_dict(self) -> dict:
        rows = [r.asDict(recursive=True) for r in self.page.collect()]
        return {"from": self.source, "rows": rows, "total": self.total.first()["total"], "count": len(rows), "limit": self.limit, "offset": self.offset}


def clamp_limit(value: Any) -> int:
    """1 to 5000; what is no number, or zero, gives 20."""
    try:
        n = int(float(value))
    except (TypeError, ValueError, OverflowError):
        n = 0
    return min(MOST_ROWS, max(1, n or DEFAULT_LIMIT))


def clamp_offset(value: Any) -> int:
    try:
        return max(0, int(float(value)))
    except (TypeError, ValueError, OverflowError):
        return 0


def literal(text: str) -> int | float | str:
    """A value in braces: decimal forms are numbers, all else (leading zeros too) stays a string."""
    plain = text.strip()
    if not NUMBER.match(plain):
        return text
    return int(plain) if re.fullmatch(r"-?\d+", plain) else float(plain)


def quoted(name: str) -> str:
    """A column name, qualified or not, in back-ticks."""
    if not IDENTIFIER.match(name or ""):
        raise ValueError(f"not a column name: {name!r}")
    return ".".join(f"`{part}`" for part in name.split("."))


class Binder:
    """Collects parameters and hands out their markers."""

    def __init__(self):
        self.values: dict[str, Any] = {}

    def bind(self, value: Any) -> str:
        name = f"p{len(self.values)}"
        self.values[name] = value
        return f":{name}"

    def template(self, text: str | None) -> str:
        return re.sub(r"\{([^{}]*)\}", lambda m: self.bind(literal(m[1])), text or "")


def items(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [x.strip() for x in str(value).split(",")]


class SpecCompiler:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def column_type(self, source: str, name: str):
        """Type of a column of the from text, found by analysis alone."""
        return self.spark.sql(f"SELECT {quoted(name)} FROM {source}").schema[0].dataType

    def condition(self, cond: Cond, source: str, binder: Binder) -> str:
        op = re.sub(r"\s+", " ", str(cond.op).strip().lower())
        if op not in OPERATORS:
            raise ValueError(f"operator not allowed: {cond.op!r}")
        name = quoted(cond.field)
        if op in ("is null", "is not null"):
            return f"{name} {op.upper()}"
        if op in ("like", "not like"):
            return f"CAST({name} AS STRING) {op.upper()} {binder.bind(f'%{cond.value}%')}"
        kind = self.column_type(source, cond.field)

        def value(v: Any) -> str:
            # A value that its column's type can't hold matches nothing, rather than stopping the query.
            marker = binder.bind(v)
            return marker if isinstance(kind, StringType) and isinstance(v, str) else f"TRY_CAST({marker} AS {kind.simpleString()})"

        if op in ("in", "not in"):
            return f"{name} {op.upper()} ({', '.join(value(v) for v in items(cond.value))})"
        if op == "between":
            low, high = items(cond.value)[:2]
            return f"{name} BETWEEN {value(low)} AND {value(high)}"
        return f"{name} {op} {value(cond.value)}"

    def args_clause(self, args: list, source: str, binder: Binder) -> str:
        """Conditions joined by AND and OR as SQL ranks them; the first one's logic is void."""
        out = ""
        for k, cond in enumerate(map(Cond.of, args or [])):
            glue = "" if k == 0 else " OR " if str(cond.logic).strip().lower() == "or" else " AND "
            out += glue + self.condition(cond, source, binder)
        return out

    def relation(self, spec: QuerySpec) -> DataFrame:
        """All rows of the request, ordered, before paging."""
        binder = Binder()
        where = [f"({x})" for x in (binder.template(spec.where), self.args_clause(spec.args, spec.source, binder)) if x and x.strip()]
        select = ", ".join(map(quoted, spec.select)) if isinstance(spec.select, (list, tuple)) else spec.select or "*"
        sql = f"SELECT {select} FROM {spec.source}"
        if where:
            sql += " WHERE " + " AND ".join(where)
        if spec.group_by:
            sql += f" GROUP BY {spec.group_by}"
        if spec.having:
            sql += f" HAVING {binder.template(spec.having)}"
        order = order_text(spec.order_by)
        if order:
            sql += f" ORDER BY {order}"
        return self.spark.sql(sql, args=binder.values) if binder.values else self.spark.sql(sql)

    def run(self, spec: QuerySpec) -> QueryResult:
        rows = self.relation(spec)
        limit, offset = clamp_limit(spec.limit), clamp_offset(spec.offset)
        total = self.relation(QuerySpec(**{**spec.__dict__, "order_by": None})).selectExpr("count(*) AS total")
        return QueryResult(spec.source, rows.offset(offset).limit(limit) if offset else rows.limit(limit), total, limit, offset)


def order_text(order: str | list | None) -> str:
    if not order:
        return ""
    if isinstance(order, str):
        return order
    return ", ".join(f"{quoted(x['field'])} {'DESC' if str(x.get('direction', '')).lower() == 'desc' else 'ASC'}" for x in order)


def run_query(spark: SparkSession, spec: QuerySpec) -> QueryResult:
    return SpecCompiler(spark).run(spec)


def first_hit(frames: list) -> tuple[int, DataFrame | None]:
    """Index and rows of the first alternative that gives a row, in order; those that fail are skipped; -1 if none does.

    Each item is a frame or a function that makes one. Only an emptiness test of one row runs per alternative.
    """
    for k, item in enumerate(frames):
        try:
            frame = item() if callable(item) else item
            if frame.limit(1).count():
                return k, frame
        except Exception:  # noqa: BLE001 - a failing alternative counts as empty, by the request's own rule
            continue
    return -1, None
