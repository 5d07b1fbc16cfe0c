"""Access-log analytics: the same functions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The files that count as static, and the month names of log times.
STATIC = (".js", ".css", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".map", ".woff", ".woff2", ".ttf", ".eot", ".json")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


#: The fields of a line of the common log format. Groups are address, time, method, url and status.
FIELDS = {
    "address": r"(\S+)",
    "identity": "-",
    "user": "-",
    "time": r"\[([^\]]+)\]",
    "request": r'"(\S+)\s+([^"]+)\s+HTTP/[^"]+"',
    "status": r"(\d+)",
}


def log_time(text: Column) -> Column:
    """dd/MMM/yyyy:HH:mm:ss +zzzz as yyyy-MM-dd HH:mm:ss; the offset is dropped, an unknown month counts as January."""
    month = F.greatest(F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(text, 4, 3)), F.lit(1))
    shown = F.concat(F.substring(text, 8, 4), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.substring(text, 1, 2), F.lit(" "), F.substring(text, 13, 8))
    return F.when(text.rlike(r"^\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}"), shown)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """ip, visit_time, method, url and status of the lines of the form `ip - - [time] "METHOD url HTTP/x" status ...`; others are left out.

    A line is matched once: its fields take the place of the line, parted by a control character (which counts as a blank
    where a line holds it), and a line that doesn't match stays in one part.
    """
    mark = "\x01"
    fields = F.split(F.regexp_replace(F.translate(F.col(column), mark, " "), r"(?s)^" + r"\s+".join(FIELDS.values()) + ".*$", mark.join(f"${k}" for k in range(1, 6))), mark)
    # A generator keeps the planner from working the fields out again for every condition and column.
    found = lines.select(F.explode(F.filter(F.array(fields), lambda x: F.size(x) == 5)).alias("f")).select(*[F.col("f")[k].alias(n) for k, n in enumerate(("ip", "at", "method", "url", "status"))])
    return found.select("ip", log_time(F.col("at")).alias("visit_time"), "method", "url", F.col("status").cast("int").alias("status"))


def page_views(parsed: DataFrame, mode: str = "contains") -> DataFrame:
    """Successful requests of pages. mode 'contains' drops a url with a static ending anywhere, 'suffix' only at its end."""
    endings = "|".join(x.replace(".", r"\.") for x in STATIC)
    pattern = f"(?:{endings})" + (r"(?:[?#].*)?$" if mode == "suffix" else "")
    return parsed.where((F.col("status") == 200) & ~F.lower("url").rlike(pattern))


def visits(parsed: DataFrame) -> DataFrame:
    """ip, visits, first_time and last_time; partial sums keep a busy address from gathering in one task."""
    return parsed.groupBy("ip").agg(F.count("*").alias("visits"), F.min("visit_time").alias("first_time"), F.max("visit_time").alias("last_time"))


def newest_first(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("last_time"), "ip")


def append_log(rows: DataFrame, path: str, at: str = "at", message: str = "message") -> None:
    """Adds `[time] message` lines to a text log, a folder that tasks add files to; blank times and messages stay blank."""
    time = F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    rows.select(F.concat(F.lit("["), time, F.lit("] "), F.coalesce(message, F.lit(""))).alias("value")).write.mode("append").text(path)
