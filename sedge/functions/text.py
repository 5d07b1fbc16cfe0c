"""Column functions on text: markers, sizes, names, paths, commands, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMAND = r"^([^|]+)\|([^|]+)\|(\d{4}-\d{2}-\d{2})$"


def after_marker(text: Column, marker: str) -> Column:
    """What follows the last marker; null without one."""
    return F.when(F.instr(text, marker) > 0, F.substring_index(text, marker, -1))


def parse_size(text: Column) -> Column:
    """Bytes of 12mb, 12m, 256kb, 256k, 10b or 77; null for other forms, such as a blank before the unit."""
    form = r"^(\d+(?:\.\d+)?)(|b|kb?|mb?)$"
    number, unit = (F.regexp_extract(F.lower(F.trim(text)), form, k) for k in (1, 2))
    return F.when(number != "", F.floor(number.try_cast("double") * F.when(unit.startswith("m"), 1048576).when(unit.startswith("k"), 1024).otherwise(1)))


def format_mb(size: Column) -> Column:
    return F.when(size.isNotNull(), F.concat(F.format_string("%.2f", size / 1048576.0), F.lit(" MB")))


def command_fields(text: Column, prefix: str) -> tuple[Column, Column, Column]:
    """ok, name and date of prefix|name|date: null, not of this form; false, a date that the calendar lacks."""
    plain = F.trim(F.substring(text, 1, 200))
    day = F.try_to_date(F.regexp_extract(plain, COMMAND, 3), "yyyy-MM-dd")
    formed = F.regexp_extract(plain, COMMAND, 1) == prefix
    ok = F.when(formed, day.isNotNull())
    return ok, F.when(ok, F.regexp_extract(plain, COMMAND, 2)), F.when(ok, day)


def clean_path(text: Column) -> Column:
    return F.translate(text, "\\", "/")


def split_list(text: Column) -> Column:
    """Items between commas and line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"[,\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")


#: The characters that file names and sheet names must not have.
BAD_IN_FILES, BAD_IN_SHEETS = r'[<>:"/\\|?*\x00-\x1f]', r"[:\\/?*\[\]]"


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, BAD_IN_FILES, "_")


def sheet_name(name: Column) -> Column:
    """At most 31 characters without those that sheets forbid; empty gives Sheet."""
    plain = F.substring(F.trim(F.regexp_replace(name, BAD_IN_SHEETS, "_")), 1, 31)
    return F.when(F.length(plain) > 0, plain).otherwise("Sheet")


def strip_uri(uri: Column) -> Column:
    """A reference without fragment and query; percent escapes are decoded where they are well formed."""
    bare = F.split_part(F.split_part(uri, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def color_from_name(name: Column) -> Column:
    """[r, g, b, a] from a name that ends in three or four numbers of up to three digits, each after an underscore; each
    counts as 255 at most, a missing fourth as 255. Null for other names."""
    parts = F.split(name, "_")
    last = lambda n: F.slice(parts, -n, n)
    numbers = lambda n: (F.size(parts) > n) & F.forall(last(n), lambda x: x.rlike("^[0-9]{1,3}$"))
    values = F.when(numbers(4), last(4)).when(numbers(3), F.concat(last(3), F.array(F.lit("255"))))
    return F.transform(values, lambda x: F.least(x.try_cast("int"), F.lit(255)))


def stamped_name(prefix: str, at: Column, name: Column, suffix: Column) -> Column:
    """prefix-yyyy-MM-dd-HH-mm-name and suffix, as folders of builds are called."""
    return F.concat(F.lit(f"{prefix}-"), F.date_format(at, "yyyy-MM-dd-HH-mm"), F.lit("-"), name, suffix)
