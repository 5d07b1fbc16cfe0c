"""Operators on lines, change lists, files and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import safe_file_name, sheet_name
from .ordinals import numbered


def added_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key and the added lines of a unified diff (begin with one plus, not three), joined in order; empty if none."""
    lines = F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n")
    added = F.transform(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substring(x, 2, 1 << 30))
    return diffs.select(key, F.array_join(added, "\n").alias("added"))


def changed_files(files: DataFrame, prefix: str, strip: str, compat: bool = False) -> DataFrame:
    """Distinct paths under prefix that were modified, added or renamed, without `strip`.

    A renamed file counts by its new path, the last tab field; with compat only the bare status R does, as the
    original has it.
    """
    path = F.element_at(F.split("path", "\t"), -1)
    status = F.col("status").isin("M", "A", "R") if compat else F.col("status").rlike("^[MAR]")
    return files.where(status).select(path.alias("path")).where(F.col("path").startswith(prefix)).select(F.substring("path", len(strip) + 1, 1 << 30).alias("path")).distinct()


def change_report(commits: DataFrame, files: DataFrame, since: str) -> DataFrame:
    """commit_id, author, at, message and its files as `[status] path` lines, for commits strictly after a day begins."""
    recent = commits.where(F.col("ts") > F.lit(since).cast("timestamp_ntz"))
    listed = files.groupBy("commit_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("["), "status", F.lit("] "), "path"))), "\n").alias("files"))
    return recent.join(listed, "commit_id", "left").select("commit_id", "author", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "message", F.coalesce("files", F.lit("(none)")).alias("files"))


def keep_listed(files: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    return files.join(keep.select(key).distinct(), key, "left_semi")


def drop_listed(files: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Files that are not on the list."""
    return files.join(keep.select(key).distinct(), key, "left_anti")


def unique_names(files: DataFrame, name: str, order: str) -> DataFrame:
    """files with out_name: safe, and unique without regard to case by _1, _2 ... before the ending.

    A number may lead to a name that another file has from the start; those that meet again are numbered once more.
    """
    stem, ending = F.regexp_extract("out_name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("out_name", r"^(.*?)(\.[^.]*)?$", 2)
    named = files.withColumn("out_name", safe_file_name(F.col(name))).withColumn("_own", F.lower("out_name"))
    for _ in range(2):
        # Files that still bear their first name come before those that were numbered into it.
        met = named.withColumns({"_key": F.lower("out_name"), "_late": F.lower("out_name") != F.col("_own")})
        named = numbered(met, "_rank", ["_key"], "_late", order).withColumn("out_name", F.when(F.col("_rank") == 1, F.col("out_name")).otherwise(F.concat(stem, F.lit("_"), (F.col("_rank") - 1).cast("string"), ending)))
    return named.drop("_own", "_rank", "_key", "_late")


def sheet_names(tables: DataFrame, name: str, order: str) -> DataFrame:
    """tables with sheet: a name that sheets allow; a repeated one is cut to 28 characters and gets its place in order."""
    # The place counts from 1 over all tables, as the list is read; it is an ordinal that the caller provides.
    named = tables.withColumn("_sheet", sheet_name(F.col(name)))
    firsts = named.groupBy(F.col("_sheet").alias("_name")).agg(F.min(order).alias("_first"))
    met = named.join(firsts, F.col("_sheet") == F.col("_name"))
    again = F.concat(F.substring("_sheet", 1, 28), F.lit("_"), F.col(order).cast("string"))
    return met.withColumn("sheet", F.when(F.col(order) == F.col("_first"), F.col("_sheet")).otherwise(again)).drop("_sheet", "_name", "_first")


def resolve_uris(references: DataFrame, files: DataFrame, uri: str = "uri", path: str = "path") -> DataFrame:
    """references with resolved: the file by exact path, else the first file whose path ends like the reference after a
    slash (case is ignored), else the first of its name; null if no file has the name.

    Files are listed once under every ending of their path, and each ending keeps its first file alone. A reference meets
    one row per way of looking it up, however many files bear its name.
    """
    last = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    steps = F.split(F.lower(F.col(path)), "/")
    endings = F.transform(F.sequence(F.lit(2), F.greatest(F.size(steps), F.lit(2))), lambda k: F.array_join(F.slice(steps, k, F.size(steps)), "/"))
    exact = files.where(F.col(path).isNotNull()).select(F.col(path).alias("_exact")).distinct()
    ended = files.where(F.size(steps) > 1).select(F.explode(endings).alias("_end"), F.col(path).alias("_path")).groupBy("_end").agg(F.min("_path").alias("_ended"))
    named = files.where(F.col(path).isNotNull()).groupBy(last(F.col(path)).alias("_base")).agg(F.min(path).alias("_named"))
    met = references.join(exact, F.col(uri) == F.col("_exact"), "left").join(ended, F.lower(uri) == F.col("_end"), "left").join(named, last(F.col(uri)) == F.col("_base"), "left")
    return met.select(*references.columns, F.coalesce("_exact", "_ended", "_named").alias("resolved"))


def grams(text: Column, longest: int) -> Column:
    """The distinct pieces of a text of the given length; a shorter text is its own piece."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - longest + 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda k: F.substr(text, k, F.lit(longest))))


def first_containing(texts: DataFrame, text: str, names: DataFrame, name: str, order: str, longest: int = 4) -> DataFrame:
    """texts with found: the first name (by order, then by name) that contains the text; null if none does.

    Names are listed under all their pieces of up to `longest` characters. A text can only be in names that have its
    rarest piece, so it meets those alone and is verified there; a text as short as a piece is answered by the list itself.
    """
    listed = names.where(F.col(name).isNotNull()).select(F.col(name).alias("_name"), F.col(order).alias("_order"))
    pieces = listed.select("_name", "_order", F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col("_name"), n) for n in range(1, longest + 1)])))).alias("_gram")).where("_gram <> ''")
    best = F.min(F.struct("_order", "_name")).alias("_best")
    held = pieces.groupBy("_gram").agg(F.count("*").alias("_n"), best).unionByName(listed.select(F.lit("").alias("_gram"), "_name", "_order").groupBy("_gram").agg(F.count("*").alias("_n"), best))
    words = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct()
    # Short texts are pieces themselves; the empty one is in every name.
    short = words.where(F.length("_text") <= longest).join(held, F.col("_text") == F.col("_gram")).select("_text", "_best")
    long = words.where(F.length("_text") > longest).select("_text", F.explode(grams(F.col("_text"), longest)).alias("_piece"))
    # A piece that no name has counts as the rarest, and its text meets nothing.
    rare = long.join(held.select(F.col("_gram").alias("_piece"), "_n"), "_piece", "left").groupBy("_text").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_piece")).alias("_r")).where("_r.n > 0").select("_text", "_r._piece")
    met = rare.join(pieces, F.col("_piece") == F.col("_gram")).where(F.col("_name").contains(F.col("_text"))).groupBy("_text").agg(best)
    answers = short.unionByName(met).select("_text", F.col("_best._name").alias("found"))
    return texts.join(answers, F.col(text) == F.col("_text"), "left").drop("_text")


def newest(records: DataFrame, key: str, time: str, n: int, *ties: str) -> DataFrame:
    """The n newest records of every key; Spark cuts each task's rows to n before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(time), *ties)
    return records.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def first_of(rows: DataFrame, keys: list[str | Column], order: str) -> DataFrame:
    """The first row of every composite key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")
