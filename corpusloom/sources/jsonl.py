"""Strict JSON lines, read by all tasks: every line's number in its file, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits whose first line numbers may be sent to all tasks; those of more files are joined by a shuffle.
FEW_SPLITS = 100_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files: line counts from 1 in each file, blank lines too.

    A split's rows come in order, so a row's place in its split is the distance to the split's first one; the lines of
    the splits before it in the file, counted in a first pass, are added. No file has to be read by one task."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "split", "first", before.alias("before"))
    if splits.limit(FEW_SPLITS + 1).count() <= FEW_SPLITS:
        starts = F.broadcast(starts)
    return rows.join(starts, ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def problem(value: Column, strings: tuple[str, ...], lists: tuple[str, ...] = ()) -> Column:
    """What keeps a line from being an object of just these fields, strings and lists of strings; null if nothing does."""
    parsed = F.try_parse_json(value)
    kind = lambda v: F.schema_of_variant(v)
    names = [*strings, *lists]
    wanted, keys = F.array(*map(F.lit, names)), F.json_object_keys(value)
    lacking, extra = F.array_except(wanted, keys), F.array_sort(F.array_except(keys, wanted))
    of = lambda name: kind(F.variant_get(parsed, f"$.{name}", "variant"))
    wrong = F.filter(F.array(*[F.when(of(n) != "STRING", n) for n in strings], *[F.when(~of(n).isin("ARRAY<STRING>", "ARRAY<VOID>"), n) for n in lists]), lambda x: x.isNotNull())
    listed = lambda a: F.array_join(a, ", ")
    return (
        F.when(parsed.isNull(), "no JSON")
        .when(~kind(parsed).startswith("OBJECT"), "no object")
        .when((F.size(lacking) > 0) | (F.size(extra) > 0), F.concat_ws("; ", F.when(F.size(lacking) > 0, F.concat(F.lit("lacks "), listed(lacking))), F.when(F.size(extra) > 0, F.concat(F.lit("has no place for "), listed(extra)))))
        .when(F.size(wrong) > 0, F.concat(F.lit("wrong types: "), listed(wrong)))
    )


def strict(lines: DataFrame, strings: tuple[str, ...], lists: tuple[str, ...] = ()) -> DataFrame:
    """The columns of lines (with "value"), the fields, and problem, of all lines that aren't blank; fields are null where there is a problem."""
    kept = lines.where(F.trim(F.regexp_replace("value", r"[\t\r\n\x0B\f]+", " ")) != "")
    schema = ", ".join([*(f"`{s}` string" for s in strings), *(f"`{x}` array<string>" for x in lists)])
    checked = kept.withColumn("problem", problem(F.col("value"), strings, lists))
    read = checked.withColumn("read", F.when(F.col("problem").isNull(), F.from_json("value", schema)))
    return read.select(*[c for c in lines.columns if c != "value"], *[F.col(f"read.{n}").alias(n) for n in (*strings, *lists)], "problem")
