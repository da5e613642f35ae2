"""What the jobs share: their configuration files, counted writes, the command line's session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.ship import ship

#: The language of documents that name none (fixed value).
NO_LANGUAGE = "und"


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults with what a JSON file of one flat object gives instead; a name that has no default is an error."""
    if path is None:
        return dict(defaults)
    given = json.loads(spark.read.text(path, wholetext=True).first().value)
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"{path}: unknown settings {', '.join(unknown)}; known: {', '.join(sorted(defaults))}")
    return defaults | given


def language(column: str = "lang") -> Column:
    """A language that can name a partition folder: neither null nor empty."""
    return F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit(NO_LANGUAGE))


def write(df: DataFrame, path: str, by: list[str] | None = None) -> int:
    """Replaces the folder at path by df, partitioned by the columns, and gives the number of rows, counted as they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").partitionBy(*(by or [])).parquet(path)
    return seen.get["rows"]


def main(run: Callable[[SparkSession, argparse.Namespace], object], about: str, paths: dict[str, str]) -> None:
    """A command line of plain paths, which makes a session and stops it."""
    parser = argparse.ArgumentParser(description=about)
    for name, what in paths.items():
        parser.add_argument(f"--{name}", required=name != "config", help=what)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(about.split(":")[0]).getOrCreate()
    try:
        run(ship(spark), args)
    finally:
        spark.stop()
