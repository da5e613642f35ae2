"""Interaction audit of document filters: what each filter removes, in every order that they can be applied in.

The filters' failures are bits of one mask. A histogram of masks, at most 2 ** n cells a part, is all that the orders are
told from, so the texts are read once and no row takes part in an order. Everything is a built-in expression.

The repeat filter fails a document whose text is identical to one of a smaller id anywhere in the table, told by the texts' SHA-256.
Grouping by text finds the smallest id; since other filters depend on the text alone, a group is a few rows of counts
before it is moved, however many copies it has.

Defined cases. A null text is an empty one; a null part is the empty string. A null id has no smaller id and is smaller than none, so it
neither fails the repeat filter nor makes others fail; repeated rows (the same id and text) don't make each other fail, and each counts.
Several rows of labels for an id count as one with the greatest values; labels without a document count nowhere. An empty table gives no row.
Long texts are whole. Other columns, whatever their names, are left aside.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import maybe_broadcast

WORD = r"[^\x20\x09-\x0D]+"
#: The letter of the filter that needs the other documents.
REPEAT = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails: too few words, too many repeated ones, too many capitals, code-like symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic. Rows without an id meet no label and are dealt by their text, not to one task."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    found = rows.join(maybe_broadcast(marks.withColumn("spread", F.lit(0).cast("long"))), ["doc_id", "spread"], "left").drop("spread")
    return found.fillna(False, ["good", "toxic"])


def histogram(docs: DataFrame, labels: DataFrame, part: str = "lang", filters=text_filters, repeat: str | None = REPEAT) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents of each part by the filters that they fail, bit i for the i-th letter."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = filters(text)
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(bits.values())), F.lit(0))
    slim = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.cast("int").alias("mask"))
    # rows that repeat an id and a text are one row with a count from here on
    once = slim.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    rows = _labelled(once, labels)
    kinds = ["part", "mask", "good", "toxic"]
    # of a text's copies: how many there are in each kind, the smallest id there, how often that one
    groups = rows.groupBy("digest", *kinds).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null")
    )
    if repeat is None:
        cells = groups.select(*kinds, "n")
    else:
        first = F.min("least").over(Window.partitionBy("digest"))  # over the kinds of one text, not over its copies
        passed = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
        split = groups.withColumn("first", first).select(*kinds, passed.alias("passed"), (F.col("n") - passed).alias("failed"))
        bit = 1 << len(bits)
        cells = split.select(*[c for c in kinds if c != "mask"], F.inline(F.array(F.struct("mask", F.col("passed").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), F.col("failed").alias("n")))))
    return cells.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic")
    )


def orders(cells: DataFrame, letters: str) -> DataFrame:
    """For each part of a histogram, every order of the letters and each step of it: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    A part's cells, at most 2 ** n, become one row, so that an order costs no shuffle; parts are independent of each other."""
    n = len(letters)
    every = sorted("".join(p) for p in permutations(letters))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))
    rows = parts.select("part", "cells", F.explode(F.array(*[F.lit(p) for p in every])).alias("filter_order"))
    rows = rows.select("part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    value = F.create_map(*[x for i, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << i))])
    bit = value[F.substring("filter_order", F.col("step"), F.lit(1))]
    earlier = F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), "")
    before = F.aggregate(earlier, F.lit(0), lambda s, c: s + F.coalesce(value[c], F.lit(0)))
    rows = rows.withColumn("bit", bit).withColumn("before", before)
    fails = lambda c: c["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda c: c["mask"].bitwiseAND(F.col("before")) != 0

    def total(which, of: str = "n") -> Column:
        return F.aggregate(F.col("cells"), F.lit(0).cast("long"), lambda s, c: s + F.when(which(c), c[of]).otherwise(0))

    # in an n-th of the orders each of a cell's n failing filters comes first
    shapley = F.aggregate(F.col("cells"), F.lit(0).cast("long"), lambda s, c: s + F.when(fails(c), c["n"] * (F.lit(len(every)) / F.bit_count(c["mask"])).cast("long")).otherwise(0))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda c: ~fails(c) & ~gone(c)).alias("kept"), total(lambda c: fails(c) & ~gone(c)).alias("removed"), total(lambda c: fails(c) & gone(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda c: fails(c) & ~gone(c), "n_good").alias("good_lost"), total(lambda c: fails(c) & ~gone(c), "n_toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of ABCDE and step."""
    return orders(histogram(docs, labels, part), "ABCD" + REPEAT)
