"""The labelled question set: rules, drift against frozen hashes, freezing, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import question_key, squeeze

#: Difficulties (fixed values).
DIFFICULTIES = ("single-hop", "multi-hop", "unanswerable")
SCHEMA = "id string, question string, answer string, relevant_chunk_ids array<string>, difficulty string"


def qrels(entries: DataFrame) -> DataFrame:
    """(id, chunk_id) for each citation."""
    return entries.select("id", F.explode("relevant_chunk_ids").alias("chunk_id"))


def duplicate_ids(entries: DataFrame) -> DataFrame:
    return entries.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_questions(entries: DataFrame) -> DataFrame:
    """(question_key, n): questions that are the same but for case and white space."""
    return entries.groupBy(question_key(F.col("question")).alias("question_key")).agg(F.count("*").alias("n")).where("n > 1")


def unknown_ids(entries: DataFrame, chunked: DataFrame) -> DataFrame:
    """(id, chunk_id) of citations of chunks that don't exist."""
    return qrels(entries).distinct().join(chunked.select("chunk_id"), "chunk_id", "left_anti").select("id", "chunk_id")


def violations(entries: DataFrame, chunked: DataFrame) -> DataFrame:
    """(id, rule) for each rule that an entry breaks, once."""
    by_id, by_question = Window.partitionBy("id"), Window.partitionBy("__key")
    ids, none = F.col("relevant_chunk_ids"), F.lit(None).cast("string")
    rule = lambda broken, name: F.when(broken, name).otherwise(none)
    keyed = entries.withColumn("__key", question_key(F.col("question"))).withColumns({"__ids": F.count("*").over(by_id), "__questions": F.count("*").over(by_question)})
    rules = F.array(
        rule(F.col("__ids") > 1, "duplicate id"),
        rule(F.col("__questions") > 1, "duplicate question"),
        rule(squeeze(F.col("question")) == "", "empty question"),
        rule(squeeze(F.col("answer")) == "", "empty answer"),
        rule(~F.col("difficulty").isin(*DIFFICULTIES), "unknown difficulty"),
        rule((F.col("difficulty") == "unanswerable") & (F.size(ids) > 0), "unanswerable with chunks"),
        rule((F.col("difficulty") != "unanswerable") & (F.size(ids) == 0), "no chunks"),
        rule(F.size(F.array_distinct(ids)) != F.size(ids), "repeated chunk"),
    )
    own = keyed.select("id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))
    return own.unionAll(unknown_ids(entries, chunked).select("id", F.lit("unknown chunk").alias("rule"))).distinct()


def cited(entries: DataFrame) -> DataFrame:
    return qrels(entries).select("chunk_id").distinct()


def drift(entries: DataFrame, chunked: DataFrame, lock: DataFrame, strategy: str | None = None, lock_strategy: str | None = None) -> DataFrame:
    """(chunk_id, state): unfrozen or drifted, for cited chunks (chunk_id, text_hash) that exist; lock is
    (chunk_id, frozen_hash). Another strategy than the lock's is the one problem then."""
    if strategy != lock_strategy:
        return entries.sparkSession.createDataFrame([(None, f"frozen with {lock_strategy}, not {strategy}")], "chunk_id string, state string")
    found = cited(entries).join(chunked.select("chunk_id", "text_hash"), "chunk_id").join(lock, "chunk_id", "left")
    state = F.when(F.col("frozen_hash").isNull(), "unfrozen").when(F.col("frozen_hash") != F.col("text_hash"), "drifted")
    return found.select("chunk_id", state.alias("state")).where("state IS NOT NULL")


def freeze(entries: DataFrame, chunked: DataFrame) -> DataFrame:
    """The lock of the present texts: (chunk_id, frozen_hash)."""
    return cited(entries).join(chunked.select("chunk_id", F.col("text_hash").alias("frozen_hash")), "chunk_id")


def freeze_diff(old: DataFrame, new: DataFrame, strategy_changed: bool = False) -> DataFrame:
    """(chunk_id, action) between two locks: added, removed, updated or same. After a change of strategy every
    common key is updated."""
    o, n = old.select("chunk_id", F.col("frozen_hash").alias("o")), new.select("chunk_id", F.col("frozen_hash").alias("n"))
    changed = F.lit(True) if strategy_changed else F.col("o") != F.col("n")
    return o.join(n, "chunk_id", "full").select("chunk_id", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(changed, "updated").otherwise("same").alias("action"))


def checked_freeze(entries: DataFrame, chunked: DataFrame, old: DataFrame, force: bool = False, strategy_changed: bool = False) -> DataFrame:
    """The new lock; refuses an entry set that breaks rules, and updates of frozen texts unless forced."""
    if broken := violations(entries, chunked).limit(5).collect():
        raise ValueError("not frozen: " + "; ".join(f"{r.id}: {r.rule}" for r in broken))
    new = freeze(entries, chunked)
    if not force and (changed := freeze_diff(old, new, strategy_changed).where("action = 'updated'").limit(5).collect()):
        raise ValueError("frozen texts changed: " + ", ".join(r.chunk_id for r in changed))
    return new


def show(entries: DataFrame, chunked: DataFrame, lock: DataFrame) -> DataFrame:
    """(id, position, chunk_id, mark): missing, not frozen, drifted or ok."""
    rows = entries.select("id", F.posexplode("relevant_chunk_ids").alias("position", "chunk_id"))
    joined = rows.join(chunked.select("chunk_id", "text_hash"), "chunk_id", "left").join(lock, "chunk_id", "left")
    mark = F.when(F.col("text_hash").isNull(), "missing").when(F.col("frozen_hash").isNull(), "not frozen").when(F.col("frozen_hash") != F.col("text_hash"), "drifted").otherwise("ok")
    return joined.select("id", "position", "chunk_id", mark.alias("mark"))


def stats(entries: DataFrame) -> DataFrame:
    """(difficulty, entries, refs) with a row for each difficulty, 0 where there is none."""
    kinds = entries.sparkSession.createDataFrame([(d,) for d in DIFFICULTIES], "difficulty string")
    count = entries.groupBy("difficulty").agg(F.count("*").alias("entries"), F.sum(F.size("relevant_chunk_ids")).alias("refs"))
    return F.broadcast(kinds).join(count, "difficulty", "left").select("difficulty", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("refs", F.lit(0)).alias("refs"))


def top_docs(entries: DataFrame, n: int = 10) -> DataFrame:
    """The documents with most references; ties by id."""
    doc = F.split_part(F.col("chunk_id"), F.lit("#"), F.lit(1))
    return qrels(entries).groupBy(doc.alias("doc_id")).agg(F.count("*").alias("refs")).orderBy(F.desc("refs"), "doc_id").limit(n)
