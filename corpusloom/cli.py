"""Command line: parse, chunk, grep, index, search, golden and eval over a folder of files."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    return SparkSession.builder.appName("corpusloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("docs", "chunks", "grep", "index", "search", "golden", "eval"):
        s = sub.add_parser(name)
        s.add_argument("--corpus", required=name not in ("search", "eval"))
        s.add_argument("--store")
        s.add_argument("--config")
        s.add_argument("--golden")
        s.add_argument("--doc")
        s.add_argument("--k", type=int, default=5)
        s.add_argument("--limit", type=int, default=0)
        s.add_argument("--freeze", action="store_true")
        s.add_argument("--force", action="store_true")
        s.add_argument("--stats", action="store_true")
        s.add_argument("--results")
        s.add_argument("--traces")
        s.add_argument("text", nargs="?")
    a = p.parse_args(argv)
    try:
        return _run(a, _session())
    except (ValueError, FileNotFoundError, NotImplementedError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, spark: SparkSession) -> int:
    from corpusloom import config as cfg
    from corpusloom.operators import chunk, golden, index, metrics, search, traces
    from corpusloom.operators.embed import embedder
    from corpusloom.plans import evaluate
    from corpusloom.sources import files, records

    config = cfg.load(a.config) if a.config else cfg.RunConfig("default", embedding="hash64")
    docs = files.load_corpus(spark, a.corpus) if a.corpus else None
    if a.command == "docs":
        for r in chunk.list_docs(docs, config.chunking).orderBy("doc_id").toLocalIterator():
            print(f"{r.chars:8d} {r.n_chunks:5d}  {r.doc_id}")
    elif a.command == "chunks":
        shown = chunk.show(chunk.chunks(docs.where(F.col("doc_id") == a.doc), config.chunking))
        for r in shown.toLocalIterator():
            print(r.header, r.body, sep="\n")
    elif a.command == "grep":
        found = chunk.grep(chunk.chunks(docs, config.chunking), a.text).orderBy("chunk_id").collect()
        for r in found:
            print(r.chunk_id, r.snippet, sep="\t")
        print(f"{len(found)} chunks", file=sys.stderr)
        return 0 if found else 1
    elif a.command == "index":
        print(index.index_corpus(index.Store(spark, a.store), docs, config.chunking, config.embedding))
    elif a.command == "golden":
        entries = records.read_golden(spark, a.golden)
        if a.stats:
            golden.stats(entries).show()
            golden.top_docs(entries).show()
            return 0
        chunked = chunk.with_hash(chunk.chunks(docs, config.chunking))
        path = records.lock_path(a.golden)
        held = records.read_lock(spark, path)
        lock = held[1] if held else spark.createDataFrame([], "chunk_id string, frozen_hash string")
        if a.freeze:
            new = golden.checked_freeze(entries, chunked, lock, a.force, bool(held) and held[0] != config.chunking)
            records.write_lock(path, config.chunking, new)
            return 0
        problems = [f"{r.id}: {r.rule}" for r in golden.violations(entries, chunked).orderBy("id", "rule").collect()]
        problems += [f"{r.chunk_id}: {r.state}" for r in golden.drift(entries, chunked, lock, config.chunking, held[0] if held else config.chunking).orderBy("chunk_id").collect()]
        print("\n".join(problems) or "ok")
        return bool(problems)
    else:
        store = index.Store(spark, a.store)
        state = store.state()
        texts = store.text_index(config.chunking, state) if config.retrieval != "dense" else None
        r = search.retriever(config, *store.read(state), embedder(config.embedding), texts, store)
        if a.command == "search":
            q = spark.createDataFrame([("q", a.text)], "query_id string, text string")
            for x in search.render(r.search(q, a.k)).orderBy("rank").collect():
                print(x.line)
        else:
            entries = records.read_golden(spark, a.golden)
            scored = evaluate.evaluate(config, entries, r, a.limit)
            means = metrics.checked_aggregate(scored)
            stamp = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            row = evaluate.report_row(config, means, stamp, records.git_commit())
            print(" | ".join(row))
            if a.traces:
                run = records.run_file_name(config.name, stamp).removesuffix(".json")
                traces.write(a.traces, *evaluate.traced(run, config, evaluate.Answered(scored)))
            if a.results and not a.limit:
                records.append_row(a.results, evaluate.HEADER, row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
