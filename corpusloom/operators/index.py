"""Incremental index: change sets between stored and new chunks, stale vectors, what has to be embedded."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import fulltext
from corpusloom.operators.chunk import chunks, with_hash
from corpusloom.operators.embed import embed, embedder, misses

KEYS = ["strategy", "chunk_id"]
CACHE = "model string, key string, vec array<float>"
CHUNKS = "strategy string, chunk_id string, doc_id string, n int, text string, text_hash string"
LENGTHS = "strategy string, chunk_id string, length int"
EMBEDDINGS = "strategy string, chunk_id string, model string, text_hash string, embedding array<float>"


def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """(strategy, chunk_id, action): insert, update, delete or keep; one full outer join on the key."""
    o = old.select(*KEYS, F.col("text_hash").alias("old_hash"), F.lit(True).alias("was"))
    n = new.select(*KEYS, F.col("text_hash").alias("new_hash"), F.lit(True).alias("now"))
    action = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "update").otherwise("keep")
    return o.join(n, KEYS, "full").select(*KEYS, action.alias("action"))


def stale(old: DataFrame, new: DataFrame, strategy: str) -> DataFrame:
    """Stored chunks of the strategy that the new corpus no longer has; all of them if it is empty."""
    return old.where(F.col("strategy") == strategy).join(new.select(*KEYS), KEYS, "left_anti")


def cascade(embeddings: DataFrame, kept_chunks: DataFrame) -> DataFrame:
    """Vectors, of all models, whose chunk is still there."""
    return embeddings.join(kept_chunks.select(*KEYS), KEYS, "left_semi")


def to_embed(chunked: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of this model for their present text."""
    have = embeddings.where(F.col("model") == model).select(*KEYS, "text_hash")
    return chunked.join(have, [*KEYS, "text_hash"], "left_anti")


def upsert_vectors(embeddings: DataFrame, fresh: DataFrame) -> DataFrame:
    return embeddings.join(fresh.select(*KEYS, "model"), [*KEYS, "model"], "left_anti").unionByName(fresh)


@dataclass(frozen=True)
class Stats:
    docs: int
    chunks: int
    written: int
    deleted: int
    embedded: int
    seconds: float


@dataclass(frozen=True)
class State:
    """What a pointer says: its number, the bucket count, and for each table the version of each partition folder."""

    number: int
    buckets: int
    folders: dict[str, dict[str, str]]


class Conflict(RuntimeError):
    """Another run has changed what this one was about to replace."""


#: The tables of a store: their columns, what they are partitioned by, and how many of these a pointer names folders by.
TABLES = {
    "chunks": (CHUNKS, ("strategy", "bucket"), 2), "embeddings": (EMBEDDINGS, ("strategy", "bucket", "model"), 3),
    "blocks": (fulltext.BLOCKS.replace("bucket int, ", ""), ("strategy", "bucket", "folder"), 2), "sizes": (LENGTHS, ("strategy", "bucket"), 2),
}
#: How often a run begins anew because another one was faster.
ATTEMPTS = 5
#: Keys that may be sent to all readers of the cache, at 64 bytes each; more meet it by a shuffle.
FEW_KEYS = 200_000


class Store:
    """Chunks, vectors and postings as Parquet under one root, dealt to buckets by document.

    A run writes new files for the buckets that it changes and for no others, then adds one small pointer file
    that names each bucket's version, and the bucket count, which a store keeps from its first run on. Pointers are numbered, appear by one rename that
    fails where the name is taken, and the last one holds; so a run that fails at any step leaves the old state, and
    a small change of a large corpus rewrites little. A run that finds pointers newer than the one it read keeps what these changed; if they changed a bucket
    that it is about to replace, it raises Conflict, and index_corpus begins anew from the new state. compact() brings all buckets into one
    version, of another count if one is given; vacuum() removes
    what no kept pointer names. Vectors are also kept by model and content hash, whatever chunk they were made for: what was
    embedded once isn't again, for another strategy, a restored text or a run after one that failed. They lie in folders by
    the first digits of the hash, and a run reads those that its new texts fall into.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self._new_buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm

    @property
    def buckets(self) -> int:
        return self.state().buckets

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, prefix: str) -> list[str]:
        root = self._jvm.org.apache.hadoop.fs.Path(self.root)
        if not self._fs().exists(root):
            return []
        return sorted(n for x in self._fs().listStatus(root) if (n := x.getPath().getName()).startswith(prefix))

    def state(self, number: int | None = None) -> State:
        """The last state, or the one of a number; number 0 is that of a store without a run."""
        if number is None:
            number = max((int(n.split("-")[1]) for n in self._listed("state-")), default=0)
        if not number:
            return State(0, self._new_buckets, {name: {} for name in TABLES})
        raw = json.loads(self.spark.read.text(f"{self.root}/state-{number:012d}", wholetext=True).first().value)
        count = raw.pop("buckets", self._new_buckets)  # pointers of older stores don't name it
        return State(number, count, {name: raw.get(name, {}) for name in TABLES})

    def table(self, name: str, state: State | None = None) -> DataFrame:
        """One table of a state, with the bucket of each row."""
        schema = TABLES[name][0] + ", bucket int"
        by_version: dict[str, list[str]] = {}
        for folder, version in (state or self.state()).folders[name].items():
            by_version.setdefault(version, []).append(folder)
        out = None
        for version, folders in sorted(by_version.items()):
            base = f"{self.root}/{version}/{name}"
            part = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{f}" for f in sorted(folders)])
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], schema) if out is None else out

    def text_index(self, strategy: str, state: State | None = None) -> tuple[DataFrame, DataFrame]:
        """(postings, lengths) of one chunking, of English terms. A store whose buckets were written before it kept them is an error; compact() mends it."""
        state = state or self.state()
        if set(state.folders["chunks"]) != set(state.folders["sizes"]):
            raise ValueError(f"{self.root} has buckets without a text index; compact() makes it")
        stored, lengths = (self.table(name, state).where(F.col("strategy") == strategy).drop("strategy") for name in ("blocks", "sizes"))
        return fulltext.unblocked(stored), lengths

    def read(self, state: State | None = None) -> tuple[DataFrame, DataFrame]:
        """(chunks, embeddings), with the bucket of each row."""
        state = state or self.state()
        return self.table("chunks", state), self.table("embeddings", state)

    def write(self, chunked: DataFrame, embeddings: DataFrame, strategy: str | None = None, touched: list[int] | None = None, base: State | None = None, buckets: int | None = None) -> None:
        """Replaces the touched buckets, of one strategy or of all; None means all. base is the state that the rows were made from.

        A bucket's rows are kept together, but one that holds more than a task's share is written by several tasks."""
        base = base or self.state()
        version = f"v-{uuid.uuid4().hex}"
        new: dict[str, list[str]] = {}
        def put(name: str, df: DataFrame) -> None:
            _, by, depth = TABLES[name]
            path = f"{self.root}/{version}/{name}"
            df.write.partitionBy(*by).parquet(path)
            new[name] = self._folders(path, depth)

        together = lambda df: df.hint("rebalance", F.col("strategy"), F.col("bucket"))
        put("chunks", together(chunked))
        put("embeddings", together(embeddings))
        # the text index of what was written: of the replaced buckets alone, as they are; since they lie together, nothing is moved again
        stored = self.spark.read.schema(CHUNKS + ", bucket int").parquet(f"{self.root}/{version}/chunks")
        put("blocks", fulltext.blocks(stored))
        put("sizes", fulltext.sizes(stored, keep=("strategy", "bucket")))
        goes = lambda folder: (strategy is None or f"strategy={strategy}" in folder.split("/")) and (touched is None or int(folder.split("bucket=")[1].split("/")[0]) in touched)
        self._commit(base, goes, {name: dict.fromkeys(folders, version) for name, folders in new.items()}, buckets or base.buckets)

    def _commit(self, base: State, goes, new: dict[str, dict[str, str]], buckets: int) -> None:
        """Adds the pointer after the last one. Pointers that came after base stay in force in all that doesn't go."""
        while True:
            last = self.state()
            if last.number != base.number:
                replaced = lambda s: {(n, f): v for n, part in s.folders.items() for f, v in part.items() if goes(f)}
                if last.buckets != base.buckets or buckets != base.buckets or replaced(last) != replaced(base):
                    raise Conflict(f"another run has changed the same buckets of {self.root} meanwhile")
            state = {name: {f: v for f, v in part.items() if not goes(f)} | new[name] for name, part in last.folders.items()}
            if self._point_to(state | {"buckets": buckets}, last.number + 1):
                return

    def _folders(self, path: str, depth: int) -> list[str]:
        out, level = [], [""]
        for _ in range(depth):
            level = [f"{f}/{x.getPath().getName()}".lstrip("/") for f in level for x in self._fs().listStatus(self._jvm.org.apache.hadoop.fs.Path(f"{path}/{f}".rstrip("/"))) if x.isDirectory()]
        return out + level

    def _point_to(self, state: dict, number: int) -> bool:
        """Whether this run has made the pointer of the number. The rename doesn't replace: of two runs one gets the name."""
        fs, part, target = self._fs(), self._path(f".state-{uuid.uuid4().hex}"), self._path(f"state-{number:012d}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(part, target, how)
        except Py4JJavaError as e:
            fs.delete(part, False)
            if "FileAlreadyExistsException" in e.java_exception.toString():
                return False
            raise
        return True

    def staged(self, df: DataFrame) -> DataFrame:
        """df written below the root and read back, in a version that no pointer names, so that vacuum() removes it."""
        path = f"{self.root}/v-{uuid.uuid4().hex}/staged"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def vacuum(self, keep: int = 2) -> int:
        """Removes pointers but the last ones, and versions that these don't name; returns how many versions went.
        Not to be called while a run writes."""
        last = self.state().number
        kept = [n for n in range(max(1, last - keep + 1), last + 1)]
        named = {v for n in kept for part in self.state(n).folders.values() for v in part.values()}
        gone = [v for v in self._listed("v-") if v not in named]
        for name in [*(n for n in self._listed("state-") if int(n.split("-")[1]) not in kept), *gone]:
            self._fs().delete(self._path(name), True)
        return len(gone)

    def cached(self, model: str | None = None, keys: DataFrame | None = None) -> DataFrame:
        """(model, key, vec): vectors by content hash; of one model and of distinct keys (column "key") where these are given.

        Of the cache only the folders that the keys fall into are read, and few keys are sent to its readers, so
        that what is moved are the vectors found. Two runs may have added the same key; one of its vectors counts."""
        if not self._fs().exists(self._path("cache")):
            return self.spark.createDataFrame([], CACHE)
        rows = self.spark.read.schema(CACHE + ", prefix string").parquet(f"{self.root}/cache")
        if model is not None:
            rows = rows.where(F.col("model") == model)
        if keys is not None:
            wanted = [r.prefix for r in keys.select(_prefix().alias("prefix")).distinct().collect()]  # at most 256
            few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS
            rows = rows.where(F.col("prefix").isin(wanted)).join(F.broadcast(keys.select("key")) if few else keys.select("key"), "key")
        return rows.select("model", "key", "vec").dropDuplicates(["model", "key"])

    def add_to_cache(self, vectors: DataFrame) -> None:
        vectors.withColumn("prefix", _prefix()).hint("rebalance", F.col("model"), F.col("prefix")).write.mode("append").partitionBy("model", "prefix").parquet(f"{self.root}/cache")

    def compact(self, buckets: int | None = None) -> None:
        """All buckets in one version; with a count, dealt anew to so many, as a store that has grown may need."""
        base = self.state()
        deal = lambda df: df.withColumn("bucket", bucket_of(F.substring_index("chunk_id", "#", 1), buckets or base.buckets))
        self.write(*map(deal, self.read(base)), base=base, buckets=buckets)


def _prefix() -> Column:
    """The folder of a content hash in the cache."""
    return F.substring("key", 1, 2)


def vectors_of(store: Store, rows: DataFrame, model, key: str) -> DataFrame:
    """(key, embedding) of rows (key, text) through the store's cache: only texts that it lacks are embedded, and kept for the next time."""
    asked = rows.select(key, F.sha2("text", 256).alias("__key"))
    keys = asked.select(F.col("__key").alias("key")).where("key IS NOT NULL").distinct()
    new = misses(rows.where("text IS NOT NULL"), store.cached(model.name, keys), model.name)
    store.add_to_cache(embed(new, model, "key", "text", "vec").select(F.lit(model.name).alias("model"), "key", "vec"))
    return asked.join(store.cached(model.name, keys).select(F.col("key").alias("__key"), F.col("vec").alias("embedding")), "__key").select(key, "embedding")


def bucket_of(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def index_corpus(store: Store, docs: DataFrame, strategy: str = "fixed512", model=None, partial: bool = False) -> Stats:
    """Brings the store up to docs (doc_id, text) for one strategy and one model; other ones stay as they are. docs is
    the whole corpus, or with partial some documents of it: stored documents with other ids then stay. Several runs may be under way: one
    whose buckets another has changed meanwhile begins anew."""
    model = embedder(model) if isinstance(model, str) else model or embedder("hash64")
    for left in reversed(range(ATTEMPTS)):
        try:
            return _index_once(store, docs, strategy, model, partial)
        except Conflict:
            if not left:
                raise


def _index_once(store: Store, docs: DataFrame, strategy: str, model, partial: bool) -> Stats:
    began = time.time()
    base = store.state()
    old, vectors = store.read(base)
    old, vectors = old.where(F.col("strategy") == strategy), vectors.where(F.col("strategy") == strategy)
    made = with_hash(chunks(docs, strategy)).select(F.lit(strategy).alias("strategy"), "chunk_id", "doc_id", "n", "text", "text_hash").withColumn("bucket", bucket_of(F.col("doc_id"), base.buckets))
    new = store.staged(made)  # cut and hashed once, for all that follows
    own = bucket_of(F.substring_index("chunk_id", "#", 1), base.buckets)
    before, after = old, new
    if partial:
        ids = docs.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        before, after = old.join(ids, "doc_id", "left_semi"), new.unionByName(old.join(ids, "doc_id", "left_anti"))
    counted = change_set(before, new).groupBy(own.alias("bucket"), "action").agg(F.count("*").alias("n")).collect()  # a few numbers a bucket
    actions: dict[str, int] = {}
    for r in counted:
        actions[r.action] = actions.get(r.action, 0) + r.n
    # ids and hashes of what lacks a vector, found once for all that follows
    todo = store.staged(to_embed(new.select(*KEYS, "text_hash", "bucket"), vectors, model.name))
    lacking = {r.bucket: r["count"] for r in todo.groupBy("bucket").count().collect()}
    touched = sorted({r.bucket for r in counted if r.action != "keep"} | set(lacking))
    if touched:
        here = F.col("bucket").isin(touched)
        after, kept = after.where(here), cascade(vectors.where(here), after.where(here))
        keys = todo.select(F.col("text_hash").alias("key")).distinct()
        few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS
        texts = new.join(F.broadcast(keys), F.col("text_hash") == F.col("key"), "left_semi") if few else new
        lacked = keys.join(store.cached(model.name, keys).select("key"), "key", "left_anti")  # distinct texts that were never embedded; kept before all else
        new_texts = texts.select(F.col("text_hash").alias("key"), "text").dropDuplicates(["key"]).join(lacked, "key", "left_semi")
        store.add_to_cache(embed(new_texts, model, "key", "text", "vec").select(F.lit(model.name).alias("model"), "key", "vec"))
        vec = store.cached(model.name, keys).select(F.col("key").alias("text_hash"), F.col("vec").alias("embedding"))
        fresh = todo.join(vec, "text_hash").select("strategy", "chunk_id", F.lit(model.name).alias("model"), "text_hash", "embedding", "bucket")
        replaced = todo.select(*KEYS, F.lit(model.name).alias("model"))
        store.write(after, kept.join(replaced, [*KEYS, "model"], "left_anti").unionByName(fresh), strategy, touched, base)
    return Stats(docs.count(), sum(n for a, n in actions.items() if a != "delete"), actions.get("insert", 0) + actions.get("update", 0), actions.get("delete", 0), sum(lacking.values()), time.time() - began)
