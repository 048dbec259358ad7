"""The stored index: statistics, listings, incremental change plans, tags, snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NoIndex, NotIndexed
from .filters import tag_set

VERSION = 1
TABLES = {
    "documents": "doc_id long, path string, title string, type string, size_bytes long, content_hash string, indexed_at string, chunk_count int, tags string",
    "chunks": "chunk_id long, doc_id long, chunk_index int, text string, heading string, heading_ancestry string, char_count int, content_hash string, doc_path string, fts_path string",
    "vectors": "chunk_id long, embedding array<float>, doc_path string",
    "postings": "term string, chunk_id long, len int, wtf double, places array<int>, doc_path string",
}
PATH = {"documents": "path"}  # the column that names a row's document, doc_path in the others


def type_rollup(documents: DataFrame) -> DataFrame:
    """(type, docs, bytes, chunks) per type, null types as ``unknown``, and the grand total as ``(all)``."""
    kinds = documents.withColumn("type", F.coalesce("type", F.lit("unknown")))
    return kinds.rollup("type").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"),
                                    F.grouping("type").alias("g")).select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("type")).alias("type"), "docs", "bytes", "chunks")


def tag_histogram(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.explode(tag_set(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def extension_histogram(paths: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return paths.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def latest(documents: DataFrame) -> DataFrame:
    """Each path's last indexing (largest doc_id), with ``versions``, how many there were."""
    rest = [c for c in documents.columns if c != "path"]
    last = documents.groupBy("path").agg(F.max_by(F.struct(*rest), "doc_id").alias("r"), F.count(F.lit(1)).alias("versions"))
    return last.select("path", "r.*", "versions")


def unchanged(documents: DataFrame) -> DataFrame:
    """The indexings whose text is that of their path's indexing before; those without a path or id are never among them.

    The one before is found in two steps, so that no path's whole history is
    sorted in one task: runs of RUN ids are ranked apart, then joined at the ends.
    """
    rows = documents.where("doc_id is not null").select("path", "doc_id", "content_hash").withColumn("run", F.floor(F.col("doc_id") / RUN))
    within = rows.select("*", F.expr("lag(struct(content_hash)) over (partition by path, run order by doc_id)").alias("before"))
    ends = rows.groupBy("path", "run").agg(F.max_by(F.struct("content_hash"), "doc_id").alias("end"))
    ends = ends.select("path", "run", F.expr("lag(end) over (partition by path order by run)").alias("end"))
    joined = within.join(ends, ["path", "run"])
    return joined.where(F.coalesce("before", "end")["content_hash"] == F.col("content_hash")).select("path", "doc_id", "content_hash")


RUN = 4096


def orphans(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Old chunks whose text the new side of their path (or keys) does not have."""
    by = [*keys, "content_hash"]
    return old.join(new.select(*by).distinct(), by, "left_anti")


def reusable(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """New chunks whose text the old side of their path (or keys) has."""
    by = [*keys, "content_hash"]
    return new.join(old.select(*by).distinct(), by, "left_semi")


def change_plan(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys.., content_hash, occurrence, action, chunk_id, chunk_index): what a re-index does to each chunk.

    old: (keys.., chunk_id, content_hash), new: (keys.., chunk_index, content_hash).
    Equal hashes within a path (or path and version) pair up in order of appearance, so repeated chunks
    keep their ids too. action is ``reuse``, ``insert`` or ``delete``.
    """
    by = ", ".join(keys)
    a = old.select(*keys, "chunk_id", "content_hash", F.expr(f"row_number() over (partition by {by}, content_hash order by chunk_id)").alias("occurrence"))
    b = new.select(*keys, "chunk_index", "content_hash", F.expr(f"row_number() over (partition by {by}, content_hash order by chunk_index)").alias("occurrence"))
    both = a.join(b, [*keys, "content_hash", "occurrence"], "full_outer")
    action = F.when(F.col("chunk_id").isNull(), "insert").when(F.col("chunk_index").isNull(), "delete").otherwise("reuse")
    return both.select(*keys, "content_hash", "occurrence", action.alias("action"), "chunk_id", "chunk_index")


def with_tags(documents: DataFrame, path: str, add: list[str] = (), remove: list[str] = ()) -> DataFrame:
    """Documents with tags added to and removed from one path; tags are lower-cased, unique and sorted."""
    low = lambda xs: F.array(*[F.lit(x.strip().lower()) for x in xs]) if xs else F.array().cast("array<string>")
    new = F.array_join(F.array_sort(F.array_except(F.array_union(tag_set(F.col("tags")), low(add)), low(remove))), ",")
    return documents.withColumn("tags", F.when(F.col("path") == path, new).otherwise(F.col("tags")))


def bucket_of(path, buckets: int):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def resolve_path(documents: DataFrame, name: str, base: str = "") -> str:
    """The stored path a name stands for: relative to ``base``, as given, else the first document of which one path ends in the other."""
    rel = name.removeprefix(base.rstrip("/") + "/") if base else name
    path = F.col("path")
    place = F.when(path == rel, 0).when(path == name, 1).otherwise(2)
    hit = documents.where(path.isin(rel, name) | path.endswith(name) | F.lit(name).endswith(path)).select("path", place.alias("p"), "doc_id").orderBy("p", "doc_id").first()
    if hit is None:
        raise NotIndexed(f"not in the index: {name}")
    return hit["path"]


class Catalog:
    """Tables of one index, cut into buckets by document path, in numbered commits.

    A commit is one small file that names, for every table and bucket, the folder
    holding its rows; it is written aside and renamed to the next number, which
    happens wholly or not at all and fails if another writer was first. The
    highest number counts. Only buckets of changed documents are written anew.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> int:
        """The number of the current commit, 0 without one."""
        at = self._path(f"{self.root}/commits")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _manifest(self, n: int) -> dict:
        if not n:
            return {"version": VERSION, "buckets": self.buckets, "tables": {}, "batches": {}}
        stream = self._fs.open(self._path(f"{self.root}/commits/{n:012d}"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if found["version"] != VERSION:
            raise NoIndex(f"the index in {self.root} has version {found['version']}, not {VERSION}: reset it and index again")
        return found

    def _publish(self, n: int, manifest: dict) -> None:
        aside = self._path(f"{self.root}/aside/{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        self._fs.mkdirs(self._path(f"{self.root}/commits"))
        target = self._path(f"{self.root}/commits/{n:012d}")
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            raise RuntimeError(f"another writer made commit {n} of {self.root}")

    def done(self, batch: tuple[str, int] | None) -> bool:
        """Whether a (stream, batch number) has been committed already."""
        return batch is not None and self._manifest(self.current())["batches"].get(batch[0], -1) >= batch[1]

    def commit(self, changes: dict[str, DataFrame], paths: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Replace the rows of the documents in ``paths`` (path) by ``changes``; tables not given lose nothing but those rows.

        A batch that was committed before changes nothing. Returns the commit's number.
        """
        last = self.current()
        manifest = self._manifest(last)
        if self.done(batch):
            return last
        buckets = manifest["buckets"]
        touched = sorted(r["b"] for r in paths.select(bucket_of(F.col("path"), buckets).alias("b")).distinct().collect())  # at most as many as there are buckets
        for name, schema in TABLES.items():
            key = PATH.get(name, "doc_path")
            columns = [c.split()[0] for c in schema.split(", ")]
            parts = []
            if kept := self._load(manifest, name, touched):
                parts.append(kept.join(paths.select(F.col("path").alias(key)).distinct(), key, "left_anti").select(*columns))
            if name in changes:
                parts.append(changes[name].select(*columns))
            if not parts or not touched:
                continue
            rows = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).withColumn("bucket", bucket_of(F.col(key), buckets))
            at = f"data/{name}/{last + 1:012d}-{uuid.uuid4().hex[:8]}"
            by = ["bucket", "term", "chunk_id"] if name == "postings" else ["bucket"]
            rows.repartition("bucket").sortWithinPartitions(*by).write.partitionBy("bucket").parquet(f"{self.root}/{at}")
            held = manifest["tables"].setdefault(name, {})
            for b in touched:
                if self._fs.exists(self._path(f"{self.root}/{at}/bucket={b}")):
                    held[str(b)] = f"{at}/bucket={b}"
                else:
                    held.pop(str(b), None)
        if batch is not None:
            manifest["batches"][batch[0]] = batch[1]
        self._publish(last + 1, manifest)
        return last + 1

    def _load(self, manifest: dict, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        held = manifest["tables"].get(name, {})
        at = [f"{self.root}/{p}" for b, p in sorted(held.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(TABLES[name]).parquet(*at) if at else None

    def read(self, name: str) -> DataFrame:
        if not (n := self.current()):
            raise NoIndex(f"no index in {self.root}")
        found = self._load(self._manifest(n), name)
        return self.spark.createDataFrame([], TABLES[name]) if found is None else found

    def size(self) -> int:
        """Bytes of the current commit's files."""
        held = self._manifest(self.current())["tables"]
        return sum(self._fs.getContentSummary(self._path(f"{self.root}/{p}")).getLength() for t in held.values() for p in t.values())

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that the last ``keep`` commits do not name, and older commits; readers of those must be gone."""
        last = self.current()
        kept = range(max(1, last - keep + 1), last + 1)
        named = {p for n in kept for t in self._manifest(n)["tables"].values() for p in t.values()}
        gone = 0
        for status in self._fs.globStatus(self._path(f"{self.root}/data/*/*/bucket=*")) or []:
            at = status.getPath()
            if "/".join(at.toString().split("/")[-4:]) not in named:
                self._fs.delete(at, True)
                gone += 1
        for status in self._fs.listStatus(self._path(f"{self.root}/commits")) if last else []:
            if int(status.getPath().getName()) < kept.start:
                self._fs.delete(status.getPath(), False)
        return gone

    def reset(self) -> None:
        self._fs.delete(self._path(self.root), True)
