"""Incremental indexing: documents to chunks, postings and vectors, a commit per batch; as a stream by ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as tx
from ..operators import chunking, fts
from ..operators.catalog import Catalog, change_plan
from ..session import materialize, scratch

EMBED_ROWS = 100
BatchEmbedder = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Run:
    """What one run did; documents first, then chunks."""

    commit: int
    indexed: int = 0
    unchanged: int = 0
    skipped: int = 0
    pruned: int = 0
    inserted: int = 0
    reused: int = 0
    deleted: int = 0


def cut(documents: DataFrame, config: EngineConfig) -> DataFrame:
    """(doc_id, chunk_index, text, heading, heading_ancestry) of documents (doc_id, type, text), Markdown by its sections."""
    how = (config.max_chunk_chars, config.min_chunk_chars, config.chunk_overlap)
    marked = F.coalesce("type", F.lit("")) == "markdown"
    return chunking.chunk_markdown(documents.where(marked).select("doc_id", "text"), *how).unionByName(chunking.chunk_plain(documents.where(~marked).select("doc_id", "text"), *how))


def embedded(chunks: DataFrame, embed: BatchEmbedder, dims: int | None = None) -> DataFrame:
    """(chunk_id, embedding, doc_path) of chunks, EMBED_ROWS texts a call; vectors longer than ``dims`` are cut, not scaled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), EMBED_ROWS):
                part = b.iloc[s : s + EMBED_ROWS]
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "embedding": [[float(x) for x in v[:dims]] for v in embed(part["t"].tolist())], "doc_path": part["doc_path"]})

    texts = chunks.select("chunk_id", "doc_path", tx.embedding_text(F.col("text"), F.col("heading_ancestry"), F.col("doc_path")).alias("t"))
    return texts.mapInPandas(run, "chunk_id long, embedding array<float>, doc_path string")


def index_batch(catalog: Catalog, batch: DataFrame, config: EngineConfig | None = None, embed: BatchEmbedder | None = None, number: tuple[str, int] | None = None, prune: bool = False) -> Run:
    """Bring the index up to a batch of documents (path, text[, doc_id, type, size_bytes, tags]) in one commit.

    A document whose text is unchanged is left alone, but for vectors it lacks.
    One without a chunk is not written; its earlier version stays. Of a path that
    comes twice the row with the larger doc_id counts (without ids the larger
    text). Chunks are paired with the stored ones by content hash and order of
    appearance: equal ones keep id and vector, others are new or vanish.
    Ids are hashes of what they name, so a run that is repeated gives the same.
    Changed Markdown takes the tags of its front matter. ``prune`` drops documents
    that the batch does not have. A stream's batch ``number`` commits once.
    """
    if catalog.done(number):
        return Run(catalog.current())
    with scratch(batch.sparkSession):
        return _index(catalog, batch, config or EngineConfig(), embed, number, prune)


def _index(catalog: Catalog, batch: DataFrame, config: EngineConfig, embed: BatchEmbedder | None, number: tuple[str, int] | None, prune: bool) -> Run:
    spark = batch.sparkSession
    have = set(batch.columns)
    given = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind)
    rows = batch.where("path is not null and text is not null")
    rows = rows.select("path", "text", given("doc_id", "long").alias("doc_id"), given("type", "string").alias("type"), F.coalesce(given("size_bytes", "long"), F.octet_length("text")).alias("size_bytes"), given("tags", "string").alias("tags"))
    order = F.struct(F.coalesce("doc_id", F.lit(-(2**63))), "text")
    rows = rows.groupBy("path").agg(F.max_by(F.struct("text", "doc_id", "type", "size_bytes", "tags"), order).alias("d")).select("path", "d.*")
    rows = materialize(rows.withColumn("content_hash", F.md5("text")).withColumn("doc_id", F.coalesce("doc_id", F.xxhash64("path"))), "index-rows")
    exists = catalog.current() > 0
    stored = {name: catalog.read(name) if exists else None for name in ("documents", "chunks", "vectors")}
    changed = rows
    if exists:
        changed = rows.join(stored["documents"].select("path", "content_hash"), ["path", "content_hash"], "left_anti")
    fresh = changed.where(F.length(tx.strip(F.col("text"))) >= config.min_chunk_chars)
    parts = cut(fresh, config).join(fresh.select("doc_id", F.col("path").alias("doc_path")), "doc_id").withColumn("content_hash", F.md5("text"))
    parts = materialize(parts, "index-parts")
    old = stored["chunks"].join(parts.select("doc_path").distinct(), "doc_path", "left_semi") if exists else spark.createDataFrame([], "doc_path string, chunk_id long, content_hash string")
    plan = materialize(change_plan(old, parts, ("doc_path",)), "index-plan")
    ids = plan.where("chunk_index is not null").select("doc_path", "chunk_index", F.coalesce("chunk_id", F.xxhash64("doc_path", "content_hash", "occurrence")).alias("chunk_id"))
    chunks = parts.join(ids, ["doc_path", "chunk_index"])
    chunks = chunks.withColumn("char_count", F.length("text")).withColumn("fts_path", tx.last_parts(F.col("doc_path")))
    chunks = materialize(chunks, "index-chunks")
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    tags = F.when(F.coalesce("type", F.lit("")) == "markdown", F.array_join(chunking.frontmatter_tags(F.col("text")), ",")).otherwise(F.coalesce("tags", F.lit("")))
    documents = fresh.join(counts, "doc_id").select("doc_id", "path", tx.title(F.col("text"), F.col("path")).alias("title"), "type", "size_bytes", "content_hash",
                                                    F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("indexed_at"), "chunk_count", tags.alias("tags"))
    documents = materialize(documents, "index-documents")
    changes = {"documents": documents, "chunks": chunks, "postings": fts.build_postings(chunks, keep=("doc_path",))}
    paths = documents.select("path")
    pruned = 0
    if prune and exists:
        gone = stored["documents"].select("path").join(rows.select("path"), "path", "left_anti")
        pruned = gone.count()
        paths = paths.unionByName(gone)
    vectors = stored["vectors"].join(chunks.select("chunk_id"), "chunk_id", "left_semi") if exists else None
    if embed is not None:
        missing = chunks if vectors is None else chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")
        if exists:  # chunks that an earlier run left without a vector
            left = stored["chunks"].join(rows.select(F.col("path").alias("doc_path")), "doc_path", "left_semi").join(paths.select(F.col("path").alias("doc_path")), "doc_path", "left_anti")
            left = materialize(left.join(stored["vectors"].select("chunk_id"), "chunk_id", "left_anti"), "index-left")
            late = left.select("doc_path").distinct()
            missing = missing.select("chunk_id", "doc_path", "text", "heading_ancestry").unionByName(left.select("chunk_id", "doc_path", "text", "heading_ancestry"))
            touched = stored["documents"].join(late.withColumnRenamed("doc_path", "path"), "path", "left_semi")
            paths = paths.unionByName(touched.select("path"))
            changes["documents"] = documents.unionByName(touched)
            kept = stored["chunks"].join(late, "doc_path", "left_semi")
            changes["chunks"] = chunks.select(*kept.columns).unionByName(kept)
            changes["postings"] = fts.build_postings(changes["chunks"], keep=("doc_path",))
            vectors = vectors.unionByName(stored["vectors"].join(late, "doc_path", "left_semi"))
        made = embedded(missing, embed, config.embed_dims).select("chunk_id", "embedding", "doc_path")
        vectors = made if vectors is None else vectors.select("chunk_id", "embedding", "doc_path").unionByName(made)
    if vectors is not None:
        changes["vectors"] = materialize(vectors, "index-vectors")
    paths = materialize(paths.distinct(), "index-paths")
    done = documents.count()
    new = changed.count()
    if paths.limit(1).count() or number is not None:
        n = catalog.commit(changes, paths, number)
    else:
        n = catalog.current() or catalog.commit({}, paths)
    acts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Run(n, done, rows.count() - new, new - done, pruned, acts.get("insert", 0), acts.get("reuse", 0), acts.get("delete", 0))


def start(catalog: Catalog, stream: DataFrame, checkpoint: str, config: EngineConfig | None = None, embed: BatchEmbedder | None = None):
    """Index a stream of documents; every batch commits once, also when it is played again after a failure."""
    return stream.writeStream.foreachBatch(lambda df, k: index_batch(catalog, df, config, embed, (checkpoint, k)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values per window and type; rows later than the watermark are dropped by the stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
