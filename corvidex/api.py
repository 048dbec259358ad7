"""The engine as one object: index, search, answer, list, tag, and notes of feedback, with results as dicts."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .config import EngineConfig
from .errors import EngineError, NotIndexed
from .operators import vector
from .operators.catalog import Catalog, resolve_path, tag_histogram, type_rollup, with_tags
from .operators.filters import parse_filters, tagged_chunks
from .plans import search
from .sources import files
from .streaming.indexer import Run, index_batch

SEVERITIES = ("bug", "suggestion", "note")


class Embed(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class Providers:
    """The models behind the engine; whatever is missing is done without."""

    embed: Embed | None = None
    answer: Callable[[str, str], str] | None = None  # (question, context)
    rank: Callable[[str, str], str] | None = None  # (question, numbered passages)
    score: Callable[[list[tuple[str, str]]], list[float]] | None = None  # cross-encoder
    hyde: Callable[[str], str] | None = None
    expand: Callable[[str], str] | None = None  # JSON {"lex": [..], "vec": [..]}


def _shown(filters) -> dict:
    return {k: v for k, v in vars(filters).items() if v}


class _Clock(dict):
    def part(self, name: str, began: float) -> None:
        self[name] = round((time.perf_counter() - began) * 1000, 1)


@dataclass
class Engine:
    spark: SparkSession
    config: EngineConfig = field(default_factory=EngineConfig)
    providers: Providers = field(default_factory=Providers)
    root: str | None = None

    def __post_init__(self):
        self.catalog = Catalog(self.spark, self.root or self.config.index_root)
        self._known: tuple[int, tuple[int, float]] | None = None

    # --- the index

    def index(self, folders: list[str] | None = None, no_size_limit: bool = False, prune: bool = False) -> Run:
        """Index the folders given, else those of the settings, in one commit; paths are stored as the settings say."""
        chosen = [Path(f) for f in folders] if folders else settings.source_folders(self.config)
        if not chosen:
            raise EngineError("There are no sources: add a folder first.")
        every: DataFrame | None = None
        for folder in chosen:
            if not folder.is_dir():
                raise EngineError(f"not a folder: {folder}")
            limit = 0 if no_size_limit else self.config.max_file_size_mb
            found = files.scan(self.spark, os.path.abspath(folder), None, limit, list(self.config.allowed_large_files), self.config.index_code)
            prefix = self.config.stored_path(folder, Path(os.path.abspath(folder)) / "x")[:-1]
            found = found.where("error is null").select(F.concat(F.lit(prefix), F.col("path")).alias("path"), "text", "type", "size_bytes")
            every = found if every is None else every.unionByName(found)
        return index_batch(self.catalog, every, self.config, self.providers.embed, prune=prune)

    def reset(self) -> None:
        self.catalog.reset()

    def tables(self) -> search.Index:
        chunks, postings = self.catalog.read("chunks"), self.catalog.read("postings")
        now = self.catalog.current()
        if self._known is None or self._known[0] != now:  # once per commit
            n = chunks.count()
            words = postings.groupBy("chunk_id").agg(F.first("len").alias("len")).agg(F.sum("len")).first()[0] or 0
            self._known = now, (n, words / n if n else 0.0)
        return search.Index(chunks, self.catalog.read("vectors"), self.catalog.read("documents"), postings, *self._known[1])

    def _resolve(self, name: str) -> str:
        base = str(self.config.folder) if self.config.folder else ""
        return resolve_path(self.catalog.read("documents"), name, base)

    # --- retrieval

    def _embed(self, text: str) -> list[float]:
        if self.providers.embed is None:
            raise EngineError("There is no embedding provider.")
        return [float(x) for x in self.providers.embed([text])[0][: self.config.embed_dims]]

    def fts(self, query: str, k: int = 5) -> dict:
        clock, began = _Clock(), time.perf_counter()
        tables = self.tables()
        rows = search.keyword_search(query, tables.chunks, tables.documents, k, tables).orderBy("rank").collect()
        clock.part("fts", began)
        results = [{"rank": r["rank"], "doc_path": r["doc_path"], "heading": r["heading"], "bm25": round(r["bm25"], 4), "fts_rank": r["fts_rank"], "text": r["text"]} for r in rows]
        return {"query": query, "filters": _shown(parse_filters(query)[1]), "timing_ms": clock, "results": results}

    def search(self, query: str, k: int = 5, threshold: float | None = None, expand: bool | None = None) -> dict:
        clean, filters = parse_filters(query)
        tables, clock, c, p = self.tables(), _Clock(), self.config, self.providers
        began = time.perf_counter()
        passage = search.guarded(p.hyde, clean) if p.hyde and c.hyde_enabled and clean else None
        clock.part("hyde", began)
        made: list[tuple[str, str]] = []
        if p.expand and (c.query_expand if expand is None else expand):
            began = time.perf_counter()
            made = search.parse_expansion(search.guarded(p.expand, clean) or "{}", clean)
            clock.part("expand", began)
        began = time.perf_counter()
        own, other = self._embed(clean), self._embed(passage) if passage else None
        variants = [(kind, text, self._embed(text) if kind == "vec" else None) for kind, text in made]
        clock.part("embed", began)
        began = time.perf_counter()
        limit = c.search_threshold if threshold is None else threshold
        found = search.hybrid_search(query, own, tables.chunks, tables.vectors, tables.documents, k, limit, index=tables, passage=other, variants=variants, rrf_k=c.rrf_k)
        rows = found.orderBy("rank").collect()
        clock.part("search", began)
        results = [{"rank": r["rank"], "doc_path": r["doc_path"], "heading": r["heading"], "similarity": None if r["similarity"] is None else round(r["similarity"], 4), "fts_rank": r["fts_rank"],
                    "rrf_score": round(r["rrf_score"], 6), "sources": r["sources"].split("+"), "text": r["text"]} for r in rows]
        fetch = (5 if filters.active else 3) * k
        if filters.tags:
            fetch = max(fetch, tagged_chunks(tables.chunks, tables.documents, filters.tags).count() + k)
        out = {"query": query, "filters": _shown(filters), "timing_ms": clock, "candidates": {"fetched": fetch, "fused": fetch if filters.active else k, **({"after_filters": len(rows)} if filters.active else {})}, "results": results}
        return out | ({"expanded": True, "expansions": [{"type": a, "text": b} for a, b in made]} if made else {})

    def ask(self, question: str, k: int = 8, threshold: float | None = None, expand: bool | None = None) -> dict:
        p, c = self.providers, self.config
        if p.answer is None:
            raise EngineError("There is no answering provider.")
        tables = self.tables()
        wide = c.query_expand if expand is None else expand
        scorer = p.score if c.rerank_method == "cross-encoder" else None
        return search.ask(question, self._embed, p.answer, tables.chunks, tables.vectors, tables.documents, k, p.rank, c.rerank_top_k, c.ask_threshold if threshold is None else threshold, tables, scorer,
                          p.hyde if c.hyde_enabled else None, p.expand if wide else None, c.bm25_shortcut_min, c.bm25_shortcut_gap, c.rerank_fetch_k, c.rrf_k)

    def similar(self, name: str, k: int = 10) -> dict:
        path = self._resolve(name)
        vectors = self.catalog.read("vectors")
        first = vectors.where(F.col("doc_path") == path).select(F.size("embedding").alias("n")).first()
        if first is None:
            raise NotIndexed(f"no vectors for {path}")
        near = vector.similar_documents(vectors, path, first["n"]).orderBy("distance", "doc_path").limit(k)
        titles = self.catalog.read("documents").select(F.col("path").alias("doc_path"), "title")
        rows = titles.join(F.broadcast(near), "doc_path", "right").orderBy("distance", "doc_path").collect()
        return {"source": path, "results": [{"rank": i, "doc_path": r["doc_path"], "similarity": round(1 - r["distance"], 4), "title": r["title"]} for i, r in enumerate(rows, 1)]}

    # --- the catalog

    def documents(self) -> DataFrame:
        return self.catalog.read("documents").orderBy("path")

    def list(self) -> dict:
        """Every document, by path; ``documents()`` is the same as a DataFrame, for listings too large for one process."""
        rows = self.documents().select("path", "type", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), "indexed_at").collect()
        return {"doc_count": len(rows), "documents": [r.asDict() for r in rows]}

    def by_type(self) -> list[dict]:
        """Documents, bytes and chunks per type, most documents first, the total last."""
        rows = [r.asDict() for r in type_rollup(self.catalog.read("documents")).collect()]
        return sorted(rows, key=lambda r: (r["type"] == "(all)", -r["docs"], r["type"]))

    def stats(self) -> dict:
        documents, chunks, vectors = (self.catalog.read(t) for t in ("documents", "chunks", "vectors"))
        words = self.catalog.read("postings").agg(F.countDistinct("chunk_id")).first()[0]
        size = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("chars")).first()
        types = documents.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy("type").collect()
        listed = documents.select("path", "title", "type", "chunk_count", "content_hash", "indexed_at").orderBy("path").collect()
        return {"index": self.catalog.root, "size_bytes": self.catalog.size(), "doc_count": len(listed), "chunk_count": size["n"], "vec_count": vectors.count(), "fts_count": words, "total_chars": size["chars"],
                "tokens_estimated": size["chars"] // 4, "type_counts": {r["type"]: r["n"] for r in types}, "documents": [r.asDict() for r in listed]}

    def tags(self) -> list[tuple[str, int]]:
        return [(r["tag"], r["n"]) for r in tag_histogram(self.catalog.read("documents")).orderBy("tag").collect()]

    def tag(self, name: str, add: list[str] = (), remove: list[str] = ()) -> str:
        """Add and remove tags of one document; the tags it has then."""
        path = self._resolve(name)
        mine = F.col("path") == path
        changed = with_tags(self.catalog.read("documents").where(mine), path, list(add), list(remove))
        rows = {t: self.catalog.read(t).where(F.col("doc_path") == path) for t in ("chunks", "vectors", "postings")}
        self.catalog.commit({"documents": changed, **rows}, changed.select("path"))
        return self.catalog.read("documents").where(mine).first()["tags"]

    def with_config(self, **changes) -> Engine:
        return Engine(self.spark, replace(self.config, **changes), self.providers, self.root)


# --- feedback, one JSON object a line


def _feedback_file() -> Path:
    return settings.home() / "feedback.jsonl"


def engine_version() -> str:
    try:
        return version("corvidex")
    except PackageNotFoundError:
        return "0"


def feedback(message: str, tool: str = "", severity: str = "note", context: str = "", agent_id: str = "", error_trace: str = "") -> dict:
    """Append a note; it needs a message and a severity of SEVERITIES."""
    if not message or not message.strip():
        raise EngineError("A note needs a message.")
    if severity not in SEVERITIES:
        raise EngineError(f"{severity!r} is not a severity: use one of {', '.join(SEVERITIES)}.")
    entry = {"timestamp": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "version": engine_version(), "message": message.strip(), "severity": severity,
             **{k: v for k, v in (("tool", tool), ("context", context), ("agent_id", agent_id), ("error_trace", error_trace)) if v}}
    at = _feedback_file()
    at.parent.mkdir(parents=True, exist_ok=True)
    with at.open("a") as f:
        f.write(json.dumps(entry, ensure_ascii=False) + "\n")
    return entry


def list_feedback() -> dict:
    at = _feedback_file()
    entries = [json.loads(x) for x in at.read_text().splitlines() if x.strip()] if at.is_file() else []
    return {"count": len(entries), "entries": entries}


def read_feedback(spark: SparkSession) -> DataFrame:
    """The notes as a DataFrame."""
    return spark.read.schema("timestamp string, version string, message string, severity string, tool string, context string, agent_id string, error_trace string").json(f"file://{_feedback_file()}")
