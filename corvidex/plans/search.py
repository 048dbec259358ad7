"""Search plans: keyword, hybrid, similar documents, and the context of an answer."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NoSearchTerms
from ..operators.filters import Filters, parse_filters, predicate, tagged_chunks
from ..operators.fts import bm25, normalised, search_postings
from ..operators.fusion import RRF_K, fuse, rank_list
from ..operators.vector import better_of, knn

Embedder = Callable[[str], list[float]]
log = logging.getLogger(__name__)
SENT = 10_000  # rows of hits that may be sent to every task


@dataclass(frozen=True)
class Index:
    """The tables a search runs on. With postings (and their number of chunks and mean length) no text is scanned for words."""

    chunks: DataFrame
    vectors: DataFrame
    documents: DataFrame
    postings: DataFrame | None = None
    total: int = 0
    average: float = 0.0
    stemmed: bool = True
    fold: bool = True

    def words(self, query: str, allowed: DataFrame | None = None) -> DataFrame:
        if self.postings is None:
            return bm25(self.chunks, query, allowed=allowed, fold=self.fold)
        return search_postings(self.postings, query, self.total, self.average, allowed, self.stemmed, self.fold)


def _backfill(hits: DataFrame, chunks: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    """Hits (at most n) with their chunk's and document's columns; only the rows that are hit are deduplicated."""
    sent = F.broadcast if n <= SENT else (lambda df: df)
    rows = chunks.select("chunk_id", "doc_id", "text", "heading", "heading_ancestry", "doc_path").join(sent(hits.select("chunk_id").distinct()), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    full = hits.join(rows, "chunk_id")
    docs = documents.select("doc_id", "type", "tags", "indexed_at", "title").join(sent(rows.select("doc_id").distinct()), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return full.join(docs, "doc_id", "left")


def keyword_search(query: str, chunks: DataFrame, documents: DataFrame, k: int = 5, index: Index | None = None) -> DataFrame:
    """rank, chunk_id, doc_path, heading, bm25 of the best k; filters run on 5k candidates, so they may leave fewer."""
    clean, filters = parse_filters(query)
    if not re.search(r"\w", clean):
        raise NoSearchTerms("The query has no searchable terms.")
    fetch = 5 * k if filters.active else k
    hits = (index or Index(chunks, chunks, documents)).words(clean).orderBy("fts_rank", "chunk_id").limit(fetch)
    full = _backfill(hits, chunks, documents, fetch).where(predicate(filters)).orderBy("fts_rank", "chunk_id").limit(k)
    return rank_list(full, [F.col("fts_rank"), F.col("chunk_id")]).select((F.col("rank") + 1).alias("rank"), "chunk_id", "doc_path", "heading", "heading_ancestry", normalised(F.col("fts_rank")).alias("bm25"), "fts_rank", "text")


def _as_list(df: DataFrame, kind: str, number: int, weight: float) -> DataFrame:
    """A retrieval list in the form that fuse() takes, ranked by its own measure."""
    measure = "distance" if kind == "vec" else "fts_rank"
    ranked = rank_list(df, [F.col(measure), F.col("chunk_id")])
    score = 1 - F.col("distance") if kind == "vec" else normalised(F.col("fts_rank"))
    none = F.lit(None).cast("double")
    return ranked.select(F.lit(number).alias("list_idx"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), "chunk_id", "rank", score.alias("score"),
                         (F.col("distance") if kind == "vec" else none).alias("distance"), (F.col("fts_rank") if kind == "fts" else none).alias("fts_rank"))


ORDER = ["rrf_score", "best_rank", "chunk_id"]


def _order() -> list:
    return [F.desc("rrf_score"), F.col("best_rank"), F.col("chunk_id")]


def fused_lists(index: Index, clean: str, embedding: list[float], fetch: int, cut: int, allowed: DataFrame | None = None, all_tagged: bool = False, passage: list[float] | None = None,
                variants: list[tuple[str, str, list[float] | None]] = (), rrf_k: float = RRF_K) -> tuple[DataFrame, list[DataFrame]]:
    """(the best ``cut`` of all lists fused, the lists).

    Lists are the query's vectors and words, then those of the variants (kind,
    text, embedding); with variants the query's own count twice. Of the query's
    and the passage's vectors, the list whose best distance is smaller is taken.
    """

    def near(v: list[float]) -> DataFrame:
        return knn(index.vectors, v, allowed=allowed, k=None if all_tagged else fetch)

    own = near(embedding) if passage is None else better_of(near(embedding), near(passage))
    weight = 2.0 if variants else 1.0
    lists = [_as_list(own, "vec", 0, weight), _as_list(index.words(clean, allowed).orderBy("fts_rank", "chunk_id").limit(fetch), "fts", 1, weight)]
    for i, (kind, text, v) in enumerate(variants, 2):
        df = near(v) if kind == "vec" else index.words(text, allowed).orderBy("fts_rank", "chunk_id").limit(fetch)
        lists.append(_as_list(df, kind, i, 1.0))
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    return fuse(every, rrf_k=rrf_k).withColumn("rrf_score", F.round("rrf_score", 9)).orderBy(*_order()).limit(cut), lists


def hybrid_search(query: str, embedding: list[float], chunks: DataFrame, vectors: DataFrame, documents: DataFrame, k: int = 5, threshold: float = 0.001, prefilter: bool = False, fold: bool = True,
                  index: Index | None = None, passage: list[float] | None = None, variants: list[tuple[str, str, list[float] | None]] = (), rrf_k: float = RRF_K) -> DataFrame:
    """The best k chunks of both lists, fused.

    tag: filters act below retrieval; the others act on the fused candidates (3k,
    with filters 5k), then the cut to k, then the similarity threshold, which
    never backfills. With tags, all tagged vectors are fused, and the words' list
    and the fused one hold at least as many candidates as there are tagged chunks
    plus k. ``prefilter`` pushes all filters below retrieval instead.
    """
    index = index or Index(chunks, vectors, documents, fold=fold)
    clean, filters = parse_filters(query)
    fetch = (5 if filters.active else 3) * k
    cut = fetch if filters.active else k
    allowed = _allowed(index, filters, prefilter)
    if filters.tags:
        fetch = cut = max(fetch, allowed.count() + k)
    fused, _ = fused_lists(index, clean, embedding, fetch, cut, allowed, bool(filters.tags), passage, variants, rrf_k)
    full = _backfill(fused, chunks, documents, cut)
    if not prefilter:
        full = full.where(predicate(filters.without_tags()))
    full = full.orderBy(*_order()).limit(k).where(F.col("similarity").isNull() | (F.col("similarity") >= threshold) if threshold > 0 else F.lit(True))
    return _shown(full)


def _allowed(index: Index, filters: Filters, prefilter: bool = False) -> DataFrame | None:
    if prefilter and filters.active:
        docs = index.documents.select("doc_id", "type", "tags", "indexed_at").dropDuplicates(["doc_id"])
        return index.chunks.select("chunk_id", "doc_id", "doc_path", "text").join(docs, "doc_id", "left").where(predicate(filters)).select("chunk_id").distinct()
    return tagged_chunks(index.chunks, index.documents, filters.tags) if filters.tags else None


def _shown(full: DataFrame) -> DataFrame:
    out = rank_list(full, _order()).withColumn("rank", F.col("rank") + 1)
    sources = F.array_join(F.filter(F.array(F.when(F.col("in_fts"), "fts"), F.when(F.col("in_vec"), "vec")), lambda s: s.isNotNull()), "+")
    return out.select("rank", "chunk_id", "doc_path", "heading", "heading_ancestry", "similarity", "fts_rank", "rrf_score", sources.alias("sources"), "text")


def candidates(query: str, embedding: list[float], index: Index, k: int, fetch_k: int, passage: list[float] | None = None, variants: list[tuple[str, str, list[float] | None]] = (), rrf_k: float = RRF_K) -> DataFrame:
    """What an answer is reranked from: the best ``fetch_k`` of lists of max(20, 3k), filtered, without a threshold."""
    clean, filters = parse_filters(query)
    allowed = _allowed(index, filters)
    fetch = max(20, 3 * k)
    if filters.tags:
        fetch = max(fetch, allowed.count() + k)
    fused, _ = fused_lists(index, clean, embedding, fetch, fetch_k, allowed, bool(filters.tags), passage, variants, rrf_k)
    return _shown(_backfill(fused, index.chunks, index.documents, fetch_k).where(predicate(filters.without_tags())))


def shortcut(best: DataFrame, least: float = 0.85, gap: float = 0.02) -> bool:
    """Whether the best document's keyword score is high and clear of the second. best: (doc_path, score)."""
    top = [r["score"] for r in best.groupBy("doc_path").agg(F.max("score").alias("score")).orderBy(F.desc("score")).limit(2).collect()]
    return bool(top) and top[0] >= least and top[0] - (top[1] if len(top) > 1 else 0.0) >= gap


def parse_ranking(answer: str, n: int, top: int) -> list[int]:
    """0-based order from a model's list of 1-based numbers: out-of-range and repeated ones dropped, missing ones appended."""
    named = dict.fromkeys(x - 1 for x in map(int, re.findall(r"\d+", answer)) if 1 <= x <= n)
    return [*named, *(i for i in range(n) if i not in named)][:top]


def passages(rows: list) -> str:
    """The passages a model is to rank, numbered, with their path and heading, 500 characters each."""
    return "\n\n".join(f"[{i}] ({r['doc_path'] or 'unknown'}{' > ' + r['heading'] if r['heading'] else ''})\n{(r['text'] or '')[:500]}" for i, r in enumerate(rows, 1))


def reranked(question: str, rows: list, keep: int, listwise: Callable[[str, str], str] | None = None, scorer: Callable[[list[tuple[str, str]]], list[float]] | None = None) -> list:
    """The ``keep`` best rows by a scorer of (question, text) pairs, best first (ties as they stood), or by a model's list; no more rows than that stay as they are."""
    if len(rows) <= keep or not (listwise or scorer):
        return rows[:keep]
    if scorer:
        scores = scorer([(question, r["text"] or "") for r in rows])
        return [rows[i] for i in sorted(range(len(rows)), key=lambda i: -scores[i])][:keep]
    return [rows[i] for i in parse_ranking(listwise(question, passages(rows)), len(rows), keep)]


def parse_expansion(answer: str, query: str) -> list[tuple[str, str]]:
    """(kind, text) of the variants in a model's JSON answer ({"lex": [..], "vec": [..]}), those equal to the query left out; no JSON gives none."""
    try:
        found = json.loads(answer)
        pairs = [(kind, v) for kind in ("lex", "vec") for v in found.get(kind, [])]
    except (ValueError, AttributeError, TypeError):
        log.warning("the expansion is not JSON of the form asked for")
        return []
    own = query.lower().strip()
    return [(kind, v) for kind, v in pairs if isinstance(v, str) and v.lower().strip() != own]


def guarded(provider: Callable[[str], str], text: str) -> str | None:
    """What a provider makes of a text, None if it fails or says nothing: search goes on without it."""
    try:
        return (provider(text) or "").strip() or None
    except ImportError:
        raise
    except Exception:
        log.warning("a provider failed", exc_info=True)
        return None


def label(path: str, heading: str | None, ancestry: str | None) -> str:
    return f"{path} > {ancestry or heading}" if ancestry or heading else path


def context(results: DataFrame, keys: tuple[str, ...] = (), headed: bool = True) -> DataFrame:
    """(keys.., context): the ranked passages as numbered blocks with path and, if ``headed``, heading path."""
    under = F.coalesce(F.when(F.col("heading_ancestry") != "", F.col("heading_ancestry")), F.col("heading"), F.lit("")) if headed else F.lit("")
    name = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("doc_path"), F.when(under != "", F.concat(F.lit(" > "), under)).otherwise(F.lit("")))
    blocks = results.select(*keys, "rank", F.concat(name, F.lit("\n"), F.col("text")).alias("block"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n")
    return (blocks.groupBy(*keys) if keys else blocks).agg(joined.alias("context"))


def distinct_sources(hits: DataFrame, keys: tuple[str, ...], at: str = "hit_pos") -> DataFrame:
    """(keys.., doc_path, source_rank): each path once, in the order in which it first appears."""
    rows = hits.groupBy(*keys, "doc_path").agg(F.min(at).alias("first_pos"))
    by = ", ".join(keys)
    return rows.select(*keys, "doc_path", F.expr(f"cast(row_number() over (partition by {by} order by first_pos, doc_path) as bigint)").alias("source_rank"))


def ask(question: str, embed: Embedder, answer: Callable[[str, str], str], chunks: DataFrame, vectors: DataFrame, documents: DataFrame, k: int = 8, rerank: Callable[[str, str], str] | None = None, keep: int = 5,
        threshold: float = 0.001, index: Index | None = None, scorer=None, hyde: Callable[[str], str] | None = None, expand: Callable[[str], str] | None = None, least: float = 0.85, gap: float = 0.02, fetch_k: int = 20, rrf_k: float = RRF_K) -> dict:
    """Retrieve, rerank and answer with the given providers; the shortcut skips vectors and reranking when one document is clearly best.

    ``rerank`` sees (question, numbered passages). The threshold holds after
    reranking, also if it is 0. At most ``fetch_k`` rows reach the driver.
    """
    index = index or Index(chunks, vectors, documents)
    clean, filters = parse_filters(question)
    quick, made = False, []
    if not filters.active and re.search(r"\w", clean):
        probe = index.words(clean).orderBy("fts_rank", "chunk_id").limit(20)
        scored = _backfill(probe, index.chunks, index.documents, 20).select("doc_path", normalised(F.col("fts_rank")).alias("score"))
        quick = shortcut(scored, least, gap)
    if quick:
        found = keyword_search(question, index.chunks, index.documents, k, index).withColumn("similarity", F.lit(None).cast("double"))
    else:
        passage = guarded(hyde, clean) if hyde else None
        made = parse_expansion(guarded(expand, clean) or "{}", clean) if expand else []
        variants = [(kind, text, embed(text) if kind == "vec" else None) for kind, text in made]
        found = candidates(question, embed(clean), index, k, fetch_k, embed(passage) if passage else None, variants, rrf_k)
    rows = found.orderBy("rank").limit(fetch_k).collect()
    top = rows[:keep] if quick else reranked(clean, rows, keep, rerank, scorer)
    chosen = [r for r in top if r["similarity"] is None or r["similarity"] >= threshold]
    out = {"question": question, "shortcut": quick, "expansions": [{"type": a, "text": b} for a, b in made], "candidates": len(rows), "ranked": len(top)}
    if not chosen:
        return out | {"answer": None, "sources": []}
    blocks = "\n\n".join(f"[{i}] {label(r['doc_path'], r['heading'], r['heading_ancestry'])}\n{r['text']}" for i, r in enumerate(chosen, 1))
    places = list(dict.fromkeys((r["doc_path"], r["heading"]) for r in chosen))
    return out | {"answer": answer(clean, blocks), "sources": [{"rank": i, "doc_path": p, "heading": h} for i, (p, h) in enumerate(places, 1)], "result_count": len(chosen), "filtered_count": len(top) - len(chosen)}
