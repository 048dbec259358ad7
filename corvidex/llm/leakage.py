"""Evaluation texts inside a training corpus (problem 6).

Method: rare n-gram seeds tie corpus passages to evaluation items, a local
alignment (Smith-Waterman over words) scores each tie, and an exact run check
gives the longest run of consecutive item words found verbatim.

1. The items' 5-word seeds are counted over all documents in one scan.
2. Rare seeds are kept, and of every ``run_words`` window of an item the rarest
   one even if it is common, so any verbatim run of that length holds a kept seed.
3. A second scan looks the kept seeds up and aligns where they hit.

The corpus is never shuffled. Items are taken in blocks of bounded size, each
block in its own pair of scans, so what is broadcast never exceeds
``block_words`` words however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fan_out
from .words import words

SEED_WORDS, RARE = 5, 20
_B = np.uint64(0x9E3779B97F4A7C15)


def _keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A key per run of n word numbers; 0 where the run holds a word no item has."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    key, known = np.zeros(m, np.uint64), np.ones(m, bool)
    with np.errstate(over="ignore"):
        for k in range(n):
            part = ids[k : k + m]
            key = (key ^ part) * _B
            key ^= key >> np.uint64(29)
            known &= part > 0
    key[~known] = 0
    return key


class _Index:
    """Word numbers and seeds of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        self.items = [(i, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(t)], np.uint64)) for i, t in items]
        keys = [_keys(ids, SEED_WORDS) for _, ids in self.items]
        self.key = np.concatenate([*keys, np.empty(0, np.uint64)])
        self.item = np.concatenate([np.full(len(k), j) for j, k in enumerate(keys)] + [np.empty(0, int)]).astype(int)
        self.pos = np.concatenate([np.arange(len(k)) for k in keys] + [np.empty(0, int)]).astype(int)
        self.seeds = np.unique(self.key)

    def keep(self, counts: dict[int, int], run_words: int) -> None:
        """Keep the rare seeds, and of each run_words window its rarest (ties: the later), of shorter items the rarest one.

        Rare is up to RARE times the median count of the seeds that occur at all.
        """
        df = np.array([counts.get(int(k), 0) for k in self.key.view(np.int64)], np.int64)
        kept, span = df <= RARE * (np.median(df[df > 0]) if (df > 0).any() else 1), run_words - SEED_WORDS + 1
        ends = np.searchsorted(self.item, np.arange(len(self.items) + 1))  # an item's seeds stand together
        for first, end in zip(ends.tolist(), ends[1:].tolist()):
            at = np.arange(first, end)
            for s in range(max(1, len(at) - span + 1) if len(at) else 0):
                window = at[s : s + span]
                kept[window[np.lexsort((-window, df[window]))[0]]] = True
        order = np.argsort(self.key[kept], kind="stable")
        self.key, self.item, self.pos = self.key[kept][order], self.item[kept][order], self.pos[kept][order]
        self.seeds = np.unique(self.key)

    def numbers(self, text: str) -> np.ndarray:
        get = self.vocab.get
        tokens = words(text)
        return np.fromiter((get(w, 0) for w in tokens), np.uint64, len(tokens))


def _hits(keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(keys)
    if not len(at) or not len(seeds):
        return at[:0]
    found = np.minimum(np.searchsorted(seeds, keys[at]), len(seeds) - 1)
    return at[seeds[found] == keys[at]]


def longest_run(doc: np.ndarray, item: np.ndarray, diagonal: int) -> int:
    """Longest run of equal words where document position minus item position is ``diagonal``."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi <= lo:
        return 0
    same = item[lo:hi] == doc[lo + diagonal : hi + diagonal]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def smith_waterman(doc: np.ndarray, item: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> int:
    """Best local alignment score; unknown document words (0) never match."""
    best, row = 0, np.zeros(len(item) + 1, np.int64)
    steps = np.arange(len(item) + 1) * gap
    for w in doc:
        hit = np.where((item == w) & (w > 0), match, mismatch)
        new = np.maximum(np.concatenate(([0], row[:-1] + hit)), np.concatenate(([0], row[1:] + gap)))
        new = np.maximum(new, 0)
        row = np.maximum.accumulate(new - steps) + steps  # gaps along the item
        best = max(best, int(row.max()))
    return best


def _score(ids: np.ndarray, at: np.ndarray, keys: np.ndarray, index: _Index) -> Iterator[tuple[int, int, float, int]]:
    by_item: dict[int, set[int]] = {}
    lo, hi = np.searchsorted(index.key, keys[at], "left"), np.searchsorted(index.key, keys[at], "right")
    for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
        for k in range(a, b):
            by_item.setdefault(int(index.item[k]), set()).add(p - int(index.pos[k]))
    for j, diagonals in by_item.items():
        item_id, item = index.items[j]
        run = max(longest_run(ids, item, d) for d in diagonals)
        score, first, slack = 0, None, len(item) // 2
        covered = -1
        for d in sorted(diagonals):  # near diagonals share one window
            if d <= covered:
                continue
            lo_w, hi_w = max(0, d - slack), min(len(ids), d + len(item) + slack)
            covered = d + slack // 2
            s = smith_waterman(ids[lo_w:hi_w], item)
            if first is None or s > score:
                score, first = s, max(0, d)
        yield item_id, run, score / (2 * len(item)), first


def leaked_items(documents: DataFrame, items: DataFrame, run_words: int = 13, block_words: int = 2_000_000) -> DataFrame:
    """Which evaluation items stand, wholly or partly, in which documents.

    documents: (doc_id, text), items: (item_id, text); further columns are
    ignored. Returns (doc_id, item_id, run_words, score, word_pos): the longest
    verbatim run in words, the alignment score as a share of a perfect match,
    and the word position of the best hit; one row per document and item tied by
    a seed. Null or empty texts and null ids take no part; repeated rows count
    once. Items under five words cannot be seeded and are never reported.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null and length(text) > 0")
    docs = fan_out(docs)
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and length(text) > 0").distinct()
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(size) // (2 * block_words)))
    out = None
    for b in range(blocks):
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found = _leaked_block(spark, docs, sorted((r["item_id"], r["text"]) for r in part.collect()), run_words)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("run_words", "score", "word_pos")).alias("m")).select("doc_id", "item_id", "m.*")


def _leaked_block(spark, docs: DataFrame, items: list[tuple[int, str]], run_words: int) -> DataFrame:
    index = _Index(items)
    shared = spark.sparkContext.broadcast((index.vocab, index.seeds))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seeds = shared.value
        total = np.zeros(len(seeds), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = words(text)
                ids = np.fromiter((vocab.get(w, 0) for w in tokens), np.uint64, len(tokens))
                keys = _keys(ids, SEED_WORDS)
                at = _hits(keys, seeds)
                if len(at):
                    total[np.searchsorted(seeds, np.unique(keys[at]))] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seeds[some].view(np.int64)), pa.array(total[some])], names=["seed", "n"])

    counted = docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    index.keep({r["seed"]: r["n"] for r in counted.collect()}, run_words)  # at most as many rows as the block has seeds
    kept = spark.sparkContext.broadcast(index)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = kept.value
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = index.numbers(text)
                keys = _keys(ids, SEED_WORDS)
                at = _hits(keys, index.seeds)
                if len(at):
                    rows += [(doc_id, *x) for x in _score(ids, at, keys, index)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "run_words", "score", "word_pos"])

    return docs.mapInArrow(find, "doc_id long, item_id long, run_words int, score double, word_pos int")


def p6_found(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    hits = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return hits.where("run_words >= 13").select("doc_id", "item_id")


def p6_leaks(spark, sf_dir: str) -> DataFrame:
    """Every tie whose alignment reaches half of a perfect match, edited copies included."""
    from ..session import table

    hits = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return hits.where("run_words >= 13 or score >= 0.5").select("doc_id", "item_id", "run_words", F.round("score", 6).alias("score"), "word_pos")
